"""SimHash near-duplicates, found through pivot distance tables.

Fingerprint: a text's words (A-Z lower-cased) give shingles of `shingle` words, repeats included; each shingle's
XXH64 (seed 42) votes for its bits, and a bit is 1 if over half of the shingles have it. Fingerprints link when at
most two bits differ; a component's id is the smallest doc_id in it.

Pivot tables: the 64 bits fall into four segments of 16. Each segment has PIVOTS reference fingerprints, and a
precomputed table gives a segment's Hamming distances to all of them. Two fingerprints that differ in two bits agree
in at least two segments, so their distance vectors agree there: an equi-join on the distance vectors of two segments
(six pairs of segments) meets every linked pair. Pairs that meet are discarded if any coordinate of the whole table
differs by more than two, and the survivors are verified by their own Hamming distance. The tables are 4 x 65,536
values, whatever the input.

Only distinct fingerprints are joined: copies of one fingerprint, however many, are one row. A bucket of more than
HOT fingerprints is split by further pivots: the 32 bits in which its fingerprints may differ fall into four segments of 8 with
tables of their own, of which two agree again, and in the same way the 16 bits that are left then into four of 4. What meets after that agrees in
56 bits: such a bucket has a few hundred fingerprints at most, whatever the input. So the pivot tables are the way at any size, no bucket
is capped, none is compared that could be large, and no list of links leaves the executors.

Defined results: null and empty texts have fingerprint zero and link with each other; a null doc_id takes part, and
is a component's id only where nothing else is in it; repeated rows are all returned; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import LOWER, MADE, SPACE, Words, doubled, each, keep, mix, shared_dir, texts_of, tidy, tune, unused, written

SHINGLE, RADIUS, SEGMENTS, BITS, PIVOTS, HOT = 3, 2, 4, 16, 12, 64
#: The pairs of segments, of which one agrees.
PAIRS = [(a, b) for a in range(SEGMENTS) for b in range(a)]
_LANES = np.uint64(0x0001_0001_0001_0001)


def _shingle_hashes(text: bytes, k: int) -> bytes:
    w = text.translate(LOWER).split()
    if not w:
        return b""
    line = b" ".join(w)
    if len(w) <= k:
        return xxhash.xxh64_digest(line, 42)
    stops = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate([[0], stops[: len(w) - k] + 1]).tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[a:b], 42) for a, b in zip(starts, stops[k - 1 :].tolist(), strict=True)])


def _majority(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each run h[first:first+count], the bits that over half of its values have; no values give zero."""
    out = np.zeros(len(first), dtype=np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    # A lane of 16 bits counts up to 65,535 values, so longer runs are summed in pieces.
    step = 60_000
    cuts = [np.arange(a, a + n, step) for a, n in zip(first[full].tolist(), count[full].tolist(), strict=True)]
    owner = np.repeat(np.arange(len(full)), [len(c) for c in cuts])
    cuts = np.concatenate(cuts)
    fp = np.zeros(len(full), dtype=np.uint64)
    for j in range(16):
        sums = np.add.reduceat((h >> np.uint64(j)) & _LANES, cuts)
        for lane in range(4):
            n = np.zeros(len(full), dtype=np.int64)
            np.add.at(n, owner, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
            fp |= (2 * n > count[full]).astype(np.uint64) << np.uint64(16 * lane + j)
    out[full] = fp
    return out


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    parts = [_shingle_hashes(t, shingle) for t in texts]
    count = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 8
    return _majority(np.frombuffer(b"".join(parts), dtype=">u8").astype(np.uint64), np.cumsum(count) - count, count)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each(batches, lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(texts_of(b), shingle).view(np.int64))], names=["doc_id", "fp"]))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


class PivotTables:
    """Distances of each possible segment to its reference fingerprints: one byte per reference, packed as 5 bits in a key. There are tables for
    segments of 16, 8 and 4 bits, four of each."""

    def __init__(self, pivots: int = PIVOTS, seed: int = 5):
        self.distance, self.packed = {}, {}
        for bits in (BITS, BITS // 2, BITS // 4):
            values = np.arange(1 << bits, dtype=np.uint64)
            refs = np.random.default_rng(seed).integers(0, 1 << bits, (SEGMENTS, pivots), dtype=np.uint64)
            self.distance[bits] = np.bitwise_count(values[None, :, None] ^ refs[:, None, :]).astype(np.int8)
            packed = np.zeros((SEGMENTS, 1 << bits), dtype=np.uint64)
            for p in range(pivots):
                packed |= self.distance[bits][:, :, p].astype(np.uint64) << np.uint64(5 * p)
            self.packed[bits] = packed

    @staticmethod
    def segments(values: np.ndarray, bits: int = BITS) -> np.ndarray:
        return np.stack([((values >> np.uint64(bits * s)) & np.uint64((1 << bits) - 1)).astype(np.int64) for s in range(SEGMENTS)])

    def keys(self, values: np.ndarray, bits: int = BITS) -> np.ndarray:
        """Six keys for each value of four segments: the distance vectors of two segments."""
        seg = self.segments(values, bits)
        vec = [mix(self.packed[bits][s][seg[s]] + np.uint64(s + 1)) for s in range(SEGMENTS)]
        return np.stack([mix(vec[a] * np.uint64(3) + vec[b] + np.uint64(k)) for k, (a, b) in enumerate(PAIRS)], axis=1)

    def coordinates(self, fp: np.ndarray) -> np.ndarray:
        seg = self.segments(fp)
        return np.concatenate([self.distance[BITS][s][seg[s]] for s in range(SEGMENTS)], axis=1)


def _open(values: np.ndarray, pair: np.ndarray, bits: int) -> np.ndarray:
    """The bits of the two segments that don't belong to the pair of this number, as one value each."""
    seg = PivotTables.segments(values, bits).astype(np.uint64)
    rest = np.array([[s for s in range(SEGMENTS) if s not in p] for p in PAIRS])[pair]
    at = np.arange(len(values))
    return seg[rest[:, 0], at] | seg[rest[:, 1], at] << np.uint64(bits)


_TABLES: list[PivotTables] = []


def tables() -> PivotTables:
    if not _TABLES:
        _TABLES.append(PivotTables())
    return _TABLES[0]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of n places over links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (before == root).all():
            break
    return root


def _bucket_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key -> links within keys, as stars around the first row of each linked group."""
    t, a, b = tables().coordinates(fp), [], []
    for shift in range(1, len(key)):
        at = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(at):
            break
        at = at[(np.abs(t[at].astype(np.int16) - t[at + shift]) <= radius).all(axis=1)]
        at = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= radius]
        a.append(at)
        b.append(at + shift)
    if not a:
        return fp[:0], fp[:0]
    root = _roots(len(key), np.concatenate(a), np.concatenate(b))
    at = np.flatnonzero(root != np.arange(len(key)))
    return fp[at], fp[root[at]]


def links(distinct: DataFrame, hot: int = HOT, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of all pairs within two bits."""
    if radius > SEGMENTS - 2:
        raise ValueError("with four segments, two of them agree only up to two differing bits")

    def keyed(batches):
        def make(b):
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            k = tables().keys(fp)
            return pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, len(PAIRS)).view(np.int64)), pa.array(np.tile(np.arange(len(PAIRS), dtype=np.int32), len(fp)))], names=["key", "fp", "way"])

        return each(batches, make)

    def further(level):
        """Rows of crowded buckets -> six rows each, by pivots of the bits that are open. `way` has the pairs that agree so far."""

        def run(batches):
            def make(b):
                key, fp = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fp"))
                way = b.column("way").to_numpy(zero_copy_only=False)
                bits = BITS
                value = fp
                for step in range(level):
                    value = _open(value, way // len(PAIRS) ** (level - 1 - step) % len(PAIRS), bits)
                    bits //= 2
                k = mix(tables().keys(value, bits) * np.uint64(5) + key[:, None])
                new = way[:, None] * len(PAIRS) + np.arange(len(PAIRS), dtype=np.int32)
                return pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, len(PAIRS)).view(np.int64)), pa.array(new.reshape(-1).astype(np.int32))], names=["key", "fp", "way"])

            return each(batches, make)

        return run

    def compared(batches):
        key, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def out(k, f):
            a, b = _bucket_links(k, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for x in batches:
            key = np.concatenate([key, x.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, x.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(key) and (at := int(np.searchsorted(key, key[-1]))):  # the last bucket may go on
                yield out(key[:at], fp[:at])
                key, fp = key[at:], fp[at:]
        if len(key):
            yield out(key, fp)

    rows = distinct.select("fp").mapInArrow(keyed, "key bigint, fp bigint, way int")
    near = None
    for level in range(3):
        sizes = rows.groupBy("key").count().where("count > 1")
        met = rows.join(sizes, "key")
        last = level == 2
        cold = met if last else met.where(F.col("count") <= hot)
        some = cold.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(compared, "a bigint, b bigint")
        near = some if near is None else near.unionByName(some)
        if last:
            break
        crowd = keep(met.where(F.col("count") > hot).select("key", "fp", "way"))
        if not crowd.limit(1).count():
            break
        rows = crowd.mapInArrow(further(level + 1), "key bigint, fp bigint, way int")
    return near


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id reachable over links of two differing bits or fewer)."""
    fps = keep(fingerprints(docs, shingle))
    least = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(least))
    by_fp = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(by_fp.select("fp", "root").join(of_root, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# --- Near-duplicates by exact Jaccard similarity ------------------------------------------------------------------------

#: Least texts whose shingles are counted for the order of shingles, as a share of all texts and a number, and the most
#: shingles that get a count; rows of a block, and of a bucket whose pairs are made at once; rounds of links; most rows that are broadcast.
ORDER_SHARE, ORDER_TEXTS, ORDER_MOST, BLOCK, SMALL, LINKING_ROUNDS, SENT = 1 / 32, 10_000, 500_000, 512, 8, 2, 500_000
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: References of the pivot table, a power of two; rows that are looked at together.
REFERENCES, TOGETHER = 256, 1 << 17


def _sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, ascending; a text of fewer words is one shingle."""
    w = Words(texts, SPACE, lower=True)
    h = doubled(w.hash, shingle)
    whole = lambda a, n: np.unique(h[a : a + n - shingle + 1]) if n >= shingle else doubled(w.hash[a : a + n], max(1, n))
    return [whole(a, n) for a, n in zip(w.first.tolist(), w.count.tolist(), strict=False)]


def _common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several of a share of the texts, ascending, with their counts. They decide the order in which
    prefixes are taken, so what is not counted costs time, never a pair."""

    def run(batches):
        return each(batches, lambda b: pa.RecordBatch.from_arrays([pa.array(np.concatenate(_sets(texts_of(b), shingle)).view(np.int64))], names=["h"]))

    share = min(1.0, max(ORDER_SHARE, ORDER_TEXTS / max(1, texts.count())))
    some = texts.where(F.pmod("text_hash", F.lit(1 << 30)) <= int(share * (1 << 30)))
    counts = some.dropDuplicates(["text_hash"]).select("text").mapInArrow(run, "h bigint").groupBy("h").count().where("count > 1")
    found = counts.orderBy(F.desc("count"), "h").limit(ORDER_MOST).toArrow()
    h, n = (found.column(k).to_numpy() for k in ("h", "count"))
    h = h.view(np.uint64)
    at = np.argsort(h)
    return h[at], n[at]


def _prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set, rarest first, so many that two sets of this similarity or more have one of them in common."""
    n = len(shingles)
    if not n:
        return shingles
    rank = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def _coordinates(shingles: np.ndarray) -> bytes:
    """A row of the pivot table: a set as a fingerprint with a place for each possible shingle has, to the reference with the
    places of which the hash begins with the bits of k, the Hamming distance |set| + |reference| - 2 * count k. Counts go up to 255."""
    return np.minimum(np.bincount((shingles >> np.uint64(64 - REFERENCES.bit_length() + 1)).astype(np.int64), minlength=REFERENCES), 255).astype(np.uint8).tobytes()


def _near_enough(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows of the pivot table, of sets of n and m shingles, may have this similarity.

    By the triangle inequality two sets' distances to a reference differ by no more than the sets' own distance, which is
    (n + m) * (1 - similarity) / (1 + similarity) at most. Unions of references are references too, and over all of these the greatest difference
    of the coordinates is the sum of the differences of the counts. So no pair of this similarity is discarded."""
    apart = np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(axis=1, dtype=np.int64)
    return apart <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def _places_allow(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles, of which the first one in common stands at places i and j of their orders, may have
    this similarity: what they share stands at or after these places."""
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (np.minimum(n - i, m - j) >= similarity / (1 + similarity) * (n + m) - 1e-9)


def _by_id(frame: DataFrame) -> DataFrame:
    """A table of the shared folder, dealt by id, so that joins on id don't move it again."""
    spark = frame.sparkSession
    name = f"kgloom_sets_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    MADE.append((path, name))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(count, "id").saveAsTable(name)
    return spark.table(name)


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, prefix) -> (key, id, at): each shingle of a prefix, with n and its place in the set's order in one value. A task emits
    a set once, so that the rows of a key grow with its different sets and the number of tasks, not with copies."""
    seen: set[int] = set()
    for b in batches:
        new = [k for k, i in enumerate(b.column(0).to_pylist()) if i not in seen and not seen.add(i)]
        b = b.take(pa.array(new, pa.int64()))
        if not b.num_rows:
            continue
        parts = [np.frombuffer(x, dtype="<i8") for x in b.column(2).to_pylist()]
        size = np.array([len(x) for x in parts])
        owner = np.repeat(np.arange(len(parts)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        n = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), b.column(0).take(pa.array(owner)), pa.array(n[owner] << 32 | place)], names=["key", "id", "at"])


def _together(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of so many rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def _meetings(similarity: float, small: int) -> Callable:
    """Rows (key, id, at) sorted by key and id -> (key, a, at, b): the pairs (a, b) of buckets of up to `small` sets whose places allow
    the similarity, without key and at, and the rows (key, a, at) of greater buckets, without b. Of a key no more than `small` + 1 rows
    are held between the pieces that are looked at together."""
    names = ["key", "a", "at", "b"]

    def run(batches):
        key, ids, at, greater = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None

        def out(k, i, v):
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            n = np.diff(np.append(first, len(k)))
            big = np.repeat((n > small) | (np.zeros(len(first), dtype=bool) if greater is None else k[first] == greater), n)
            if big.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[big]), pa.array(i[big]), pa.array(v[big]), pa.nulls(int(big.sum()), pa.int64())], names=names)
            k, i, v = k[~big], i[~big], v[~big]
            n, place = v >> 32, v & 0xFFFFFFFF
            found = []
            for shift in range(1, small):
                x = np.flatnonzero(k[shift:] == k[:-shift])
                if not len(x):
                    break
                x = x[_places_allow(n[x], place[x], n[x + shift], place[x + shift], similarity)]
                found.append((i[x], i[x + shift]))
            if found:
                a, b = (np.concatenate(f) for f in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(b)], names=names)

        for parts in _together(batches):
            key, ids, at = (np.concatenate([x, *(b.column(c).to_numpy(zero_copy_only=False) for b in parts)]) for c, x in enumerate((key, ids, at)))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]) if len(key) else np.zeros(0, dtype=bool)
            key, ids, at = key[new], ids[new], at[new]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if len(key) - last > small:
                yield from out(key, ids, at)
                greater, key, ids, at = key[-1], key[:0], ids[:0], at[:0]
            elif last:
                yield from out(key[:last], ids[:last], at[:last])
                key, ids, at = key[last:], ids[last:], at[last:]
        if len(key):
            yield from out(key, ids, at)

    return tidy(run)


def _columns_of(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """Rows of buckets as arrays: id, n, place, root, and their rows of the pivot table."""
    of = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts])
    at = of("at")
    table = np.frombuffer(b"".join(x for b in parts for x in b.column("coordinates").to_pylist()), dtype=np.uint8).reshape(-1, REFERENCES)
    return {"id": of("id"), "root": of("root"), "n": at >> 32, "place": at & 0xFFFFFFFF, "table": table}


def _survivors(x: dict, y: dict, similarity: float, above: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of rows of x and y whose roots differ, whose places allow the similarity and that the pivot table doesn't
    discard, with the greatest coordinate difference over the sizes; `above`: only pairs i < j of one block."""
    found = []
    for begin in range(0, len(y["id"]), 256):
        z = {k: v[begin : begin + 256] for k, v in y.items()}
        ok = (x["root"][:, None] != z["root"]) & _places_allow(x["n"][:, None], x["place"][:, None], z["n"], z["place"], similarity)
        if above:
            ok &= np.arange(len(x["id"]))[:, None] < np.arange(begin, begin + len(z["id"]))
        i, j = np.nonzero(ok)
        for k in range(0, len(i), 8192):
            p, q = i[k : k + 8192], j[k : k + 8192]
            apart = np.abs(x["table"][p].astype(np.int16) - z["table"][q]).sum(axis=1, dtype=np.int64)
            both = x["n"][p] + z["n"][q]
            near = apart <= both * (1 - similarity) / (1 + similarity) + 1e-6
            found.append((p[near], q[near] + begin, (apart / both)[near]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    i, j, apart = (np.concatenate(c) for c in zip(*found, strict=True))
    return i, j, apart


def _forest(root: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) make a spanning forest of the rows' roots, the nearest pairs first: in each round every tree takes its
    nearest pair to another tree."""
    tree = np.unique(root, return_inverse=True)[1]
    order = np.argsort(apart, kind="stable")
    taken = []
    while len(order):
        a, b = tree[i[order]], tree[j[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        if not len(order):
            break
        chosen = np.unique(np.unique(np.stack([a, b], axis=1).ravel(), return_index=True)[1] // 2)
        taken.append(order[chosen])
        tree = _roots(len(tree), a[chosen], b[chosen])[tree]
    return np.concatenate(taken) if taken else order


def _by_block(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Rows that are sorted by some columns as runs of equal values of these: (values, batches of the run)."""
    left: list[pa.RecordBatch] = []
    source = iter(batches)

    def piece():
        """The next batch's first run: (values, rows, whether the run may go on)."""
        if not left:
            b = next(source, None)
            while b is not None and not b.num_rows:
                b = next(source, None)
            if b is None:
                return None
            left.append(b)
        b = left.pop()
        at = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        other = np.flatnonzero(np.any([c != c[0] for c in at], axis=0))
        end = int(other[0]) if len(other) else b.num_rows
        if end < b.num_rows:
            left.append(b.slice(end))
        return tuple(c[0] for c in at), b.slice(0, end)

    now = piece()
    while now is not None:
        value, held = now[0], [now]

        def run(value=value, held=held):
            while held:
                yield held.pop()[1]
                more = piece()
                if more is not None and more[0] == value:
                    held.append(more)
                else:
                    rest.append(more)
                    return

        rest: list = []
        yield value, run()
        now = rest[0] if rest else piece()


def _nearest_pairs(similarity: float) -> Callable:
    """Rows (key, part, id, at, root, coordinates) by key and part -> (a, b): a spanning forest of the block's roots, of pairs that the pivot
    table leaves."""

    def run(batches):
        for _, rows in _by_block(batches, ["key", "part"]):
            x = _columns_of(list(rows))
            i, j, apart = _survivors(x, x, similarity, above=True)
            at = _forest(x["root"], i, j, apart)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(x["id"][i[at]]), pa.array(x["id"][j[at]])], names=["a", "b"])

    return tidy(run)


def _all_pairs(similarity: float) -> Callable:
    """Rows (key, i, j, side, id, at, root, coordinates) by key, i, j and side -> (a, b): the pairs of a left row (side 0) and a right one that
    the pivot table leaves. The left rows of a block are held; the right ones pass by."""

    def run(batches):
        held = at = None
        for value, rows in _by_block(batches, ["key", "i", "j", "side"]):
            if value[-1] == 0:
                held, at = _columns_of(list(rows)), value[:-1]
            elif at == value[:-1]:
                for b in rows:
                    y = _columns_of([b])
                    i, j, _ = _survivors(held, y, similarity)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(held["id"][i]), pa.array(y["id"][j])], names=["a", "b"])
            for _ in rows:
                pass

    return tidy(run)


def jaccard_links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, rounds: int = LINKING_ROUNDS) -> DataFrame:
    """nodes (id, n, prefix, coordinates), rows of sets (copies of a set are equal), and texts, which gives a row (id, text) or more of
    each id (id) it is called with -> links (a, b) whose components are those of all pairs of Jaccard similarity `similarity` or more.

    Two such sets have a shingle of their prefixes in common, so buckets of prefix shingles meet every pair, and the place of
    their first common shingle allows the similarity. Pairs that meet are discarded by the pivot table, and the sets themselves decide on the
    survivors. Of small buckets all pairs are tried. In greater ones a set first takes part in the largest of its buckets that isn't linked, with
    its row of the pivot table: of the pairs that the table leaves in a block of a bucket, those of a spanning forest, nearest first, are tried. Then
    the rows of every bucket that aren't linked to its largest component go by all of its rows, block against block, in tasks that hand on only the
    pairs that the table leaves; these are all tried. Pairs that links connect already need no trial: they can't change a component. So
    no pair is left out, and neither joins nor tables grow with the pairs of a group."""
    t = similarity

    def near(batches):
        def make(b):
            table = [np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, REFERENCES) for c in ("xc", "yc")]
            n, m = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("xn", "yn"))
            return b.select(["a", "b"]).filter(pa.array(_near_enough(*table, n, m, t)))

        return each(batches, make)

    def set_of(batches):
        def make(b):
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<u8").tobytes() for x in _sets(texts_of(b), shingle)], pa.binary())], names=["id", "members"])

        return each(batches, make)

    def verified(batches):
        def make(b):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= t * (len(x) + len(y) - both) - 1e-9)
            return b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return each(batches, make)

    rows = nodes.select("id", "n", "prefix").mapInArrow(_emitted, "key bigint, id bigint, at bigint")
    met = written(rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_meetings(t, min(SMALL, block)), "key bigint, a bigint, at bigint, b bigint"))
    ids = met.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    table = _by_id(nodes.select("id", "n", "coordinates").join(ids, "id", "left_semi").groupBy("id").agg(F.first("n").alias("n"), F.min("coordinates").alias("coordinates")))

    def tried(pairs):
        row = lambda name, n, c: table.select(F.col("id").alias(name), F.col("n").alias(n), F.col("coordinates").alias(c))
        survivors = keep(pairs.join(row("a", "xn", "xc"), "a").join(row("b", "yn", "yc"), "b").select("a", "b", "xn", "yn", "xc", "yc").mapInArrow(near, "a bigint, b bigint"))
        wanted = keep(survivors.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        sets = _by_id(texts(wanted).groupBy("id").agg(F.first("text").alias("text")).mapInArrow(set_of, "id bigint, members binary"))
        of = lambda name: sets.select(F.col("id").alias(name), F.col("members").alias(f"set_{name}"))
        return keep(survivors.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(verified, "a bigint, b bigint"))

    def rooted(rows, links):
        """The rows of buckets that have rows of several components."""
        now = rows.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        split = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return keep(now.join(split, "key"))

    def with_coordinates(rows):
        return rows.join(table.select("id", "coordinates"), "id")

    links = tried(met.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    great = met.where("b is null").select("key", F.col("a").alias("id"), "at")
    if not great.limit(1).count():
        return links
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    now = rooted(great, links)
    for k in range(rounds):
        if not now.limit(1).count():
            return links
        size = now.groupBy("key").agg(F.count("*").alias("size"))
        one = now.join(size, "key").groupBy("id").agg(F.max(F.struct("size", "key"))["key"].alias("key"))
        chosen = now.join(one, ["id", "key"], "left_semi")
        count = chosen.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks"))
        dealt = with_coordinates(chosen.join(count, "key").withColumn("part", F.pmod(F.xxhash64("id", F.lit(100 + k)), F.col("blocks"))))
        dealt = dealt.select("key", "part", "id", "at", "root", "coordinates").repartition("key", "part").sortWithinPartitions("key", "part")
        links = links.unionByName(tried(dealt.mapInArrow(_nearest_pairs(t), "a bigint, b bigint").select(*pair).distinct()))
        now = rooted(great, links)

    # All that is left: in each bucket the rows outside its largest component against all of its rows.
    of_root = now.groupBy("key", "root").agg(F.count("*").alias("c"))
    of_key = of_root.groupBy("key").agg(F.sum("c").alias("c"), F.max(F.struct("c", "root")).alias("m"))
    plan = of_key.select("key", F.col("m.root").alias("large"), F.ceil((F.col("c") - F.col("m.c")) / block).alias("left_blocks"), F.ceil(F.col("c") / block).alias("right_blocks"))
    planned = written(with_coordinates(now.join(plan, "key")))
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    place = lambda salt, c: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(c))
    left = planned.where("root <> large").withColumn("i", place(200, "left_blocks")).withColumn("j", spread("right_blocks")).withColumn("side", F.lit(0))
    right = planned.withColumn("j", place(201, "right_blocks")).withColumn("i", spread("left_blocks")).withColumn("side", F.lit(1))
    columns = ["key", "i", "j", "side", "id", "at", "root", "coordinates"]
    blocks = left.select(*columns).unionByName(right.select(*columns)).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return links.unionByName(tried(blocks.mapInArrow(_all_pairs(t), "a bigint, b bigint").select(*pair).distinct()))


def first_of_each(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near-duplicates: of each group, linked by the exact Jaccard similarity of their sets of shingles or
    by the rule of `near_duplicates`, the one of smallest doc_id stays, with all its columns.

    Repeated rows are duplicates of each other; null doc_ids stay only where their group has no other."""
    spark = tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    of_text = F.xxhash64(F.lit(8), F.coalesce("text", F.lit("")))
    hashed = docs.select("doc_id", "text", of_text.alias("text_hash"))
    shared = spark.sparkContext.broadcast(_common_shingles(hashed, shingle))
    columns = {"doc_id": kind, "id": "bigint", "n": "int", "prefix": "binary", "coordinates": "binary", "fp": "bigint", "text_hash": "bigint"}

    @tidy
    def prints(batches):
        def make(b):
            texts = texts_of(b)
            sets = _sets(texts, shingle)
            id_ = pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets], pa.int64())
            prefix = pa.array([_prefix(x, *shared.value, similarity).astype("<u8").tobytes() for x in sets], pa.binary())
            table = pa.array([_coordinates(x) for x in sets], pa.binary())
            return pa.RecordBatch.from_arrays([b.column(0), id_, pa.array([len(x) for x in sets], pa.int32()), prefix, table, pa.array(fingerprints_of(texts).view(np.int64)), b.column(2)], names=[*columns])

        yield from each(batches, make)

    # One row a document: its narrow fingerprint, and the hash of its set of shingles as a node.
    all_ = written(hashed.mapInArrow(prints, ", ".join(f"{c} {k}" for c, k in columns.items())))

    def texts(wanted):
        at = all_.select("id", "doc_id", "text_hash").join(wanted, "id").groupBy("id").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"))
        at = at.select("id", F.col("m.doc_id").alias("at"), F.col("m.text_hash").alias("hash"))
        at = F.broadcast(at) if wanted.count() <= SENT else at  # texts of few sets needn't be moved
        return hashed.join(at, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("text_hash") == F.col("hash"))).select("id", "text")

    fps = keep(all_.groupBy("fp").agg(F.min("id").alias("id")))
    by_fp = all_.select("fp", F.col("id").alias("a")).distinct().join(fps.withColumnRenamed("id", "b"), "fp").select("a", "b")
    ids = fps.withColumnRenamed("id", "n")
    near = links(fps).join(ids.withColumnRenamed("fp", "a").withColumnRenamed("n", "na"), "a").join(ids.withColumnRenamed("fp", "b").withColumnRenamed("n", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    edges = jaccard_links(all_, texts, shingle, similarity).unionByName(by_fp).unionByName(near)
    roots = components(edges)
    member = all_.select("doc_id", "id", "text_hash").join(roots.withColumnRenamed("node", "id"), "id", "left").select("doc_id", "text_hash", F.coalesce("root", "id").alias("root"))
    # A third of all rows may be one group: its first is found by a combined minimum, nulls last.
    first = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("m"))
    others = member.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("text_hash") == F.col("m.text_hash"))))
    names = [unused(docs, "id"), unused(docs, "hash")]
    gone = keep(others.select("doc_id", "text_hash").distinct().toDF(*names))
    gone = F.broadcast(gone) if gone.count() <= SENT else gone  # texts aren't moved for few rows
    met = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(names[0])) & (of_text == F.col(names[1])), "left_anti")
    # Rows that repeat both doc_id and text are one document.
    return met if not _repeated(all_) else met.dropDuplicates(["doc_id", "text"])


def _repeated(rows: DataFrame) -> bool:
    return rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0
