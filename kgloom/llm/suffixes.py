"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier are removed.

The enhanced suffix array is sparse and distributed. Of the 69 grams of 32 bytes in each 100-byte window, the one of
least hash is the window's anchor; it depends on the window's content alone, so equal windows have equal anchors at
equal distances. A document's windows with one anchor are a segment: its bytes reach from the first such window to the
end of the last.
  1. Anchors whose gram is found once among all documents are dropped: their windows are unique.
  2. Segments of equal content: all but the earliest are covered whole, whatever their number.
  3. Where different segments share an anchor's gram, the earliest of each content comes to the suffix array of that
     anchor: suffixes sorted from the anchor on, with their common prefixes. A stack scan finds the intervals of the
     common-prefix tree; in each, the text before the anchor, sorted backwards, shows by a second scan where the left
     extensions differ. A pair of intervals that together share LENGTH bytes or more is a maximal repeat with all its
     occurrences; all but the earliest are covered.
An anchor with more than CROWD different segments (a common passage's edge) doesn't come into one task: its windows are
hashed and the earliest of each is found by sorting over the cluster.

Order is by doc_id, then place; documents with equal doc_id follow their place in the table, null doc_ids come last.
Texts never match across documents. Equality in step 2 and in crowds is that of 64-bit hashes that pair halves and are
linear in nothing.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH keep all; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import anchors, answered, blocked, column, found_of, joined, within
from .common import covered, doubled, eights, keep, mix, paired, runs, tidy

LENGTH, GRAM, CROWD = 100, 32, 4096

def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hashes of all byte strings of `gram` bytes: eight neighbouring bytes are a value of their own, longer ones are
    paired from halves."""
    if gram < 8:
        return doubled(mix(data.astype(np.uint64) + np.uint64(1)), gram)
    h, done = mix(eights(data)[: max(0, len(data) - 7)] ^ np.uint64(0x6A09E667F3BCC909)), 8
    while done < gram and len(h):
        shift = min(done, gram - done)
        h = paired(h[: max(0, len(h) - shift)], h[shift:])
        done += shift
    return h


def range_hashes(h: np.ndarray, gram: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hashes of the byte ranges [start, stop), of `gram` bytes or more each, from those of their grams: the ranges' lengths
    and, one after the other, grams that lie side by side, of which the last ends where the range does."""
    out = mix((stop - start).astype(np.uint64))
    for k in range(int((stop - start).max(initial=0) - 1) // gram + 1):
        some = np.flatnonzero(start + k * gram < stop)
        out[some] = paired(out[some], h[np.minimum(start[some] + k * gram, stop[some] - gram)])
    return out


class Segments:
    """The windows of a block's documents by anchor. Documents stand in order of doc_id (null last), then of place."""

    def __init__(self, rows: pa.ListArray, k: int, length: int = LENGTH):
        ids = column(rows, k, "doc_id")
        self.order = pa.compute.sort_indices(pa.table({"i": ids, "p": np.arange(len(ids))}), sort_keys=[("i", "ascending"), ("p", "ascending")], null_placement="at_end").to_numpy()
        self.ids = ids.take(pa.array(self.order))
        data = column(rows, k, "text").cast(pa.binary()).to_pylist()
        self.texts = [data[i] or b"" for i in self.order]
        self.length = length
        self.data = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        sizes = np.fromiter(map(len, self.texts), dtype=np.int64, count=len(self.texts))
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        gram = max(1, min(GRAM, length // 3))
        n = len(self.data) - length + 1
        if n <= 0:
            self.low = self.high = self.at = np.zeros(0, dtype=np.int64)
            self.gram = self.content = np.zeros(0, dtype=np.uint64)
            return
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        start = np.flatnonzero(owner[:n] == owner[length - 1 :])
        h = gram_hashes(self.data, gram)
        at = anchors(h, length - gram + 1)[start]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, dtype=np.int64)
        self.low, self.high, self.at = start[first], start[np.concatenate([first[1:], [len(at)]]) - 1] if len(at) else start[:0], at[first]
        self.gram = h[self.at]
        self.content = paired(range_hashes(h, gram, self.low, self.high + length), (self.at - self.low).astype(np.uint64))

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1


def _rows_of(x: Segments, some: np.ndarray, block: int) -> list[pa.Array]:
    """doc_id, block, seq, pos of segments."""
    d = x.document(x.low[some])
    return [x.ids.take(pa.array(d)), pa.array(np.full(len(some), block, dtype=np.int64)), pa.array(x.order[d].astype(np.int64)), pa.array(x.low[some] - x.begin[d])]


def _segments(blocks: DataFrame, length: int, kind: str) -> DataFrame:
    """(g, c, doc_id, block, seq, pos) of the segments whose gram is found elsewhere, the first of each content in a block."""

    @tidy
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                found = found_of(b, k)
                if not len(found):
                    continue
                x = Segments(b.column("rows"), k, length)
                some = np.flatnonzero(within(x.gram, found))
                some = some[np.unique(x.content[some], return_index=True)[1]]
                for i in range(0, len(some), 100_000):
                    s = some[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(x.gram[s].view(np.int64)), pa.array(x.content[s].view(np.int64)), *_rows_of(x, s, b.column("block")[k].as_py())], names=["g", "c", "doc_id", "block", "seq", "pos"])

    return blocks.mapInArrow(run, f"g bigint, c bigint, doc_id {kind}, block bigint, seq bigint, pos bigint")


def _order() -> list:
    return [F.col("doc_id").asc_nulls_last(), "block", "seq", "pos"]


def _owners(rows: DataFrame) -> DataFrame:
    """(block, copies, asked): contents of which an earlier copy exists, and first ones whose gram has other contents too.

    Rows come sorted by (g, c, order) and are streamed; of a group no more than one row waits for a decision."""

    def run(batches):
        held: list[tuple] = []  # answers, to be sent by block in large pieces
        g0, c0, seen, waiting = None, None, 0, None  # the last g and c, how many contents g had, its only first row
        for b in batches:
            if not b.num_rows:
                continue
            g, c, block = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new_g = np.concatenate([[g[0] != g0], g[1:] != g[:-1]])
            first = new_g | np.concatenate([[c[0] != c0], c[1:] != c[:-1]])
            group = np.cumsum(new_g) - int(new_g[0])
            went_on = seen if not new_g[0] else 0
            counts = np.bincount(group, weights=first).astype(np.int64)
            counts[0] += went_on
            asked = first & (counts[group] > 1)
            out_block, out_c, out_kind = [block[~first], block[asked]], [c[~first], c[asked]], [np.zeros((~first).sum(), dtype=bool), np.ones(asked.sum(), dtype=bool)]
            if waiting is not None and not new_g[0] and counts[0] > 1:
                out_block.append(np.array([waiting[0]]))
                out_c.append(np.array([waiting[1]]))
                out_kind.append(np.array([True]))
                waiting = None
            if counts[-1] > 1:
                waiting = None
            elif len(counts) > 1 or new_g[0]:
                last = int(np.flatnonzero(first)[-1])
                waiting = (block[last], c[last])
            g0, c0, seen = g[-1], c[-1], int(counts[-1])
            held.append((np.concatenate(out_block), np.concatenate(out_c), np.concatenate(out_kind)))
            if sum(len(x[0]) for x in held) >= 1 << 20:
                yield _blobs(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield _blobs(*map(np.concatenate, zip(*held, strict=True)))

    met = rows.repartition("g").sortWithinPartitions("g", "c", *_order()).select("g", "c", "block").mapInArrow(run, "block bigint, copies binary, asked binary")
    return met.groupBy("block").agg(F.collect_list("copies").alias("copies"), F.collect_list("asked").alias("asked"))


def _blobs(block: np.ndarray, c: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(block, kind="stable")
    block, c, asked = block[order], c[order], asked[order]
    names, first = np.unique(block, return_index=True)
    ends = [*first[1:], len(c)]
    cut = lambda m: [c[a:e][m[a:e]].astype("<i8").tobytes() for a, e in zip(first, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(cut(~asked), pa.binary()), pa.array(cut(asked), pa.binary())], names=["block", "copies", "asked"])


def _list(b: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(b.column(name)[k].as_py() or []), dtype="<u8"))


def _contexts(blocks: DataFrame, length: int, kind: str) -> DataFrame:
    """(g, c, doc_id, block, seq, pos, left, bytes) of the asked segments; left: bytes before the anchor."""

    @tidy
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                asked = _list(b, "asked", k)
                if not len(asked):
                    continue
                x = Segments(b.column("rows"), k, length)
                some = np.flatnonzero(within(x.content, asked))
                some = some[np.unique(x.content[some], return_index=True)[1]]
                for i in range(0, len(some), 20_000):
                    s = some[i : i + 20_000]
                    parts = [x.data[a:e].tobytes() for a, e in zip(x.low[s].tolist(), (x.high[s] + length).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x.gram[s].view(np.int64)), pa.array(x.content[s].view(np.int64)), *_rows_of(x, s, b.column("block")[k].as_py()), pa.array((x.at[s] - x.low[s]).astype(np.int32)), pa.array(parts, pa.binary())], names=["g", "c", "doc_id", "block", "seq", "pos", "left", "bytes"])

    return blocks.mapInArrow(run, f"g bigint, c bigint, doc_id {kind}, block bigint, seq bigint, pos bigint, left int, bytes binary")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of common prefixes of sorted neighbours (lcp[i]: of i and i + 1) -> (depth, first, last) of the inner nodes
    of the prefix tree, children before parents."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeats(rights: list[bytes], lefts: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): maximal repeats of at least `least` bytes around an anchor, with all their occurrences.

    rights: text from the anchor on; lefts: text before it, backwards. Members share `right` bytes on and `left` before."""
    by = sorted(range(len(rights)), key=rights.__getitem__)
    longest = max(map(len, lefts))
    for right, a, e in intervals([common_prefix(rights[x], rights[y]) for x, y in zip(by, by[1:], strict=False)]):
        if right + longest < least:
            continue
        inside = sorted(by[a : e + 1], key=lefts.__getitem__)
        for left, p, q in intervals([common_prefix(lefts[x], lefts[y]) for x, y in zip(inside, inside[1:], strict=False)]):
            if left + right >= least:
                yield left, right, inside[p : q + 1]


def _scanned(rows: DataFrame, length: int) -> DataFrame:
    """(block, c, a, e): bytes from a before the anchor to e after it that are covered, by the suffix array of each gram."""

    def run(batches):
        held: list[tuple] = []
        out: list[tuple] = []

        def scan(group):
            rights, lefts = [r[5][r[4] :] for r in group], [r[5][: r[4]][::-1] for r in group]
            best: dict[tuple[int, int], int] = {}
            for left, right, members in repeats(rights, lefts, length):
                first = min(members)
                for m in members:
                    if m != first:
                        best[m, right] = max(best.get((m, right), 0), left)
            out.extend((group[m][1], group[m][2], left, right) for (m, right), left in best.items())

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["block", "c", "a", "e"])

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if held and held[-1][0] != r[0]:
                    scan(held)
                    held = []
                held.append(r)
            if out:
                yield batch()
                out.clear()
        if held:
            scan(held)
        if out:
            yield batch()

    ordered = rows.repartition("g").sortWithinPartitions("g", *_order())
    return ordered.select("g", "block", "c", "pos", "left", "bytes").mapInArrow(run, "block bigint, c bigint, a int, e int")


def _crowded(rows: DataFrame, length: int, kind: str) -> DataFrame:
    """The same by sorting all windows of the contexts over the cluster."""

    def windows(batches):
        for b in batches:
            data, left = b.column("bytes").to_pylist(), b.column("left").to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
            begin = np.cumsum(size) - size
            many = size - length + 1
            who = np.repeat(np.arange(len(data)), many)
            off = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            gram = max(1, min(GRAM, length // 3))
            start = begin[who] + off
            w = paired(range_hashes(gram_hashes(np.frombuffer(b"".join(data), dtype=np.uint8), gram), gram, start, start + length), (left[who] - off).astype(np.uint64))
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), *(b.column(c).take(at) for c in ("doc_id", "block", "seq")), pa.array(b.column("pos").to_numpy(zero_copy_only=False)[who] + off), b.column("c").take(at), pa.array((left[who] - off).astype(np.int32))], names=["w", "doc_id", "block", "seq", "pos", "c", "a"])

    def later(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            w = b.column("w").to_numpy(zero_copy_only=False)
            again = np.concatenate([[w[0] == last], w[1:] == w[:-1]])
            last = w[-1]
            kept = b.filter(pa.array(again))
            a = kept.column("a").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([kept.column("block"), kept.column("c"), kept.column("a"), pa.array((length - a).astype(np.int32))], names=["block", "c", "a", "e"])

    all_ = rows.mapInArrow(windows, f"w bigint, doc_id {kind}, block bigint, seq bigint, pos bigint, c bigint, a int")
    ordered = all_.repartition("w").sortWithinPartitions("w", *_order())
    return ordered.select("w", "block", "c", "a").mapInArrow(later, "block bigint, c bigint, a int, e int")


def _judged(docs: DataFrame, length: int, crowd: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = blocked(docs)

    @tidy
    def grams(batches):
        for b in batches:
            for k in range(b.num_rows):
                h, n = np.unique(Segments(b.column("rows"), k, length).gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), b.column("block")[k].as_py(), dtype=np.int64)), pa.array(n > 1)], names=["h", "block", "many"])

    one = answered(blocks.mapInArrow(grams, "h bigint, block bigint, many boolean"))
    two = keep(_owners(_segments(joined(blocks, one), length, kind)))
    contexts = keep(_contexts(joined(blocks, two), length, kind))
    sizes = contexts.groupBy("g").count()
    crowds = sizes.where(F.col("count") > crowd).select("g")
    spans = _scanned(contexts.join(crowds, "g", "left_anti"), length).unionByName(_crowded(contexts.join(crowds, "g", "left_semi"), length, kind))
    answers = spans.groupBy("block").agg(F.collect_list(F.struct("c", "a", "e")).alias("spans"))
    return joined(blocks, two.select("block", "copies").join(answers, "block", "full"))


def removed(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges that are removed)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = Segments(b.column("rows"), k, length)
                _, first, again = np.unique(x.content, return_index=True, return_inverse=True)
                whole = within(x.content, _list(b, "copies", k)) | (first[again] != np.arange(len(again)))
                low, high = [x.low[whole]], [x.high[whole] + length]
                if b.column("spans")[k].is_valid:
                    s = b.column("spans")[k].values
                    c, a, e = (s.field(n).to_numpy(zero_copy_only=False) for n in ("c", "a", "e"))
                    by = np.argsort(x.content[first])
                    at = x.at[first[by[np.searchsorted(x.content[first], c.view(np.uint64), sorter=by)]]] if len(first) else c
                    low.append(at - a)
                    high.append(at + e)
                mask = covered(len(x.data), np.concatenate(low), np.concatenate(high))
                gone, n_spans, shas, spans = [], [], [], []
                for d, t in enumerate(x.texts):
                    m = mask[x.begin[d] : x.begin[d + 1]]
                    starts, stops = runs(m)
                    gone.append(int(m.sum()))
                    n_spans.append(len(starts))
                    spans.append([{"start": p, "stop": q} for p, q in zip(starts.tolist(), stops.tolist(), strict=True)])
                    shas.append(hashlib.sha256(x.data[x.begin[d] : x.begin[d + 1]][~m].tobytes() if len(starts) else t).hexdigest())
                yield pa.RecordBatch.from_arrays([x.ids, pa.array([len(t) for t in x.texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, ranges)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"
    return _judged(docs.select("doc_id", "text"), length, crowd).mapInArrow(run, f"doc_id {kind}, {out}")
