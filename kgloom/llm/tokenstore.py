"""Token ids in a content-addressed store: unique chunks once, recipes by document, Merkle roots over both.

Every text is encoded with the tokenizers library and ends with an end id. A rolling hash over the last WINDOW ids cuts
the stream of a document where the hash's low bits are zero, so equal passages fall into equal chunks wherever they
stand; a chunk's address is the SHA-256 of its bytes (little-endian ids, 16 bits wide if the vocabulary allows).

Files (Parquet tables with binary columns, under one folder):
  chunks    address, data            each unique chunk once
  recipes   part, pos, doc_id, start, n_tokens, root, chunks (addresses in order)   in ascending doc_id order
  manifest  part, n_docs, n_tokens, root     the Merkle root over the documents' roots of a part
`start` counts the ids of all documents before. A document's root is the Merkle root of its chunks' addresses.

Reading back takes both tables: each chunk is held against its address, each document's root and each part's root are
computed again, and a mismatch raises. `read_digests` needs no ids of a document in one place: it checks each chunk
once, takes its CRC-32 and length, and combines these along the recipes. `read_ids` returns whole id lists.

Defined results: null and empty texts have the end id alone. Documents with equal or null doc_id are kept as they are,
one after the other (null first). Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Pieces, Vocabulary, read_file
from .common import Rolling, each, mix, shared_dir, texts_of, tune, written

END, WINDOW, LEAST, MEAN_BITS, MOST = 0, 16, 256, 10, 8192


class LibraryPieces:
    """The tokenizers library on pre-tokens that are not in the cache. Many go through it end to end in one text, where its
    pre-tokenizer is bound to cut at the same places: those of a space and letters as they are, others without inner
    white space with a line break, which is a pre-token and an id of its own, between them."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        v = Vocabulary(source)
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.opens = np.array([t[:1] == b" " for t in v.token])
        self.line = v.ids[b"\n"]
        self.wide = v.size > 1 << 16
        self.pieces = Pieces(v.special, self.many)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def many(self, new: list[str]) -> list[bytes]:
        kinds: tuple[list[int], ...] = ([], [], [])
        for k, p in enumerate(new):
            word = p[1:] if p[:1] == " " else p
            kinds[0 if word is not p and word.isalpha() else 1 if word and not any(map(str.isspace, word)) else 2].append(k)
        out: list[bytes] = [b""] * len(new)
        for some, glue in ((kinds[0], ""), (kinds[1], "\n")):
            ids = self._ids(glue.join([new[k] for k in some]))
            data = ids.tobytes()
            if glue:
                marks = np.flatnonzero(ids == self.line)
                begins, ends = [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)]
            else:
                begins = np.flatnonzero(self.opens[ids]).tolist()
                ends = [*begins[1:], len(ids)]
            if some and len(begins) != len(some):
                kinds[2].extend(some)
                continue
            for k, a, e in zip(some, begins, ends, strict=False):
                out[k] = data[4 * a : 4 * e]
        for k, e in zip(kinds[2], self.library.encode_batch_fast([new[k] for k in kinds[2]], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, dtype="<u4").tobytes()
        return out


_LIBRARY: dict[str, LibraryPieces] = {}


def library(source: str) -> LibraryPieces:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _LIBRARY:
        _LIBRARY[key] = LibraryPieces(source)
    return _LIBRARY[key]


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Places before which the last WINDOW ids have a hash with low bits of zero."""
    marks = Rolling(mix(ids.astype(np.uint64) + np.uint64(1))).every(WINDOW)
    return np.flatnonzero((marks & np.uint64((1 << MEAN_BITS) - 1)) == 0) + WINDOW


def cuts(n: int, marks: list[int]) -> list[int]:
    """Where the chunks of n ids end: at marks, with LEAST to MOST ids in a chunk (a last one may have fewer)."""
    out, last = [], 0
    for e in marks:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST and n - e >= LEAST:
            out.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n]


def _chunked(lists: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each list. A mark whose window reaches into the list before is none."""
    size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    begin = np.cumsum(size) - size
    marks = marks_of(np.concatenate(lists))
    who = np.searchsorted(begin, marks - 1, "right") - 1
    inner = marks - begin[who]
    keep = inner >= WINDOW
    who, inner = who[keep], inner[keep]
    edges = np.searchsorted(who, np.arange(len(lists) + 1))
    return [cuts(n, inner[a:b].tolist()) for n, a, b in zip(size.tolist(), edges[:-1], edges[1:], strict=True)]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Crc:
    """CRC-32 of two byte strings end to end, from the CRC of each and the length of the second (as zlib does it:
    appending n zero bytes is a linear map over the 32 bits, and maps for 2**k bytes are squared up)."""

    def __init__(self):
        bit = np.array([zlib.crc32(b"\0", (1 << i)) ^ zlib.crc32(b"\0", 0) for i in range(32)], dtype=np.int64).tolist()
        self.maps = [bit]
        for _ in range(40):
            self.maps.append([self._apply(self.maps[-1], x) for x in self.maps[-1]])

    @staticmethod
    def _apply(columns: list[int], x: int) -> int:
        out = 0
        while x:
            low = x & -x
            out ^= columns[low.bit_length() - 1]
            x ^= low
        return out

    def combine(self, a: int, b: int, length_b: int) -> int:
        k = 0
        while length_b:
            if length_b & 1:
                a = self._apply(self.maps[k], a)
            length_b >>= 1
            k += 1
        return a ^ b


def _encode(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(read_file(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(source.value)
        form = "<u4" if lib.wide else "<u2"

        def make(b):
            counts, roots, names, data = [], [], [], []
            lists = [np.append(x, np.uint32(END)).astype(form) for x in lib.pieces.encode([x.decode() for x in texts_of(b)])]
            for ids, ends in zip(lists, _chunked(lists), strict=True):
                parts = [ids[x:y].tobytes() for x, y in zip([0, *ends[:-1]], ends, strict=True)]
                addresses = [hashlib.sha256(p).digest() for p in parts]
                counts.append(len(ids))
                roots.append(merkle(addresses))
                names.append(addresses)
                data.append(parts)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(roots, pa.binary()), pa.array(names, pa.list_(pa.binary())), pa.array(data, pa.list_(pa.binary()))], names=["doc_id", "n_tokens", "root", "chunks", "data"])

        return each(batches, make)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, root binary, chunks array<binary>, data array<binary>")


def write(docs: DataFrame, path: str, folder: str | None = None) -> str:
    """Encode all documents into a store; returns its folder (in the shared folder if none is given)."""
    spark = tune(docs.sparkSession)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    staged = written(_encode(docs, path))  # the texts are encoded once
    put = lambda df, name: df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    pairs = staged.select(F.explode(F.arrays_zip("chunks", "data")).alias("x")).select(F.col("x.chunks").alias("address"), F.col("x.data").alias("data"))
    put(pairs.groupBy("address").agg(F.first("data").alias("data")), "chunks")
    ranged = staged.select("doc_id", "n_tokens", "root", "chunks").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("root"))
    placed = written(ranged.select(F.spark_partition_id().alias("part"), "*"))
    sums = [(r.part, r.n) for r in placed.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()]  # a row a partition
    before = np.concatenate([[0], np.cumsum([n for _, n in sums])])
    base = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sums, before, strict=False)], "part int, base bigint")
    w = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root")
    upto = F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    recipes = placed.withColumns({"pos": F.row_number().over(w).cast("long"), "upto": upto}).join(F.broadcast(base), "part")
    put(recipes.select("part", "pos", "doc_id", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "root", "chunks"), "recipes")
    put(_manifest(spark.read.parquet(f"{folder}/recipes")), "manifest")
    return folder


class _Roots:
    """A Merkle root over leaves that come one by one: equal to `merkle` of the list, in memory of its logarithm."""

    def __init__(self):
        self.full: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        k = 0
        while k < len(self.full) and self.full[k] is not None:
            leaf, self.full[k] = hashlib.sha256(self.full[k] + leaf).digest(), None
            k += 1
        if k == len(self.full):
            self.full.append(None)
        self.full[k] = leaf

    def root(self) -> bytes:
        out = None
        for x in self.full:
            if x is not None:
                out = x if out is None else hashlib.sha256(x + out).digest()
        return out or hashlib.sha256(b"").digest()


def _manifest(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, root; a part is read in order and streamed."""

    def run(batches):
        part, docs, tokens, roots = None, 0, 0, _Roots()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([roots.root()], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])
        for b in batches:
            for p, n, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield row()
                    part, docs, tokens, roots = p, 0, 0, _Roots()
                docs, tokens = docs + 1, tokens + n
                roots.add(r)
        if part is not None:
            yield row()

    ordered = recipes.select("part", "pos", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "pos")
    return ordered.select("part", "n_tokens", "root").mapInArrow(run, "part int, n_docs bigint, n_tokens bigint, root binary")


def _verified(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """address, n, crc of each chunk, after holding its bytes against its address."""

    def run(batches):
        def make(b):
            names, data = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, d in zip(names, data, strict=True):
                if hashlib.sha256(d).digest() != a:
                    raise ValueError(f"chunk {a.hex()} doesn't match its address")
            crc = [zlib.crc32(np.frombuffer(d, dtype=f"<u{width}").astype("<u4").tobytes()) for d in data]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(d) // width for d in data], pa.int64()), pa.array(crc, pa.int64())], names=["address", "n", "crc"])

        return each(batches, make)

    return spark.read.parquet(f"{folder}/chunks").select("address", "data").mapInArrow(run, "address binary, n bigint, crc bigint")


def width_of(path: str) -> int:
    """Bytes of an id in the chunks of a store made with this vocabulary."""
    return 4 if Vocabulary(read_file(path)).size > 1 << 16 else 2


def read_digests(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files of a store, with everything verified."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    bad = spark.read.parquet(f"{folder}/manifest").join(_manifest(recipes).withColumnRenamed("root", "again"), ["part", "n_docs", "n_tokens"], "full").where("root is null or again is null or root <> again")
    if bad.limit(1).count():
        raise ValueError("a part of the recipes doesn't match the manifest")
    one = recipes.select("part", "pos", F.posexplode("chunks").alias("k", "address"))
    met = one.join(_verified(spark, folder, width), "address", "left").groupBy("part", "pos").agg(F.sort_array(F.collect_list(F.struct("k", "n", "crc"))).alias("found"))
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def run(batches):
        crc = Crc()

        def make(b):
            out = []
            for i, n_tokens, root, names, found in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True):
                if merkle(names) != root or any(x["n"] is None for x in found) or sum(x["n"] for x in found) != n_tokens:
                    raise ValueError(f"document {i} can't be put together again")
                total = found[0]["crc"]
                for x in found[1:]:
                    total = crc.combine(total, x["crc"], 4 * x["n"])
                out.append(total)
            return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return each(batches, make)

    whole = recipes.join(met, ["part", "pos"]).select("doc_id", "start", "n_tokens", "root", "chunks", "found")
    return whole.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """doc_id, start, ids (array of int) of each document, put together from its chunks."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    one = recipes.select("part", "pos", F.posexplode("chunks").alias("k", "address"))
    met = one.join(spark.read.parquet(f"{folder}/chunks"), "address").groupBy("part", "pos").agg(F.sort_array(F.collect_list(F.struct("k", "data"))).alias("found"))

    def run(batches):
        def make(b):
            ids = [np.frombuffer(b"".join(x["data"] for x in f), dtype=f"<u{width}").astype(np.int32).tolist() for f in b.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

        return each(batches, make)

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return recipes.join(met, ["part", "pos"]).select("doc_id", "start", "found").mapInArrow(run, f"doc_id {kind}, start bigint, ids array<int>")
