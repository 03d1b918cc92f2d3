"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams is held against every text window.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A benchmark item gives its
windows of `ngram` consecutive words; an item with fewer words (but not none) is one window. A document word inside
any occurrence of a window is hit. A hash match is verified word by word before it counts.

Defined results: null and empty texts have no words and no hit. Benchmark rows without text or words give no windows;
rows without an item_id mark hits but are not listed; a repeated item_id counts once. Repeated documents are judged
each on its own. Extra columns, whatever their names, are neither read nor returned, except that `cleaned` carries
all columns of its input.

The set is broadcast only while it takes at most `broadcast_bytes` (an aggregate counts the benchmark's windows, at
WINDOW_BYTES each). Beyond that, windows are matched by a shuffled equi-join, which needs no memory bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, Words, covered, doubled, each, runs, texts_of, tune, unused, written

NGRAM = 10
BROADCAST_BYTES = 64 << 20
#: What a window takes in the set besides its words' bytes: their places in two tables and the set of its items.
WINDOW_BYTES = 512

SPANS = "n_words bigint, n_hit bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


def _windows(texts: list[bytes], ngram: int):
    """(text number, window text, words in it) for each window of the benchmark."""
    w = Words(texts, PUNCT, lower=True)
    for k, (a, n) in enumerate(zip(w.first.tolist(), w.count.tolist(), strict=False)):
        if n:
            for i in range(a, a + max(1, n - ngram + 1)):
                yield k, w.joined(i, min(i + ngram, a + n)), min(ngram, n)


class Grams:
    """The benchmark's windows, ready to be looked up by hash: small tables by window length."""

    BITS = 22

    def __init__(self, items: list[tuple[str | None, bytes]], ngram: int):
        self.items: dict[bytes, frozenset] = {}
        lengths: dict[int, set[bytes]] = {}
        gathered: dict[bytes, set] = {}
        for k, text, n in _windows([t for _, t in items], ngram):
            gathered.setdefault(text, set()).add(items[k][0])
            lengths.setdefault(n, set()).add(text)
        self.items = {k: frozenset(x for x in v if x is not None) for k, v in gathered.items()}
        self.by_length = {}
        for n, found in lengths.items():
            w = Words(sorted(found), PUNCT, lower=True)
            hashes = np.unique(doubled(w.hash, n)[w.first[:-1]])
            sieve = np.zeros(1 << self.BITS, dtype=bool)
            sieve[hashes >> np.uint64(64 - self.BITS)] = True
            self.by_length[n] = (hashes, sieve)

    def find(self, w: Words) -> list[tuple[int, int, frozenset]]:
        """Verified occurrences: first word, word after the last, items."""
        out = []
        for n, (hashes, sieve) in self.by_length.items():
            at = w.inside(n)
            h = doubled(w.hash, n)[at]
            may = np.flatnonzero(sieve[h >> np.uint64(64 - self.BITS)])
            may = may[np.isin(h[may], hashes)]
            for i in at[may].tolist():
                if (items := self.items.get(w.joined(i, i + n))) is not None:
                    out.append((i, i + n, items))
        return out


def _judge(texts: list[bytes], grams: Grams):
    w = Words(texts, PUNCT, lower=True)
    found = grams.find(w)
    hit = covered(len(w.start), np.array([a for a, _, _ in found], dtype=np.int64), np.array([b for _, b, _ in found], dtype=np.int64))
    items: dict[int, set] = {}
    for a, _, names in found:
        items.setdefault(int(w.text[a]), set()).update(names)
    return w, hit, items


def _spans(w: Words, hit: np.ndarray, items: dict[int, set]) -> tuple[list, list, list, list]:
    n_hit = np.bincount(w.text[hit], minlength=len(w.count))[: len(w.count)]
    spans = []
    for k, n in enumerate(n_hit.tolist()):
        if not n:
            spans.append([])
            continue
        a, b = w.first[k], w.first[k + 1]
        starts, stops = runs(hit[a:b])
        spans.append([{"start": int(w.start[a + x] - w.text_start[k]), "stop": int(w.stop[a + y - 1] - w.text_start[k])} for x, y in zip(starts, stops, strict=True)])
    return w.count.tolist(), n_hit.tolist(), spans, [sorted(items.get(k, ())) for k in range(len(w.count))]


_STRUCT = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _grams(benchmark: DataFrame, ngram: int):
    """The broadcast set, or None if the benchmark is beyond the bound."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    return Grams([(r.item_id, bytes(r.text)) for r in rows.collect()], ngram)


def small(benchmark: DataFrame, bound: int, ngram: int = NGRAM) -> bool:
    """Whether the set of the benchmark's windows keeps within so many bytes."""
    words = F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    windows = F.greatest(words - (ngram - 1), F.lit(1)).cast("long")
    letters = F.octet_length("text").cast("long") * ngram  # a word stands in so many windows at most
    return (benchmark.where("text is not null").agg(F.sum(windows * WINDOW_BYTES + letters)).first()[0] or 0) <= bound


def scan(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans (byte ranges of the UTF-8 text, hit words from first to last), items."""
    spark = tune(docs.sparkSession)
    if not small(benchmark, broadcast_bytes, ngram):
        return _scan_by_join(docs, benchmark, ngram)
    shared = spark.sparkContext.broadcast(_grams(benchmark, ngram))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(b):
            n_words, n_hit, spans, items = _spans(*_judge(texts_of(b), shared.value))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, _STRUCT), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "spans", "items"])

        return each(batches, make)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SPANS}")


def _hits_by_join(base: DataFrame, benchmark: DataFrame, ngram: int) -> DataFrame:
    """base (row, text) -> (row, found, found_items) for a benchmark of any size: windows as rows, joined on their words."""

    def grams(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            found = [(ids[k], text, n) for k, text, n in _windows(texts_of(b), ngram)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.int32())], names=["item", "gram", "n"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").mapInArrow(grams, "item string, gram binary, n int").distinct()
    lengths = [r.n for r in items.select("n").distinct().collect()]  # at most ngram values

    def windows(batches):
        for b in batches:
            w, rows = Words(texts_of(b), PUNCT, lower=True), b.column(0).to_pylist()
            for n in lengths:
                for part in np.array_split(w.inside(n), len(w.inside(n)) // 20000 + 1):
                    at = part.tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([rows[w.text[i]] for i in at], pa.int64()), pa.array([i - int(w.first[w.text[i]]) for i in at], pa.int64()), pa.array([w.joined(i, i + n) for i in at], pa.binary()), pa.array([n] * len(at), pa.int32())], names=["row", "at", "gram", "n"])

    by_gram = items.groupBy("gram", "n").agg(F.collect_set("item").alias("items"))
    hits = base.select("row", "text").mapInArrow(windows, "row bigint, at bigint, gram binary, n int").join(by_gram, ["gram", "n"])
    return hits.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("found"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found_items"))


def _joined_hits(texts: list[bytes], found: list, items: list):
    """What _judge gives, from joined hits."""
    w = Words(texts, PUNCT, lower=True)
    hit, names = np.zeros(len(w.start), dtype=bool), {}
    for k, (some, listed) in enumerate(zip(found, items, strict=True)):
        for x in some or ():
            hit[w.first[k] + x["at"] : w.first[k] + x["at"] + x["n"]] = True
        names[k] = set(listed or ())
    return w, hit, names


def _scan_by_join(docs: DataFrame, benchmark: DataFrame, ngram: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))

    def finish(batches):
        for b in batches:
            n_words, n_hit, spans, listed = _spans(*_joined_hits(texts_of(b), b.column(2).to_pylist(), b.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, _STRUCT), pa.array(listed, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "spans", "items"])

    found = base.join(_hits_by_join(base, benchmark, ngram), "row", "left").select("doc_id", "text", "found", "found_items")
    return found.mapInArrow(finish, f"doc_id {kind}, {SPANS}")


def _cut(text: bytes, spans: list) -> bytes:
    out, last = [], 0
    for s in spans:
        out.append(text[last : s["start"]])
        last = s["stop"]
    return b"\n".join([*out, text[last:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, most: float = 0.5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with hit spans cut out of `text` (a line break takes their place); a document of which more than
    the share `most` of its words is hit goes. All columns stay; n_chars, if there, is set to the new length."""
    spark = tune(docs.sparkSession)
    at, names = docs.columns.index("text"), docs.columns
    if small(benchmark, broadcast_bytes, ngram):
        shared, source = spark.sparkContext.broadcast(_grams(benchmark, ngram)), docs
    else:
        row, found, listed = (unused(docs, c) for c in ("row", "found", "found_items"))
        base = written(docs.withColumn(row, F.monotonically_increasing_id()))
        hits = _hits_by_join(base.select(F.col(row).alias("row"), "text"), benchmark, ngram).toDF(row, found, listed)
        shared, source = None, base.join(hits, row, "left").select(*names, found, listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            whole = [x or b"" for x in texts]
            judged = _judge(whole, shared.value) if shared else _joined_hits(whole, b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist())
            n_words, n_hit, spans, _ = _spans(*judged)
            new = [t if not h else _cut(t, s) for t, h, s in zip(texts, n_hit, spans, strict=True)]
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array([None if x is None else x.decode() for x in new], pa.string())
            stays = pa.array([h <= most * n for n, h in zip(n_words, n_hit, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(stays)

    out = source.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
