"""Substring dedup by level-wise doubling: words in windows of WINDOW words that stand anywhere else are removed.

Level 1 asks for windows of 9 words, level 2 for 18, the last for 35 (the doubled length, less the one word by which its
two halves overlap). Only what was repeated at one length is extended to the next: if nothing is, nothing is asked.
  1. Every window of 35 words has 27 windows of 9; the one of least hash is its anchor, which depends on the window's
     content alone. Anchors' hashes are counted over all documents, a fraction of the words.
  2. A repeated window of 35 has a repeated anchor, and holds the 18 words from the anchor on or those around it.
  3. Windows of 35 words that hold a repeated window of 18 are counted.
All occurrences of a repeated window go, the first included. Windows are judged on the input, and are equal when their
64-bit hashes are: those of a level pair two of the level before, the first level's pair hashes of the words' bytes, and
no pairing is linear, so long regular texts collide no more often than others. At 10**12 candidate windows the odds for a
given one to meet a false partner are 1 in 2 * 10**7.

Hashes are counted block-wise (see blocks.py), so no hash is hot and no rows of a group are brought together.

Defined results: null and empty texts have no words; texts of fewer than 35 words keep all; repeated rows are documents of
their own (and so remove each other); null doc_ids are kept as they are; extra columns are neither read nor returned by
`removed`, and all of them are returned by `deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import anchors, answered, blocked, column, found_of, joined, sent, texts, within
from .common import SPACE, Words, covered, doubled, paired, runs, tidy

WINDOW = 35


class Levels:
    """The windows of the levels over the words of one block."""

    def __init__(self, block: list[bytes], window: int):
        self.first, self.second, self.window = -(-window // 4), -(-window // 2), window
        self.w = Words(block, SPACE)
        self.starts = self.w.inside(window)
        self.made: dict[int, np.ndarray] = {}

    def places(self) -> np.ndarray:
        """Where anchors are."""
        if not len(self.starts):
            return self.starts
        return np.unique(anchors(self.all(self.first), self.window - self.first + 1)[self.starts])

    def seconds(self, places: np.ndarray) -> np.ndarray:
        """Starts of the second level's windows at these anchors: from the anchor on, and around it."""
        at = np.unique(np.concatenate([places, places - (self.second - self.first)]))
        at = at[(at >= 0) & (at + self.second <= len(self.w.start))]
        return at[self.w.text[at] == self.w.text[at + self.second - 1]]

    def all(self, length: int) -> np.ndarray:
        """The hashes of all windows of a level, each from two of the level before."""
        if length not in self.made:
            below = {self.second: self.first, self.window: self.second}.get(length, 0)
            if 0 < below < length:
                h, shift = self.all(below), length - below
                self.made[length] = paired(h[: max(0, len(h) - shift)], h[shift:])
            else:
                self.made[length] = doubled(self.w.hash, length)
        return self.made[length]

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.all(length)[at]


def _first(window: int):
    def hashes(block, found):
        x = Levels(block, window)
        return x.hashes(x.places(), x.first)

    return hashes


def _second(window: int):
    def hashes(block, found):
        if not len(found):
            return np.zeros(0, dtype=np.uint64)
        x = Levels(block, window)
        at = x.places()
        return x.hashes(x.seconds(at[within(x.hashes(at, x.first), found)]), x.second)

    return hashes


def _last(window: int):
    def hashes(block, found):
        if not len(found):
            return np.zeros(0, dtype=np.uint64)
        x = Levels(block, window)
        at = x.seconds(x.places())
        at = at[within(x.hashes(at, x.second), found)]
        holds = covered(len(x.w.start), np.maximum(at - (window - x.second), 0), at + 1)
        return x.hashes(x.starts[holds[x.starts]], window)

    return hashes


def _hit(block: list[bytes], found: np.ndarray, window: int) -> tuple[Words, np.ndarray]:
    """The words of a block, and which of them lie in a repeated window."""
    x = Levels(block, window)
    at = x.starts[within(x.hashes(x.starts, window), found)] if len(found) else x.starts[:0]
    return x.w, covered(len(x.w.start), at, at + window)


def _judged(docs: DataFrame, window: int) -> DataFrame:
    blocks = blocked(docs)
    one = answered(sent(blocks, _first(window)))
    two = answered(sent(joined(blocks, one), _second(window)))
    return joined(blocks, answered(sent(joined(blocks, two), _last(window))))


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                w, hit = _hit(texts(b.column("rows"), k), found_of(b, k), window)
                gone = np.bincount(w.text[hit], minlength=len(w.count))[: len(w.count)].tolist()
                shas = []
                for d, n in enumerate(gone):
                    words = w.buffer[w.text_start[d] : w.text_start[d + 1]].split()
                    if n:
                        words = [x for x, h in zip(words, hit[w.first[d] : w.first[d + 1]].tolist(), strict=True) if not h]
                    shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([column(b.column("rows"), k, "doc_id"), pa.array(w.count, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _judged(docs.select("doc_id", "text"), window).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents and columns, with removed words cut out of `text` (a line break takes the place of each run of them);
    n_chars, if there, is set to the new length."""
    names = docs.columns

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = b.column("rows")
                w, hit = _hit(texts(rows, k), found_of(b, k), window)
                gone = np.bincount(w.text[hit], minlength=len(w.count))[: len(w.count)].tolist()
                new = column(rows, k, "text").to_pylist()
                for d, n in enumerate(gone):
                    if n:
                        a, e = runs(~hit[w.first[d] : w.first[d + 1]])
                        new[d] = b"\n".join(w.buffer[w.start[x] : w.stop[y]] for x, y in zip((a + w.first[d]).tolist(), (e + w.first[d] - 1).tolist(), strict=True)).decode()
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else column(rows, k, c) for c in names], names=names)

    out = _judged(docs, window).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
