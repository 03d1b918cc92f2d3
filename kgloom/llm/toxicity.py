"""Toxicity by subword-bag embeddings, averaged into a linear softmax and trained jointly in numpy.

A word (white-space separated, lower-cased, between the marks < and >) is the bag of its character n-grams of 3 to 6
characters and itself, hashed into BUCKETS embedding rows. A word's vector is the mean of its rows, a document's the mean
of its words' vectors; a linear softmax over two classes follows. The embeddings of all buckets and the softmax are trained together
by accelerated gradient descent on the log loss. A misspelled word that was never seen keeps most of its n-grams, and with them
its score.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1; of these, at most TRAIN_DOCS are fitted (the
least by a hash of doc_id: a documented bound), each by all words of its whole text. Executors count a training text's words; the
driver gets the different words and their counts. For scoring, embeddings and softmax fold into one weight a bucket: a table of
2 ** BUCKET_BITS floats is broadcast, whatever the input.

Defined results: null and empty texts get the score of the softmax's bias alone; rows with a null doc_id are scored,
never learned, and held_out is false; a label without a document is ignored, of labels that repeat or disagree for a
doc_id the greatest counts, and of documents that repeat a doc_id the least text is learned; with no labels, or of one class only,
every score is the share of label 1 (0 without any). Extra columns are not read, except that `accepted` carries all columns of
its input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, each, give_back, mix, texts_of, tidy, tune

BUCKET_BITS, SIZES, WIDTH = 18, (3, 4, 5, 6), 6
TRAIN_DOCS, STEPS, TRUST, SLOW, BIAS_RATE, SEED = 4000, 80, 3, 0.2, 2.0, 13
THRESHOLD, CACHED, WORDS_AT_ONCE = 0.7, 150_000, 20_000


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, grouped by word, and how many each word has."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    begin = np.cumsum(size) - size
    rolling, owner = Rolling(mix(codes.astype(np.uint64) + np.uint64(77))), np.repeat(np.arange(len(words)), size)
    hashes, whose = [rolling.windows(begin, begin + size) ^ np.uint64(0xABCDEF)], [np.arange(len(words))]
    for n in SIZES:
        at = np.flatnonzero(owner[: max(0, len(codes) - n + 1)] == owner[n - 1 :])
        hashes.append(rolling.every(n)[at])
        whose.append(owner[at])
    whose_all = np.concatenate(whose)
    order = np.argsort(whose_all, kind="stable")
    return (np.concatenate(hashes)[order] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.bincount(whose_all, minlength=len(words))


def word_counts(text: str) -> dict[str, int]:
    """The different words of a whole text, lower-cased, and how often it has them."""
    out: dict[str, int] = {}
    for w in text.lower().split():
        out[w] = out.get(w, 0) + 1
    return out


class _Bags:
    """The inputs of training: documents as means of words, words as means of n-grams. Both means are linear maps, kept as
    lists of their entries; `down` takes a value a bucket to one a document, and `up` is its transpose."""

    def __init__(self, counted: Iterable[dict[str, int]]):
        number: dict[str, int] = {}
        word, share = [], []
        for c in counted:
            word.append(np.fromiter((number.setdefault(w, len(number)) for w in c), dtype=np.int32, count=len(c)))
            share.append(np.fromiter(c.values(), dtype=np.float32, count=len(c)) / max(1, sum(c.values())))
        self.n_docs, self.n_words = len(word), len(number)
        self.document = np.repeat(np.arange(len(word), dtype=np.int32), [len(w) for w in word])
        self.word, self.share = np.concatenate([*word, np.zeros(0, dtype=np.int32)]), np.concatenate([*share, np.zeros(0, dtype=np.float32)])
        words, self.parts = list(number), []
        number.clear()
        for a in range(0, len(words), WORDS_AT_ONCE):
            bucket, size = grams(words[a : a + WORDS_AT_ONCE])
            self.parts.append((a, bucket.astype(np.int32), size, np.cumsum(size) - size))

    def down(self, value: np.ndarray) -> np.ndarray:
        of_word = np.concatenate([np.zeros(0), *(np.add.reduceat(value[bucket], begin) / size for _, bucket, size, begin in self.parts)])
        weights = of_word.astype(np.float32)[self.word]
        weights *= self.share
        return np.bincount(self.document, weights=weights, minlength=self.n_docs)

    def up(self, value: np.ndarray, power: int = 1) -> np.ndarray:
        """With power 2, the entries of both maps are squared."""
        weights = value.astype(np.float32)[self.document]
        for _ in range(power):
            weights *= self.share
        of_word = np.bincount(self.word, weights=weights, minlength=self.n_words)
        out = np.zeros(1 << BUCKET_BITS)
        for a, bucket, size, _ in self.parts:
            out += np.bincount(bucket, weights=np.repeat(of_word[a : a + len(size)] / size.astype(np.float64) ** power, size), minlength=len(out))
        return out


def train(counted: Iterable[dict[str, int]], labels: list[int], steps: int = STEPS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights by bucket and a bias: a document's log-odds are the bias and the mean over its words of their mean weight. counted:
    the words of each text, read once.

    Inputs are centred, and a bucket's are scaled to root mean square one and then by the power TRUST of their correlation with the
    label: vectors of buckets that say little about it grow slowly, but all are trained. As the softmax has two classes, the gradient of
    all embeddings is the outer product of one value a bucket and the difference of the softmax's columns."""
    share = sum(labels) / len(labels) if labels else 0.0
    if not 0 < share < 1:
        return np.zeros(1 << BUCKET_BITS, dtype=np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    bags, n, target = _Bags(counted), len(labels), np.array(labels, dtype=np.float64)
    mean, square = bags.up(np.ones(n)) / n, np.maximum(bags.up(np.ones(n), 2) / n, 1e-30)
    toward = np.abs(bags.up(target - share)) / n / np.sqrt(square * share * (1 - share))
    scale = np.where(mean > 0, np.minimum(toward, 1) ** TRUST / np.sqrt(square), 0.0)

    def logits(value: np.ndarray) -> np.ndarray:
        return bags.down(value * scale) - mean @ (value * scale)

    def gradient(error: np.ndarray) -> np.ndarray:
        return (bags.up(error) - mean * error.sum()) * scale

    rng = np.random.default_rng(seed)
    most = rng.normal(0, 1, len(scale))  # its length comes to be the greatest curvature
    for _ in range(6):
        most = gradient(logits(most / max(np.linalg.norm(most), 1e-30)) / n)
    rate = 4 / max(np.linalg.norm(most), 1e-30)
    e = np.zeros((len(scale), WIDTH), dtype=np.float32)
    soft = rng.normal(0, 1, (WIDTH, 2))
    soft /= np.linalg.norm(soft[:, 1] - soft[:, 0])
    bias, before, pace = np.log(np.array([1 - share, share])), e, 1.0
    for _ in range(steps):
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, before, pace = e + np.float32((pace - 1) / next_pace) * (e - before), e, next_pace
        way = soft[:, 1] - soft[:, 0]
        p = 1 / (1 + np.exp(-np.clip(logits(ahead @ way) + bias[1] - bias[0], -50, 50)))
        error = (p - target) / n
        g = gradient(error)
        e = ahead - np.outer(rate * g, way).astype(np.float32)
        toward_one = before.T @ g
        soft = soft - SLOW * rate * np.stack([-toward_one, toward_one], axis=1)
        bias = bias - BIAS_RATE * np.array([-error.sum(), error.sum()])
    weights = (e @ (soft[:, 1] - soft[:, 0])) * scale
    return weights.astype(np.float32), float(bias[1] - bias[0] - mean @ weights)


class Scorer:
    """Scores texts; keeps the scores of words it has met."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def scores(self, texts: list[str]) -> list[float]:
        cut = [t.lower().split() for t in texts]
        new = []
        for w in dict.fromkeys(w for c in cut for w in c):
            if w not in self.young:
                if (got := self.old.get(w)) is not None:
                    self.young[w] = got
                else:
                    new.append(w)
        if new:
            bucket, size = grams(new)
            sums = np.add.reduceat(self.weights[bucket].astype(np.float64), np.cumsum(size) - size)
            self.young.update(zip(new, (sums / size).tolist(), strict=True))
        get = self.young.__getitem__
        z = np.array([self.bias + (sum(map(get, c)) / len(c) if c else 0.0) for c in cut])
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        return (1 / (1 + np.exp(-np.clip(z, -700, 700)))).tolist()


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """A model from a bounded sample of the rows that may be learned from."""
    tune(docs.sparkSession)
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label")).where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(b):
            counted = [word_counts(t) for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([" ".join(c) for c in counted]), pa.array([np.fromiter(c.values(), dtype="<i4").tobytes() for c in counted], pa.binary())], names=["doc_id", "label", "words", "counts"])

        return each(batches, make)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"doc_id {kind}, label int, words string, counts binary").collect()
    rows.sort(key=lambda r: str(r.doc_id))
    labels_, rows = [r.label for r in rows], rows[::-1]

    def counted() -> Iterator[dict[str, int]]:
        while rows:  # a row's words go when they have been counted
            r = rows.pop()
            yield dict(zip(r.words.split(), np.frombuffer(r.counts, dtype="<i4").tolist(), strict=True))

    try:
        return train(counted(), labels_)
    finally:
        give_back()


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or fitted(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        yield from each(batches, lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores([x.decode() for x in texts_of(b)]))], names=["doc_id", "score"]))

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fitted(docs, labels))
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            s = scorer.scores([(x or b"").decode() for x in b.column(at).cast(pa.binary()).to_pylist()])
            yield b.filter(pa.array([x < threshold for x in s], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
