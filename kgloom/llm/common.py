"""What the training-data operators share: the shared folder, kept tables, Arrow helpers and text rules."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..plans.session import MADE, forget, shared_dir, ship, written

__all__ = ["MADE", "forget", "shared_dir", "written"]  # besides what is defined here

#: ASCII lower-casing, as the contracts ask for (A-Z only).
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows and bytes of one Arrow batch; texts can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for long texts, and see that workers can import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df hasn't got (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values (shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E6C63D0876A9A47)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for each pair of hashes, in this order; it isn't linear in them."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + b)


def doubled(h: np.ndarray, length: int) -> np.ndarray:
    """The hashes of all windows of `length` neighbours of h, by doubling: a window is a pair of windows of half its length or
    more, which may overlap. Equal windows have equal hashes, and no pattern in long windows makes different ones collide."""
    if len(h) < length:
        return h[:0]
    done = 1
    while done * 2 <= length:
        h = paired(h[:-done], h[done:])
        done *= 2
    return paired(h[: len(h) - (length - done)], h[length - done :]) if done < length else h


#: Bytes up to which `hashed` takes ranges eight bytes at a time, and masks of the first bytes of a value.
LONG = 128
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one value; zeros follow the end."""
    return np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, dtype=np.uint8)]), 0, (1,))


def hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range [start, stop): its length, paired with its bytes, eight at a time. Ranges of
    more than LONG bytes are hashed by XXH3."""
    size, at = stop - start, eights(data)
    out = mix(size.astype(np.uint64) + np.uint64(1))
    some = np.flatnonzero((size > 0) & (size <= LONG))
    for k in range(0, LONG, 8):
        left = size[some] - k
        out[some] = paired(out[some], at[start[some] + k] & _MASKS[np.minimum(left, 8)])
        some = some[left > 8]
        if not len(some):
            break
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]])
    return out


class Rolling:
    """Hashes of any window of a sequence of 64-bit values, from prefix sums of value * base**i modulo 2**64.

    Patterns of some hundred values exist that it can't tell apart, so it serves where a collision changes no result: for the cuts of
    chunks and the buckets of n-grams."""

    BASE = 0x5851F42D4C957F2D
    INVERSE = pow(BASE, -1, 1 << 64)
    _up = _down = np.zeros(0, dtype=np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        if len(Rolling._up) < n:
            Rolling._up, Rolling._down = powers(self.BASE, n + n // 2), powers(self.INVERSE, n + n // 2)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(values * Rolling._up[: n - 1], out=self.sums[1:])

    def windows(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """One hash for each [start, stop); equal contents have equal hashes, and the length counts."""
        raw = (self.sums[stop] - self.sums[start]) * Rolling._down[start]
        return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def every(self, length: int) -> np.ndarray:
        """The hashes of all windows of one length, in order."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        raw = (self.sums[length:] - self.sums[:n]) * Rolling._down[:n]
        return mix(raw + np.uint64(length * 0xD6E8FEB86659FD93 & (2**64 - 1)))


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def each(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Apply make to each batch that has rows."""
    for b in batches:
        if b.num_rows:
            yield make(b)


#: Which bytes cut words: ASCII white space, or (with lower-casing) everything ASCII but digits and letters.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
PUNCT = np.array([not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) for c in range(256)])
_LOWER = np.frombuffer(LOWER, dtype=np.uint8)


class Words:
    """The words of many texts at once, as byte ranges of one buffer and 64-bit hashes of their bytes; no word crosses a text."""

    def __init__(self, texts: list[bytes], cut: np.ndarray, lower: bool = False):
        self.buffer = b" ".join(texts) + b" "
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        if lower:
            data = _LOWER[data]
            self.buffer = data.tobytes()
        gap = np.ones(len(data) + 1, dtype=np.int8)
        gap[1:] = cut[data]
        turn = np.diff(gap)
        self.start, self.stop = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        self.hash = hashed(data, self.start, self.stop)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        #: Word number at which each text starts, and one more at the end.
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def inside(self, length: int) -> np.ndarray:
        """Starts of the windows of so many words that lie in one text."""
        n = len(self.start) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.text[:n] == self.text[length - 1 :])

    def joined(self, start: int, stop: int) -> bytes:
        """The words of a window, joined by one space."""
        return b" ".join(self.buffer[a:b] for a, b in zip(self.start[start:stop].tolist(), self.stop[start:stop].tolist(), strict=True))


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n places lie in a range [start, stop)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, stop, -1)
    return np.cumsum(step)[:n] > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True."""
    turn = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def give_back() -> None:
    """Give memory that is no longer used back to the system."""
    Rolling._up = Rolling._down = np.zeros(0, dtype=np.uint64)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: memory stays with the process
        pass


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back at a task's end: Python workers live on between tasks, and
    what one stage leaves in them would stand in the way of the next."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
