"""Documents in blocks, and the question which hashes are found more than once among all blocks.

A block holds neighbouring documents of about TARGET bytes of text, whole. Blocks are written once, bucketed by block
number, so a later pass reads them again without a shuffle and meets what was found out about each block by a
co-located join. A block sends each of its hashes once, however often it has it, so the most common hash of all gives
one row a block: no key is hotter than the number of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MADE, shared_dir, tidy, tune

TARGET = 2 << 20


def _ddl(schema: T.StructType) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in schema)


def blocked(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """(block, n_rows, rows): rows is an array of structs with the columns of docs, in their order."""
    spark = tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out():
            nonlocal n
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            rows = pa.StructArray.from_arrays(whole.columns, fields=list(whole.schema))
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([part | n], pa.int64()), pa.array([len(rows)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=["block", "n_rows", "rows"])

        for b in batches:
            sizes = np.array([len(x or b"") + 1 for x in b.column(at).cast(pa.binary()).to_pylist()], dtype=np.int64)
            begin = 0
            for k, s in enumerate(sizes.tolist()):
                if size and size + s > target:
                    if k > begin:
                        held.append(b.slice(begin, k - begin))
                    yield out()
                    held, size, begin = [], 0, k
                size += s
            if b.num_rows > begin:
                held.append(b.slice(begin))
        if held:
            yield out()

    frame = docs.mapInArrow(run, f"block bigint, n_rows bigint, rows array<struct<{_ddl(docs.schema)}>>")
    name = f"kgloom_blocks_{uuid.uuid4().hex}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    MADE.append((f"{shared_dir(spark)}/{name}", name))
    frame.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(count, "block").saveAsTable(name)
    return spark.table(name)


def column(rows: pa.ListArray, k: int, name: str) -> pa.Array:
    """A column of the documents in the k-th block of a batch."""
    return rows[k].values.field(name)


def texts(rows: pa.ListArray, k: int) -> list[bytes]:
    return [x or b"" for x in column(rows, k, "text").cast(pa.binary()).to_pylist()]


def sent(blocks: DataFrame, hashes: Callable) -> DataFrame:
    """(h, block, many): each hash that hashes(texts, found) gives of a block, once; many: more than once in the block.

    found is None, or what `answered` brought: the hashes of the block that were found elsewhere too."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                h, n = np.unique(hashes(texts(b.column("rows"), k), found_of(b, k)), return_counts=True)
                for i in range(0, len(h), 200_000):
                    part = h[i : i + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(np.full(len(part), b.column("block")[k].as_py(), dtype=np.int64)), pa.array(n[i : i + 200_000] > 1)], names=["h", "block", "many"])

    return blocks.mapInArrow(run, "h bigint, block bigint, many boolean")


def found_of(b: pa.RecordBatch, k: int) -> np.ndarray | None:
    """What `answered` brought for the k-th block, sorted; None if the batch has no such column."""
    if "found" not in b.schema.names:
        return None
    blobs = b.column("found")[k].as_py() or []
    return np.sort(np.frombuffer(b"".join(blobs), dtype="<u8"))


def within(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values are among found (sorted)."""
    if not len(found):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(found, values)
    at[at == len(found)] = 0
    return found[at] == values


def answered(rows: DataFrame, together: int = 1 << 20) -> DataFrame:
    """`sent` rows -> (block, found): for each block the hashes that another block has too, or that it has more than once.

    Rows come sorted by hash and are streamed, `together` at a time; of a hash that goes on, however many blocks have it, no more
    than its first row is held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, None  # the last hash, and the block of its only row so far, if one row says nothing yet
        parts: list[tuple] = []

        def out():
            nonlocal last, waiting
            h, block, many = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            new = np.concatenate([[h[0] != last], h[1:] != h[:-1]])
            group = np.cumsum(new) - int(new[0])
            found = np.bincount(group) > 1
            found[group[many]] = True
            keep = found[group]
            if not new[0]:  # the last hash goes on
                found[0] = True
                keep = found[group]
                if waiting is not None:
                    h, block, keep = np.append(h[:1], h), np.append(waiting, block), np.append(True, keep)
            last, waiting = h[-1], None if found[-1] else block[-1]
            h, block = h[keep], block[keep]
            order = np.argsort(block, kind="stable")
            h, block = h[order], block[order]
            names, first = np.unique(block, return_index=True)
            blobs = [h[a:e].astype("<i8").tobytes() for a, e in zip(first, [*first[1:], len(h)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["block", "blob"])

        held = 0
        for b in batches:
            if not b.num_rows:
                continue
            parts.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            held += b.num_rows
            if held >= together:
                yield out()
                held = 0
        if parts:
            yield out()

    met = rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "block bigint, blob binary")
    return met.groupBy("block").agg(F.collect_list("blob").alias("found"))


def joined(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """The blocks with their answers; a block without one has a null there."""
    return blocks.join(answers.hint("shuffle_hash"), "block", "left")


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by windows of doubled width."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` neighbouring hashes, the place of the least one, the leftmost of equals. The place depends
    on the window's content alone, so equal windows have it at the same distance."""
    packed = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    return (sliding_min(packed, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
