"""Sharding by sampled splitters: shards of nearly equal bytes (law `bytes`).

Records are ordered by (hash of the text, doc_id, row), so equal texts stand side by side. A sample of keys is drawn with
probability proportional to size; its quantiles are the splitters of RANGES ranges a shard. Every record is put into
its range, and the ranges' exact bytes are summed. A range of more than twice its share is subdivided by splitters
sampled from its own records, again and again, until none is overfull (a range of one record stays). Each shard gets the
ranges that lie wholly within its quantile of the bytes; the few ranges that straddle a boundary go, largest first,
to the shard with the fewest bytes. A slot is a record's place in its shard.

A group of equal texts is split only where it is larger than a range may be. The driver holds splitters and one sum a
range, whose number depends on the number of shards and on RANGE_BYTES alone, never records.

Sampling is by hashes of the keys, so a lost executor's work comes out the same when it is done again.

Defined results: null texts have size 1 and CRC 0, as empty ones; null doc_ids sort first; repeated rows are kept and
get a slot each; extra columns are not read. A table without rows gives none.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, tune

SHARDS, RANGES, RANGE_BYTES, SAMPLES, OVERFULL, LEVEL = 16, 128, 4 << 30, 16, 2.0, 0.002

Key = tuple  # (hash, has doc_id, doc_id, row)


def _sampled(base: DataFrame, rate, seed: int) -> list[Key]:
    """Keys drawn with probability size * rate, by a hash of the key."""
    u = (F.xxhash64(F.lit(seed), "h", "row").bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    rows = base.where(u < F.col("size") * rate).select("h", "doc_id", "row").collect()
    return sorted((r.h, r.doc_id is not None, r.doc_id if r.doc_id is not None else 0, r.row) for r in rows)


def _ranged(base: DataFrame, splitters: list[Key]) -> DataFrame:
    """Adds `range`: how many splitters are at or below the record's key."""
    hashes = np.array([s[0] for s in splitters], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            tied = np.flatnonzero(low != high)
            if len(tied):
                ids, rows = b.column("doc_id").take(pa.array(tied)).to_pylist(), b.column("row").take(pa.array(tied)).to_pylist()
                for k, i, r in zip(tied.tolist(), ids, rows, strict=True):
                    high[k] = bisect.bisect_right(splitters, (int(h[k]), i is not None, i if i is not None else 0, r), low[k], high[k])
            yield b.append_column("range", pa.array(high.astype(np.int32)))

    return base.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", range int")


def _assign(sums: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(range, bytes, rows) in range order -> (range, shard, first slot)."""
    total = sum(b for _, b, _ in sums)
    load, shard_of, late, before = [0] * shards, {}, [], 0
    for r, b, _ in sums:
        first, last = before * shards // total, (before + b - 1) * shards // total
        before += b
        if first == last:
            shard_of[r] = first
            load[first] += b
        else:
            late.append((b, r))
    for b, r in sorted(late, reverse=True):
        k = min(range(shards), key=lambda s: (load[s], s))
        shard_of[r] = k
        load[k] += b
    # What one large range has upset is levelled by ranges that fit between the heaviest and the lightest shard.
    size = {r: b for r, b, _ in sums}
    for _ in range(len(sums)):
        heavy, light = max(range(shards), key=lambda s: (load[s], s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        fits = [r for r, s in shard_of.items() if s == heavy and 0 < size[r] < gap]
        if gap * shards <= LEVEL * total or not fits:
            break
        r = min(fits, key=lambda r: (abs(2 * size[r] - gap), r))
        shard_of[r] = light
        load[heavy] -= size[r]
        load[light] += size[r]
    slots, out = [0] * shards, []
    for r, _, n in sums:
        out.append((r, shard_of[r], slots[shard_of[r]]))
        slots[shard_of[r]] += n
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = tune(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    base = keep(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row")))
    total = base.agg(F.sum("size")).first()[0]
    if not total:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    count = max(shards * ranges, -(-total // RANGE_BYTES))
    keys = _sampled(base, F.lit(SAMPLES * count / total), 1)
    step = max(1.0, len(keys) / count)
    splitters: list[Key] = sorted({(keys[int(k * step)][0], False, 0, -1) for k in range(1, int(len(keys) / step))})
    share = total / count
    for again in range(2, 40):
        placed = _ranged(base, splitters)
        sums = [(r.range, r.bytes, r.n) for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range").collect()]
        over = [(r, b) for r, b, n in sums if b > OVERFULL * share and n > 1]
        new: set[Key] = set()
        if over:
            rates = spark.createDataFrame([(r, float(SAMPLES / share)) for r, _ in over], "range int, rate double")
            drawn = _sampled(placed.join(F.broadcast(rates), "range").select("h", "doc_id", "row", "size", "rate"), F.col("rate"), again)
            by: dict[int, list[Key]] = {}
            for k in drawn:
                by.setdefault(bisect.bisect_right(splitters, k), []).append(k)
            for r, b in over:
                own, parts = by.get(r, []), int(np.ceil(b / share))
                new |= {own[int(i * len(own) / parts)] for i in range(1, parts) if own}
        new -= set(splitters)
        if not new:
            break
        splitters = sorted({*splitters, *new})
    plan = spark.createDataFrame(_assign(sums, shards), "range int, shard int, first long")
    w = Window.partitionBy("range").orderBy("h", F.col("doc_id").asc_nulls_first(), "row")
    return (
        placed.withColumn("k", F.row_number().over(w) - 1)
        .join(F.broadcast(plan), "range")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
