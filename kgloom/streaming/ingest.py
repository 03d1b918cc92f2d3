"""Incremental ingest: a file stream whose micro-batches are upserted into a graph store.

The stream's checkpoint remembers which files were read; a batch that is done again after a failure changes nothing, as the
store remembers the stream's last batch. Texts that an extractor fails on go to a dead-letter table, with their error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import Extractor, extract
from ..plans.session import cut
from ..sources.files import GraphStore, corpus


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose `fuente` hasn't been processed."""
    return files.join(done.select("fuente"), "fuente", "left_anti")


def ingest(spark: SparkSession, folder: str, store: GraphStore, extractor: Extractor, checkpoint: str, files_per_batch: int | None = None, chars: int | None = None) -> list[dict]:
    """Read all *.txt files that are new since the last call, then stop; what each batch has found, in order. Texts are whole; `chars` truncates them."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.txt$", "")
    return ingest_stream(reader.load(folder).select(name.alias("fuente"), F.col("value").alias("text")), store, extractor, checkpoint, chars)


def ingest_stream(stream: DataFrame, store: GraphStore, extractor: Extractor, checkpoint: str, chars: int | None = None) -> list[dict]:
    """The same for any stream of texts (fuente, text): what is new since the last call with this checkpoint."""
    found: list[dict] = []

    def batch(rows: DataFrame, number: int) -> None:
        found.append({"batch": number} | _upsert(rows, store, extractor, f"batch={number}", (checkpoint, number)))

    texts = stream.select("fuente", "text" if chars is None else F.substring("text", 1, chars).alias("text"))
    texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return found


def _upsert(rows: DataFrame, store: GraphStore, extractor: Extractor, name: str, mark: tuple[str, int] | None = None) -> dict:
    """One batch into the store; its counts are observed as it is written, no job counts again."""
    g, _, errors = extract(rows, extractor)
    done = store.upsert(g, mark)
    failed = Observation()
    errors.observe(failed, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{store.folder}/errors/{name}")
    return {"nodes": done["nodes"], "relations": done["edges"], "errors": failed.get["n"]}


def ingest_some(spark: SparkSession, folder: str, store: GraphStore, extractor: Extractor, limit: int, chars: int | None = None) -> dict:
    """The same without a stream, for the first `limit` files by name; those whose chunks the store has are skipped."""
    first = corpus(spark, folder, chars).orderBy("fuente").limit(limit)
    rest = pending(first, store.load().docs.select("fuente").distinct())
    return _upsert(cut(rest), store, extractor, f"version={(store.versions() or [0])[-1] + 1}")
