"""File sources and sinks: corpora, merge groups, search and career responses; the graph store is in store.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import defaults as D
from ..plans.session import cut
from .store import Conflict, GraphStore

__all__ = ["Conflict", "GraphStore", "best_hit", "careers", "corpus", "exists", "read_groups", "write_groups"]


def corpus(spark: SparkSession, folder: str, chars: int | None = D.DOCUMENT_CHARS) -> DataFrame:
    """(fuente, text) of each *.txt file in a folder, whole; `chars` truncates as a download does (None: whole texts)."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    text = F.col("value") if chars is None else F.substring("value", 1, chars)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("fuente"), text.alias("text"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Merge groups from JSON: one object a line, as `write_groups` writes them, or files with one array each. Those of an array
    have their place in it as a further column, `ord`: lists that share names are applied in that order."""
    head = spark.read.text(path).where("trim(value) <> ''").first()
    if head is None or not head.value.lstrip().startswith("["):
        return spark.read.schema(model.GROUPS).json(path)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in model.GROUPS.split(', '))}>>")).alias("ord", "g")).select("g.*", F.col("ord").cast("long"))


def write_groups(groups: DataFrame, path: str) -> None:
    """Write one object a line. The groups may come from the same path: they are cut from it before it is written again."""
    cut(groups).orderBy("detector", "tipo", "canonico").write.mode("overwrite").json(path)


def best_hit(responses: DataFrame, hints: list[str] | None = None) -> DataFrame:
    """responses (nombre, json) of a name search -> (nombre, qid): the first of at most five hits whose description has a hint, else
    the first hit, else null."""
    found = F.from_json("json", "search array<struct<id:string,description:string>>")["search"]
    hits = responses.select("nombre", F.posexplode_outer(F.slice(F.coalesce(found, F.array().cast("array<struct<id:string,description:string>>")), 1, 5)).alias("pos", "hit"))
    hint = F.coalesce(F.lower("hit.description").rlike("|".join(D.SEARCH_HINTS if hints is None else hints)), F.lit(False))
    w = Window.partitionBy("nombre").orderBy(hint.desc(), "pos")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").select("nombre", F.col("hit.id").alias("qid"))


def careers(responses: DataFrame) -> DataFrame:
    """responses (nombre, json) of a career query -> (nombre, tipo, equipo, inicio, fin); years have four characters or are empty, rows
    without a translated label are left out."""
    value = "struct<value:string>"
    rows = F.from_json("json", f"results struct<bindings:array<struct<tipo:{value},equipoLabel:{value},inicio:{value},fin:{value}>>>")["results"]["bindings"]
    year = lambda c: F.coalesce(F.substring(f"b.{c}.value", 1, 4), F.lit("")).alias(c)
    out = responses.select("nombre", F.explode(rows).alias("b")).where(~F.col("b.equipoLabel.value").rlike("^Q[0-9]+$"))
    return out.select("nombre", F.col("b.tipo.value").alias("tipo"), F.col("b.equipoLabel.value").alias("equipo"), year("inicio"), year("fin"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
