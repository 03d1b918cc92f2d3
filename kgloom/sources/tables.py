"""Graphs from tables: the star schema and the words of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.session import written

STAR_TYPES = ["Region", "Nation", "Customer", "Supplier", "Product", "Brand"]
HIERARCHY = ["LOCATED_IN", "PART_OF"]
RELATIONS = ["LOCATED_IN", "PART_OF", "BOUGHT_FROM", "SUPPLIES", "MADE_BY"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _typed(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df.select(F.col(column).alias("id"), F.lit(kind).alias("tipo"))


def star_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (id, tipo, tipos, origen)."""
    t = lambda name: read(spark, folder, name)
    parts = [("region", "r_name", "Region"), ("nation", "n_name", "Nation"), ("customer", "c_name", "Customer"), ("supplier", "s_name", "Supplier"), ("part", "p_name", "Product"), ("part", "p_brand", "Brand")]
    one, *rest = (_typed(t(name), column, kind) for name, column, kind in parts)
    for r in rest:
        one = one.unionByName(r)
    return one.distinct().select("id", F.array("tipo").alias("tipos"), "tipo", F.lit(None).cast("string").alias("origen"))


def _numbered(df: DataFrame, key: str, name: str, number: str) -> tuple[DataFrame, DataFrame]:
    """(key, number) and (number, name): each different name has a number, so rows that meet by keys are made distinct by two longs, not by texts."""
    names = written(df.select(name).distinct().withColumn(number, F.monotonically_increasing_id()))
    of = names.withColumnRenamed(name, "__name")
    return df.select(key, name).join(of, F.col(name).eqNullSafe(F.col("__name"))).select(key, number), names


def star_edges(spark: SparkSession, folder: str, relations: list[str] | None = None) -> DataFrame:
    """Distinct (src, rel, dst, origen) of the asked relations; only the tables that they need are read. Each relation is made distinct on its
    own, those of order lines before they get their names."""
    wanted = RELATIONS if relations is None else relations
    t = lambda name: read(spark, folder, name)
    parts: list[DataFrame] = []
    edge = lambda df, src, rel, dst: df.select(F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(dst).alias("dst"))
    if "LOCATED_IN" in wanted:
        nation = t("nation").select("n_nationkey", "n_name")
        one, two = (edge(t(name).join(nation, F.col(key) == F.col("n_nationkey")), label, "LOCATED_IN", "n_name") for name, key, label in (("customer", "c_nationkey", "c_name"), ("supplier", "s_nationkey", "s_name")))
        parts.append(one.unionByName(two).distinct())
    if "PART_OF" in wanted:
        parts.append(edge(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "PART_OF", "r_name").distinct())
    if {"BOUGHT_FROM", "SUPPLIES"} & set(wanted):
        s_of, s_names = _numbered(t("supplier"), "s_suppkey", "s_name", "s_number")
    if "BOUGHT_FROM" in wanted:
        c_of, c_names = _numbered(t("customer"), "c_custkey", "c_name", "c_number")
        bought = t("orders").select("o_orderkey", "o_custkey").join(c_of, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_number")
        pairs = t("lineitem").select("l_orderkey", "l_suppkey").join(s_of, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_number")
        pairs = pairs.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select("c_number", "s_number").distinct()
        parts.append(edge(pairs.join(c_names, "c_number").join(s_names, "s_number"), "c_name", "BOUGHT_FROM", "s_name"))
    if "SUPPLIES" in wanted:
        p_of, p_names = _numbered(t("part"), "p_partkey", "p_name", "p_number")
        pairs = t("lineitem").select("l_suppkey", "l_partkey").join(p_of, F.col("l_partkey") == F.col("p_partkey")).join(s_of, F.col("l_suppkey") == F.col("s_suppkey"))
        parts.append(edge(pairs.select("s_number", "p_number").distinct().join(s_names, "s_number").join(p_names, "p_number"), "s_name", "SUPPLIES", "p_name"))
    if "MADE_BY" in wanted:
        parts.append(edge(t("part"), "p_name", "MADE_BY", "p_brand").distinct())
    one, *rest = parts
    for r in rest:
        one = one.unionByName(r)
    return one.withColumn("origen", F.lit(None).cast("string"))


def star(spark: SparkSession, folder: str, relations: list[str] | None = None) -> Graph:
    return Graph(star_nodes(spark, folder), star_edges(spark, folder, relations))


def mentions_of_words(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, tipo, id): the capitalised words of four letters or more in each document; tipo is its language."""
    word = F.explode(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{L}{3,})"), F.lit(1))).alias("id")
    return docs.select("doc_id", F.col("lang").alias("tipo"), word).distinct()


def word_entities(docs: DataFrame, least: int = 2) -> DataFrame:
    """(id, tipo, grado): words that so many documents of a language have, with their number."""
    return mentions_of_words(docs).groupBy("tipo", "id").agg(F.count("*").alias("grado")).where(F.col("grado") >= least).select("id", "tipo", "grado")
