"""The property graph as DataFrames: nodes(id, tipos, tipo, origen), edges(src, rel, dst, origen), docs and mentions.

Graphs are immutable; every operation returns a new one. Provenance links (mentions) are a table of their own, so no
domain query can run through them by accident.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import defaults as D

NODES = "id string, tipos array<string>, tipo string, origen string"
EDGES = "src string, rel string, dst string, origen string"
DOCS = "doc_id string, fuente string, chunk int, text string, embedding array<float>"
MENTIONS = "doc_id string, entity_id string"
GROUPS = "detector string, tipo string, canonico string, variantes array<string>, aprobado boolean, nota string"


@dataclasses.dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    docs: DataFrame | None = None
    mentions: DataFrame | None = None

    def with_(self, **changes) -> Graph:
        return dataclasses.replace(self, **changes)


def first_type(tipos: Column, base: str = "__Entity__") -> Column:
    """The first label that isn't the base label; null if there is none."""
    return F.try_element_at(F.filter(tipos, lambda x: x != base), F.lit(1))


def declared_order(tipos: Column, order: list[str]) -> Column:
    """Labels in order of declaration, others after them by name."""
    known = F.filter(F.array(*(F.lit(t) for t in order)), lambda t: F.array_contains(tipos, t))
    return F.concat(known, F.array_sort(F.array_except(F.array_distinct(tipos), F.array(*(F.lit(t) for t in order)))))


def graph(nodes: DataFrame, edges: DataFrame, docs: DataFrame | None = None, mentions: DataFrame | None = None, order: list[str] | None = None) -> Graph:
    """A graph from loose tables: nodes (id, tipo[, origen]), one row an id and label; edges (src, rel, dst[, origen]).

    One node an id, with all its labels and the least origin; edges are distinct triples. Null ids and parts are dropped."""
    blank = F.lit(None).cast("string")
    n = nodes if "origen" in nodes.columns else nodes.withColumn("origen", blank)
    e = edges if "origen" in edges.columns else edges.withColumn("origen", blank)
    labels = n.where("id is not null").groupBy("id").agg(F.collect_set("tipo").alias("tipos"), F.min("origen").alias("origen"))
    labels = labels.withColumn("tipos", declared_order(F.col("tipos"), D.ENTITY_TYPES if order is None else order))
    return Graph(
        labels.select("id", "tipos", first_type(F.col("tipos")).alias("tipo"), "origen"),
        e.where("src is not null and rel is not null and dst is not null").groupBy("src", "rel", "dst").agg(F.min("origen").alias("origen")),
        docs,
        mentions,
    )


def empty(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (NODES, EDGES, DOCS, MENTIONS)))
