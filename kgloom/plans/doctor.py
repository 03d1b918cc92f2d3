"""Health checks of a store, cheap ones first; all failures are gathered."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.retrieve import index_coverage
from ..sources.files import GraphStore


def doctor(spark: SparkSession, folder: str, least_version: tuple[int, int] = (4, 0), dimension: int | None = None) -> list[str]:
    """What is wrong, in order; empty if nothing is."""
    wrong = []
    if tuple(int(x) for x in spark.version.split(".")[:2]) < least_version:
        wrong.append(f"Spark {spark.version} is too old")
    store = GraphStore(spark, folder)
    if not store.versions():
        return [*wrong, "the store has no version"]
    try:
        store.assert_unique()
    except ValueError as e:
        wrong.append(str(e))
    g = store.load()
    loose = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(g.nodes, "id", "left_anti").limit(1).count()
    if loose:
        wrong.append("an edge has an end that is no node")
    c = index_coverage(g.docs).first()
    if c.con_vector < c.total:
        wrong.append(f"{c.total - c.con_vector} of {c.total} chunks have no vector")
    if dimension is not None and c.dimension not in (None, dimension):
        wrong.append(f"vectors have {c.dimension} dimensions, not {dimension}")
    return wrong
