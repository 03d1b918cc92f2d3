"""Exports: the graph as a JSON payload and as one page."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from .graphs import endpoint_degree, typed_edges

PAGE = """<!DOCTYPE html>
<html lang="es"><head><meta charset="utf-8"><title>{title}</title></head>
<body><h1>{title}</h1><p id="totals"></p><ul id="edges"></ul>
<script type="application/json" id="data">{data}</script>
<script>
const graph = JSON.parse(document.getElementById("data").textContent);
document.getElementById("totals").textContent = graph.nodos.length + " nodes, " + graph.aristas.length + " edges";
for (const e of graph.aristas) {{
  const li = document.createElement("li");
  li.textContent = e.from + " -" + e.tipo + "-> " + e.to;
  document.getElementById("edges").append(li);
}}
</script></body></html>
"""


def site_edges(g: Graph, relations: list[str]) -> DataFrame:
    """Typed edges of the exported relations; those with an untyped end are left out."""
    return typed_edges(g, relations).where("src_tipo is not null and dst_tipo is not null")


def site_nodes(edges: DataFrame, highlighted: int = 3) -> DataFrame:
    """(id, tipo, grado, destacado): the ends of the exported edges; `destacado` from so many ends on."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("src_tipo").alias("tipo")), F.struct(F.col("dst").alias("id"), F.col("dst_tipo").alias("tipo")))).alias("n"))
    types = ends.groupBy("n.id").agg(F.min("n.tipo").alias("tipo"))
    return types.join(endpoint_degree(edges), "id").select("id", "tipo", "grado", (F.col("grado") >= highlighted).alias("destacado"))


def payload(edges: DataFrame) -> DataFrame:
    """One row (json): {nodos, aristas}, sorted. The page's data end in one file by nature, so this is for graphs to be looked at."""
    nodes = site_nodes(edges).agg(F.sort_array(F.collect_list(F.struct("id", "tipo"))).alias("nodos"))
    links = edges.agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("rel").alias("tipo")))).alias("aristas"))
    return nodes.crossJoin(links).select(F.to_json(F.struct("nodos", "aristas")).alias("json"))


def page(edges: DataFrame, title: str = "Graph") -> str:
    """The page's text; json.loads of its data block gives the payload."""
    data = payload(edges).first()["json"]
    json.loads(data)
    return PAGE.format(title=title, data=data.replace("</", "<\\/"))
