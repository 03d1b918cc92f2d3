"""Graph operators: patterns, degrees, neighbourhoods and mutations, as joins and aggregates over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact, strip_year
from ..model import Graph, first_type
from ..plans.session import written
from .merges import in_order


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other, src, rel, dst): every edge seen from both ends, a loop once."""
    one = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "src", "rel", "dst")
    back = edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "src", "rel", "dst")
    return one.unionByName(back)


def typed_edges(g: Graph, relations: list[str] | None = None) -> DataFrame:
    """(src, src_tipo, rel, dst, dst_tipo) of the edges of these relations with their ends' types."""
    e = g.edges if relations is None else g.edges.where(F.col("rel").isin(relations))
    ends = lambda side: g.nodes.select(F.col("id").alias(side), F.col("tipo").alias(f"{side}_tipo"))
    return e.join(ends("src"), "src").join(ends("dst"), "dst").select("src", "src_tipo", "rel", "dst", "dst_tipo")


def type_counts(g: Graph) -> DataFrame:
    return g.nodes.groupBy("tipo").agg(F.count("*").alias("n"))


def relation_counts(g: Graph) -> DataFrame:
    return g.edges.groupBy("rel").agg(F.count("*").alias("n"))


def degree(g: Graph) -> DataFrame:
    """(id, tipo, grado): relationships at a node, 0 for isolated ones; a loop counts once."""
    per = g.edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("grado"))
    return g.nodes.select("id", "tipo").join(per, "id", "left").select("id", "tipo", F.coalesce("grado", F.lit(0)).alias("grado"))


def endpoint_degree(edges: DataFrame) -> DataFrame:
    """(id, grado): ends of edges at a node; a loop counts twice, isolated nodes are absent."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("grado"))


def neighbourhood(edges: DataFrame, ids: DataFrame, relations: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(hecho): distinct facts one hop around the ids (column id), the first `most` by text."""
    e = edges if relations is None else edges.where(F.col("rel").isin(relations))
    near = undirected(e).join(ids.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    facts = near.select(fact(F.col("src"), F.col("rel"), F.col("dst")).alias("hecho")).distinct()
    return facts if most is None else facts.orderBy("hecho").limit(most)


def strict_schema(edges: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed edges (see typed_edges) that the closed schema (src_tipo, rel, dst_tipo) has, and those that it rejects."""
    on = ["src_tipo", "rel", "dst_tipo"]
    return edges.join(allowed, on, "left_semi"), edges.join(allowed, on, "left_anti")


def detach_delete(g: Graph, ids: DataFrame) -> Graph:
    """Without these nodes (column id), their edges and their mentions."""
    gone = lambda name: ids.select(F.col("id").alias(name))
    kept = g.edges.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select(*g.edges.columns)
    links = None if g.mentions is None else g.mentions.join(gone("entity_id"), "entity_id", "left_anti").select(*g.mentions.columns)
    return g.with_(nodes=g.nodes.join(gone("id"), "id", "left_anti"), edges=kept, mentions=links)


def existing_edges(edges: DataFrame, listed: DataFrame) -> DataFrame:
    """Those of the listed triples that the graph has: what a deletion would remove."""
    return listed.join(edges.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_semi")


def delete_edges(g: Graph, listed: DataFrame) -> Graph:
    return g.with_(edges=g.edges.join(listed.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_anti").select(*g.edges.columns))


def outside_whitelist(edges: DataFrame, whitelist: DataFrame, rel: str) -> DataFrame:
    """Edges of one relation from listed sources (whitelist: src, dst) to targets that their list doesn't have."""
    mine = edges.where(F.col("rel") == rel).join(whitelist.select("src").distinct(), "src", "left_semi")
    return mine.join(whitelist.select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns)


def enforce_whitelist(g: Graph, whitelist: DataFrame, rel: str) -> Graph:
    return delete_edges(g, outside_whitelist(g.edges, whitelist, rel))


def outside_lists(edges: DataFrame, members: DataFrame, lists: DataFrame, rel: str) -> DataFrame:
    """The same for a whitelist in two parts, members (src, lista) and lists (lista, dst): targets that many sources share are listed once. A
    source may have several lists; an edge is looked up in each, so the pairs of sources and targets are never made."""
    mine = edges.where(F.col("rel") == rel)
    listed = members.select("src", "lista").distinct()
    allowed = mine.join(listed, "src").join(lists.select("lista", "dst"), ["lista", "dst"], "left_semi").select("src", "dst").distinct()
    return mine.join(listed.select("src").distinct(), "src", "left_semi").join(allowed, ["src", "dst"], "left_anti").select(*edges.columns)


def enforce_lists(g: Graph, members: DataFrame, lists: DataFrame, rel: str) -> Graph:
    return delete_edges(g, outside_lists(g.edges, members, lists, rel))


def resolved(mapping: DataFrame) -> DataFrame:
    """A map (variante, canonico, ord) in which no target is a key itself: chains are followed to their ends.

    Each round halves the chains that are left, so a map of n rows without a cycle is done after log2(n) + 1 rounds: if rows still move
    then, that raises. Rounds are written and read again, which keeps the planner's estimates true."""
    now = written(mapping.where("variante <> canonico").select("variante", "canonico", "ord"))
    for _ in range(now.count().bit_length() + 2):
        step = now.select(F.col("variante").alias("canonico"), F.col("canonico").alias("next"))
        again = written(now.join(step, "canonico", "left").select("variante", F.coalesce("next", "canonico").alias("canonico"), "ord", F.col("next").isNotNull().alias("moved")))
        if not again.where("moved").limit(1).count():
            return now
        now = again.drop("moved")
    raise ValueError("the map has a cycle")


def contract(g: Graph, mapping: DataFrame, drop_self_loops: bool = False) -> Graph:
    """Merge nodes along a map (variante, canonico, ord): each variant becomes its canonical, which need not exist.

    The canonical's own properties come first, then those of the least ord; labels are united; edges and mentions are
    pointed anew, and equal ones become one with the least origin."""
    to = mapping.groupBy("variante").agg(F.min(F.struct("ord", "canonico")).alias("m")).select("variante", "m.canonico", "m.ord")

    def moved(df: DataFrame, column: str) -> DataFrame:
        names = to.select(F.col("variante").alias(column), F.col("canonico").alias("__to"))
        return df.join(names, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")

    ranked = g.nodes.join(to.select(F.col("variante").alias("id"), F.col("canonico").alias("__to"), F.col("ord").alias("__ord")), "id", "left")
    merged = ranked.select(F.coalesce("__to", "id").alias("id"), F.struct(F.when(F.col("__to").isNull(), -1).otherwise(F.col("__ord")).alias("o"), F.col("id").alias("was"), "tipos", "origen").alias("v"))
    nodes = merged.groupBy("id").agg(F.min("v").alias("first"), F.collect_set("v.tipos").alias("all"))
    nodes = nodes.select("id", F.concat("first.tipos", F.array_sort(F.array_except(F.array_distinct(F.flatten("all")), F.col("first.tipos")))).alias("tipos"), F.col("first.origen").alias("origen"))
    edges = moved(moved(g.edges, "src"), "dst").groupBy("src", "rel", "dst").agg(F.min("origen").alias("origen"))
    links = None if g.mentions is None else moved(g.mentions, "entity_id").distinct()
    return g.with_(nodes=nodes.select("id", "tipos", first_type(F.col("tipos")).alias("tipo"), "origen"), edges=edges.where("src <> dst") if drop_self_loops else edges, mentions=links)


def present_aliases(nodes: DataFrame, aliases: DataFrame, least: int = 2) -> DataFrame:
    """(canonico, presentes): of each alias list (canonico, variante, ord) the names in the graph, if at least so many are."""
    names = aliases.select("canonico", F.col("variante").alias("id"), "ord").unionByName(aliases.select("canonico", F.col("canonico").alias("id"), F.lit(-1).cast("int").alias("ord")).distinct())
    there = names.join(nodes.select("id"), "id", "left_semi")
    return there.groupBy("canonico").agg(F.sort_array(F.collect_set(F.struct("ord", "id"))).alias("p")).where(F.size("p") >= least).select("canonico", F.transform("p", lambda x: x["id"]).alias("presentes"))


def merge_aliases(g: Graph, aliases: DataFrame, rename_singletons: bool = False) -> Graph:
    """Merge each alias list (canonico, variante, ord) of which two names or more are in the graph, under its canonical name. Lists go by their
    least ord, then by name, one after the other: a later list finds what the earlier ones have left."""
    named = aliases.groupBy("canonico").agg(F.min("ord").cast("long").alias("prio"), F.sort_array(F.collect_set(F.struct("ord", "variante"))).alias("v"))
    lists = named.select("prio", F.lit("").alias("tipo"), "canonico", F.transform("v", lambda x: x["variante"]).alias("variantes"))
    return contract(g, in_order(lists, g.nodes, rename=True, least=1 if rename_singletons else 2))


def year_groups(nodes: DataFrame, kind: str = "Competicion") -> DataFrame:
    """(canonico, variantes): names of one type that change or meet when years at their end go."""
    clean = nodes.where(F.col("tipo") == kind).select("id", strip_year(F.col("id")).alias("canonico")).where("canonico <> ''")
    found = clean.groupBy("canonico").agg(F.sort_array(F.collect_set("id")).alias("variantes"))
    return found.where((F.size("variantes") > 1) | (F.element_at("variantes", 1) != F.col("canonico")))


def merge_years(g: Graph, kind: str = "Competicion") -> Graph:
    mapping = year_groups(g.nodes, kind).select("canonico", F.posexplode("variantes").alias("ord", "variante")).where("variante <> canonico")
    return contract(g, mapping)


def repair(g: Graph, missing: DataFrame, origin: str = "curado") -> Graph:
    """Add missing edges (src, rel, dst, dst_tipo) and the targets that don't exist, stamped with their origin; what there is
    stays as it is, and sources that don't exist add nothing."""
    wanted = missing.join(g.nodes.select(F.col("id").alias("src")), "src", "left_semi")
    new_nodes = wanted.select(F.col("dst").alias("id"), F.col("dst_tipo").alias("tipo")).groupBy("id").agg(F.min("tipo").alias("tipo")).join(g.nodes, "id", "left_anti")
    new_edges = wanted.select("src", "rel", "dst").distinct().join(g.edges, ["src", "rel", "dst"], "left_anti")
    nodes = g.nodes.unionByName(new_nodes.select("id", F.array("tipo").alias("tipos"), "tipo", F.lit(origin).alias("origen")))
    return g.with_(nodes=nodes, edges=g.edges.unionByName(new_edges.withColumn("origen", F.lit(origin))))
