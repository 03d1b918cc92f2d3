"""Whitelists and truths in two parts (who has which list, what a list has) give what their pairs give, and the pairs are never made."""

from kgloom.model import Graph
from kgloom.operators import audit, graphs


def tables(spark):
    edges = spark.createDataFrame([(f"s{i}", "SUPPLIES", f"t{(i * k) % 7}", None) for i in range(12) for k in (1, 3, 4)], "src string, rel string, dst string, origen string").distinct()
    nodes = spark.createDataFrame([(f"s{i}", "S") for i in range(11)], "id string, tipo string")
    members = spark.createDataFrame([(f"s{i}", i % 3) for i in range(0, 14, 2)] + [("s4", 0), ("s6", 9)], "persona string, lista int")
    lists = spark.createDataFrame([(k % 4, n) for k in range(8) for n in (f"t{k}", f"T{k} Club F. C.")], "lista int, equipo string")
    return edges, nodes, members, lists


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_truth_in_two_parts(spark):
    edges, nodes, members, lists = tables(spark)
    truth = members.join(lists, "lista").selectExpr("'SUPPLIES' AS rel", "persona", "equipo")
    assert rows(audit.counted_lists(edges, nodes, members, lists, "SUPPLIES")) == rows(audit.counted(edges, nodes, truth))
    left = edges.selectExpr("src AS persona", "dst AS a")
    pairs = audit.same_entity(left, truth.selectExpr("persona", "equipo AS b").distinct(), ["persona"])
    assert rows(audit.same_listed(left, members, lists).select("persona", "a", "b").distinct()) == rows(pairs)


def test_whitelist_in_two_parts(spark):
    edges, nodes, members, lists = tables(spark)
    members = members.where("lista < 9").withColumnRenamed("persona", "src")
    lists = lists.withColumnRenamed("equipo", "dst")
    pairs = members.join(lists, "lista").select("src", "dst").distinct()
    g = Graph(nodes, edges)
    assert rows(graphs.enforce_lists(g, members, lists, "SUPPLIES").edges) == rows(graphs.enforce_whitelist(g, pairs, "SUPPLIES").edges)


def test_order_lines_are_distinct_before_they_have_names(spark, tmp_path):
    """Equal names of several keys, a key of two names and a missing name; lines are made distinct by numbers, not by names."""
    from kgloom.sources import tables

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("customer", [(1, "Ana"), (2, "Ana"), (3, "Eva"), (3, "Leo"), (4, None)], "c_custkey long, c_name string")
    put("supplier", [(1, "S"), (2, "S"), (3, "T")], "s_suppkey long, s_name string")
    put("part", [(1, "nut"), (2, "nut"), (3, None)], "p_partkey long, p_name string")
    put("orders", [(10 + c, c) for c in (1, 2, 3, 4, 9)], "o_orderkey long, o_custkey long")
    put("lineitem", [(11, 1, 1), (12, 2, 2), (13, 3, 3), (14, 1, 3), (19, 1, 1), (11, 2, 1)], "l_orderkey long, l_partkey long, l_suppkey long")
    found = tables.star_edges(spark, str(tmp_path), ["BOUGHT_FROM", "SUPPLIES"])
    want = {("Ana", "BOUGHT_FROM", "S"), ("Eva", "BOUGHT_FROM", "T"), ("Leo", "BOUGHT_FROM", "T"), (None, "BOUGHT_FROM", "T"), ("S", "SUPPLIES", "nut"), ("T", "SUPPLIES", "nut"), ("T", "SUPPLIES", None)}
    got = [(r.src, r.rel, r.dst) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate(keys=[c_number" in plan and "Aggregate(keys=[src" not in plan
