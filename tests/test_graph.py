import random

import pytest

from kgloom import model
from kgloom.operators import export, graphs, paths
from kgloom.plans.session import shared_dir


def make(spark, nodes, edges, mentions=None):
    n = spark.createDataFrame(nodes, "id string, tipo string")
    e = spark.createDataFrame(edges, "src string, rel string, dst string")
    m = None if mentions is None else spark.createDataFrame(mentions, model.MENTIONS)
    return model.graph(n, e, mentions=m, order=["A", "B"])


def triples(g):
    return {(r.src, r.rel, r.dst) for r in g.edges.collect()}


def test_graph_unites_labels_and_drops_nulls(spark):
    g = make(spark, [("x", "B"), ("x", "A"), ("y", None), (None, "A")], [("x", "R", "y"), ("x", "R", "y"), (None, "R", "y")])
    assert {(r.id, tuple(r.tipos), r.tipo) for r in g.nodes.collect()} == {("x", ("A", "B"), "A"), ("y", (), None)}
    assert triples(g) == {("x", "R", "y")}


def test_degrees_and_self_loops(spark):
    g = make(spark, [("a", "A"), ("b", "A"), ("c", "A")], [("a", "R", "b"), ("a", "S", "b"), ("a", "R", "a")])
    assert {r.id: r.grado for r in graphs.degree(g).collect()} == {"a": 3, "b": 2, "c": 0}
    assert {r.id: r.grado for r in graphs.endpoint_degree(g.edges).collect()} == {"a": 4, "b": 2}
    assert graphs.undirected(g.edges).count() == 5


def test_neighbourhood_keeps_stored_direction(spark):
    g = make(spark, [("a", "A")], [("a", "R", "b"), ("c", "S", "a"), ("c", "S", "d")])
    ids = spark.createDataFrame([("a",)], "id string")
    assert [r.hecho for r in graphs.neighbourhood(g.edges, ids, most=60).collect()] == ["a -R-> b", "c -S-> a"]
    assert graphs.neighbourhood(g.edges, ids, ["S"], 60).count() == 1 and graphs.neighbourhood(g.edges, ids, most=1).count() == 1


def test_deletions_and_whitelist(spark):
    g = make(spark, [("a", "A"), ("b", "B"), ("c", "B")], [("a", "R", "b"), ("a", "R", "c"), ("b", "S", "c"), ("z", "R", "c")], [("d1", "a"), ("d1", "b")])
    gone = graphs.detach_delete(g, spark.createDataFrame([("b",), ("nope",)], "id string"))
    assert triples(gone) == {("a", "R", "c"), ("z", "R", "c")} and gone.nodes.count() == 2 and gone.mentions.count() == 1
    listed = spark.createDataFrame([("a", "R", "b", "why"), ("a", "R", "x", "why")], "src string, rel string, dst string, motivo string")
    assert graphs.existing_edges(g.edges, listed).count() == 1 and triples(graphs.delete_edges(g, listed)) == triples(g) - {("a", "R", "b")}
    white = spark.createDataFrame([("a", "c")], "src string, dst string")
    assert triples(graphs.enforce_whitelist(g, white, "R")) == triples(g) - {("a", "R", "b")}


def test_contraction(spark):
    g = make(spark, [("v1", "B"), ("v2", "A"), ("k", "A"), ("o", "A")], [("v1", "R", "o"), ("v2", "R", "o"), ("o", "S", "v1"), ("v1", "T", "v2")], [("d", "v1"), ("d", "v2")])
    mapping = spark.createDataFrame([("v1", "k", 1), ("v2", "k", 2)], "variante string, canonico string, ord int")
    out = graphs.contract(g, mapping)
    assert triples(out) == {("k", "R", "o"), ("o", "S", "k"), ("k", "T", "k")}
    assert {(r.id, tuple(r.tipos)) for r in out.nodes.collect()} == {("k", ("A", "B")), ("o", ("A",))} and out.mentions.count() == 1
    assert triples(graphs.contract(g, mapping, drop_self_loops=True)) == {("k", "R", "o"), ("o", "S", "k")}
    assert triples(graphs.contract(out, mapping)) == triples(out)
    new = graphs.contract(g, spark.createDataFrame([("v1", "new", 0)], "variante string, canonico string, ord int"))
    assert "new" in {r.id for r in new.nodes.collect()}


def test_chains_are_followed_and_cycles_raise(spark):
    chain = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "d", 0), ("x", "x", 0)], "variante string, canonico string, ord int")
    assert {(r.variante, r.canonico) for r in graphs.resolved(chain).collect()} == {("a", "d"), ("b", "d"), ("c", "d")}
    cycle = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0)], "variante string, canonico string, ord int")
    with pytest.raises(ValueError, match="cycle"):
        graphs.resolved(cycle)
    n = 1000
    long = spark.range(n).selectExpr("cast(id as string) as variante", "cast(id + 1 as string) as canonico", "0 as ord")
    assert {r.canonico for r in graphs.resolved(long).select("canonico").distinct().collect()} == {str(n)}


def test_aliases_need_two_present_names(spark):
    aliases = spark.createDataFrame([("Canon", "v1", 0), ("Canon", "v2", 1), ("Alone", "w", 0)], "canonico string, variante string, ord int")
    g = make(spark, [("v1", "A"), ("v2", "A"), ("w", "A")], [("v1", "R", "w"), ("v2", "R", "w")])
    assert {r.id for r in graphs.merge_aliases(g, aliases).nodes.collect()} == {"Canon", "w"}
    assert {r.id for r in graphs.merge_aliases(g, aliases, rename_singletons=True).nodes.collect()} == {"Canon", "Alone"}


def test_years_merge_and_rename(spark):
    n = spark.createDataFrame([("Cup 2001", "Competicion"), ("Cup 2002", "Competicion"), ("Cup", "Competicion"), ("Liga 1999", "Competicion"), ("Old 1990", "Club")], "id string, tipo string")
    g = model.graph(n, spark.createDataFrame([("x", "GANO", "Cup 2001"), ("x", "GANO", "Cup 2002")], "src string, rel string, dst string"))
    out = graphs.merge_years(g)
    assert {r.id for r in out.nodes.collect()} == {"Cup", "Liga", "Old 1990"} and triples(out) == {("x", "GANO", "Cup")}
    assert graphs.year_groups(out.nodes).count() == 0


def test_repair_adds_only_what_is_missing(spark):
    g = make(spark, [("a", "A"), ("b", "B")], [("a", "R", "b")])
    missing = spark.createDataFrame([("a", "R", "b", "B"), ("a", "R", "new", "B"), ("ghost", "R", "b", "B")], "src string, rel string, dst string, dst_tipo string")
    out = graphs.repair(g, missing)
    assert {(r.src, r.rel, r.dst, r.origen) for r in out.edges.collect()} == {("a", "R", "b", None), ("a", "R", "new", "curado")}
    assert {(r.id, r.origen) for r in out.nodes.collect()} == {("a", None), ("b", None), ("new", "curado")}
    again = graphs.repair(out, missing)
    assert again.edges.count() == 2 and again.nodes.count() == 3


def brute_path(edges, a, b, most):
    if a == b:
        return None
    level = {a: ((), (a,))}
    seen = {a}
    for _ in range(most):
        new = {}
        for node, (steps, way) in level.items():
            for s, r, d in edges:
                for x, y in ((s, d), (d, s)):
                    if x == node and y not in seen and s != d:
                        cand = (*steps, f"{s} -{r}-> {d}"), (*way, y)
                        if y not in new or cand < new[y]:
                            new[y] = cand
        if b in new:
            return new[b]
        seen |= set(new)
        level = new
    return None


def test_paths_equal_brute_force(spark):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(14)]
    edges = sorted({(rng.choice(names), rng.choice("RS"), rng.choice(names)) for _ in range(20)})
    pairs = [(i, rng.choice(names), rng.choice([*names, "nobody"])) for i in range(25)]
    e = spark.createDataFrame(edges, "src string, rel string, dst string")
    p = spark.createDataFrame(pairs, "pair_id long, a string, b string")
    for most in (2, 6, None):
        got = {r.pair_id: (tuple(r.pasos), tuple(r.nodos)) for r in paths.shortest_paths(e, p, most).collect()}
        want = {i: brute_path(edges, a, b, most or 99) for i, a, b in pairs}
        assert got == {i: w for i, w in want.items() if w}


def test_path_bound_of_six_hops(spark):
    line = spark.createDataFrame([(f"p{i}", "R", f"p{i + 1}") for i in range(8)], "src string, rel string, dst string")
    pairs = spark.createDataFrame([(1, "p0", "p6"), (2, "p0", "p7")], "pair_id long, a string, b string")
    assert [r.pair_id for r in paths.shortest_paths(line, pairs).collect()] == [1]
    assert {r.pair_id: r.hops for r in paths.shortest_paths(line, pairs, None).collect()} == {1: 6, 2: 7}


def test_highlight_has_parallel_edges(spark):
    e = spark.createDataFrame([("a", "R", "b"), ("b", "S", "a"), ("b", "R", "c"), ("a", "R", "c2")], "src string, rel string, dst string")
    found = paths.shortest_paths(e, spark.createDataFrame([(1, "a", "c")], "pair_id long, a string, b string"))
    assert {(r.src, r.rel, r.dst) for r in paths.on_path(e, found).collect()} == {("a", "R", "b"), ("b", "S", "a"), ("b", "R", "c")}


def test_page_holds_the_payload(spark):
    g = make(spark, [("a</script>", "A"), ("b", "B"), ("u", None)], [("a</script>", "R", "b"), ("u", "R", "b")])
    edges = export.site_edges(g, ["R"])
    assert edges.count() == 1
    html = export.page(edges, "Title")
    assert "Title" in html and html.count("</script>") == 2
    assert [r.destacado for r in export.site_nodes(edges).collect()] == [False, False]


def test_strict_schema_reports_rejected(spark):
    g = make(spark, [("a", "A"), ("b", "B")], [("a", "R", "b"), ("b", "R", "a")])
    allowed = spark.createDataFrame([("A", "R", "B")], "src_tipo string, rel string, dst_tipo string")
    good, bad = graphs.strict_schema(graphs.typed_edges(g), allowed)
    assert [r.src for r in good.collect()] == ["a"] and [r.src for r in bad.collect()] == ["b"]


def test_shared_dir_is_read_from_the_session(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/kgloom-shared")
