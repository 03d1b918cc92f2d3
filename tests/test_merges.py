"""Merge lists in order: the walk and the rounds against a plain walk over sets, conflicts, chains, what survives."""

import random
import time

import pytest

from kgloom import model
from kgloom.operators import graphs, merges, resolve

LISTS = "prio long, tipo string, canonico string, variantes array<string>"


def brute(lists, nodes, rename, least=2):
    """{original: (name, whether its properties are kept)} of a walk through the lists."""
    holds = {n: [n] for n in nodes}
    for _, _, canonical, variants in sorted(lists, key=lambda r: (r[0], r[1], r[2], [r[2], *(v for v in r[3] if v != r[2])])):
        names = [canonical, *(v for v in variants if v != canonical)]
        here = [n for n in names if n in holds]
        if len(here) >= least:
            merged = [o for n in dict.fromkeys(here) for o in holds.pop(n)]
            holds[canonical if rename else here[0]] = merged
    return {o: (name, i == 0) for name, members in holds.items() for i, o in enumerate(members)}


@pytest.mark.parametrize("rename", [False, True])
def test_equals_a_plain_walk(spark, rename):
    rng = random.Random(rename)
    for least in (2, 1) if rename else (2,):
        names = [f"n{i}" for i in range(60)]
        nodes = rng.sample(names, 45)
        lists = [(rng.randint(0, 3), rng.choice("ab"), rng.choice(names), rng.choices(names, k=rng.randint(0, 4))) for _ in range(30)]
        want = {o: w for o, w in brute(lists, nodes, rename, least).items() if w[0] != o or not w[1]}
        table, there = spark.createDataFrame(lists, LISTS), spark.createDataFrame([(n,) for n in nodes], "id string")
        for walk in (merges.WALK, 0):
            got = {r.variante: (r.canonico, r.ord == 0) for r in merges.in_order(table, there, rename, least, walk).collect()}
            assert got == want


def make(spark, ids, edges):
    return model.graph(spark.createDataFrame([(i, "Club") for i in ids], "id string, tipo string"), spark.createDataFrame(edges, "src string, rel string, dst string"))


def groups(spark, rows):
    return spark.createDataFrame([(d, "Club", c, v, True, None) for d, c, v in rows], model.GROUPS)


def applied(spark, ids, rows):
    g = make(spark, ids, [(f"of {i}", "R", i) for i in ids])
    return {r.src[3:]: r.dst for r in resolve.apply(g, groups(spark, rows)).edges.collect()}


def test_the_canonical_comes_first_and_else_the_first_variant(spark):
    assert applied(spark, "AB", [("prefijo", "A", ["B", "A"])]) == {"A": "A", "B": "A"}
    assert applied(spark, "ABC", [("prefijo", "C", ["A", "B"])]) == {"A": "C", "B": "C", "C": "C"}
    assert applied(spark, "AB", [("prefijo", "C", ["B", "A"])]) == {"A": "B", "B": "B"}
    assert applied(spark, "A", [("prefijo", "C", ["A", None, "A"])]) == {"A": "A"}


def test_conflicting_groups_end_at_once(spark):
    began = time.time()
    assert applied(spark, "AB", [("normalizacion", "A", ["A", "B"]), ("manual", "B", ["B", "A"])]) == {"A": "A", "B": "A"}
    assert applied(spark, "ABC", [("normalizacion", "A", ["A", "B"]), ("manual", "B", ["B", "C"])]) == {"A": "A", "B": "A", "C": "C"}
    assert applied(spark, "ABC", [("normalizacion", "A", ["A", "B"]), ("manual", "C", ["A"])]) == {"A": "C", "B": "C", "C": "C"}
    assert time.time() - began < 100


def test_groups_of_a_file_go_in_its_order(spark, tmp_path):
    from kgloom.sources import files

    path = str(tmp_path / "groups.json")
    with open(path, "w") as out:
        out.write('[{"detector": "manual", "tipo": "Club", "canonico": "B", "variantes": ["A"], "aprobado": true},\n {"detector": "normalizacion", "tipo": "Club", "canonico": "A", "variantes": ["A", "B", "C"], "aprobado": true}]')
    found = files.read_groups(spark, path)
    g = make(spark, "ABC", [("x", "R", i) for i in "ABC"])
    assert {r.id for r in resolve.apply(g, found).nodes.collect()} == {"B"}
    assert {r.id for r in resolve.apply(g, found.drop("ord")).nodes.collect()} == {"A"}


def test_chained_alias_lists(spark):
    aliases = spark.createDataFrame([("B", "A", 0), ("C", "B", 0)], "canonico string, variante string, ord int")
    g = make(spark, "ABC", [("x", "R", "A"), ("x", "S", "B")])
    out = graphs.merge_aliases(g, aliases)
    assert {r.id for r in out.nodes.collect()} == {"C"} and {(r.src, r.rel, r.dst) for r in out.edges.collect()} == {("x", "R", "C"), ("x", "S", "C")}
    # a name that a list has made is there for the next
    made = spark.createDataFrame([("new", "A", 0), ("new", "B", 1), ("C", "new", 2)], "canonico string, variante string, ord int")
    assert {r.id for r in graphs.merge_aliases(g, made).nodes.collect()} == {"C"}


def test_properties_are_those_of_the_first(spark):
    nodes = spark.createDataFrame([("A", "Club", "a"), ("B", "Club", "b"), ("D", "Club", "d")], "id string, tipo string, origen string")
    g = model.graph(nodes, spark.createDataFrame([("A", "R", "B")], "src string, rel string, dst string"))
    aliases = spark.createDataFrame([("X", "D", 0), ("X", "B", 1), ("X", "A", 2)], "canonico string, variante string, ord int")
    assert [(r.id, r.origen) for r in graphs.merge_aliases(g, aliases).nodes.collect()] == [("X", "d")]


def test_no_groups_and_no_nodes(spark):
    none = groups(spark, [("manual", "A", ["B"])]).limit(0)
    g = make(spark, "AB", [("A", "R", "B")])
    assert resolve.apply(g, none).nodes.count() == 2
    assert resolve.apply(g.with_(nodes=g.nodes.limit(0)), groups(spark, [("manual", "A", ["B"]), ("manual", None, ["B"]), ("manual", "A", None)])).nodes.count() == 0
