"""Paths from both ends against a plain search: hubs, parallel edges, ties, limits, landmarks, parts that aren't connected."""

import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import paths


def brute(edges, pairs, most):
    """{pair: (hops, least sequence of facts, nodes)}."""
    step: dict = {}
    for s, r, d in edges:
        if s != d:
            text = f"{s} -{r}-> {d}"
            for x, y in ((s, d), (d, s)):
                step.setdefault(x, {})
                step[x][y] = min(step[x].get(y, text), text)
    out = {}
    for p, a, b in pairs:
        if a == b or a not in step or b not in step:
            continue
        level, seen, hops = {a: ((), (a,))}, {a}, 0
        while level and b not in level and (most is None or hops < most):
            hops += 1
            new: dict = {}
            for x, (facts, nodes) in level.items():
                for y, text in step[x].items():
                    if y not in seen:
                        path = (facts + (text,), nodes + (y,))
                        new[y] = min(new.get(y, path), path)
            seen |= set(new)
            level = new
        if b in level:
            out[p] = (hops, *level[b])
    return out


def run(spark, edges, pairs, most, marks=None, **kw):
    e = spark.createDataFrame(edges, "src string, rel string, dst string")
    q = spark.createDataFrame(pairs, "pair_id long, a string, b string")
    m = paths.landmarks(e, *marks) if marks else None
    return {r.pair_id: (r.hops, tuple(r.pasos), tuple(r.nodos)) for r in paths.shortest_paths(e, q, most, marks=m, **kw).collect()}


def some_graph(rng):
    """A sparse part, a hub with leaves, a chain, a part of its own, parallel edges and loops."""
    n = [f"n{i}" for i in range(40)]
    edges = [(rng.choice(n), rng.choice("RS"), rng.choice(n)) for _ in range(55)]
    edges += [("hub", "H", x) for x in n[:15]] + [("hub", "H", f"leaf{i}") for i in range(20)]
    edges += [(f"c{i}", "C", f"c{i + 1}") if i % 2 else (f"c{i + 1}", "C", f"c{i}") for i in range(14)] + [("c0", "C", "hub")]
    edges += [("x1", "R", "x2"), ("x2", "S", "x1"), ("x2", "R", "x3"), ("n1", "R", "n1")]
    return edges, [*n, "hub", "leaf0", "leaf1", "c3", "c9", "c14", "x1", "x3", "nobody"]


@pytest.mark.parametrize("most", [None, 3])
def test_equal_to_a_plain_search(spark, most):
    rng = random.Random(most or 0)
    edges, names = some_graph(rng)
    pairs = [(i, rng.choice(names), rng.choice(names)) for i in range(60)]
    pairs += [(100, "leaf0", "leaf1"), (101, "leaf0", "hub"), (102, "hub", "leaf1"), (103, "x1", "n1"), (104, "c14", "leaf0"), (105, "x3", "x1")]
    want = brute(edges, pairs, most)
    assert run(spark, edges, pairs, most) == want
    assert run(spark, edges, pairs, most, (4, 20) if most else (2, 3)) == want  # followed to their ends, or not


def test_no_hops_and_no_pairs(spark):
    edges, pairs = [("a", "R", "b"), ("b", "R", "c")], [(1, "a", "c"), (2, "a", "b")]
    assert run(spark, edges, pairs, 0) == {} and set(run(spark, edges, pairs, 1)) == {2}
    e = spark.createDataFrame(edges, "src string, rel string, dst string")
    none = spark.createDataFrame([], "pair_id long, a string, b string")
    assert paths.shortest_paths(e, none).collect() == [] == paths.shortest_paths(e.limit(0), spark.createDataFrame(pairs, none.schema)).collect()


def test_a_hub_next_to_one_end_is_entered_from_the_other(spark):
    """From the hub there are hundreds of ways on, from the other end a few: rows stay few."""
    edges = [("hub", "R", f"m{i}") for i in range(400)] + [(f"m{i}", "R", f"z{i}") for i in range(400)] + [(f"z{i}", "R", f"y{i % 50}") for i in range(400)]
    edges += [("p", "R", "q"), ("q", "R", "z7"), ("z7", "R", "m7")]
    trace: list = []
    got = run(spark, edges, [(1, "hub", "p")], None, trace=trace)
    assert got == brute(edges, [(1, "hub", "p")], None) and got[1][0] == 4
    assert sum(rows for *_, rows, _ in trace) < 450


def test_landmarks_prove_that_there_is_no_path(spark):
    edges = [("h", "R", f"a{i}") for i in range(30)] + [(f"a{i}", "R", f"b{i}") for i in range(30)] + [("o1", "R", "o2"), ("o2", "R", "o3")]
    trace: list = []
    assert run(spark, edges, [(1, "b1", "o3"), (2, "o1", "b2")], None, (1, 9), trace=trace) == {} and trace == []
    run(spark, edges, [(1, "b1", "o3")], None, trace=trace)
    assert trace


@pytest.mark.parametrize("block", [4096, 8])
def test_paths_of_three_steps_that_landmarks_know_are_not_searched(spark, monkeypatch, block):
    """Hubs that all shops share, hundreds of ways on from each end: no level of a search is made, lists of neighbours are cut into blocks or not."""
    monkeypatch.setattr(paths, "LIST", block)
    rng = random.Random(5)
    shops = [f"s{i:02}" for i in range(60)]
    edges = [(f"c{i:03}", "BUYS", s) for i in range(200) for s in rng.sample(shops, 4)]
    edges += [(s, "SELLS", f"p{k}") for s in shops for k in range(4)] + [(s, "IN", f"n{i % 3}") for i, s in enumerate(shops)]
    pairs = [(i, f"c{i:03}", rng.choice(shops)) for i in range(200)]
    trace: list = []
    got = run(spark, edges, pairs, 6, (8, 12), trace=trace)
    assert got == brute(edges, pairs, 6) and {g[0] for g in got.values()} == {1, 3}
    assert trace == []


def test_names_with_arrows_go_by_the_search(spark):
    edges = [("a", "R", "b -R-> c"), ("a", "R-> b -R", "c"), ("b -R-> c", "S", "h"), ("c", "S", "h"), ("h", "R", "z"), ("h", "R", "y"), ("h", "R", "x")]
    assert run(spark, edges, [(1, "a", "z")], 6, (1, 9)) == brute(edges, [(1, "a", "z")], 6)


def test_contexts_take_landmarks_and_each_entity_is_ranked_once(spark):
    """Blocks of a hub that all questions name: the first facts of each, with and without landmarks."""
    from kgloom.operators import retrieve

    edges = spark.createDataFrame([("hub", "R", f"m{i:02}") for i in range(30)] + [(f"m{i:02}", "S", "end") for i in range(30)], "src string, rel string, dst string")
    detected = spark.createDataFrame([(q, e) for q in range(3) for e in ("hub", "end", f"m{q:02}")], "question_id long, id string")
    near = {r.question_id: r.bloque.split("\n")[1:] for r in retrieve.neighbour_blocks(detected, edges, most=40).collect()}
    facts = sorted([f"hub -R-> m{i:02}" for i in range(30)] + [f"m{i:02} -S-> end" for i in range(30)])
    assert near == {q: facts[:40] for q in range(3)}
    marked = retrieve.path_blocks(detected, edges, marks=paths.landmarks(edges, 2)).collect()
    assert len(marked) == 3 and all("m00 -S-> end\n  hub -R-> m00" in r.bloque for r in marked)


def test_tables_of_a_search_are_shuffled(spark, monkeypatch):
    """The driver collects no table that grows with the pairs: files of names are small, so the planner would have them sent to every task."""
    edges = spark.createDataFrame([(f"c{i}", "IN", f"n{i % 5}") for i in range(40)] + [(f"n{i}", "OF", f"r{i % 2}") for i in range(5)], "src string, rel string, dst string")
    pairs = spark.createDataFrame([(i, f"c{i}", f"c{39 - i}") for i in range(20)], "pair_id long, a string, b string")
    want = sorted(map(str, paths.shortest_paths(edges, pairs, None).collect()))
    monkeypatch.setattr("kgloom.plans.session.SENT_ROWS", 0)
    found = sorted(map(str, paths.shortest_paths(edges, pairs, None).collect()))
    assert found == want and len(want) > 10
    plan = lambda: paths.written(pairs).join(edges, F.col("a") == F.col("src"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan() and "Broadcast" not in plan()
    monkeypatch.undo()
    assert "Broadcast" in plan()
