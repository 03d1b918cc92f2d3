"""The store of deltas: what a batch writes, first writers, tombstones, two writers, killed commits, compaction, older versions."""

import os

import pytest

from kgloom import model
from kgloom.sources import store as stores
from kgloom.sources.store import Conflict, GraphStore


def make(spark, nodes, edges, docs=(), mentions=()):
    g = model.graph(spark.createDataFrame(nodes, "id string, tipo string, origen string"), spark.createDataFrame(list(edges), "src string, rel string, dst string, origen string"))
    return g.with_(docs=spark.createDataFrame([(d, "f", 0, t, None) for d, t in docs], model.DOCS), mentions=spark.createDataFrame(list(mentions), model.MENTIONS))


def state(g):
    return (
        sorted((r.id, tuple(r.tipos), r.tipo, r.origen) for r in g.nodes.collect()),
        sorted((r.src, r.rel, r.dst, r.origen) for r in g.edges.collect()),
        sorted((r.doc_id, r.text, r.embedding is not None) for r in g.docs.collect()),
        sorted(tuple(r) for r in g.mentions.collect()),
    )


def written(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, str(tmp_path / "store"))


def test_the_first_writer_keeps_its_properties_and_labels_unite(spark, store):
    assert store.upsert(make(spark, [("a", "Club", "x"), ("b", "Jugador", "x")], [("b", "R", "a", "x")], [("d", "one")], [("d", "a")])) == {"nodes": 2, "edges": 1, "docs": 1, "mentions": 1}
    store.upsert(make(spark, [("a", "Jugador", "y"), ("c", "Club", "y")], [("b", "R", "a", "y"), ("c", "S", "a", "y")], [("d", "two"), ("e", "three")], [("d", "a"), ("e", "c")]))
    want = (
        [("a", ("Jugador", "Club"), "Jugador", "x"), ("b", ("Jugador",), "Jugador", "x"), ("c", ("Club",), "Club", "y")],
        [("b", "R", "a", "x"), ("c", "S", "a", "y")],
        [("d", "one", False), ("e", "three", False)],
        [("d", "a"), ("e", "c")],
    )
    assert state(store.load()) == want
    store.compact()
    assert state(store.load()) == want and store.manifest()["deltas"] == []
    assert [r.deltas for r in store.history().orderBy("version").collect()] == [1, 2, 0]
    assert state(store.load(1))[0] == [("a", ("Club",), "Club", "x"), ("b", ("Jugador",), "Jugador", "x")]


def test_tombstones_hide_what_was_and_not_what_comes(spark, store):
    store.upsert(make(spark, [(i, "Club", "x") for i in "abc"], [("a", "R", "b", "x"), ("b", "R", "c", "x"), ("c", "R", "a", "x")], [("d", "t")], [("d", "a"), ("d", "b")]))
    store.delete(nodes=spark.createDataFrame([("a",), ("nobody",)], "id string"))
    assert [x[0] for x in state(store.load())[0]] == ["b", "c"] and state(store.load())[1] == [("b", "R", "c", "x")] and state(store.load())[3] == [("d", "b")]
    store.delete(edges=spark.createDataFrame([("b", "R", "c")], "src string, rel string, dst string"))
    store.upsert(make(spark, [("a", "Jugador", "y")], [("a", "R", "b", "y")]))
    want = ([("a", ("Jugador",), "Jugador", "y"), ("b", ("Club",), "Club", "x"), ("c", ("Club",), "Club", "x")], [("a", "R", "b", "y")])
    assert state(store.load())[:2] == want
    store.compact()
    assert state(store.load())[:2] == want
    store.replace_docs(store.load().docs.selectExpr("doc_id", "fuente", "chunk", "text", "array(1f) AS embedding"))
    assert state(store.load())[2] == [("d", "t", True)]


def test_a_batch_writes_in_proportion_to_itself(spark, store):
    n = 20_000
    big = spark.range(n).selectExpr("concat('node ', sha2(cast(id as string), 256)) AS id", "'Club' AS tipo", "'x' AS origen")
    store.save(model.graph(big, big.selectExpr("id AS src", "'R' AS rel", "id AS dst", "'x' AS origen")))
    before = written(store.folder)
    store.upsert(make(spark, [("new", "Club", "y")], [("new", "R", "new", "y")]))
    assert written(store.folder) - before < before / 20
    assert store.load().nodes.count() == n + 1


def test_a_killed_commit_and_a_replay_leave_the_same_graph(spark, store, monkeypatch):
    one, two = make(spark, [("a", "Club", "x")], []), make(spark, [("b", "Club", "x")], [("a", "R", "b", "x")])
    store.upsert(one, ("stream", 0))

    def die(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(GraphStore, "_publish", die)
        store.upsert(two, ("stream", 1))
    assert state(store.load())[0] == [("a", ("Club",), "Club", "x")]
    store.upsert(two, ("stream", 1))
    after, versions = state(store.load()), store.versions()
    assert store.upsert(two, ("stream", 1)) == dict.fromkeys(stores.TABLES, 0) and store.upsert(one, ("stream", 0))["nodes"] == 0
    assert state(store.load()) == after and store.versions() == versions and len(after[0]) == 2
    assert len(store.vacuum(keep=1, older_than_s=-60)) == 1 and state(GraphStore(spark, store.folder).load()) == after


def test_two_writers(spark, store):
    store.upsert(make(spark, [("a", "Club", "x")], []))
    mine, other = GraphStore(spark, store.folder), GraphStore(spark, store.folder)
    g = mine.load()
    other.upsert(make(spark, [("b", "Club", "x")], []))
    with pytest.raises(Conflict):
        mine.save(g)  # without what the other has added
    assert mine.load().nodes.count() == 2
    mine.save(mine.load())
    # both have seen the same version: the later one's delta goes on top
    publish, late = GraphStore._publish, []

    def overtaken(self, manifest):
        if not late:
            late.append(1)
            other.upsert(make(spark, [("c", "Club", "x")], []))
        publish(self, manifest)

    GraphStore._publish = overtaken
    try:
        mine.upsert(make(spark, [("d", "Club", "x")], []))
    finally:
        GraphStore._publish = publish
    assert {r.id for r in store.load().nodes.collect()} == {"a", "b", "c", "d"}
    with pytest.raises(Conflict):
        mine._publish(mine.manifest())


def test_deltas_are_folded_beyond_a_number(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "MOST_DELTAS", 3)
    for i in range(6):
        store.upsert(make(spark, [(f"n{i}", "Club", "x")], []))
        assert len(store.manifest()["deltas"]) <= 3
    assert store.load().nodes.count() == 6
    store.assert_unique()
    store.reset()
    assert store.load().nodes.count() == 0 and store.versions() == []
