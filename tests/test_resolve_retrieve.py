import random
import time

import pytest

from kgloom import model
from kgloom.operators import audit, resolve, retrieve
from kgloom.plans import answer as answers


def ents(spark, *rows):
    return spark.createDataFrame([(i, t, g) for i, t, g in rows], "id string, tipo string, grado long")


def pairs(df):
    return {(r.corto, r.largo) for r in df.collect()}


def test_same_key_takes_degree_then_length(spark):
    e = ents(spark, ("Real Madrid", "Club", 5), ("Real Madrid C. F.", "Club", 9), ("Real Sociedad", "Club", 1), ("real madrid", "Jugador", 1), ("x", None, 1))
    got = resolve.same_key(e).collect()
    assert [(r.canonico, r.variantes) for r in got] == [("Real Madrid C. F.", ["Real Madrid C. F.", "Real Madrid"])]


def test_detectors(spark):
    e = ents(spark, ("Ajax", "Club", 1), ("Ajax de Ámsterdam", "Club", 1), ("Copa de Europa", "Competicion", 1), ("Supercopa de Europa", "Competicion", 1), ("Manchester United", "Club", 1), ("Manchester City", "Club", 1))
    assert pairs(resolve.prefix_pairs(e)) == {("Ajax", "Ajax de Ámsterdam")}
    p = ents(spark, ("Ancelotti", "Entrenador", 1), ("Carlo Ancelotti", "Entrenador", 1), ("Bielsa", "Entrenador", 1), ("Marcelo Bielsa", "Entrenador", 1), ("Rafael Bielsa", "Entrenador", 1), ("- -", "Entrenador", 1), ("Diego Simeone", "Jugador", 1), ("Diego Pablo Simeone", "Jugador", 1))
    got = resolve.surname_pairs(p)
    assert pairs(got) == {("Ancelotti", "Carlo Ancelotti"), ("Bielsa", "Marcelo Bielsa"), ("Bielsa", "Rafael Bielsa")}
    assert pairs(resolve.unambiguous(got)) == {("Ancelotti", "Carlo Ancelotti")}
    assert [(r.corto, r.ejemplos) for r in resolve.ambiguous(got).collect()] == [("Bielsa", ["Marcelo Bielsa", "Rafael Bielsa"])]
    assert pairs(resolve.subset_pairs(p)) == {("Diego Simeone", "Diego Pablo Simeone")}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_typos_lose_no_pair(spark):
    rng = random.Random(1)
    names = {"".join(rng.choice("abc") for _ in range(rng.randrange(4, 12))) for _ in range(150)}
    want = {(a, b) for a in names for b in names if a < b and len(a) >= 6 and abs(len(a) - len(b)) <= 2 and 1 <= edit(a, b) <= 2}
    assert pairs(resolve.typo_pairs(ents(spark, *((n, "Club", 1) for n in names)))) == want
    assert pairs(resolve.typo_pairs(ents(spark, ("Johann Cruyff", "Jugador", 1), ("Johan Cruyff", "Jugador", 1), ("Johan Cruyff", "Club", 1)))) == {("Johan Cruyff", "Johann Cruyff")}


def test_typos_of_all_lengths_meet_where_they_are_true(spark):
    """Runs, alternations and lengths around the border between the two kinds of keys. Pairs that differ in place meet once and are all true."""
    rng = random.Random(2)
    names = {"".join(rng.choice("ab") for _ in range(rng.randrange(4, 9))) for _ in range(120)}
    for n in range(12, 22):
        whole = "".join(rng.choice("abcd") for _ in range(n))
        names |= {whole, whole[1:], whole[2:], "x" + whole[1:], whole[1:] + "y", "x" + whole + "y", whole[::-1], "ab" * (n // 2), "ba" * (n // 2), "a" * n}
    want = {(a, b) for a in names for b in names if a < b and len(a) >= 6 and abs(len(a) - len(b)) <= 2 and 1 <= edit(a, b) <= 2}
    found = resolve.typo_pairs(ents(spark, *((n, "Club", 1) for n in names))).collect()
    assert {(r.corto, r.largo) for r in found} == want and len(found) == len(want)
    n = spark.createDataFrame([("Club", a, a, len(a)) for a in names if 6 <= len(a) <= resolve.SHORT_NAME], "tipo string, id string, norm string, len int")
    met = [(r.x, r.y) for r in resolve._in_place(n).collect()]
    assert sorted(met) == sorted((a, b) for a, b in want if len(a) == len(b) <= resolve.SHORT_NAME and sum(p != q for p, q in zip(a, b, strict=True)) <= 2)


def test_selection_equals_the_sequential_walk(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(25)]
    rows = sorted({(rng.randrange(4), "t", *rng.sample(names, 2)) for _ in range(60)}, key=lambda r: (r[0], r[2], r[3]))
    used, taken = {"n0", "n1"}, set()
    for prio, _, a, b in rows:
        if a not in used and b not in used:
            taken.add((prio, a, b))
            used |= {a, b}
    got = resolve.select_pairs(spark.createDataFrame(rows, "prio int, tipo string, corto string, largo string"), spark.createDataFrame([("n0",), ("n1",)], "id string"))
    assert {(r.prio, r.corto, r.largo) for r in got.collect()} == taken


PAIRS = "prio int, tipo string, corto string, largo string"


def walked(rows):
    used, taken = set(), set()
    for prio, _, a, b in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        if a not in used and b not in used:
            taken.add((prio, a, b))
            used |= {a, b}
    return taken


def test_short_components_are_walked_together(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), "t", f"n{3 * i + a:05}", f"n{3 * i + b:05}") for i in range(400) for a, b in ((0, 1), (1, 2), (0, 2))]
    got = resolve.select_pairs(spark.createDataFrame(rows, PAIRS), spark.createDataFrame([], "id string"))
    assert {(r.prio, r.corto, r.largo) for r in got.collect()} == walked(rows)
    assert "FlatMapGroupsInPandas [walk" in got._jdf.queryExecution().analyzed().toString()  # not a call for each of 400 components


def test_a_long_chain_is_selected_in_seconds(spark):
    rows = [(0, "t", f"n{i:05}", f"n{i + 1:05}") for i in range(5000)]
    none = spark.createDataFrame([], "id string")
    began = time.perf_counter()
    got = {(r.prio, r.corto, r.largo) for r in resolve.select_pairs(spark.createDataFrame(rows, PAIRS), none).collect()}
    assert got == walked(rows) and len(got) == 2500 and time.perf_counter() - began < 120


def test_great_components_go_by_rounds_and_raise_if_these_end(spark):
    rng = random.Random(5)
    rows = list({(rng.randrange(4), "t", *rng.sample([f"n{i}" for i in range(12)], 2)) for _ in range(30)}) + [(0, "t", "x1", "x2")]
    none = spark.createDataFrame([], "id string")
    pairs_ = spark.createDataFrame(rows, PAIRS)
    assert {(r.prio, r.corto, r.largo) for r in resolve.select_pairs(pairs_, none, walk=2).collect()} == walked(rows)
    chain = spark.createDataFrame([(0, "t", f"n{i}", f"n{i + 1}") for i in range(9)], PAIRS)
    with pytest.raises(RuntimeError):
        resolve.select_pairs(chain, none, most_rounds=1, walk=2)


def test_short_forms_are_counted_before_they_meet(spark):
    rng = random.Random(6)
    words = ["ana", "eva", "paz", "sol"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(40)}
    e = ents(spark, *((n, t, 1) for n in names for t in ("Jugador", "Entrenador") if rng.random() < 0.6))
    for sides, found in ((resolve._prefix_sides(e), resolve.prefix_pairs(e)), (resolve._surname_sides(e), resolve.surname_pairs(e))):
        assert sorted(map(tuple, resolve._met_once(*sides).collect())) == sorted(map(tuple, resolve.unambiguous(found).collect()))


def test_proposal_approval_application(spark):
    e = ents(spark, ("Real Madrid", "Club", 5), ("Real Madrid C. F.", "Club", 9), ("Ajax", "Club", 2), ("Ajax de Ámsterdam", "Club", 1), ("Johan Cruyff", "Jugador", 9), ("Johann Cruyff", "Jugador", 1))
    found = resolve.propose(e)
    by = {r.detector: (r.canonico, r.variantes, r.aprobado) for r in found.collect()}
    assert by["normalizacion"][0] == "Real Madrid C. F." and by["prefijo"] == ("Ajax de Ámsterdam", ["Ajax de Ámsterdam", "Ajax"], False)
    assert by["errata"][0] == "Johan Cruyff"
    assert {r.canonico for r in resolve.propose(e, canonical="reference").where("detector = 'errata'").collect()} == {"Johann Cruyff"}
    manual = spark.createDataFrame([("manual", "Club", "M", ["M", "m2"], True, "")], model.GROUPS)
    yes = spark.createDataFrame([("Ajax de Ámsterdam",), ("Johan Cruyff",)], "canonico string")
    no = spark.createDataFrame([("Johan Cruyff",)], "canonico string")
    once = resolve.approve(found, yes, manual, no)
    state = lambda df: sorted((r.detector, r.canonico, r.aprobado) for r in df.collect())
    assert state(once) == [("errata", "Johan Cruyff", False), ("manual", "M", True), ("normalizacion", "Real Madrid C. F.", True), ("prefijo", "Ajax de Ámsterdam", True)]
    assert state(resolve.approve(once, yes, manual, no)) == state(once)
    assert state(resolve.keep_decisions(found, once)) == state(once)
    g = model.graph(e.select("id", "tipo"), spark.createDataFrame([("x", "R", "Ajax"), ("x", "R", "Real Madrid")], "src string, rel string, dst string"))
    assert {(r.src, r.dst) for r in resolve.apply(g, once).edges.collect()} == {("x", "Ajax de Ámsterdam"), ("x", "Real Madrid C. F.")}


def test_clean_removes_noise(spark):
    g = model.graph(spark.createDataFrame([("Club", "Club"), ("Ajax", "Club")], "id string, tipo string"), spark.createDataFrame([("Ajax", "R", "Club")], "src string, rel string, dst string"))
    out = resolve.clean(g)
    assert [r.id for r in out.nodes.collect()] == ["Ajax"] and out.edges.count() == 0


def test_audit(spark):
    edges = spark.createDataFrame([("p", "R", "FC Barcelona"), ("p", "R", "Barcelona B"), ("p", "R", "Colonia"), ("p", "R", "Extra"), ("p", "R", "de la")], "src string, rel string, dst string")
    nodes = spark.createDataFrame([("p",), ("Extra",)], "id string")
    truth = spark.createDataFrame([("R", "p", "Fútbol Club Barcelona"), ("R", "p", "1. FC Köln"), ("R", "p", "Missing"), ("R", "gone", "X"), ("R", "p", "de la")], "rel string, persona string, equipo string")
    aliases = spark.createDataFrame([(1, "Colonia"), (1, "1. FC Köln")], "group_id int, name string")
    found = audit.compare(edges, nodes, truth, aliases)
    got = {r.persona: (r.correctas, r.sobran, r.faltan) for r in found.collect()}
    assert got == {"p": (["Colonia", "FC Barcelona", "de la"], ["Barcelona B", "Extra"], ["Missing"]), "gone": (None, None, None)}
    key = lambda r: (r.rel, r.persona)
    assert sorted(audit.counted(edges, nodes, truth, aliases).collect(), key=key) == sorted(audit.counts(found).collect(), key=key)
    t = audit.totals(found).first()
    assert (t.n_ok, t.n_graph, t.n_truth) == (3, 5, 4) and abs(t.precision - 0.6) < 1e-12 and abs(t.coverage - 0.75) < 1e-12
    assert {r.dst for r in audit.extra_edges(found).collect()} == {"Barcelona B", "Extra"} and [r.dst for r in audit.missing_edges(found).collect()] == ["Missing"]


def test_denominators_may_differ(spark):
    edges = spark.createDataFrame([("p", "R", "Ajax FC"), ("p", "R", "Club Ajax")], "src string, rel string, dst string")
    found = audit.compare(edges, spark.createDataFrame([("p",)], "id string"), spark.createDataFrame([("R", "p", "Ajax")], "rel string, persona string, equipo string"))
    t = audit.totals(found).first()
    assert (t.n_ok, t.n_graph, t.n_truth) == (2, 2, 2)


def test_detection_prefers_longer_names(spark):
    e = ents(spark, ("Pep Guardiola", "E", 3), ("Guardiola", "E", 9), ("Ajax", "C", 1), ("ajax", "C", 5), ("abc", "C", 1), ("one two three four five six seven eight nine ten eleven twelve thirteen", "C", 1))
    q = spark.createDataFrame([(1, "¿Quién es PEP GUARDIOLA?"), (2, "guardiola y Ajax"), (3, "Ajaxito abc"), (4, None), (5, "one two three four five six seven eight nine ten eleven twelve thirteen"), (6, "one two three four five six seven eight nine ten eleven twelve")], "question_id long, text string")
    found = retrieve.detect_entities(q, e)
    got = {}
    for r in found.collect():
        got.setdefault(r.question_id, set()).add(r.id)
    assert got == {1: {"Pep Guardiola"}, 2: {"Guardiola", "ajax"}, 5: {"one two three four five six seven eight nine ten eleven twelve thirteen"}}
    assert {r.question_id: r.ruta for r in retrieve.routes(q, found).collect()} == {1: "neighbourhood", 2: "path", 3: "vectors", 4: "vectors", 5: "neighbourhood", 6: "vectors"}


def test_top_k_breaks_ties_by_id_and_skips_null_vectors(spark):
    docs = spark.createDataFrame([("d2", [1.0, 0.0]), ("d1", [2.0, 0.0]), ("d3", [0.0, 1.0]), ("d4", None), ("d5", [0.0, 0.0])], "doc_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "question_id long, vector array<float>")
    assert [(r.doc_id, r["rank"]) for r in retrieve.top_k(docs, q, 2).orderBy("rank").collect()] == [("d1", 1), ("d2", 2)]


def test_chunk_facts_are_a_bag_with_a_limit(spark):
    m = spark.createDataFrame([("d", "a"), ("d", "b")], model.MENTIONS)
    e = spark.createDataFrame([("a", "R", "b"), ("c", "R", "a")], "src string, rel string, dst string")
    assert retrieve.chunk_facts(m, e).first().hechos == ["a -R-> b", "a -R-> b", "c -R-> a"]
    assert retrieve.chunk_facts(m, e, distinct_facts=True).first().hechos == ["a -R-> b", "c -R-> a"]
    assert len(retrieve.chunk_facts(m, e, most=1).first().hechos) == 1


def test_answer_assembles_path_neighbours_chunks(spark):
    nodes = spark.createDataFrame([("Pep Guardiola", "Entrenador"), ("Johan Cruyff", "Entrenador"), ("Barcelona", "Club")], "id string, tipo string")
    edges = spark.createDataFrame([("Johan Cruyff", "INFLUYO_EN", "Pep Guardiola"), ("Pep Guardiola", "ENTRENO_A", "Barcelona")], "src string, rel string, dst string")
    embed = answers.hashing_embedder(64)
    docs = spark.createDataFrame([("d1", "src", 0, "pep guardiola entrenador", None), ("d2", "src", 1, "otra cosa", None)], model.DOCS)
    docs = retrieve.embed_missing(docs, embed)
    g = model.graph(nodes, edges, docs, spark.createDataFrame([("d1", "Pep Guardiola")], model.MENTIONS))
    q = spark.createDataFrame([(1, "¿Qué une a Pep Guardiola y Johan Cruyff?"), (2, "nada")], "question_id long, text string")
    got = {r.question_id: r for r in answers.answer(g, q, embed).collect()}
    text = got[1].contexto
    assert got[1].camino and text.index("[Camino") < text.index("[Relaciones de las") < text.index("[Relaciones del grafo]")
    assert got[1].detectadas == ["Johan Cruyff", "Pep Guardiola"] and got[1].caracteres == len(text) and not got[2].camino
    plain = answers.answer(g, q, embed, with_graph=False, model=lambda c, q: f" {len(c)} ").collect()
    assert all(r.hechos == 0 and r.respuesta == str(r.caracteres) for r in plain)
    c = retrieve.index_coverage(docs).first()
    assert (c.total, c.con_vector, c.dimension) == (2, 2, 64)


def test_templates_are_filled_whatever_the_texts_hold():
    say = answers.templated(lambda prompt: prompt, "C: {contexto} Q: {pregunta}.")
    assert say("{pregunta} x", "{contexto}") == "C: {pregunta} x Q: {contexto}."
    assert "{" not in answers.templated(lambda p: p)("a", "b")


def test_careers_of_statements(spark):
    claims = spark.createDataFrame([("ana", "P1", "s1", "Q1"), ("ana", "P2", "s2", "Q2"), ("ana", "P1", "s3", "Q3"), ("ana", "P9", "s4", "Q1"), ("eva", "P1", "s5", "Q1")], "subject string, property string, statement string, value string")
    qualifiers = spark.createDataFrame([("s1", "B", "1990-05"), ("s1", "B", "1995"), ("s1", "E", "2000"), ("s2", "E", None), ("s4", "B", "1"), ("sx", "B", "2")], "statement string, property string, value string")
    labels = spark.createDataFrame([("Q1", "en", "one"), ("Q1", "es", "uno"), ("Q2", "en", "two"), ("Q3", "de", "drei")], "id string, lang string, label string")
    got = audit.statement_careers(claims, qualifiers, labels, {"P1": "J", "P2": "E"}, "B", "E", ["es", "en"])
    assert sorted(map(tuple, got.collect())) == [("ana", "E", "two", "", ""), ("ana", "J", "uno", "1990", "2000"), ("ana", "J", "uno", "1995", "2000"), ("eva", "J", "uno", "", "")]
