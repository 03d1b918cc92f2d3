import json

import pytest

from kgloom import __main__ as cli
from kgloom import model
from kgloom.operators.extract import PatternExtractor, Triple, extract
from kgloom.plans.doctor import doctor
from kgloom.sources import files
from kgloom.streaming.ingest import ingest, ingest_some, pending

PHRASES = {"entrenó al": ("Entrenador", "ENTRENO_A", "Club"), "jugó en el": ("Jugador", "JUGO_EN", "Club"), "venció a": ("Club", "VENCIO", "Club")}


def test_corpus_truncates_and_names(spark, tmp_path):
    (tmp_path / "uno.txt").write_text("é" * 9000, encoding="utf-8")
    (tmp_path / "skip.md").write_text("no")
    r = files.corpus(spark, str(tmp_path)).collect()
    assert [(x.fuente, len(x.text)) for x in r] == [("uno", 8000)]
    (tmp_path / "uno.txt").write_text("uno\ndos\n\ntres", encoding="utf-8")
    assert [x.text for x in files.corpus(spark, str(tmp_path)).collect()] == ["uno\ndos\n\ntres"]
    (tmp_path / "uno.txt").write_text("é" * 9000, encoding="utf-8")
    assert len(files.corpus(spark, str(tmp_path), None).first().text) == 9000


def test_groups_round_trip(spark, tmp_path):
    g = spark.createDataFrame([("prefijo", "Club", "Ñandú", ["Ñandú", "N"], True, "x")], model.GROUPS)
    files.write_groups(g, str(tmp_path / "g"))
    assert files.read_groups(spark, str(tmp_path / "g")).collect() == g.collect()


def test_many_groups_round_trip_in_both_forms(spark, tmp_path):
    rows = [("prefijo", "Club", f"Club {i} de Ñandú", [f"Club {i} de Ñandú", f"C{i}"], i % 2 == 0, "x\ny") for i in range(50)]
    g = spark.createDataFrame(rows, model.GROUPS).repartition(4)
    files.write_groups(g, str(tmp_path / "g"))
    read = lambda p: sorted(tuple(r) for r in files.read_groups(spark, str(tmp_path / p)).collect())
    assert read("g") == sorted(rows)
    names = ["detector", "tipo", "canonico", "variantes", "aprobado", "nota"]
    (tmp_path / "array.json").write_text(json.dumps([dict(zip(names, r)) for r in rows], ensure_ascii=False, indent=2), encoding="utf-8")
    assert read("array.json") == sorted((*r, i) for i, r in enumerate(rows))  # with their places
    files.write_groups(files.read_groups(spark, str(tmp_path / "g")), str(tmp_path / "g"))  # over itself
    assert read("g") == sorted(rows)


def test_proposals_keep_approvals(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    store, groups = files.GraphStore(spark, str(tmp_path / "store")), str(tmp_path / "g")
    names = [(f"Ajax{i}{tail}", "Club") for i in range(12) for tail in ("", " de Ámsterdam")]
    store.save(model.graph(spark.createDataFrame(names, "id string, tipo string"), spark.createDataFrame([("Ajax1", "R", "Ajax2")], "src string, rel string, dst string")))
    assert cli.main(["dedupe", store.folder, "--propose", "--groups", groups]) == 0
    (tmp_path / "yes.csv").write_text("canonico\nAjax3 de Ámsterdam\nAjax7 de Ámsterdam\n", encoding="utf-8")
    (tmp_path / "no.csv").write_text("canonico\nAjax7 de Ámsterdam\n", encoding="utf-8")
    assert cli.main(["curate", store.folder, "--approve", "--groups", groups, "--approved", str(tmp_path / "yes.csv"), "--rejected", str(tmp_path / "no.csv")]) == 0
    approved = lambda: {r.canonico for r in files.read_groups(spark, groups).where("aprobado").collect()}
    assert approved() == {"Ajax3 de Ámsterdam"}
    before = files.read_groups(spark, groups).count()
    assert cli.main(["dedupe", store.folder, "--propose", "--groups", groups]) == 0
    assert approved() == {"Ajax3 de Ámsterdam"} and files.read_groups(spark, groups).count() == before == 12
    assert cli.main(["dedupe", store.folder, "--apply", "--groups", groups]) == 0
    assert store.load().nodes.count() == 23


def test_review_and_download_of_careers(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(spark, "stop", lambda: None)
    row = lambda kind, team, begin: {"tipo": {"value": kind}, "equipoLabel": {"value": team}, "inicio": {"value": begin}}
    b = [row("JUGO_EN", "Ajax", "1990-01-01"), row("JUGO_EN", "Ajax", "1985-01-01"), row("ENTRENO_A", "Milan", "2001-01-01"), row("JUGO_EN", "Q12", "1999")]
    (tmp_path / "r.json").write_text(json.dumps({"nombre": "Ana", "json": json.dumps({"results": {"bindings": b}})}), encoding="utf-8")
    truth = str(tmp_path / "truth")
    assert cli.main(["evaluate", str(tmp_path / "store"), "--review", "--download", "--truth", truth, "--responses", str(tmp_path / "r.json")]) == 0
    assert "1985" in capsys.readouterr().out
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(truth).collect()) == [("ENTRENO_A", "Ana", "Milan"), ("JUGO_EN", "Ana", "Ajax")]


def test_search_and_career_responses(spark):
    hit = lambda *d: json.dumps({"search": [{"id": f"Q{i}", "description": x} for i, x in enumerate(d)]})
    rows = spark.createDataFrame([("a", hit("pintor", "Entrenador de fútbol")), ("b", hit("pintor", None)), ("c", hit()), ("d", "{}")], "nombre string, json string")
    assert {r.nombre: r.qid for r in files.best_hit(rows).collect()} == {"a": "Q1", "b": "Q0", "c": None, "d": None}
    b = [{"tipo": {"value": "jugador"}, "equipoLabel": {"value": "Ajax"}, "inicio": {"value": "1990-01-01"}}, {"tipo": {"value": "jugador"}, "equipoLabel": {"value": "Q123"}}]
    rows = spark.createDataFrame([("a", json.dumps({"results": {"bindings": b}}))], "nombre string, json string")
    assert [tuple(r) for r in files.careers(rows).collect()] == [("a", "jugador", "Ajax", "1990", "")]


def test_extraction_keeps_the_schema_and_reports_errors(spark):
    docs = spark.createDataFrame([("f", "Johan Cruyff entrenó al Barcelona. Ajax venció a Milan."), ("g", "boom")], "fuente string, text string")
    base = PatternExtractor(PHRASES)

    def extractor(text):
        if text == "boom":
            raise RuntimeError("no")
        return base(text)

    g, rejected, errors = extract(docs, extractor)
    assert {(r.src, r.rel, r.dst) for r in g.edges.collect()} == {("Johan Cruyff", "ENTRENO_A", "Barcelona")}
    assert [r.rel for r in rejected.collect()] == ["VENCIO"] and [(r.doc_id, r.error) for r in errors.collect()] == [("g#0", "RuntimeError: no")]
    assert g.docs.count() == 2 and {r.entity_id for r in g.mentions.collect()} == {"Johan Cruyff", "Barcelona"}
    assert Triple("a", "b", "c", "d", "e").rel == "c"


def test_stream_reads_new_files_once_and_upserts(spark, tmp_path):
    source, store = tmp_path / "in", files.GraphStore(spark, str(tmp_path / "store"))
    source.mkdir()
    (source / "a.txt").write_text("Johan Cruyff entrenó al Barcelona.", encoding="utf-8")
    run = lambda: ingest(spark, str(source), store, PatternExtractor(PHRASES), str(tmp_path / "cp"))
    run()
    assert store.load().edges.count() == 1
    (source / "b.txt").write_text("Johan Cruyff jugó en el Ajax. Johan Cruyff entrenó al Barcelona.", encoding="utf-8")
    run()
    g, versions = store.load(), len(store.versions())
    assert {r.dst for r in g.edges.collect()} == {"Barcelona", "Ajax"} and g.docs.count() == 2
    assert {r.id: tuple(r.tipos) for r in g.nodes.collect()}["Johan Cruyff"] == ("Entrenador", "Jugador")
    run()
    assert len(store.versions()) == versions
    store.upsert(g)
    assert store.load().edges.count() == 2
    store.assert_unique()
    assert doctor(spark, store.folder) == ["2 of 2 chunks have no vector"]
    store.reset()
    assert store.load().nodes.count() == 0 and doctor(spark, store.folder) == ["the store has no version"]


def test_limited_ingest_takes_the_first_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, club in (("b", "Ajax"), ("a", "Milan"), ("c", "Lille")):
        (tmp_path / f"in/{name}.txt").write_text(f"Johan Cruyff entrenó al {club}.", encoding="utf-8")
    store = files.GraphStore(spark, str(tmp_path / "store"))
    run = lambda n: ingest_some(spark, str(tmp_path / "in"), store, PatternExtractor(PHRASES), n)
    assert run(2) == {"nodes": 3, "relations": 2, "errors": 0} and {r.dst for r in store.load().edges.collect()} == {"Milan", "Ajax"}
    assert run(2)["relations"] == 0 and run(3)["relations"] == 1


def test_pending_is_an_anti_join(spark):
    f = spark.createDataFrame([("a",), ("b",)], "fuente string")
    assert [r.fuente for r in pending(f, f.where("fuente = 'a'")).collect()] == ["b"]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Johan Cruyff entrenó al Barcelona. Johan Cruyff jugó en el Ajax.", encoding="utf-8")
    (tmp_path / "p.json").write_text(json.dumps(PHRASES), encoding="utf-8")
    (tmp_path / "truth.csv").write_text("rel,persona,equipo\nENTRENO_A,Johan Cruyff,FC Barcelona\nENTRENO_A,Johan Cruyff,Ajax\n")
    store = str(tmp_path / "store")
    assert cli.main(["ingest", store, "--corpus", str(tmp_path / "in"), "--phrases", str(tmp_path / "p.json")]) == 0
    assert cli.main(["query", store, "--index"]) == 0
    assert cli.main(["query", store, "¿Qué une a Johan Cruyff y Barcelona?", "--mode", "comparar"]) == 0
    assert cli.main(["dedupe", store, "--clean", "--propose", "--groups", str(tmp_path / "g")]) == 0
    assert cli.main(["evaluate", store, "--truth", str(tmp_path / "truth.csv"), "--add-missing"]) == 0
    assert cli.main(["curate", store, "--apply"]) == 0
    assert cli.main(["site", store, "--out", str(tmp_path / "page.html")]) == 0
    assert cli.main(["doctor", store]) == 0
    out = capsys.readouterr().out
    assert "all well" in out and "[Camino mas corto" in out and "Johan Cruyff" in (tmp_path / "page.html").read_text(encoding="utf-8")
    assert files.GraphStore(spark, store).load().edges.where("rel = 'ENTRENO_A'").count() == 2
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
