"""Texts are ingested whole: what comes after 8,000 characters is in the store, and in the query's digest."""

import duckdb

from kgloom import catalogue
from kgloom.functions.chunking import covered, split_text
from kgloom.sources.files import GraphStore
from kgloom.streaming.ingest import ingest, ingest_some, ingest_stream

LONG = "\n".join(f"Line {i} of a text that goes on for long." for i in range(600))


def test_the_end_of_a_long_text_is_in_the_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(LONG + " Last word.", encoding="utf-8")
    stores = {n: GraphStore(spark, str(tmp_path / n)) for n in ("files", "some", "rows", "cut")}
    nothing = lambda text: []
    ingest(spark, str(tmp_path / "in"), stores["files"], nothing, str(tmp_path / "c1"))
    ingest_some(spark, str(tmp_path / "in"), stores["some"], nothing, 1)
    spark.createDataFrame([("a", LONG + " Last word.")], "fuente string, text string").write.parquet(str(tmp_path / "rows_in"))
    stream = lambda: spark.readStream.schema("fuente string, text string").parquet(str(tmp_path / "rows_in"))
    ingest_stream(stream(), stores["rows"], nothing, str(tmp_path / "c2"))
    ingest_stream(stream(), stores["cut"], nothing, str(tmp_path / "c3"), 8000)
    ends = {n: max(store.load().docs.collect(), key=lambda r: r.chunk).text.endswith("Last word.") for n, store in stores.items()}
    assert ends == {"files": True, "some": True, "rows": True, "cut": False}


def test_the_digest_is_of_the_whole_text(spark, tmp_path):
    rows = [(1, LONG + " one end"), (2, LONG + " another end"), (3, "word " * 5000), (4, "x" * 20000), (5, "\x0b short \n"), (6, " \n "), (7, None), (8, "\x0b")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sql = catalogue.ORACLES["incremental_ingest"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(duckdb.connect().execute(sql).fetchall())
    got = dict(map(tuple, catalogue.QUERIES["incremental_ingest"](spark, str(tmp_path)).collect()))
    assert sorted(got.items()) == want and len(got) == 6 and got["1"] != got["2"]


def test_chunks_hold_a_text_or_not():
    for text in (LONG, "word " * 3000, "ab " * 40 + "\n\n" + "ab " * 900, "a. b. c", "", " \n"):
        assert covered(text, split_text(text))
    assert not covered(LONG, split_text(LONG)[:-1]) and not covered(LONG, split_text(LONG)[:3] + split_text(LONG)[4:]) and not covered("one two", ["one", "three"]) and not covered("one", [])
