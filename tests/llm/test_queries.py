"""The queries themselves, over whole tables: against SQL where there is one, else against brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
import test_sharding_quality
import test_simhash
import test_suffixes
import test_whitening
from tokenizers import Tokenizer

import __spark_entry__
from kgloom.llm import licenses, queries

FOLDER = os.environ.get("KGLOOM_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, FOLDER).toPandas()[list(want.columns)]
    plain = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) else x
    rows = lambda frame: sorted(str([plain(x) for x in r]) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_simhash_query(spark, docs):
    fps, roots = test_simhash.brute([t for _, t in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{f:016x}", docs[k][0]) for (i, _), f, k in zip(docs, fps, roots)}


def test_token_queries(spark, docs):
    lib = Tokenizer.from_file(queries.tokenizer_path())
    two = {r.doc_id: r for r in queries.op2_bpe(spark, FOLDER).collect()}
    five = {r.doc_id: r for r in queries.op5_tokenstore(spark, FOLDER).collect()}
    at = 0
    for i, t in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (two[i].n_tokens, two[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert two[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        crc = zlib.crc32(np.array([*ids, 0], dtype="<u4").tobytes())
        assert (five[i].start, five[i].n_tokens, five[i].ids_crc32) == (at, len(ids) + 1, crc)
        at += len(ids) + 1


def test_license_query(spark, docs):
    notices = [t for _, t in licenses.TEMPLATES if len(t) < 90]
    got = {r.doc_id: r for r in queries.op3_licenses(spark, FOLDER).collect()}
    for i, t in docs:
        assert (got[i].n_matches > 0) or not any(n in (t or "") for n in notices)
        assert got[i].n_matches == 0 or "icense" in t or "ICENSE" in t


def test_toxicity_query(spark, docs):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{FOLDER}/labels.parquet'").fetchall())
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, FOLDER).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held)
    assert sum((got[i].score >= 0.5) == bool(labels[i]) for i in held) >= 0.8 * len(held)


def test_suffix_query(spark, docs):
    want = test_suffixes.brute(docs, 100)
    assert test_suffixes.got(queries.op6_suffixes(spark, FOLDER)) == want


def test_sharding_query(spark, docs):
    got = queries.op7_sharding(spark, FOLDER).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs}
    load = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    assert max(load) - min(load) <= max(0.1 * sum(load) / 16, max(r.size for r in got)) and {r.law for r in got} == {"bytes"}
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_quality_query(spark, docs):
    got = {r.doc_id: r for r in queries.op9_quality(spark, FOLDER).collect()}
    for i, t in docs:
        r, want = got[i], test_sharding_quality.brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_whitening_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' ORDER BY vec_id").fetchall()
    test_whitening.check(queries.op13_whitening(spark, FOLDER).collect(), [v for _, v in rows], [i for i, _ in rows])


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and len(queries.QUERIES) == 13
