import collections
import hashlib
import os
import random
import re

import duckdb
import pytest
import test_decontaminate
import test_near_duplicates
from tokenizers import Tokenizer

import corpus_pipeline
from kgloom.llm import queries, simhash, toxicity

FOLDER = os.environ.get("KGLOOM_TEST_TABLES", "/root/testdata/sf0.001")


def text(rng, n):
    syllables = ["an", "ther", "on", "es", "ti", "ble", "sh", "re", "nd", "ou", "ing", "he"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_first_of_each_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    rows, groups = [], []
    for k in range(40):
        w = text(rng, 300).split()
        ids = [10 * k + j for j in range(4)]
        rng.shuffle(ids)
        copy, near = list(w), list(w)
        near[50] = "other"
        near[200] = "word"
        cut = w[:-3]
        rows += [(i, " ".join(x), "x") for i, x in zip(ids, (w, copy, near, cut))]
        groups.append(sorted(ids))
    clean = [(10_000 + i, text(rng, rng.randrange(20, 200)), "y") for i in range(200)]
    rows += clean + [(20_000, None, "n"), (20_001, "", "n"), (None, "  ", "n"), (30_000, "same row", "z"), (30_000, "same row", "z"), (None, "only null", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = simhash.first_of_each(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert all([i for i in g if i in kept] == g[:1] for g in groups)
    assert {i for i, _, _ in clean} <= {*kept} and kept.count(30_000) == 1 and kept.count(None) == 1
    assert 20_000 in kept and 20_001 not in kept
    assert simhash.first_of_each(docs.limit(0)).count() == 0


def test_a_large_group_keeps_one(spark):
    rng = random.Random(5)
    w = text(rng, 400).split()
    rows = []
    for i in range(120):
        x = list(w)
        x[rng.randrange(400)] = f"edit{i}"
        rows.append((i, " ".join(x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in simhash.first_of_each(docs).collect()] == [0]


def test_pipeline_runs_over_all_stages(spark, tmp_path):
    rng = random.Random(8)
    passage = text(rng, 60)
    bench = text(rng, 30)
    rows = [(i, text(rng, 120), "en", "s", 0) for i in range(60)]
    rows = [(i, t if i % 3 else t + " idiot moron idiot moron", a, b, c) for i, t, a, b, c in rows]
    rows += [(100, text(rng, 90) + " " + passage, "en", "s", 0), (101, passage + " " + text(rng, 90), "en", "s", 0)]
    rows += [(102, text(rng, 90) + " " + bench + " " + text(rng, 50), "en", "s", 0), (103, rows[1][1], "en", "s", 0), (104, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == before
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not {i for i in texts["toxicity"] if i < 60 and i % 3 == 0} and len(texts["toxicity"]) == 45
    assert 103 not in texts["simhash_near_dedup"] and len(texts["simhash_near_dedup"]) == 44
    assert passage not in texts["substring_dedup"][100] and passage not in texts["substring_dedup"][101]
    last = texts["benchmark_decontamination"]
    assert bench not in last[102] and len(last) == 44 and last[104] is None
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {*last} and all(len(r.ids) == r.n_tokens for r in out.collect())


def cut_by_brute_force(texts, length=35):
    spans = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    words = [[t[a:b] for a, b in s] for t, s in zip(texts, spans)]
    count = collections.Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for t, s, w in zip(texts, spans, words):
        gone = {p for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for p in range(i, i + length)}
        kept, last = [], None
        for p, (a, b) in enumerate(s):
            if p not in gone:
                if last == p - 1 and kept:
                    kept[-1] = (kept[-1][0], b)
                else:
                    kept.append((a, b))
                last = p
        out.append("\n".join(t[a:b] for a, b in kept) if gone else t)
    return out


def cleaned_by_brute_force(texts, items):
    windows = set()
    for t in items:
        w = test_decontaminate.WORD.findall(test_decontaminate.low(t))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    out = []
    for t in texts:
        spans = [m.span() for m in test_decontaminate.WORD.finditer(test_decontaminate.low(t or ""))]
        w = [test_decontaminate.low(t)[a:b] for a, b in spans] if spans else []
        hit = {p for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        parts, last = [], 0
        for p in sorted(hit):
            if p - 1 in hit:
                last = spans[p][1]
            else:
                parts.append(t[last : spans[p][0]])
                last = spans[p][1]
        out.append(None if 2 * len(hit) > len(w) else t if not hit else "\n".join([*parts, t[last:]]))
    return out


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")
def test_pipeline_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    scores = toxicity.Scorer(*toxicity.fitted(read("documents"), read("labels"))).scores([t for _, t in docs])
    docs = [d for d, x in zip(docs, scores, strict=True) if x < 0.7]
    first = test_near_duplicates.kept_by_brute_force([test_decontaminate.low(t) for _, t in docs])
    docs = [docs[k] for k in first]
    texts = cleaned_by_brute_force(cut_by_brute_force([t for _, t in docs]), items)
    lib, want = Tokenizer.from_file(queries.tokenizer_path()), {}
    for (i, _), t in zip(docs, texts, strict=True):
        if t is not None:
            ids = lib.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want
