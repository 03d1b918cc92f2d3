import random
import zlib

from kgloom.llm import toxicity


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    syllables = ["an", "ther", "on", "es", "ti", "ble", "sh", "re", "nd", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.25
        w = [word() for _ in range(rng.randrange(30, 120))]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "pathetic", "worthless"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy_and_misspellings(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, "idiot " * 9, 0.0), (-1, None, 0.0), (-2, "", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(rows[0][0], 0), (10**9, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == len(rows) + 3
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert sum((got[i].score >= 0.5) == bool(y) for i, y in held) / len(held) > 0.95
    marked, toxic = {i for i, _ in held if got[i].predicted}, {i for i, y in held if y}
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
    assert len(marked & toxic) >= 0.9 * len(toxic) and len(marked & toxic) >= 0.9 * len(marked)
    assert got[-1].score == got[-2].score and not got[None].held_out and got[None].predicted == 1
    model = toxicity.fitted(docs, labels)
    base, wrong = toxicity.Scorer(*model).scores(["ther on es ti ble sh re nd ou an idioot pathetiic", "ther on es ti ble sh re nd ou an onther tible"])
    assert base > wrong
    assert {r.doc_id for r in toxicity.accepted(docs, labels).collect()} == {i for i, r in got.items() if not r.predicted}


def test_model_never_reads_held_out_labels(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    a = toxicity.fitted(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.fitted(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(docs, none).first().score < 1e-6
    assert toxicity.scored(docs.limit(0), none).count() == 0


def test_repeated_ids_and_long_texts(spark):
    rows = corpus(200, 4)
    filler = " ".join(f"filler{i}" for i in range(60_000))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    texts = [(i, f"{t} {filler}" if i % 50 == 0 else t) for i, t, _ in rows]
    once = spark.createDataFrame(texts, "doc_id long, text string")
    twice = spark.createDataFrame([*((i, t + " and more") for i, t in texts[:90]), *texts, *texts[:20], (0, "\uffff")], "doc_id long, text string")
    a, b = toxicity.fitted(once, labels), toxicity.fitted(twice, labels)
    assert (a[0] == b[0]).all() and a[1] == b[1]
    assert toxicity.scored(twice, labels).count() == 200 + 90 + 21


def test_every_bucket_of_a_training_text_is_trained():
    rows = corpus(60, 6)
    weights, _ = toxicity.train([toxicity.word_counts(t) for _, t, _ in rows], [y for _, _, y in rows])
    used = set(toxicity.grams([w for _, t, _ in rows for w in t.split()])[0].tolist())
    assert sum(weights[b] != 0 for b in used) > 0.99 * len(used)
