import collections
import hashlib
import random
import re

from regular import both, regular

from kgloom.llm import substrings


def brute(texts, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for p in range(i, i + n)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


def sample(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "中", "A", "a"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [text(rng.randrange(30, 90)) for _ in range(6)]
    out = [text(rng.randrange(120)) + rng.choice(["", "\n", "\t "]) + rng.choice(shared) + " " + text(rng.randrange(80)) for _ in range(60)]
    cut = [s.split() for s in shared]
    out += [" ".join(c[k:]) + " " + text(5) for c in cut for k in (1, 7, 20)]
    return out + [None, "", " ", "same " * 200, "same " * 34, out[0], "x" * 60_000, text(9000), shared[0] + " " + shared[0]]


def test_against_brute_force(spark):
    texts = sample(1)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[3], 1)], "doc_id long, text string, n_words int").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs).collect()}
    want = brute([*texts, texts[3]], 35)
    assert got == {**{i: want[i] for i in range(len(texts))}, None: want[-1]}


def test_other_lengths(spark):
    texts = sample(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (7, 8, 50):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs, n).collect()}
        assert got == dict(enumerate(brute(texts, n)))


def test_deduplicated_keeps_columns(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"own  one {shared}\nlast", "x", 5), (2, f"{shared} two", "y", 5), (3, "only  mine", None, 5), (4, None, "z", None)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in substrings.deduplicated(docs).collect()}
    assert got[1].text == "own  one\nlast" and got[1].n_chars == len(got[1].text) and got[1].lang == "x"
    assert got[2].text == "two" and got[3].text == "only  mine" and got[4].text is None
    assert substrings.deduplicated(docs.limit(0)).count() == 0


def test_regular_words_are_told_apart(spark):
    rng = random.Random(9)
    some = [f"w{rng.randrange(10**6)}" for _ in range(34)]
    texts = [" ".join([*some[:k], w, *some[k:]]) for n in (1024, 2048, 4096, 8192) for k, w in enumerate(both(n))]
    texts += [" ".join([*some[:9], w, *some[9:]]) for n in (1024, 2048, 4096, 8192) for w in both(n)]
    texts += [" ".join(regular(64, [x, y])) for x, y in ("pq", "qp")] + [" ".join(regular(4096, [x, y])) for x, y in ("rs", "sr")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs).collect()}
    assert got == dict(enumerate(brute(texts, 35)))
