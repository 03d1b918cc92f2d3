import random
import re

import xxhash

from kgloom.llm import simhash


def brute(texts):
    fps = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return fps, [find(i) for i in range(len(fps))]


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "délta", "eps\t", "zeta", "eta\n", "theta"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 8, 300]))) for _ in range(120)]
    texts += [t + " tail" for t in texts[:40]] + [None, "", "  ", texts[0], "ÀÉ", "x" * 50_000, "w " * 70_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    fps, roots = brute(texts)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], roots[i]) for i in range(len(texts))}


def test_links_of_crowded_buckets_equal_all_pairs(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    fps = [x & (2**64 - 1) for x in fps]
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 2:
                root[find(x)] = find(y)
    want = {}
    for x in fps:
        want.setdefault(find(x), set()).add(x)
    want = {frozenset(g) for g in want.values() if len(g) > 1}
    for hot in (4, 100_000):
        groups = {}
        for r in simhash.components(simhash.links(df, hot=hot)).collect():
            groups.setdefault(r.root, set()).add(r.node % 2**64)
        assert {frozenset(g) for g in groups.values()} == want


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
