"""The near-duplicate stage against brute force: exact Jaccard similarity of sets of five words, and the rule of op1."""

import random

import pytest

from kgloom.llm import simhash


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def roots_of(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def kept_by_brute_force(texts):
    sets, fps = [shingles(t) for t in texts], simhash.fingerprints_of([t.encode() for t in texts]).tolist()
    root = roots_of(len(texts), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8 or (fps[i] ^ fps[j]).bit_count() <= 2)
    return sorted(set(root))


def edited(rng, w, edits):
    x = list(w)
    for at in rng.sample(range(len(x)), edits):
        x[at] = words(rng, 1)[0]
    return x


def template_texts(seed, sources=3, each=40):
    """Sources of one template each: their documents differ in some words, so that pairs lie on both sides of 0.8."""
    rng = random.Random(seed)
    out = []
    for _ in range(sources):
        base = words(rng, 200)
        for _ in range(each):
            x = edited(rng, base, rng.randrange(1, 9))
            out += [" ".join(x)] + [" ".join(edited(rng, x, rng.randrange(3, 6))) for _ in range(rng.randrange(2))]
    rng.shuffle(out)
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_partners_on_a_shared_template_are_all_found(spark):
    texts = template_texts(4)
    got = sorted(r.doc_id for r in simhash.first_of_each(frame(spark, texts)).collect())
    assert got == kept_by_brute_force(texts)


@pytest.mark.parametrize(("block", "rounds"), [(4, 0), (4, 2), (1000, 0), (1000, 3)])
def test_crowded_buckets_lose_no_pair(spark, block, rounds):
    texts = template_texts(6, sources=2, each=25)
    sets = [shingles(t) for t in texts]
    docs = frame(spark, texts).withColumnRenamed("doc_id", "id")
    none = (simhash.np.zeros(0, dtype="<u8"), simhash.np.zeros(0, dtype="<i8"))
    made = simhash._sets([t.encode() for t in texts], 5)
    rows = [(i, len(x), bytearray(simhash._prefix(x, *none, 0.8).astype("<u8").tobytes()), bytearray(simhash._coordinates(x))) for i, x in enumerate(made)]
    nodes = spark.createDataFrame(rows + rows[:5], "id long, n int, prefix binary, coordinates binary").repartition(3)
    links = simhash.jaccard_links(nodes, lambda wanted: docs.join(wanted, "id"), block=block, rounds=rounds)
    assert all(jaccard(sets[r.a], sets[r.b]) >= 0.8 for r in links.collect())
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == roots_of(len(texts), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)


def test_the_threshold_is_exact(spark):
    rng = random.Random(12)
    texts, sides = [], {True: 0, False: 0}
    while min(sides.values()) < 60:
        w = words(rng, 150)
        x = edited(rng, w, rng.randrange(3, 6))
        similar = jaccard(shingles(" ".join(w)), shingles(" ".join(x)))
        if 0.75 <= similar < 0.85 and sides[similar >= 0.8] < 60:
            sides[similar >= 0.8] += 1
            texts += [" ".join(w), " ".join(x)]
    got = sorted(r.doc_id for r in simhash.first_of_each(frame(spark, texts)).collect())
    assert got == kept_by_brute_force(texts) and len(got) == 180


def test_no_pair_of_the_similarity_is_discarded():
    rng = random.Random(21)
    for n in (1, 6, 40, 300, 30_000):
        base = words(rng, n)
        for edits in {0, 1, max(1, n // 60), n // 30}:
            a, b = simhash._sets([" ".join(base).encode(), " ".join(edited(rng, base, min(edits, n))).encode()], 5)
            rows = [simhash.np.frombuffer(simhash._coordinates(x), dtype="uint8")[None] for x in (a, b)]
            near = len(simhash.np.intersect1d(a, b)) / len(simhash.np.union1d(a, b)) >= 0.8
            assert simhash._near_enough(*rows, *(simhash.np.array([len(x)]) for x in (a, b)), 0.8)[0] or not near
    a, b = simhash._sets([" ".join(words(rng, 300)).encode() for _ in range(2)], 5)
    rows = [simhash.np.frombuffer(simhash._coordinates(x), dtype="uint8")[None] for x in (a, b)]
    assert not simhash._near_enough(*rows, simhash.np.array([len(a)]), simhash.np.array([len(b)]), 0.8)[0]


def test_columns_with_clashing_names(spark):
    texts = ["one two three four five six seven"] * 2 + ["other words than these"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, id int, hash int, __first int")
    got = simhash.first_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 2]
