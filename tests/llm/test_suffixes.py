import hashlib
import random

from kgloom.llm import blocks, suffixes


def brute(rows, n):
    """rows (doc_id, text) in table order; order by doc_id (null last), then place."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            s = t[p : p + n]
            if s in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(s)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (rows[i][0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


def sample(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdef é") for _ in range(n))
    shared = [text(rng.randrange(90, 300)) for _ in range(5)]
    rows = []
    for _ in range(70):
        s = rng.choice(shared)
        a = rng.randrange(0, 40)
        rows.append(text(rng.randrange(200)) + s[a : len(s) - rng.randrange(0, 40)] + text(rng.randrange(150)))
    rows += [None, "", "x" * 99, "y" * 100, "z" * 101, "ab" * 400, rows[3], rows[3][:150], shared[0] * 3, "p" * 99, "p" * 100, text(20_000)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = list(zip(ids, rows))
    return [*rows, (None, shared[1] + "tail"), (None, shared[1] + "tail"), (5, shared[2]), (5, shared[2])]


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = sample(seed)
        docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_bytes int").coalesce(1)
        assert got(suffixes.removed(docs)) == brute(rows, 100)


def test_many_blocks_and_crowds(spark, monkeypatch):
    rows = sample(3)[:-4]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(suffixes.removed(docs)) == brute(rows, 100)
    assert got(suffixes.removed(docs, crowd=2)) == brute(rows, 100)
    assert got(suffixes.removed(docs, length=30)) == brute(rows, 30)


def test_repeats_are_maximal_and_have_all_occurrences():
    rights = [b"abcX", b"abcY", b"abZZ", b"abcX"]
    lefts = [b"11", b"12", b"11", b"2"]
    found = {(left, right, tuple(sorted(m))) for left, right, m in suffixes.repeats(rights, lefts, 3)}
    assert found == {(0, 4, (0, 3)), (0, 3, (0, 1, 3)), (1, 3, (0, 1)), (1, 2, (0, 1, 2)), (2, 2, (0, 2))}


def test_empty(spark):
    assert suffixes.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hashes_of_very_many_blocks_are_streamed(spark):
    rng = random.Random(3)
    rows = [(h, b, False) for h in (1, 5, 9) for b in range(50)] + [(h, 60, h % 2 == 0) for h in range(10, 30)] + [(40, 7, True), (-3, 8, False), (-3, 9, False)]
    rng.shuffle(rows)
    sent = spark.createDataFrame(rows, "h long, block long, many boolean")
    want = {}
    for h, b, many in rows:
        if many or sum(x[0] == h for x in rows) > 1:
            want.setdefault(b, set()).add(h)
    for together in (1, 7, 1 << 20):
        got = {r.block: {int.from_bytes(x[i : i + 8], "little", signed=True) for x in map(bytes, r.found) for i in range(0, len(x), 8)} for r in blocks.answered(sent, together).collect()}
        assert got == want, together
