import collections
import itertools
import random
import re
import zlib

import regex

from kgloom.llm import quality, sharding


def test_shards_are_near_equal_and_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "t" * rng.randrange(1, 4000)) for i in range(3000)] + [(5000 + i, "hot copy " * 40) for i in range(1500)]
    rows += [(None, "null id"), (None, "null id"), (7, None), (8, ""), (9, "x" * 60_000), (10, "same"), (10, "same")]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, shard int").repartition(5)
    got = sharding.sharded(docs).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    load = collections.Counter()
    for r in got:
        load[r.shard] += r.size
    mean = sum(load.values()) / 16
    assert len(load) == 16 and max(abs(x - mean) for x in load.values()) < 0.02 * mean
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_small_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.sharded(docs).collect()) in ([0, 0], [0, 1])
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_overfull_ranges_keep_small_groups_whole(spark):
    rows = [(i, f"group {i // 5} " * 20) for i in range(4000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), ranges=8).collect()
    shards = collections.defaultdict(set)
    for r in got:
        shards[r.doc_id // 5].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = collections.Counter(tri)
    cov = {p for k, x in enumerate(tri) if n[x] > 1 for p in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov)


def test_features_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = ["a", "b", "é", "#", "word", "中文", "<x>", "\n", "\n", "\t", "\x0b"]
    texts = [rng.choice(["", " "]).join(rng.choice([" ", ""]) + rng.choice(vocab) for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += [None, "", " \n ", "a b c a b c", "a a a a", "x\nx\n\n\nx", "w " * 30_000, "z" * 50_000, "\x1c \x85\xa0 "]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "q", 1)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality.judged(docs.limit(0)).count() == 0


def test_em_recovers_accuracies():
    rng = random.Random(1)
    accuracy = [0.9, 0.8, 0.7, 0.95]
    counts = collections.Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        counts[tuple(0 if rng.random() < 0.2 else (1 if good else -1) * (1 if rng.random() < a else -1) for a in accuracy)] += 1
    share, table = quality.fit(sorted(counts.items()))
    assert abs(share - 0.7) < 0.03
    for t, a in zip(table, accuracy):
        assert abs(t[1][0] / (t[1][0] + t[-1][0]) - a) < 0.04
    best = {p: quality.posterior(p, share, table) for p in itertools.product((-1, 0, 1), repeat=4)}
    assert best[1, 1, 1, 1] > 0.99 and best[-1, -1, -1, -1] < 0.05


def test_clean_documents_are_kept(spark):
    rng = random.Random(3)
    clean = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(150))) for i in range(80)]
    junk = [(1000 + i, " ".join("#$%&*" for _ in range(60)) + "\n" + "same line\n" * 20) for i in range(20)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk)


def votes(t):
    t = t or ""
    n_words, word_chars, symbols, dup_lines, repeats = brute(t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda a, b: a / b if b else None

    def vote(x, good, bad):
        return 0 if x is None else -1 if bad(x) else int(good(x))

    return (
        vote(n_words, lambda x: x >= 80, lambda x: x < 50),
        vote(share(symbols, word_chars), lambda x: x < 0.02, lambda x: x > 0.08),
        vote(share(dup_lines, len(lines)), lambda x: x < 0.1, lambda x: x > 0.5 and dup_lines >= 3),
        vote(share(repeats, n_words), lambda x: x < 0.15, lambda x: x > 0.4),
        vote(share(word_chars, n_words), lambda x: 3 < x < 9, lambda x: x < 2.5 or x > 12),
        vote(share(t.count("|"), n_words), lambda x: x < 0.01, lambda x: x > 0.1),
        vote(share(len(regex.findall(r"\p{L}", t)), word_chars), lambda x: x > 0.85, lambda x: x < 0.7),
    )


def kept_by_brute_force(texts):
    """Expectation-maximisation document by document, without patterns."""
    rows = [votes(t) for t in texts]
    post = [0.5 + 0.45 * sum(v) / max(1, sum(map(abs, v))) for v in rows]
    for _ in range(60):
        good = sum(post)
        share = (good + 1) / (len(rows) + 2)
        odds = []
        for k in range(7):
            of = {}
            for x in (-1, 0, 1):
                a, b = sum(q for q, v in zip(post, rows) if v[k] == x), sum(1 - q for q, v in zip(post, rows) if v[k] == x)
                of[x] = ((a + 1) / (good + 3)) / ((b + 1) / (len(rows) - good + 3)) if x else 1.0
            odds.append(of)
        post = []
        for v in rows:
            ratio = share / (1 - share)
            for k, x in enumerate(v):
                ratio *= odds[k][x]
            post.append(ratio / (1 + ratio))
    out = []
    for t, q in zip(texts, post):
        n, _, _, _, r = brute(t)
        out.append(not (n < 50 or 100 * r > 50 * n) and round(q, 9) >= 0.5)
    return out


def test_kept_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 11)))
    texts = [None, ""]
    for _ in range(150):
        w = [word() for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.choice([0, 0, 0, 10, 60])):
            w[rng.randrange(len(w))] = rng.choice(["|", "##", "***", "12345", "\nsame line\nsame line\n", "a b c"])
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(7, texts[7])], "doc_id long, text string")
    got = quality.judged(docs).collect()
    want = kept_by_brute_force([*texts, texts[7]])
    assert len(got) == len(texts) + 1 and {r.doc_id: r.kept for r in got} == dict(enumerate(want[:-1])) and 0 < sum(want) < len(want)
