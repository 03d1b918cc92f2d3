"""The prefix trie against one made of plain tuples, with groups dealt anew at every size, and its edge cases."""

import hashlib
import os
import random
import zlib

import pandas as pd
import pytest

from kgloom.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """{(turns): node} of rows (conv_id, turn, role, text), as the contract says it."""

    def digest(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()

    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(w)] for c, w in own.items()}
    members: dict[tuple, list] = {}
    ends: dict[tuple, list] = {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        w = tuple(own.get(c - c % 100, [])[:h] + w[h:])
        ends.setdefault(w, []).append(c)
        for d in range(len(w) + 1):
            members.setdefault(w[:d], []).append(c)
    leaves, saved, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items()
    )


def got(spark, rows, **kw):
    found = conversations.trie(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found), key=lambda r: tuple(-1 if x is None else x for x in r))


def some(rng, convs, words=3, longest=7):
    rows = []
    for c in range(convs):
        rows += [(c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["ä", "hello", "", None, "x" * 9][:words])) for t in range(rng.randint(0, longest))]
    return rows


@pytest.mark.parametrize("most", [None, 40, 1])
def test_equals_a_plain_trie(spark, most):
    rng = random.Random(most or 0)
    rows = some(rng, 150) + [(200 + i, t, "user", f"opening {min(t, 3)} {t > 3 and i % 5}") for i in range(60) for t in range(6)]
    rng.shuffle(rows)
    assert got(spark, rows, most=most) == brute(rows)


def test_copies_of_one_conversation_and_a_chain_in_common(spark):
    """A third are copies, a third share 12 turns and part then, and one of these ends where the others part."""
    rows = [(i, t, "user", f"copy {t}") for i in range(0, 60) for t in range(5)]
    rows += [(i, t, "user", f"chain {t}" if t < 12 else f"own {i}") for i in range(100, 160) for t in range(12 if i in (100, 107) else 13)]
    rows += [(i, 0, "user", f"alone {i}") for i in range(200, 230)]
    want = brute(rows)
    for most in (1, 30, 10_000):
        assert got(spark, rows, most=most) == want


def test_tries_of_several_groups_in_one_call():
    rows = pd.DataFrame(
        [(b"a" * 16 + b"b" * 16, [1, 2], 3, 7, "x", [0]), (b"a" * 16, [1], 1, 2, "y", [0]), (b"c" * 16 + b"d" * 16, [5, 6], 1, 1, "z", [0, 1])],
        columns=["seq", "chars", "n", "first", "ends", "cuts"],
    )
    out = conversations._forest(rows)
    assert out[["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]].values.tolist() == [[1, 2, 4, 1, 1, 3 * 1 + 2 * 2, "y"], [2, 7, 3, 0, 1, 4, "x"], [2, 1, 1, 0, 1, 0, "z"]]
    assert [x is None for x in out["top"]] == [False, True, False] and out["cuts"][2] == [0, 1]


def test_ids_of_many_blocks_are_hashed_in_order(spark):
    rows = [(i, None, None, None) for i in range(0, 3 * conversations.BLOCK, 2)]
    assert got(spark, rows) == brute(rows)


def test_nulls_ties_repeats_long_texts_and_other_columns(spark):
    rows = [
        (None, 0, "user", "nobody"), (0, None, "user", "first"), (0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 2, None, None), (7, 0, "user", "é" * 3_000_000), (7, 1, "us", "er"), (8, 0, "use", "r"),
        (300, 5, "user", None), (301, 5, "user", ""), (-5, 0, "user", "minus"), (2**62, 0, "user", "far"),
    ]
    want = [r for r in brute([r for r in rows if r[0] is None or r[0] >= 0])]
    assert got(spark, [r for r in rows if r[0] is None or r[0] >= 0]) == want
    assert sum(r[3] for r in got(spark, rows) if r[1] == 0) == 7
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows[1:6]], SCHEMA + ", seq int, w string, name string")
    assert conversations.trie(table).count() == len(brute(rows[1:6]))
    assert conversations.trie(table.limit(0)).collect() == [] == conversations.trie(table.withColumn("conv_id", table.conv_id * None)).collect()


def test_conversations_without_turns(spark):
    """Conversation c of a stem that isn't there, with no more turns than h, is rebuilt without turns; it may be the only one."""
    c = next(c for c in range(401, 499) if zlib.crc32(str(c).encode()) % 6 >= 2)
    assert got(spark, [(c, 0, "user", "a")]) == brute([(c, 0, "user", "a")]) and len(brute([(c, 0, "user", "a")])) == 1
    rows = [(c, 0, "user", "a"), (500, 0, "user", "b"), (500, 1, "user", "b")]
    assert got(spark, rows) == brute(rows)


def test_a_very_long_conversation(spark):
    n = 100_000
    table = spark.range(n).selectExpr("id % 2 * 100 AS conv_id", "id AS turn", "'user' AS role", "cast(id div 20000 AS string) AS text")
    out = conversations.trie(table).agg({"depth": "max", "n_convs": "sum"}).first()
    assert out[0] == n // 2 and out[1] == n + 2
    assert conversations.trie(table, most=10).count() == n // 2 + 1


FOLDER = os.environ.get("KGLOOM_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")
def test_the_query_and_its_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(spark, rows, most=5) == brute(rows)
