import random
import re

from kgloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(texts, items, n):
    windows = []
    for i, t in items:
        w = WORD.findall(low(t))
        windows += [(i, tuple(w[k : k + n])) for k in range(max(1, len(w) - n + 1)) if w]
    out = []
    for t in texts:
        w = WORD.findall(low(t))
        hit, names = set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    names |= {str(i)} if i is not None else set()
        out.append((len(w), len(hit), sorted(names)))
    return out


def sample():
    rng = random.Random(6)
    vocab = ["Alpha", "beta", "γάμμα", "x1", "Été", "end"]
    text = lambda n: rng.choice([" ", ", ", "-\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 14, 25]))) for i in range(12)] + [(3, text(12)), (None, text(11)), (77, None), (78, "..."), (79, "")]
    texts = [text(rng.randrange(60)) for _ in range(50)] + [f"{text(7)} {t} {text(4)}" for _, t in items] + [None, "", "?!", "word " * 20_000, items[5][1]]
    return texts, items


def test_both_ways_equal_brute_force(spark):
    texts, items = sample()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[0], 0)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute([*texts, texts[0]], items, 10)
    for bound in (1 << 20, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.scan(docs, bench, broadcast_bytes=bound).collect()}
        assert got == {**dict(enumerate(want[:-1])), None: want[-1]}
    assert all(r.n_hit == 0 for r in decontaminate.scan(docs, bench.limit(0)).collect())
    assert decontaminate.scan(docs.limit(0), bench).count() == 0


def test_cleaned_cuts_spans_and_drops_benchmark_texts(spark):
    passage = " ".join(f"Item{i}" for i in range(14))
    rows = [(1, f"own words here, {passage}. And more own words follow it to the very end of this text, so that most of it stays.", 9), (2, passage, 9), (3, "clean  text", 9), (4, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.cleaned(docs, bench).collect()}
    assert got == {r.doc_id: r for r in decontaminate.cleaned(docs, bench, broadcast_bytes=0).collect()}
    assert set(got) == {1, 3, 4} and "Item5" not in got[1].text and got[1].text.startswith("own words here, \n.")
    assert got[3].text == "clean  text" and got[4].text is None and got[1].n_chars == len(got[1].text)


def test_columns_with_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words of its own", 5, 6, 7), (2, "a b c", 5, 6, 7)], "doc_id long, text string, row int, found int, __items int")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for bound in (1 << 20, 0):
        got = decontaminate.cleaned(docs, bench, broadcast_bytes=bound)
        assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "some words of its own", 5, 6, 7)]
        assert decontaminate.cleaned(docs.limit(0), bench, broadcast_bytes=bound).count() == 0
        assert decontaminate.cleaned(docs, bench.limit(0), broadcast_bytes=bound).count() == 2


def test_the_set_is_measured_by_windows(spark):
    bench = spark.createDataFrame([(1, "a " * 1009), (2, "b"), (3, None), (4, "")], "item_id long, text string")
    assert decontaminate.small(bench, 1050 * decontaminate.WINDOW_BYTES) and not decontaminate.small(bench, 1000 * decontaminate.WINDOW_BYTES)
    long = spark.createDataFrame([(1, "x" * 1_000_000)], "item_id long, text string")
    assert decontaminate.small(long, 11_000_000) and not decontaminate.small(long, 9_000_000)
