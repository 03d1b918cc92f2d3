"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes for good (1), for bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns
estimates, for either class, how often each rule votes each way, and the share of good documents; a document is kept if
its posterior probability of being good is at least `least` (0.5) and the base rules don't reject it. Patterns are at
most 3 ** 7 (2,187), whatever the input; their counts come from all documents, and only they come to the driver.

Features of a whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, letters and bars. Words in three-word
windows are found by sorting the windows' 64-bit hashes with their places inside the row; no row is exploded.

Defined results: null and empty texts have no words, fail the base rules and are not kept; repeated rows are judged each;
null doc_ids are kept as they are; extra columns are not read. A table without rows gives none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
ROUNDS, SMOOTH = 60, 1.0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once: it is bound to a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more among w."""

    def from_places(p: Column) -> Column:
        n = F.size(p)
        pairs = F.arrays_zip(F.slice(p, 1, n - 1).alias("x"), F.slice(p, 2, n - 1).alias("y"))
        return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(3), lambda acc, z: acc + F.least(F.lit(3), z["y"] - z["x"])))

    def from_sorted(s: Column) -> Column:
        n = F.size(s)
        pairs = F.arrays_zip(F.slice(s, 1, n - 1).alias("x"), F.slice(s, 2, n - 1).alias("y"))
        same = F.filter(pairs, lambda z: z["x"]["h"] == z["y"]["h"])
        return let(F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda z: F.array(z["x"]["i"], z["y"]["i"]))))), from_places)

    def from_words(v: Column) -> Column:
        n = F.size(v) - 2
        windows = F.arrays_zip(F.slice(v, 1, n).alias("a"), F.slice(v, 2, n).alias("b"), F.slice(v, 3, n).alias("c"))
        hashed = F.transform(windows, lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("h"), i.alias("i")))
        return F.when(n < 2, F.lit(0)).otherwise(let(F.sort_array(hashed), from_sorted))

    return from_words(w)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""
    t = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(t, "[ \\t-\\r]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(_without(x, BLANKS)) > 0)
    both = let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")))
    duplicates = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    letters = F.length(F.regexp_replace(t, "[^\\p{L}]+", ""))
    bars = F.length(t) - F.length(_without(t, "|"))
    raw = docs.select("doc_id", both.alias("b"), duplicates.alias("d"), F.length(_without(t, BLANKS)).alias("word_chars"), (F.length(t) - F.length(_without(t, SYMBOLS))).alias("n_symbols"), letters.alias("n_letters"), bars.alias("n_bars"))
    names = {"n_words": "b.n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_lines": "d.n_lines", "n_dup_lines": "d.n_dup_lines", "n_repeat_words": "b.n_repeat_words", "n_letters": "n_letters", "n_bars": "n_bars"}
    return raw.select("doc_id", *(F.col(v).cast("long").alias(k) for k, v in names.items()))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """A vote of each rule, from the features; ratios with an empty denominator are null and abstain."""
    c = F.col
    ratio = lambda a, b: c(a) / F.when(c(b) > 0, c(b))
    mean = ratio("word_chars", "n_words")
    return {
        "length": _vote(c("n_words") >= 80, c("n_words") < 50),
        "symbols": _vote(ratio("n_symbols", "word_chars") < 0.02, ratio("n_symbols", "word_chars") > 0.08),
        "lines": _vote(ratio("n_dup_lines", "n_lines") < 0.1, (ratio("n_dup_lines", "n_lines") > 0.5) & (c("n_dup_lines") >= 3)),
        "repeats": _vote(ratio("n_repeat_words", "n_words") < 0.15, ratio("n_repeat_words", "n_words") > 0.4),
        "word_length": _vote((mean > 3) & (mean < 9), (mean < 2.5) | (mean > 12)),
        "table": _vote(ratio("n_bars", "n_words") < 0.01, ratio("n_bars", "n_words") > 0.1),
        "letters": _vote(ratio("n_letters", "word_chars") > 0.85, ratio("n_letters", "word_chars") < 0.7),
    }


def fit(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Counts of vote patterns -> share of good, and for each rule and vote its probabilities given good and bad.

    The first posterior is each pattern's share of votes for good; counts are smoothed, so no probability is 0 or 1."""
    n_rules = len(counts[0][0]) if counts else 0
    post = [0.5 + 0.45 * sum(p) / max(1, sum(map(abs, p))) for p, _ in counts]
    total = sum(n for _, n in counts)
    share, table = 0.5, [dict.fromkeys((-1, 0, 1), (1 / 3, 1 / 3)) for _ in range(n_rules)]
    for _ in range(rounds):
        good = sum(q * n for q, (_, n) in zip(post, counts, strict=True))
        share = (good + SMOOTH) / (total + 2 * SMOOTH)
        for r in range(n_rules):
            for v in (-1, 0, 1):
                a = sum(q * n for q, (p, n) in zip(post, counts, strict=True) if p[r] == v)
                b = sum((1 - q) * n for q, (p, n) in zip(post, counts, strict=True) if p[r] == v)
                table[r][v] = ((a + SMOOTH) / (good + 3 * SMOOTH), (b + SMOOTH) / (total - good + 3 * SMOOTH))
        post = [posterior(p, share, table) for p, _ in counts]
    return share, table


def posterior(pattern: tuple[int, ...], share: float, table: list[dict[int, tuple[float, float]]]) -> float:
    logit = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(table, pattern, strict=True) if v)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, the votes, p_good and kept."""
    found = features(docs)
    c = F.col
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    votes = rules()
    voted = keep(found.select("*", failed.alias("base_failed"), *(v.cast("int").alias(f"vote_{k}") for k, v in votes.items())))
    names = [f"vote_{k}" for k in votes]
    counts = [(tuple(r[:-1]), r[-1]) for r in sorted(voted.groupBy(*names).count().collect())] or [((0,) * len(names), 0)]
    share, table = fit(counts)
    logit = F.lit(math.log(share / (1 - share)))
    for name, t in zip(names, table, strict=True):
        logit += F.when(c(name) == 1, math.log(t[1][0] / t[1][1])).when(c(name) == -1, math.log(t[-1][0] / t[-1][1])).otherwise(0.0)
    p = F.round(1 / (1 + F.exp(-logit)), 9)
    return voted.withColumn("p_good", p).withColumn("kept", ~c("base_failed") & (c("p_good") >= least))
