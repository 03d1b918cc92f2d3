import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.functions.chunking import chunks, split_text


def value(spark, column, *cells):
    return [r[0] for r in spark.createDataFrame([(c,) for c in cells], "s string").select(column(F.col("s"))).collect()]


def plain(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip()


def test_normalize(spark):
    names = ["José Mourinho", "Real Madrid C. F.", "", " .,! ", "Ñandú_x", "ΣΑΣ", "a-b–c", "x² y", "  two   words ", "Ça n'est", "Å"]
    assert value(spark, X.normalize, *names) == [plain(n) for n in names]
    once = value(spark, X.normalize, *names)
    assert value(spark, X.normalize, *once) == once
    assert value(spark, X.normalize, None) == [None]


def test_match_keys_collide_only_where_they_should(spark):
    key = lambda c: X.match_key(c, F.lit("Club"))
    a, b, c = value(spark, key, "Real Madrid C. F.", "Real Madrid", "Real Sociedad")
    assert a == b != c
    assert value(spark, lambda c: X.match_key(c, F.lit("Jugador")), "F. C. Club") == ["f c club"]


@pytest.mark.parametrize(("name", "clean"), [("FA Cup 2010-11", "FA Cup"), ("Serie A 1996-97 2000", "Serie A"), ("Balón de Oro en 2011", "Balón de Oro"), ("Copa 2010", "Copa"), ("Copa de 1998", "Copa"), ("Mundial 98", "Mundial 98"), ("2010", "2010"), ("X 2001/02", "X"), ("", "")])
def test_strip_year(spark, name, clean):
    assert value(spark, X.strip_year, name) == [clean]


def test_youth_flag_and_tokens(spark):
    assert value(spark, X.is_youth_team, "Barcelona B", "Tottenham Hotspur F. C.", "Real II", "Sub-19", "Ajax", "", None) == [True, False, True, False, False, False, False]
    assert value(spark, X.significant_tokens, "Fútbol Club Barcelona", "FC Barcelona", "de la") == [["barcelona"], ["barcelona"], []]


def test_noise_rules_in_order(spark):
    cases = {
        " . ": "empty", "CLUB": "generic", "x" * 56: "sentence", "12 copas": "leading count", "a b c d e f g h i j": "too many words", "Mejor jugador": "description",
        "Equipo de su ciudad": "description", "Equipo del Año": None, "Subcampeonato": "result", "Clasificados": "result", "Copa (1990)": "parenthetical", "Liga contra todos": "phrase",
        "Real Madrid": None, "Mejora": None, "Época dorada": "phrase",
    }
    assert value(spark, X.noise_reason, *cases) == list(cases.values())


def test_slug_range_fact_truncate(spark):
    assert value(spark, X.slugify, "Pep Guardiola!", "__A--b__", "Ñu") == ["pep_guardiola", "a_b", "u"]
    df = spark.createDataFrame([("1990", "1995"), ("1990", None), (None, "1995"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(X.year_range(F.col("a"), F.col("b"))).collect()] == ["1990-1995", "1990", "1995", ""]
    assert value(spark, lambda c: X.fact(F.lit("x"), c, F.lit("y")), "R", None) == ["x -R-> y", None]
    assert value(spark, lambda c: X.truncated(c, 2), "é😀x") == ["é😀"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(X.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1:] == [None, None]


def test_chunks_bound_cover_and_overlap(spark):
    rng = random.Random(2)
    text = "".join("w" * rng.randrange(1, 12) + rng.choice([" ", ". ", "\n", "\n\n"]) for _ in range(3000))
    parts = split_text(text)
    assert all(len(p) <= 1500 for p in parts)
    squeeze = lambda s: re.sub(r"\s+", "", s)
    at, whole = 0, squeeze(text)
    for p in parts:  # every chunk continues within or right after the one before
        p = squeeze(p)
        k = whole.find(p, max(0, at - 250))
        assert 0 <= k <= at
        at = k + len(p)
    assert at >= len(whole) - 2
    assert split_text("x" * 2000) == ["x" * 2000] and split_text("  ") == [] and split_text("y" * 1500) == ["y" * 1500]
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " "), (4, text)], "id long, text string")
    got = chunks(df, "id").collect()
    assert [(r.chunk, r.text) for r in got if r.id == 4] == list(enumerate(parts)) and {r.id for r in got} == {1, 4}


def test_accents_of_all_code_points(spark):
    import sys
    import unicodedata

    every = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    rows = [(i, "".join(every[i : i + 200])) for i in range(0, len(every), 200)] + [(-1, None), (-2, ""), (-3, "한국어 각 é ো한")] + [(-10 - i, c) for i, c in enumerate(every[0xA000:0xAC00:7])]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i long, s string").select("i", X.strip_accents(F.col("s")).alias("t")).collect()}
    want = {i: s and "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn") for i, s in rows}
    order = lambda s: s and sorted(s)  # noqa: E731  next to each other, marks of the standard's reordering may swap
    assert {i: order(t) for i, t in got.items()} == {i: order(t) for i, t in want.items()}
    assert got[-3] == want[-3] and all(got[i] == want[i] for i, s in rows if i < 0)
