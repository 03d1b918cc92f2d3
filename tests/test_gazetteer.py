"""The dictionary automaton against a walk over words: places, longest spans, parts, and the extractor of known names."""

import random
import re

from kgloom.operators import gazetteer, retrieve
from kgloom.operators.extract import GazetteerExtractor, Triple

WORDS = ["real", "madrid", "ajax", "de", "la", "club", "x", "copa"]


def brute(texts, names):
    """{(question, name, start, stop)} of lower-case ASCII texts."""
    out = set()
    for q, t in texts:
        norm = " ".join((t or "").split())
        for n in names:
            out |= {(q, n, m.start(), m.start() + len(n)) for m in re.finditer(f"(?<![^ ])(?={re.escape(n)}(?![^ ]))", norm)}
    return out


def some(rng):
    names = sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(25)})
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(90, None), (91, ""), (92, " ".join(["real madrid"] * 5000))]
    return names, texts


def test_places_and_longest_spans(spark):
    names, texts = some(random.Random(4))
    t = spark.createDataFrame(texts, "question_id long, text string")
    d = spark.createDataFrame([(n, n) for n in names], "norm string, id string")
    want = brute(texts, names)
    for part_bytes in (gazetteer.PART_BYTES, 300):
        found = gazetteer.occurrences(t, d, part_bytes=part_bytes)
        assert {tuple(r) for r in found.select("question_id", "id", "start", "stop").collect()} == want
    small = gazetteer.longest_spans(found.where("question_id < 90"))
    want = {w for w in want if w[0] < 90}
    inside = {a for a in want for b in want if a[0] == b[0] and a != b and b[2] <= a[2] and a[3] <= b[3]}
    assert {tuple(r) for r in small.select("question_id", "id", "start", "stop").collect()} == want - inside
    assert gazetteer.occurrences(t, d.limit(0)).collect() == [] == gazetteer.occurrences(t.limit(0), d).collect()


def test_names_across_blocks_without_python(spark, monkeypatch, capsys):
    """A dictionary of any size stays out of Python workers; names that go over the end of a block are found once."""
    monkeypatch.setattr(gazetteer, "BLOCK", 3)
    names, texts = some(random.Random(6))
    t, d = spark.createDataFrame(texts, "question_id long, text string"), spark.createDataFrame([(n, n) for n in names], "norm string, id string")
    for part_bytes in (gazetteer.PART_BYTES, 300):
        found = gazetteer.occurrences(t, d, part_bytes=part_bytes)
        got = [tuple(r) for r in found.where("question_id < 92").select("question_id", "id", "start", "stop").collect()]
        assert len(got) == len(set(got)) and set(got) == brute(texts[:-1], names)
        capsys.readouterr()
        found.explain()
        plan = capsys.readouterr().out
        assert "Join" in plan and "Arrow" not in plan and "Python" not in plan


def test_a_short_name_on_its_own_counts_with_spans(spark):
    q = spark.createDataFrame([(1, "¿Ajax o Ajax de Ámsterdam?"), (2, "Ajax de Amsterdam"), (3, "el ajaxiano")], "question_id long, text string")
    e = spark.createDataFrame([("Ajax", 5), ("AJAX", 9), ("Ajax de Ámsterdam", 1)], "id string, grado long")
    found = lambda **kw: {(r.question_id, r.id) for r in retrieve.detect_entities(q, e, **kw).collect()}
    assert found() == {(1, "Ajax de Ámsterdam"), (2, "Ajax de Ámsterdam")}
    assert found(spans=True) == {(1, "AJAX"), (1, "Ajax de Ámsterdam"), (2, "Ajax de Ámsterdam")}


def test_extractor_of_known_names():
    x = GazetteerExtractor({"Johan Cruyff": "Entrenador", "Cruyff": "Entrenador", "Ajax": "Club", "Ajax Cape": "Club"}, {"entrenó al": "ENTRENO_A", ",": "CON"})
    assert x("Johan Cruyff entrenó  al Ajax Cape. Cruyff entrenó al Ajaxito y Cruyff, Ajax") == [
        Triple("Johan Cruyff", "Entrenador", "ENTRENO_A", "Ajax Cape", "Club"), Triple("Cruyff", "Entrenador", "CON", "Ajax", "Club"),
    ]
    assert x("") == [] == GazetteerExtractor({}, {})("Ajax")
