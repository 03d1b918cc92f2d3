"""Paths by numbers: these go in the order of texts, also where one name begins another, and names that aren't plain are read back."""

from test_paths import brute, run

from kgloom.operators import paths, retrieve

EDGES = [("a", "R", "m"), ("a b", "R", "m"), ("a!", "R", "m"), ("a", "R S", "n"), ("a", "R", "n"), ("n", "R", "a"), ("z", "R", "n"), ("z", "R", "a!"), ("m", "Q", "z"), ("z", "Q", "m"), ("ab", "R", "a b")]
PAIRS = [(i, x, y) for i, (x, y) in enumerate([("a", "z"), ("a b", "z"), ("ab", "n"), ("ab", "z"), ("a!", "n"), ("m", "n"), ("a", "none")])]


def test_numbers_go_in_the_order_of_texts(spark):
    marks = paths.landmarks(spark.createDataFrame(EDGES, "src string, rel string, dst string"), 2)
    names = {r.id: r.name for r in marks.coded.names.collect()}
    assert marks.coded.plain and [names[i] for i in range(len(names))] == sorted(names.values())
    assert all(marks.coded.adjacency.schema[c].dataType.typeName() in ("integer", "long") for c in ("node", "other", "paso"))
    facts = sorted(marks.coded.adjacency.select("paso").distinct().collect())
    texts = {r.head: r.text for r in marks.coded.texts.collect()}
    read = [texts[r.paso >> 32] + names[r.paso & 0xFFFFFFFF] for r in facts]
    assert read == sorted(read) and len(read) > 7 and "z -Q-> m" not in read  # of parallel edges the least fact
    assert run(spark, EDGES, PAIRS, 6, (2, 6)) == brute(EDGES, PAIRS, 6)


def test_a_list_of_facts_an_entity(spark):
    """Repeated edges count once, and a fact that two entities share stands once."""
    edges = spark.createDataFrame([("a", "R", f"m{i:02}") for i in range(9)] * 2 + [("a", "R", "b"), ("b", "S", "c")], "src string, rel string, dst string")
    detected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b"), (3, "nobody")], "question_id long, id string")
    got = {r.question_id: r.bloque.split("\n")[1:] for r in retrieve.neighbour_blocks(detected, edges, most=4).collect()}
    assert got == {1: ["a -R-> b", "a -R-> m00", "a -R-> m01", "a -R-> m02"], 2: ["a -R-> b", "b -S-> c"]}
