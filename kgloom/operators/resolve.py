"""Entity resolution: noise, five duplicate detectors as blocked equi-joins, greedy selection, approval and application.

Entities are (id, tipo, grado). No detector compares all pairs: each explodes one side into blocking keys that every true
pair shares, and verifies what meets.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import defaults as D
from ..functions.text import match_key, noise_reason, normalize
from ..model import Graph
from ..plans.session import cut, ship, written
from . import graphs
from .components import components
from .merges import in_order

DETECTORS = ["normalizacion", "prefijo", "apellido", "subconjunto", "errata", "manual"]


def noise(entities: DataFrame) -> DataFrame:
    """(id, motivo) of the entities that are noise."""
    return entities.select("id", noise_reason(F.col("id")).alias("motivo")).where("motivo is not null")


def clean(g: Graph) -> Graph:
    return graphs.detach_delete(g, noise(g.nodes).select("id"))


def typed(entities: DataFrame) -> DataFrame:
    return entities.where("tipo is not null and tipo <> ''")


def same_key(entities: DataFrame, noise_words: list[str] | None = None) -> DataFrame:
    """Detector 1: (tipo, clave, canonico, variantes): names of one type that are equal when normalised. The canonical is
    the one of highest degree, then the longest, then the first."""
    keyed = typed(entities).withColumn("clave", match_key(F.col("id"), F.col("tipo"), noise_words))
    order = F.sort_array(F.collect_set(F.struct((-F.col("grado")).alias("g"), (-F.char_length("id")).alias("n"), "id")))
    found = keyed.groupBy("tipo", "clave").agg(order.alias("m")).where(F.size("m") >= 2)
    return found.select("tipo", "clave", F.element_at("m", 1)["id"].alias("canonico"), F.transform("m", lambda x: x["id"]).alias("variantes"))


def _normal(entities: DataFrame) -> DataFrame:
    return typed(entities).select("id", "tipo", "grado", normalize(F.col("id")).alias("norm")).where("norm <> ''")


def _prefix_sides(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = _normal(entities).withColumn("t", F.split("norm", " "))
    cuts = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda k: F.array_join(F.slice("t", 1, k), " "))
    long = n.where(F.size("t") > 1).select("tipo", F.explode(cuts).alias("k"), F.col("id").alias("largo"))
    return n.select("tipo", F.col("norm").alias("k"), F.col("id").alias("corto")), long


def prefix_pairs(entities: DataFrame) -> DataFrame:
    """Detector 2: (tipo, corto, largo): the short name is the first words of the long one."""
    return _met(*_prefix_sides(entities))


def _surname_sides(entities: DataFrame, persons: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    n = _normal(entities).where(F.col("tipo").isin(D.PERSON_TYPES if persons is None else persons))
    short = n.where(~F.col("id").contains(" ")).select("tipo", F.col("norm").alias("k"), F.col("id").alias("corto"))
    return short, n.where(F.col("id").contains(" ")).select("tipo", F.element_at(F.split("norm", " "), -1).alias("k"), F.col("id").alias("largo"))


def surname_pairs(entities: DataFrame, persons: list[str] | None = None) -> DataFrame:
    """Detector 3: a single word that is the last word of a longer name; persons only."""
    return _met(*_surname_sides(entities, persons))


def _met(short: DataFrame, long: DataFrame) -> DataFrame:
    return short.join(long, ["tipo", "k"]).select("tipo", "corto", "largo")


def _met_once(short: DataFrame, long: DataFrame) -> DataFrame:
    """The pairs of short forms that have one pair in all. The long forms of a key are counted before they meet the short ones, so
    an ambiguous key, however hot, is one row."""
    counted = long.groupBy("tipo", "k").agg(F.count("*").alias("c"), F.min("largo").alias("largo"))
    return _single(short.join(counted, ["tipo", "k"]).select("tipo", "corto", "largo", "c"), F.sum("c"))


def _single(pairs: DataFrame, count: F.Column) -> DataFrame:
    one = pairs.groupBy("corto").agg(count.alias("n"), F.min(F.struct("tipo", "largo")).alias("m")).where("n = 1")
    return one.select("m.tipo", "corto", "m.largo")


def subset_pairs(entities: DataFrame, persons: list[str] | None = None) -> DataFrame:
    """Detector 4: equal first and last words, and all words of the shorter name among those of the longer; persons only."""
    n = _normal(entities).where(F.col("tipo").isin(D.PERSON_TYPES if persons is None else persons)).withColumn("t", F.split("norm", " "))
    n = n.where(F.size("t") >= 2).select("tipo", "id", "t", F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"))
    a, b = (n.select("tipo", "first", "last", F.col("id").alias(i), F.col("t").alias(t)) for i, t in (("corto", "tc"), ("largo", "tl")))
    return a.join(b, ["tipo", "first", "last"]).where((F.size("tc") < F.size("tl")) & (F.size(F.array_except("tc", "tl")) == 0)).select("tipo", "corto", "largo")


def _less(s: F.Column, i: F.Column) -> F.Column:
    return F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.lit(1 << 30)))


def _places(names: DataFrame) -> DataFrame:
    """A row for each place i of each name. Rows instead of arrays of strings, as these would be made by interpreted functions."""
    return names.select("*", F.explode(F.sequence(F.lit(1), F.col("len"))).alias("i"))


def _two_places(names: DataFrame) -> DataFrame:
    """A row for each two places i < j of each name."""
    return names.select("*", F.explode(F.sequence(F.lit(2), F.col("len"))).alias("j")).select("*", F.explode(F.sequence(F.lit(1), F.col("j") - 1)).alias("i"))


#: Names up to this length meet on what is left of them without two characters, longer ones on their segments.
SHORT_NAME = 16


def typo_pairs(entities: DataFrame, most: int = 2, least_length: int = 6, short_name: int = SHORT_NAME) -> DataFrame:
    """Detector 5: (tipo, corto, largo), corto < largo, whose normal forms differ by 1 or 2 edits; the first has at least six characters.

    Pairs of which the shorter has up to `short_name` characters are of three kinds. Forms that differ in one or two places meet where these are
    masked, and each such pair counts once: at the mask of its two differences, or of its one and the next place. Forms of one length that are
    displaced between two places leave the same without one character each. Of two lengths, the longer leaves without two characters what the other
    leaves without one or is. Of longer names, of `most` edits one of most + 1 segments of the shorter form stays whole, displaced by
    `most` places at most: segments and substrings at these places are the keys. What meets is verified."""
    if most != 2:
        raise ValueError("strings without more than two characters aren't made")
    # The names are read many times: what makes them (words of all texts) runs once.
    n = written(_normal(entities).select("tipo", "id", "norm", F.char_length("norm").alias("len")).where(F.col("len") >= least_length - most))
    true = lambda met: met.where((F.char_length("nx") >= least_length) & F.levenshtein("nx", "ny", most).between(1, most)).select("tipo", F.col("x").alias("corto"), F.col("y").alias("largo"))
    same = n.where((F.col("len") >= least_length) & (F.col("len") <= short_name))
    return true(_in_place(same)).unionByName(true(_displaced(same).unionByName(_longer(n, least_length, short_name)).unionByName(_on_segments(n.where(F.col("len") > short_name), most))).distinct())


def _same_type(one: str, two: str) -> F.Column:
    """Types are part of the keys, which are numbers; an equation here would make the join sort by types first, as texts."""
    return F.col(one).between(F.col(two), F.col(two))


def _met_twice(keys: DataFrame) -> DataFrame:
    """Rows (tipo, id, norm, key, ...) as sides a and b, where they share type and key, and the id of a is the lesser. Both sides are one shuffle
    if the same columns are asked of both."""
    a, b = keys.alias("a"), keys.alias("b")
    return a.join(b.hint("merge"), F.col("a.key") == F.col("b.key")).where(_same_type("a.tipo", "b.tipo") & (F.col("a.id") < F.col("b.id")))


_MET = ["a.tipo", "a.id AS x", "b.id AS y", "a.norm AS nx", "b.norm AS ny"]


def _in_place(n: DataFrame) -> DataFrame:
    """Pairs of one length that differ in one or two places, each once. Keys are names with two places masked; near is 2 if these are the last two,
    1 if one follows the other, else 0."""
    i, j = F.col("i"), F.col("j")
    masked = F.xxhash64("tipo", i, j, F.substring("norm", F.lit(1), i - 1), F.substring("norm", i + 1, j - i - 1), F.substring("norm", j + 1, F.lit(1 << 30)))
    near = F.when(j > i + 1, 0).when(j < F.col("len"), 1).otherwise(2)
    at = lambda k: F.ascii(F.substring("norm", k, F.lit(1)))
    keys = _two_places(n).select("tipo", "id", "norm", masked.alias("key"), at(i).alias("c"), at(j).alias("d"), near.alias("near"))
    once = "a.c <> b.c and a.d <> b.d or a.near > 0 and b.near > 0 and a.c <> b.c or a.near = 2 and b.near = 2 and a.d <> b.d"
    return _met_twice(keys).where(once).selectExpr(*_MET)


def _displaced(n: DataFrame) -> DataFrame:
    """Pairs of one length that are equal without one character each, and differ in three places or more."""
    keys = _places(n).select("tipo", "id", "norm", F.xxhash64("tipo", "len", _less(F.col("norm"), F.col("i"))).alias("key"))
    apart = F.size(F.filter(F.sequence(F.lit(1), F.char_length("nx")), lambda k: F.substring("nx", k, F.lit(1)) != F.substring("ny", k, F.lit(1))))
    return _met_twice(keys).selectExpr(*_MET).where((F.char_length("nx") == F.char_length("ny")) & (apart > 2))


def _longer(n: DataFrame, least_length: int, short_name: int) -> DataFrame:
    """Pairs of which one has one or two characters more, and leaves without two what the other leaves without one or is."""
    norm, i, j = F.col("norm"), F.col("i"), F.col("j")
    key = lambda of, left: F.xxhash64("tipo", of, left).alias("key")
    long = _two_places(n.where((F.col("len") >= least_length) & (F.col("len") <= short_name + 2))).select("tipo", F.col("id").alias("a"), F.col("norm").alias("na"), key("len", _less(_less(norm, j), i)))
    short = n.where(F.col("len") <= short_name).select(F.col("tipo"), "id", "norm", "len")
    one = _places(short.where(F.col("len") >= least_length - 1)).select(F.col("tipo").alias("tipo2"), F.col("id").alias("b"), F.col("norm").alias("nb"), key(F.col("len") + 1, _less(norm, i)))
    none = short.select(F.col("tipo").alias("tipo2"), F.col("id").alias("b"), F.col("norm").alias("nb"), key(F.col("len") + 2, norm))
    first = F.col("a") < F.col("b")
    either = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    met = long.join(one.unionByName(none).hint("merge"), "key").where(_same_type("tipo", "tipo2") & (F.col("a") != F.col("b")))
    return met.select("tipo", either("a", "b").alias("x"), either("b", "a").alias("y"), either("na", "nb").alias("nx"), either("nb", "na").alias("ny"))


def _on_segments(n: DataFrame, most: int) -> DataFrame:
    parts = most + 1

    def bounds(length: F.Column, k: F.Column) -> tuple[F.Column, F.Column]:
        return F.floor(length * k / parts).cast("int"), F.floor(length * (k + 1) / parts).cast("int")

    def segment(k):
        a, b = bounds(F.col("len"), k)
        return F.struct(F.col("len").alias("of"), k.cast("int").alias("k"), F.substring("norm", a + 1, b - a).alias("s"))

    short = n.select("tipo", F.col("id").alias("x"), F.col("norm").alias("nx"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), segment)).alias("key"))
    lengths = n.select("tipo", F.col("id").alias("y"), F.col("norm").alias("ny"), F.col("len").alias("ly"), F.explode(F.sequence(F.col("len") - most, F.col("len"))).alias("of"))
    placed = lengths.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("k")).select("*", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("d"))
    a, b = bounds(F.col("of"), F.col("k"))
    begin = a + F.col("d")
    keys = placed.where((begin >= 0) & (begin + (b - a) <= F.col("ly"))).select("tipo", "y", "ny", F.struct("of", F.col("k").cast("int").alias("k"), F.substring("ny", begin + 1, b - a).alias("s")).alias("key")).distinct()
    met = short.join(keys.hint("merge"), ["tipo", "key"]).where("x <> y")
    swap = F.col("x") < F.col("y")
    turned = lambda p, q: F.when(swap, F.col(p)).otherwise(F.col(q))
    return met.select("tipo", turned("x", "y").alias("x"), turned("y", "x").alias("y"), turned("nx", "ny").alias("nx"), turned("ny", "nx").alias("ny"))


def ambiguous(pairs: DataFrame, shown: int = 6) -> DataFrame:
    """(corto, n, ejemplos): short forms with several long ones, and the first of these. Of a short form's long ones no more than
    `shown` come together."""
    n = pairs.groupBy("corto").agg(F.count("*").alias("n")).where("n > 1")
    w = Window.partitionBy("corto").orderBy("largo")
    first = pairs.select("corto", "largo").distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown)
    return n.join(first.groupBy("corto").agg(F.sort_array(F.collect_list("largo")).alias("ejemplos")), "corto")


def unambiguous(pairs: DataFrame) -> DataFrame:
    """The pairs (tipo, corto, largo) whose short form has no other."""
    return _single(pairs, F.count("*"))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs that a walk in order takes, if a name may be used once."""
    rows, used, kept = rows.sort_values(["prio", "corto", "largo"], kind="stable"), set(), []
    for a, b in zip(rows["corto"], rows["largo"], strict=True):
        kept.append(a not in used and b not in used)
        if kept[-1]:
            used.update((a, b))
    return rows[kept]


#: Pairs of a component that are walked through in one task.
WALK = 200_000
#: Pairs of short components that are walked through together, about.
WALKED = 20_000


def select_pairs(pairs: DataFrame, used: DataFrame, most_rounds: int = 1000, walk: int = WALK) -> DataFrame:
    """pairs (prio, corto, largo, ...) -> those that a walk in order of (prio, corto, largo) takes, if a name may be used once and
    names in `used` (column id) not at all.

    What a pair is taken for depends on pairs that share a name with it, directly or through others, so each component of names is
    walked through on its own, in any task. Components of more than `walk` pairs don't come into one task: of these, in each round every
    pair that is the least at both of its names is taken, and pairs that touch a taken name go, which gives the same. If `most_rounds`
    leave pairs undecided, that raises."""
    columns = pairs.columns
    key = F.struct("prio", "corto", "largo")
    names = lambda df: df.select(F.explode(F.array("corto", "largo")).alias("id")).distinct()

    def without(df: DataFrame, ids: DataFrame) -> DataFrame:
        return df.join(ids.select(F.col("id").alias("corto")), "corto", "left_anti").join(ids.select(F.col("id").alias("largo")), "largo", "left_anti").select(*df.columns)

    free = cut(without(pairs, used))
    of = components(free.select(F.col("corto").alias("a"), F.col("largo").alias("b")))
    rooted = free.join(of.select(F.col("node").alias("corto"), "root"), "corto", "left").withColumn("root", F.coalesce("root", "corto"))
    great = rooted.groupBy("root").agg(F.count("*").alias("c")).where(F.col("c") > walk).select("root")
    great, rooted = cut(great), cut(rooted)
    ship(pairs.sparkSession)
    # Components share no names, so many that are short are walked through together: a call for each would cost more than its walk.
    walks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rooted.count() // WALKED))
    short = rooted.join(great, "root", "left_anti").withColumn("walk", F.pmod(F.xxhash64("root"), F.lit(walks)))
    taken = short.groupBy("walk").applyInPandas(lambda rows: _walk(rows)[columns], free.select(*columns).schema)
    left = cut(rooted.join(great, "root", "left_semi").select(*columns).withColumn("key", key))
    rounds = 0
    while left.limit(1).count():
        if rounds == most_rounds:
            raise RuntimeError(f"pairs are undecided after {most_rounds} rounds")
        rounds += 1
        least = left.select("key", F.explode(F.array("corto", "largo")).alias("id")).groupBy("id").agg(F.min("key").alias("least"))
        both = left.join(least.select(F.col("id").alias("corto"), F.col("least").alias("lc")), "corto").join(least.select(F.col("id").alias("largo"), F.col("least").alias("ll")), "largo")
        now = cut(both.where("key = lc and key = ll").select(*left.columns))
        taken = taken.unionByName(now.drop("key"))
        left = cut(without(left, names(now)))
    return taken


_NOTES = {"prefijo": "revisar: forma corta contenida", "apellido": "revisar: apellido suelto", "subconjunto": "revisar: mismo nombre y apellido, distinto segundo nombre", "errata": "revisar: difieren en 1-2 letras"}


def propose(entities: DataFrame, persons: list[str] | None = None, canonical: str = "degree") -> DataFrame:
    """Merge groups (detector, tipo, canonico, variantes, aprobado, nota) of all detectors.

    canonical: 'reference' takes the long name of a pair, for typos the greater one; 'degree' takes, for typos, the name of higher
    degree, then the longer, then the first."""
    entities = cut(entities)  # all detectors read them; what makes them (words of all texts) runs once
    keys = cut(same_key(entities))
    used = keys.select(F.explode("variantes").alias("id")).distinct()
    found = [("prefijo", _met_once(*_prefix_sides(entities))), ("apellido", _met_once(*_surname_sides(entities, persons))), ("subconjunto", unambiguous(subset_pairs(entities, persons))), ("errata", unambiguous(typo_pairs(entities)))]
    one, *rest = (p.select(F.lit(k).alias("prio"), "tipo", "corto", "largo") for k, (_, p) in enumerate(found))
    for r in rest:
        one = one.unionByName(r)
    pairs = select_pairs(one, used)
    name = F.element_at(F.array(*(F.lit(n) for n, _ in found)), F.col("prio") + 1)
    if canonical == "degree":
        grade = lambda side: entities.groupBy("tipo", F.col("id").alias(side)).agg(F.max("grado").alias(f"g_{side}"))
        pairs = pairs.join(grade("corto"), ["tipo", "corto"]).join(grade("largo"), ["tipo", "largo"])
        rank = lambda side: F.struct(-F.col(f"g_{side}"), -F.char_length(side), F.col(side))
        swap = (F.col("prio") == 3) & (rank("corto") < rank("largo"))
    else:
        swap = F.lit(False)
    first, second = F.when(swap, F.col("corto")).otherwise(F.col("largo")), F.when(swap, F.col("largo")).otherwise(F.col("corto"))
    notes = F.create_map(*(F.lit(x) for kv in _NOTES.items() for x in kv))
    weak = pairs.select(name.alias("detector"), "tipo", first.alias("canonico"), F.array(first, second).alias("variantes"))
    strong = keys.select(F.lit("normalizacion").alias("detector"), "tipo", "canonico", "variantes")
    groups = strong.unionByName(weak)
    return groups.select("*", F.lit(False).alias("aprobado"), F.coalesce(notes[F.col("detector")], F.lit("alta confianza: mismo nombre tras normalizar")).alias("nota"))


def keep_decisions(proposed: DataFrame, before: DataFrame) -> DataFrame:
    """New proposals with the decisions that were made on equal groups; manual groups stay."""
    on = ["detector", "tipo", "canonico", "variantes"]
    old = before.groupBy(*on).agg(F.max("aprobado").alias("was"))
    merged = proposed.join(old, on, "left").withColumn("aprobado", F.coalesce("was", "aprobado")).drop("was").select(*proposed.columns)
    manual = before.where("detector = 'manual'").join(proposed.select("canonico", "detector"), ["canonico", "detector"], "left_anti")
    return merged.unionByName(manual.select(*proposed.columns))


def approve(groups: DataFrame, approved: DataFrame, manual: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """Mark groups: exact keys and approved canonicals (column canonico) yes, rejected ones no; manual groups keep their flag, and
    those whose canonical is missing are added. Running it again changes nothing."""
    yes = groups.join(approved.select("canonico", F.lit(True).alias("__yes")).distinct(), "canonico", "left")
    ok = F.when(F.col("detector") == "manual", F.coalesce("aprobado", F.lit(False))).otherwise((F.col("detector") == "normalizacion") | F.coalesce("__yes", F.lit(False)))
    out = yes.withColumn("aprobado", ok).select(*groups.columns)
    if manual is not None:
        new = manual.join(groups.where("detector = 'manual'").select("canonico"), "canonico", "left_anti")
        out = out.unionByName(new.select(*(c for c in groups.columns if c in new.columns)), allowMissingColumns=True)
    if rejected is not None:
        no = out.join(rejected.select("canonico", F.lit(True).alias("__no")).distinct(), "canonico", "left")
        out = no.withColumn("aprobado", F.col("aprobado") & F.col("__no").isNull()).select(*groups.columns)
    return out


def apply(g: Graph, groups: DataFrame) -> Graph:
    """Merge the approved groups, one after the other, of which two names or more are still in the graph: into the canonical if it is there,
    else into the first variant that is. Groups go by `ord` if they have such a column (as in a file), else by detector, type and name."""
    order = F.col("ord") if "ord" in groups.columns else F.array_position(F.array(*map(F.lit, DETECTORS)), F.coalesce("detector", F.lit(""))).cast("long")
    lists = groups.where(F.coalesce("aprobado", F.lit(False))).select(order.cast("long").alias("prio"), "tipo", "canonico", "variantes")
    return graphs.contract(g, in_order(lists, g.nodes))
