"""Audits: matching names of two sources by three equi-joins, differences per person, precision and coverage, repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_youth_team, significant_tokens


def same_entity(left: DataFrame, right: DataFrame, on: list[str], aliases: DataFrame | None = None) -> DataFrame:
    """left (on..., a), right (on..., b) -> distinct (on..., a, b) that name one entity.

    They are equal, or in one alias group (group_id, name), or have the same non-empty set of significant tokens and both or neither
    the mark of a youth team. Each way is an equi-join."""
    exact = left.withColumn("k", F.col("a")).join(right.withColumn("k", F.col("b")), [*on, "k"]).select(*on, "a", "b")
    sides = []
    for df, c in ((left, "a"), (right, "b")):
        sides.append(df.select("*", significant_tokens(F.col(c)).alias("tokens"), is_youth_team(F.col(c)).alias("youth")).where(F.size("tokens") > 0))
    out = exact.unionByName(sides[0].join(sides[1], [*on, "tokens", "youth"]).select(*on, "a", "b"))
    if aliases is not None:
        by = lambda df, c: df.join(aliases.select("group_id", F.col("name").alias(c)), c)
        out = out.unionByName(by(left, "a").join(by(right, "b"), [*on, "group_id"]).select(*on, "a", "b"))
    return out.distinct()


def judged(edges: DataFrame, truth: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """truth (rel, persona, equipo) against the graph -> (rel, persona, kind, x): what the graph has and the truth too ('ok') or not
    ('extra'), by the graph's names, and what it hasn't ('missing'), by the truth's; people of the truth only."""
    key = ["rel", "persona"]
    t = truth.select(*key, F.col("equipo").alias("b")).distinct()
    mine = edges.select("rel", F.col("src").alias("persona"), F.col("dst").alias("a")).distinct().join(t.select(*key).distinct(), key, "left_semi")
    match = same_entity(mine, t, key, aliases)
    ok = mine.join(match.select(*key, "a", F.lit(True).alias("found")).distinct(), [*key, "a"], "left")
    had = ok.select(*key, F.when(F.col("found"), "ok").otherwise("extra").alias("kind"), F.col("a").alias("x"))
    return had.unionByName(t.join(match, [*key, "b"], "left_anti").select(*key, F.lit("missing").alias("kind"), F.col("b").alias("x")))


def same_listed(left: DataFrame, members: DataFrame, lists: DataFrame) -> DataFrame:
    """`same_entity` of left (persona, a) and a truth in two parts, members (persona, lista) and lists (lista, equipo): distinct (persona, lista, a, b).

    Names meet within a list, whatever number of people share it: first the graph's names of each list, once, then who has them."""
    mine = left.join(members.select("persona", "lista").distinct(), "persona").select("persona", "lista", "a").distinct()
    names = lists.select("lista", F.col("equipo").alias("b")).distinct()
    return mine.join(same_entity(mine.select("lista", "a").distinct(), names, ["lista"]), ["lista", "a"]).select("persona", "lista", "a", "b")


def counted_lists(edges: DataFrame, nodes: DataFrame, members: DataFrame, lists: DataFrame, rel: str) -> DataFrame:
    """`counted` for a truth in two parts of one relation, members (persona, lista) and lists (lista, equipo): the teams of a list, or of
    several that one person has, are counted once, and those that a person lacks are the rest of those that matched."""
    has = members.join(lists.select("lista").distinct(), "lista", "left_semi").groupBy("persona").agg(F.sort_array(F.collect_set("lista")).alias("all"))
    sizes = has.select("all").distinct().select("all", F.explode("all").alias("lista")).join(lists, "lista").select("all", "equipo").distinct().groupBy("all").agg(F.count("*").alias("n_list"))
    people = has.join(sizes, "all").select("persona", "n_list")
    mine = edges.where(F.col("rel") == rel).select(F.col("src").alias("persona"), F.col("dst").alias("a")).distinct().join(people.select("persona"), "persona", "left_semi")
    match = same_listed(mine, members, lists)
    n = match.groupBy("persona").agg(F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b"))
    per = people.join(mine.groupBy("persona").agg(F.count("*").alias("n_mine")), "persona", "left").join(n, "persona", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    there = per.join(nodes.select(F.col("id").alias("persona"), F.lit(True).alias("there")), "persona", "left")
    shown = {"n_ok": zero("n_a"), "n_extra": zero("n_mine") - zero("n_a"), "n_missing": F.col("n_list") - zero("n_b")}
    return there.select(F.lit(rel).alias("rel"), "persona", *(F.when(F.col("there"), v).cast("long").alias(c) for c, v in shown.items()))


def _people(nodes: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.select("rel", "persona").distinct().join(nodes.select(F.col("id").alias("persona"), F.lit(True).alias("there")), "persona", "left")


def compare(edges: DataFrame, nodes: DataFrame, truth: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(rel, persona, correctas, sobran, faltan): sorted lists for each person of the truth, null where the graph doesn't have the
    person. For people to be looked at; `counted` needs no lists."""
    key = ["rel", "persona"]
    pick = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("x"))))
    per = judged(edges, truth, aliases).groupBy(*key).agg(pick("ok").alias("correctas"), pick("extra").alias("sobran"), pick("missing").alias("faltan"))
    shown = lambda c: F.when(F.col("there"), F.coalesce(c, F.array().cast("array<string>"))).alias(c)
    return _people(nodes, truth).join(per, key, "left").select(*key, shown("correctas"), shown("sobran"), shown("faltan"))


def counted(edges: DataFrame, nodes: DataFrame, truth: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(rel, persona, n_ok, n_extra, n_missing); nulls for absent people. No list is made."""
    kinds = {"ok": "n_ok", "extra": "n_extra", "missing": "n_missing"}
    per = judged(edges, truth, aliases).groupBy("rel", "persona").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(c) for k, c in kinds.items()))
    shown = (F.when(F.col("there"), F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in kinds.values())
    return _people(nodes, truth).join(per, ["rel", "persona"], "left").select("rel", "persona", *shown)


def counts(compared: DataFrame) -> DataFrame:
    """The lengths of the lists of `compare`, as `counted` has them."""
    n = lambda c, name: F.when(F.col(c).isNotNull(), F.size(c)).cast("long").alias(name)
    return compared.select("rel", "persona", n("correctas", "n_ok"), n("sobran", "n_extra"), n("faltan", "n_missing"))


def totals(found: DataFrame) -> DataFrame:
    """What `counted` or `compare` gives -> (rel, n_ok, n_graph, n_truth, precision, coverage), micro-averaged; absent people don't
    count."""
    per = (found if "n_ok" in found.columns else counts(found)).groupBy("rel").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_ok", "n_extra", "n_missing")))
    share = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    per = per.withColumns({"n_graph": F.col("n_ok") + F.col("n_extra"), "n_truth": F.col("n_ok") + F.col("n_missing")})
    return per.select("rel", "n_ok", "n_graph", "n_truth", share("n_ok", "n_graph").alias("precision"), share("n_ok", "n_truth").alias("coverage"))


def extra_edges(compared: DataFrame) -> DataFrame:
    """(src, rel, dst) that the graph has and the truth doesn't."""
    return compared.select(F.col("persona").alias("src"), "rel", F.explode("sobran").alias("dst"))


def missing_edges(compared: DataFrame) -> DataFrame:
    return compared.select(F.col("persona").alias("src"), "rel", F.explode("faltan").alias("dst"))


def truth_lists(rows: DataFrame) -> DataFrame:
    """(rel, persona, equipo) -> (rel, persona, equipos): distinct and sorted."""
    return rows.groupBy("rel", "persona").agg(F.sort_array(F.collect_set("equipo")).alias("equipos"))


def career(first: DataFrame, second: DataFrame, tags: tuple[str, str]) -> DataFrame:
    """Two branches of (equipo, inicio, fin) as one table with a constant tag each (tipo); years are the first four characters,
    and labels without a translation (Q and digits) are left out."""
    both = first.select(F.lit(tags[0]).alias("tipo"), "equipo", "inicio", "fin").unionByName(second.select(F.lit(tags[1]).alias("tipo"), "equipo", "inicio", "fin"))
    year = lambda c: F.coalesce(F.substring(c, 1, 4), F.lit("")).alias(c)
    return both.where(~F.col("equipo").rlike("^Q[0-9]+$")).select("tipo", "equipo", year("inicio"), year("fin"))


def statement_careers(claims: DataFrame, qualifiers: DataFrame, labels: DataFrame, roles: dict[str, str], begin: str, end: str, languages: list[str]) -> DataFrame:
    """claims (subject, property, statement, value), qualifiers (statement, property, value) and labels (id, lang, label) as a store of statements
    has them -> (nombre, tipo, equipo, inicio, fin) of the claims whose property has a role.

    Qualifiers are optional, and a statement with several of one kind is a row for each; a label is that of the first language that has
    one (of several the least), else the id itself, which drops the row if it is Q and digits. Years are the first four characters, or empty."""
    role = F.create_map(*(F.lit(x) for kv in roles.items() for x in kv))
    mine = claims.where(F.col("property").isin(list(roles))).select("subject", "statement", "value", role[F.col("property")].alias("tipo"))
    one = lambda p, name: qualifiers.where(F.col("property") == p).select("statement", F.col("value").alias(name))
    rank = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
    named = labels.where(F.col("lang").isin(languages)).groupBy(F.col("id").alias("value")).agg(F.min(F.struct(rank.alias("k"), "label"))["label"].alias("label"))
    rows = mine.join(one(begin, "inicio"), "statement", "left").join(one(end, "fin"), "statement", "left").join(named, "value", "left")
    year = lambda c: F.coalesce(F.substring(c, 1, 4), F.lit("")).alias(c)
    found = rows.select(F.col("subject").alias("nombre"), "tipo", F.coalesce("label", "value").alias("equipo"), year("inicio"), year("fin"))
    return found.where(~F.col("equipo").rlike("^Q[0-9]+$"))


def career_counts(rows: DataFrame) -> DataFrame:
    """(nombre, tipo, ...) -> (nombre, tipo, n): a person's career rows of each role."""
    return rows.groupBy("nombre", "tipo").agg(F.count("*").alias("n"))
