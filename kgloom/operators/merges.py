"""Merge lists applied one after the other, as a walk through them would, where lists share names.

A list merges those of its names that are still there into the first of them (the canonical leads) and, if asked, gives what is merged
the canonical's name; names that are gone take no part in later lists. What a list does depends only on earlier lists that share a name with it,
directly or through others, so each component of names is walked through on its own, in any task. Components of very many names
go by rounds over the cluster instead: in each, the lists that are the earliest at all of their names are applied.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut, ship
from .components import components

#: Names of a component that are walked through in one task.
WALK = 200_000
_KEY = ["prio", "tipo", "canonico", "nombres"]
_MAP = "variante string, canonico string, ord int"


def _walk(lists: pd.DataFrame, rename: bool, least: int) -> pd.DataFrame:
    """(variante, canonico, ord) of one component; ord 0 has the properties that the merged node keeps."""
    rows = sorted((int(p), t, c, list(n), set(h)) for p, t, c, n, h in zip(lists["prio"], lists["tipo"], lists["canonico"], lists["nombres"], lists["hay"], strict=True))
    live = {name: [name] for *_, here in rows for name in here}
    for _, _, canonical, names, _ in rows:
        here = [n for n in dict.fromkeys(names) if n in live]
        if len(here) >= least:
            merged = [o for n in here for o in live.pop(n)]
            live[canonical if rename else here[0]] = merged
    out = [(o, now, int(k > 0)) for now, originals in live.items() for k, o in enumerate(originals) if o != now or k]
    return pd.DataFrame(out, columns=["variante", "canonico", "ord"])


def _by_rounds(lists: DataFrame, rename: bool, least: int, most_rounds: int) -> DataFrame:
    """The same for components of any size: (variante, canonico, ord)."""
    left = cut(lists.select(F.struct(*_KEY).alias("key"), "canonico", "nombres", "hay"))
    now = cut(left.select(F.explode("hay").alias("variante")).distinct().select("variante", F.col("variante").alias("canonico"), F.lit(True).alias("first")))
    for _ in range(most_rounds):
        if not left.limit(1).count():
            return now.where("variante <> canonico or not first").select("variante", "canonico", F.when(F.col("first"), 0).otherwise(1).alias("ord"))
        at = left.select("key", "canonico", F.posexplode("nombres").alias("pos", "name"))
        earliest = at.groupBy("name").agg(F.min("key").alias("earliest"))
        ready = cut(at.join(earliest, "name").groupBy("key").agg(F.bool_and(F.col("key") == F.col("earliest")).alias("r")).where("r").select("key"))
        live = now.select(F.col("canonico").alias("name")).distinct()
        here = at.join(ready, "key", "left_semi").join(live, "name", "left_semi").groupBy("key", "name").agg(F.min("pos").alias("pos"), F.first("canonico").alias("canonico"))
        some = here.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("pos", "name"))["name"].alias("leader")).where(F.col("n") >= least)
        target = F.col("canonico") if rename else F.col("leader")
        moves = here.join(some, "key").select(F.col("name").alias("canonico"), target.alias("to"), (F.col("name") == F.col("leader")).alias("leads"))
        now = cut(now.join(moves, "canonico", "left").select("variante", F.coalesce("to", "canonico").alias("canonico"), (F.col("first") & F.coalesce("leads", F.lit(True))).alias("first")))
        left = cut(left.join(ready, "key", "left_anti"))
    raise RuntimeError(f"lists are left after {most_rounds} rounds")


def in_order(lists: DataFrame, nodes: DataFrame, rename: bool = False, least: int = 2, walk: int = WALK, most_rounds: int = 1000) -> DataFrame:
    """lists (prio, tipo, canonico, variantes), applied by (prio, tipo, canonico, names) to the nodes (column id) -> (variante, canonico, ord) of
    each node that gets another name or other properties; the one with ord 0 gives its own to what is merged.

    Null names count for nothing, repeated names once. Lists of which fewer than `least` names are there change nothing."""
    whole = F.array_distinct(F.array_compact(F.concat(F.array("canonico"), F.coalesce("variantes", F.array().cast("array<string>")))))
    every = lists.where("canonico is not null").select("prio", F.coalesce("tipo", F.lit("")).alias("tipo"), "canonico", whole.alias("nombres")).distinct()
    at = every.select(*_KEY, F.explode("nombres").alias("id"))
    there = at.join(nodes.select("id").distinct(), "id", "left_semi").groupBy(*_KEY).agg(F.sort_array(F.collect_set("id")).alias("hay"))
    # without renaming no name comes back, so lists that have too few names at the beginning never get more
    kept = there.where(F.size("hay") >= least) if not rename else every.join(there, _KEY, "left").withColumn("hay", F.coalesce("hay", F.array().cast("array<string>")))
    kept = cut(kept.select(*_KEY, "hay"))
    counting = kept.select("canonico", F.explode("nombres" if rename else "hay").alias("b"), F.element_at("hay", 1).alias("h"))
    links = counting.select((F.col("canonico") if rename else F.col("h")).alias("a"), "b")
    of = components(links)
    anchor = F.col("canonico") if rename else F.element_at("hay", 1)
    rooted = kept.withColumn("a", anchor).join(of.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a")).drop("a")
    great = cut(rooted.groupBy("root").agg(F.sum(F.size("nombres")).alias("n")).where(F.col("n") > walk).select("root"))
    rooted = cut(rooted)
    ship(lists.sparkSession)
    out = rooted.join(great, "root", "left_anti").groupBy("root").applyInPandas(lambda rows: _walk(rows, rename, least), _MAP)
    if great.limit(1).count():
        out = out.unionByName(_by_rounds(rooted.join(great, "root", "left_semi"), rename, least, most_rounds))
    return cut(out)
