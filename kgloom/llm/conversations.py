"""Conversation prefix trie: which turns conversations begin with in common, and what sharing them would save.

Conversations are rebuilt from stems (see `rebuilt`), a turn is told from another by 128 bits of SHA-256 over role and text, and a
conversation is the string of its turns' digests, 16 bytes a turn; texts are never shuffled. Equal conversations become one row
with their number before anything else is done, however many there are, so copies make no group large.

The rows are dealt by their first turn, and tries are built from pointer dictionaries inside applyInPandas, some to each call. Where the
conversations of one first turn have more turns than a call should get, they are dealt by the next turn at which they differ instead, and
so on, recursively: the turns that such a group has in common (the common beginning of its least and its greatest string) are a
chain that needs no trie. A chain's end is a split. Whatever is below a split reports its totals to it and to the splits above, as sums,
so that no task holds a split's group. Totals go up inside a call by an iterative postorder: children are made after their parents, so the
nodes backwards have each child before its parent.

The digest of the conversations that end at a node has to run over their ids in order. Ids are joined in blocks of 4,096 at most, which
are made in parallel; one task then runs over a node's blocks, a block at a time.

Defined results: rows without conv_id are left out; null role and text are empty; turns go by turn, null first, rows of one turn by their
digest; a repeated row is a turn of its own. The stem of a negative conv_id is the multiple of 100 next to it toward zero. A conversation's
digests are one row (long conversations are tested with 100,000 turns). Extra columns are not read. A table without conversations gives no
rows, not even the root, as no member names it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, tidy, tune, written

#: Fixed values of the contract: ids of one stem, and one more than the most turns of a stem.
STEM, SHARED = 100, 6
#: Bytes of a turn's digest, and ids of a block.
DIGEST, BLOCK = 16, 4096
#: Turns that one trie may have, whatever the number of tasks; and turns below which a group isn't dealt anew.
MOST_TURNS, FEW_TURNS = 500_000, 256
NOBODY = hashlib.sha256(b"").hexdigest()
_LEAST, _GREATEST = -(1 << 63), (1 << 63) - 1


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, seq (digests of the turns, joined) and chars (code points of their texts) of every conversation: the first h turns of the
    stem conversation (conv_id less conv_id % 100), then its own turns after the first h, where h is crc32(conv_id) % 6."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("t"), digest.alias("d"), F.char_length(text).alias("n")).alias("turn"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    whole = written(whole.select("conv_id", F.transform("own", lambda x: F.struct(x["d"], x["n"])).alias("own")))
    stems = whole.where(F.col("conv_id") % STEM == 0).select(F.col("conv_id").alias("stem"), F.slice("own", 1, SHARED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    joined = whole.select("*", (F.col("conv_id") - F.col("conv_id") % STEM).alias("stem"), h.alias("h")).join(stems, "stem", "left")
    nothing = F.slice("own", 1, F.lit(0))
    new = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), nothing), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return joined.select("conv_id", new.alias("w")).select("conv_id", F.unhex(F.array_join(F.transform("w", lambda x: x["d"]), "")).alias("seq"), F.transform("w", lambda x: x["n"]).alias("chars"))


def _first(seq: Column, turns: Column) -> Column:
    """The digests of the first turns."""
    return F.substring(seq, F.lit(1), turns * DIGEST)


def _name(seq: Column, turns: Column) -> Column:
    """What the node after so many turns is called: a digest of its turns' digests."""
    return F.unhex(F.sha2(_first(seq, turns), 256))


def _ends(conversations: DataFrame) -> DataFrame:
    """name and ends: the digest of the ids of all conversations of one string, in order and joined by commas."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = conversations.select(F.unhex(F.sha2("seq", 256)).alias("name"), "conv_id", F.expr(f"conv_id div {BLOCK}").alias("block")).groupBy("name", "block").agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by name and block; a name may go on in the next batch."""
        now, digest = None, None
        for b in batches:
            done = []
            for name, ids in zip(b.column("name").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if name == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = name, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["name", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["name", "ends"])

    return blocks.repartition("name").sortWithinPartitions("name", "block").mapInArrow(tidy(run), "name binary, ends string")


def _distinct(conversations: DataFrame) -> DataFrame:
    """Each different conversation once: seq, chars, length, n (conversations), first (least conv_id), ends."""
    found = conversations.groupBy("seq", "chars").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    found = found.select("*", F.size("chars").alias("length"), F.unhex(F.sha2("seq", 256)).alias("name"))
    return written(found.join(_ends(conversations), "name").drop("name"))


def _in_common(a: Column, b: Column) -> Column:
    """How many turns two strings begin with in common."""
    shorter = F.least(F.octet_length(a), F.octet_length(b)) / DIGEST
    piece = lambda s, i: F.substring(s, (i - 1) * DIGEST + 1, F.lit(DIGEST))
    differ = F.filter(F.sequence(F.lit(1), shorter.cast("int")), lambda i: piece(a, i) != piece(b, i))
    return F.coalesce(F.array_min(differ) - 1, shorter.cast("int"))


def _dealt(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups that one trie can take, by recursive dealing: (rows with `cuts`, the splits' depths above them, of which the first is the root's, 0;
    conversations that end at a split, with cuts up to it; the splits themselves: cuts, seq and chars of the chain)."""
    now = rows.where("length > 0").withColumn("cuts", F.array(F.lit(0)))
    placed, ended, splits = [], [rows.where("length = 0").withColumn("cuts", F.array(F.lit(0)))], []
    last = F.element_at("cuts", -1)
    while True:
        now = now.withColumn("group", _name(F.col("seq"), last + 1))
        great = keep(now.groupBy("group").agg(F.sum("length").alias("t"), F.count("*").alias("c")).where((F.col("t") > most) & (F.col("c") > 1)).select("group"))
        placed.append(now.join(great, "group", "left_anti").drop("group"))
        if not great.limit(1).count():
            break
        over = now.join(great, "group", "left_semi")
        ends = over.groupBy("group").agg(F.min(F.struct("seq", "chars", "cuts")).alias("a"), F.max("seq").alias("z"))
        ends = ends.select("group", "a", _in_common(F.col("a.seq"), F.col("z")).alias("common"))
        chains = written(ends.select("group", "common", _first(F.col("a.seq"), F.col("common")).alias("seq"), F.slice("a.chars", F.lit(1), F.col("common")).alias("chars"), F.col("a.cuts").alias("cuts")))
        splits.append(chains.select("seq", "chars", F.concat("cuts", F.array("common")).alias("cuts")))
        deeper = written(over.join(chains.select("group", "common"), "group").select("seq", "chars", "n", "first", "length", "ends", F.concat("cuts", F.array("common")).alias("cuts")))
        ended.append(deeper.where(F.col("length") == last))
        now = deeper.where(F.col("length") > last)
    one = lambda parts: parts[0] if len(parts) == 1 else one([parts[0].unionByName(parts[1]), *parts[2:]])
    columns = ["seq", "chars", "n", "first", "length", "ends", "cuts"]
    root = rows.limit(0).select("seq", "chars", F.array(F.lit(0)).alias("cuts"))
    return one([p.select(*columns) for p in placed]), one([e.select(*columns) for e in ended]), one([root, *splits])


_FOREST = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, cuts array<int>, top binary"


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of some groups. A trie's top stands one turn below the last cut; it carries its cuts and its string."""
    tops: dict[bytes, int] = {}
    child: list[dict[bytes, int]] = []
    parent: list[int] = []
    depth: list[int] = []
    chars: list[int] = []
    members: list[int] = []
    least: list[int] = []
    ends: list[str] = []
    cuts: list = []
    path: list = []

    def grow(above: int, at: int, n: int) -> int:
        child.append({})
        parent.append(above)
        depth.append(at)
        chars.append(n)
        members.append(0)
        least.append(_GREATEST)
        ends.append(NOBODY)
        cuts.append(None)
        path.append(None)
        return len(child) - 1

    for seq, own_chars, n, first, end, above in zip(rows["seq"], rows["chars"], rows["n"], rows["first"], rows["ends"], rows["cuts"], strict=True):
        seq, start = bytes(seq), int(above[-1])
        begin = seq[: (start + 1) * DIGEST]
        node = tops.get(begin)
        if node is None:
            node = tops[begin] = grow(-1, start + 1, int(own_chars[start]))
            cuts[node], path[node] = [int(c) for c in above], begin
        for d in range(start + 1, len(own_chars) + 1):
            members[node] += n
            least[node] = min(least[node], first)
            if d == len(own_chars):
                ends[node] = end
                break
            piece = seq[d * DIGEST : (d + 1) * DIGEST]
            below = child[node].get(piece)
            if below is None:
                below = child[node][piece] = grow(node, d + 1, int(own_chars[d]))
            node = below
    leaves = [0 if c else 1 for c in child]
    saved = [(m - 1) * c for m, c in zip(members, chars, strict=True)]
    for node in range(len(child) - 1, -1, -1):
        if parent[node] >= 0:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    above = pd.array([least[p] if p >= 0 else None for p in parent], dtype="Int64")
    return pd.DataFrame({"depth": depth, "conv_id": least, "parent_conv_id": above, "n_convs": members, "n_children": [len(c) for c in child], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "cuts": cuts, "top": path})


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _above(tops: DataFrame, ended: DataFrame, splits: DataFrame) -> DataFrame:
    """Each split with its totals: name, up (the name of the split above), depth, chars (of its chain), n_convs, conv_id, n_leaves,
    n_children, saved_tokens (of the whole chain and what is below), ends_sha256. The root is a split of depth 0 whose chain is empty."""
    named = lambda seq: F.transform("cuts", lambda c: F.struct(_name(F.col(seq), c).alias("name"), c.alias("depth")))
    from_tops = tops.select(F.explode(named("top")).alias("s"), "n_convs", "conv_id", "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
    last = F.element_at("cuts", -1)
    from_ends = ended.select(F.explode(named("seq")).alias("s"), F.col("n").alias("n_convs"), F.col("first").alias("conv_id"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "ends", last.alias("at"))
    from_ends = from_ends.withColumn("ends", F.when(F.col("s.depth") == F.col("at"), F.col("ends"))).drop("at")
    both = from_tops.unionByName(from_ends).groupBy(F.col("s.name").alias("name"))
    totals = both.agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.max("ends").alias("ends"))
    totals = keep(totals)
    before = F.element_at("cuts", -2)
    chain = splits.select(_name(F.col("seq"), last).alias("name"), _name(F.col("seq"), before).alias("up"), last.alias("depth"), F.slice("chars", before + 1, last - before).alias("chars"), F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), lambda c: _name(F.col("seq"), c)).alias("line"))
    root = totals.sparkSession.range(1).select(F.unhex(F.lit(NOBODY)).alias("name"), F.lit(None).cast("binary").alias("up"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("chars"), F.array().cast("array<binary>").alias("line"))
    own = F.aggregate("chars", F.lit(0).cast("long"), lambda s, c: s + c) * (F.col("n_convs") - 1)
    found = keep(root.unionByName(chain).join(totals, "name").withColumn("own", own))
    shared = found.select(F.explode(F.concat("line", F.array("name"))).alias("name"), "own").groupBy("name").agg(F.sum("own").alias("chains"))
    children = tops.select(_name(F.col("top"), last).alias("name")).unionByName(found.where("up is not null").select(F.col("up").alias("name"))).groupBy("name").agg(F.count("*").alias("n_children"))
    out = found.join(shared, "name").join(children, "name", "left")
    return keep(
        out.select(
            "name", "up", "depth", "chars", "n_convs", "conv_id", F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            (F.col("below") + F.col("chains")).alias("saved_tokens"), F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
        )
    )


def _along(splits: DataFrame) -> DataFrame:
    """The nodes of the splits' chains: all have the split's members, and all but the last one child."""
    up = splits.select(F.col("name").alias("up"), F.col("conv_id").alias("up_conv"))
    each = splits.where("up is not null").join(up, "up").select("*", F.explode(F.sequence(F.lit(1), F.size("chars"))).alias("k"))
    m = F.size("chars")
    before = F.aggregate(F.slice("chars", F.lit(1), F.col("k") - 1), F.lit(0).cast("long"), lambda s, c: s + c) * (F.col("n_convs") - 1)
    below = F.col("k") < m
    chains = each.select(
        "conv_id", (F.col("depth") - m + F.col("k")).cast("long").alias("depth"), F.when(F.col("k") == 1, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(below, F.lit(1)).otherwise(F.col("n_children")).cast("long").alias("n_children"), "n_leaves", (F.col("saved_tokens") - before).alias("saved_tokens"), F.when(below, F.lit(NOBODY)).otherwise(F.col("ends_sha256")).alias("ends_sha256"),
    )
    root = splits.where("up is null").select("conv_id", F.col("depth").cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return root.unionByName(chains)


def trie(turns: DataFrame, most: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations. `most` turns at most are in one trie of a task; by default a share
    of all turns that leaves several tries a task, MOST_TURNS at most."""
    spark = tune(turns.sparkSession)
    conversations = written(rebuilt(turns))
    rows = _distinct(conversations)
    total = rows.agg(F.sum("length")).first()[0]
    if total is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = most or min(MOST_TURNS, max(FEW_TURNS, total // (4 * tasks)))
    placed, ended, splits = _dealt(rows, most)
    bins = max(8 * tasks, -(-4 * total // MOST_TURNS))
    forest = placed.withColumn("bin", F.pmod(F.xxhash64(_first(F.col("seq"), F.element_at("cuts", -1) + 1)), F.lit(bins)))
    nodes = written(forest.select("bin", "seq", "chars", "n", "first", "ends", "cuts").groupBy("bin").applyInPandas(_forest, _FOREST))
    tops = nodes.where("top is not null")
    above = _above(tops, ended, splits)
    parents = above.select("name", F.col("conv_id").alias("up_conv"))
    heads = tops.withColumn("name", _name(F.col("top"), F.element_at("cuts", -1))).join(parents, "name").withColumn("parent_conv_id", F.col("up_conv"))
    return nodes.where("top is null").select(*_NODE).unionByName(heads.select(*_NODE)).unionByName(_along(above).select(*_NODE))


#: The same in SQL, where every node is the list of its turns.
ORACLE = """
WITH own AS (SELECT CAST(conv_id AS BIGINT) AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS w
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, w, xor(list_reduce(list_prepend(4294967295, [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')]),
             lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda k, z: xor(k >> 1, 3988292384 * (k & 1)))), 4294967295) % 6 AS h FROM own),
r AS (SELECT h.c, list_concat(coalesce(s.w[1:h.h], []), h.w[h.h + 1:]) AS w FROM h LEFT JOIN own s ON s.c = h.c - h.c % 100),
n AS (SELECT w[1:d] AS k, d, count(*) AS n_convs, min(c) AS conv_id FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM r) GROUP BY ALL),
e AS (SELECT w AS k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM r GROUP BY w),
c AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.k, n.d, n_convs, conv_id, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.k[n.d].t) END AS own FROM n LEFT JOIN c ON n.k = c.k AND n.d = c.d),
u AS (SELECT k[1:j] AS k, j AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM m) GROUP BY ALL)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens,
       coalesce(e.ends, sha256('')) AS ends_sha256
FROM m JOIN u ON m.k = u.k AND m.d = u.d LEFT JOIN e ON e.k = m.k LEFT JOIN n p ON m.d > 0 AND p.d = m.d - 1 AND p.k = m.k[1:m.d - 1]
"""
