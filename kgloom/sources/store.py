"""The graph store: a base and deltas in Parquet, merged by key when they are read, behind a chain of small manifests.

A commit writes its rows to a folder of its own, then publishes a manifest that names the base and all deltas in order. A manifest is written
aside and renamed to its number, which fails if that number is there: of two writers of one version one loses, and either tries again on
top of the other (what it has written stays valid, as deltas are merged by key) or gives up with `Conflict`. A writer that dies before
that leaves a folder that no manifest names. Readers take the last manifest, or any older one.

Keys are ids, triples, doc_ids and (doc_id, entity_id). Of a key's rows the first delta's properties count, labels are united; a tombstone hides
what earlier deltas have of its key. What a batch writes grows with the batch alone; `compact` folds the deltas into a new base, and does so
by itself beyond MOST_DELTAS, so that a key has a bounded number of rows to merge.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import defaults as D
from ..model import Graph

#: Deltas that a version may have before it is compacted; attempts of a commit that others overtake.
MOST_DELTAS, ATTEMPTS = 16, 20
TABLES = {"nodes": model.NODES, "edges": model.EDGES, "docs": model.DOCS, "mentions": model.MENTIONS}
KEYS = {"nodes": ["id"], "edges": ["src", "rel", "dst"], "docs": ["doc_id"], "mentions": ["doc_id", "entity_id"]}


class Conflict(RuntimeError):
    """Another writer has published a version that this commit doesn't know."""


class GraphStore:
    """A graph in a folder: `versions/` has the manifests, `data/` a folder of tables for each commit."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: The version that was last read through this object, which `save` replaces.
        self.read: int | None = None

    # --- Files ----------------------------------------------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, of the last one by default; version 0 is the empty store."""
        there = self.versions()
        n = (there or [0])[-1] if version is None else version
        if n == 0:
            return {"version": 0, "base": None, "deltas": [], "marks": {}}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.folder}/versions/{n:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs, path = self._fs()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        aside = path(f"{self.folder}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.writeBytes(json.dumps(manifest))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        target = fs.makeQualified(path(f"{self.folder}/versions/{manifest['version']:08d}.json"))
        try:
            files.rename(fs.makeQualified(aside), target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e) or fs.exists(target):
                raise Conflict(f"version {manifest['version']} is there already") from e
            raise

    def _commit(self, change: Callable[[dict], dict | None]) -> int:
        """Publish what `change` makes of the last manifest, again on top of whatever others publish meanwhile; None changes nothing."""
        for attempt in range(ATTEMPTS):
            now = self.manifest()
            new = change(now)
            if new is None:
                return now["version"]
            try:
                self._publish(new | {"version": now["version"] + 1, "time": time.time()})
                return now["version"] + 1
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError

    # --- Reading --------------------------------------------------------------------------------------------------------

    def load(self, version: int | None = None) -> Graph:
        m = self.manifest(version)
        if version is None:
            self.read = m["version"]
        return self._graph(m)

    def _graph(self, m: dict) -> Graph:
        if not m["base"] and not m["deltas"]:
            return model.empty(self.spark)
        return Graph(*(self._table(m, t) for t in TABLES))

    def _table(self, m: dict, t: str) -> DataFrame:
        stored = lambda at: self.spark.read.schema(f"{TABLES[t]}, gone boolean").parquet(f"{self.folder}/data/{at}/{t}")
        columns = [c.split()[0] for c in TABLES[t].split(", ")]
        parts = [(0, m["base"], 0)] * bool(m["base"]) + [(k, d["at"], d["gone"].get(t, 0)) for k, d in enumerate(m["deltas"], 1) if d["rows"].get(t, 0) or d["gone"].get(t, 0)]
        if not parts:
            return self.spark.createDataFrame([], TABLES[t])
        if len(parts) == 1 and not parts[0][2]:
            return stored(parts[0][1]).select(*columns)
        one, *rest = (stored(at).withColumn("seq", F.lit(k)) for k, at, _ in parts)
        for r in rest:
            one = one.unionByName(r)
        rows = one.where("not gone")
        if any(gone for *_, gone in parts):
            last = one.where("gone").groupBy(*KEYS[t]).agg(F.max("seq").alias("cut"))
            rows = rows.join(last, KEYS[t], "left").where("cut is null or seq >= cut")
        keyed = rows.groupBy(*KEYS[t])
        if t == "nodes":
            found = keyed.agg(F.min(F.struct("seq", "origen")).alias("m"), F.flatten(F.collect_set("tipos")).alias("all"))
            labels = found.select("id", model.declared_order(F.array_distinct("all"), D.ENTITY_TYPES).alias("tipos"), F.col("m.origen").alias("origen"))
            return labels.select("id", "tipos", model.first_type(F.col("tipos")).alias("tipo"), "origen")
        if t == "mentions":
            return rows.select(*columns).distinct()
        payload = [c for c in columns if c not in KEYS[t]]
        return keyed.agg(F.min_by(F.struct(*payload), "seq").alias("m")).select(*KEYS[t], *(F.col(f"m.{c}").alias(c) for c in payload)).select(*columns)

    def history(self) -> DataFrame:
        """(version, time, deltas, nodes, edges, docs, mentions): the versions, and what each one's last commit has written."""
        rows = []
        for v in self.versions():
            m = self.manifest(v)
            last = m["deltas"][-1]["rows"] if m["deltas"] else m.get("rows", {})
            rows.append((v, m["time"], len(m["deltas"]), *(last.get(t) for t in TABLES)))
        return self.spark.createDataFrame(rows, "version int, time double, deltas int, nodes long, edges long, docs long, mentions long")

    # --- Writing --------------------------------------------------------------------------------------------------------

    def _write(self, tables: dict[str, DataFrame]) -> dict:
        """Write tables (with `gone`) to a folder of their own: {at, rows, gone}, counted as they are written."""
        at, rows, gone = uuid.uuid4().hex, {}, {}
        for t, df in tables.items():
            seen = Observation()
            observed = df.observe(seen, F.count(F.when(~F.col("gone"), 1)).alias("rows"), F.count(F.when(F.col("gone"), 1)).alias("gone"))
            writer = observed.write.option("compression", "zstd")
            (writer.partitionBy("rel") if t == "edges" else writer).parquet(f"{self.folder}/data/{at}/{t}")
            rows[t], gone[t] = seen.get["rows"], seen.get["gone"]
        return {"at": at, "rows": rows, "gone": gone}

    def _rows(self, g: Graph) -> dict[str, DataFrame]:
        blank = model.empty(self.spark)
        columns = {t: [c.split()[0] for c in s.split(", ")] for t, s in TABLES.items()}
        return {t: (getattr(blank, t) if getattr(g, t) is None else getattr(g, t)).select(*columns[t], F.lit(False).alias("gone")) for t in TABLES}

    def save(self, g: Graph) -> int:
        """Make a graph the whole store. If others have published since this object last read the store, that raises `Conflict`: what
        they have added isn't in the graph."""
        known = self.read
        made = self._write(self._rows(g))

        def change(now: dict) -> dict:
            if known is not None and now["version"] != known:
                raise Conflict(f"version {now['version']} came after version {known}, which this graph was made of")
            return {"base": made["at"], "rows": made["rows"], "deltas": [], "marks": now["marks"]}

        self.read = self._commit(change)
        return self.read

    def _add(self, tables: dict[str, DataFrame], mark: tuple[str, int] | None = None) -> dict[str, int]:
        if mark and self.manifest()["marks"].get(mark[0], -1) >= mark[1]:
            return dict.fromkeys(TABLES, 0)
        delta = self._write(tables)

        def change(now: dict) -> dict | None:
            if mark and now["marks"].get(mark[0], -1) >= mark[1]:
                return None
            return now | {"deltas": [*now["deltas"], delta], "marks": now["marks"] | ({mark[0]: mark[1]} if mark else {})}

        done = self._commit(change)
        if len(self.manifest(done)["deltas"]) > MOST_DELTAS:
            self.compact()
        return delta["rows"]

    def upsert(self, new: Graph, mark: tuple[str, int] | None = None) -> dict[str, int]:
        """Add a graph by key, as one delta: what was there first keeps its properties. Returns the rows of each table, counted as they were
        written. A batch with a mark (a stream's name, its number) is added once: one whose number is there or below changes nothing."""
        return self._add(self._rows(new), mark)

    def delete(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> dict[str, int]:
        """Hide nodes (id) with their edges and mentions, and edges (src, rel, dst), as one delta of tombstones."""
        g, tables = self._graph(self.manifest()), {}
        blank = lambda t, keys: [F.col(c.split()[0]) if c.split()[0] in keys else F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in TABLES[t].split(", ")] + [F.lit(True).alias("gone")]
        gone = edges.select(*KEYS["edges"]).distinct() if edges is not None else None
        if nodes is not None:
            ids = nodes.select("id").distinct()
            tables["nodes"] = ids.select(*blank("nodes", KEYS["nodes"]))
            ends = F.explode(F.array("src", "dst")).alias("id")
            theirs = g.edges.select(*KEYS["edges"], ends).join(ids, "id", "left_semi").select(*KEYS["edges"]).distinct()
            gone = theirs if gone is None else gone.unionByName(theirs).distinct()
            tables["mentions"] = g.mentions.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").select(*blank("mentions", KEYS["mentions"]))
        if gone is not None:
            tables["edges"] = gone.select(*blank("edges", KEYS["edges"]))
        return self._add(tables)

    def replace_docs(self, docs: DataFrame) -> dict[str, int]:
        """Put chunks in the place of those of the same doc_id, as vectors are filled in."""
        columns = [c.split()[0] for c in TABLES["docs"].split(", ")]
        fresh = docs.select(*columns, F.lit(False).alias("gone"))
        return self._add({"docs": fresh.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("dead")).select(*columns, F.col("dead").alias("gone"))})

    def compact(self) -> int:
        """Fold the deltas into a new base. Deltas that others publish meanwhile stay deltas."""
        before = self.manifest()
        if not before["deltas"]:
            return before["version"]
        made = self._write(self._rows(self._graph(before)))
        folded = [d["at"] for d in before["deltas"]]

        def change(now: dict) -> dict:
            if now["base"] != before["base"] or [d["at"] for d in now["deltas"][: len(folded)]] != folded:
                raise Conflict("another writer has made a new base")
            return now | {"base": made["at"], "rows": made["rows"], "deltas": now["deltas"][len(folded) :]}

        return self._commit(change)

    def vacuum(self, keep: int = 2, older_than_s: float = 3600) -> list[str]:
        """Delete manifests but the last `keep`, and folders that no manifest left names and that are older than so many seconds
        (younger ones may belong to a commit that is under way). Returns the folders."""
        fs, path = self._fs()
        for v in self.versions()[:-keep]:
            fs.delete(path(f"{self.folder}/versions/{v:08d}.json"), False)
        named = set()
        for v in self.versions():
            m = self.manifest(v)
            named |= {m["base"], *(d["at"] for d in m["deltas"])}
        old = [n for n in self._names("data") if n not in named and fs.getFileStatus(path(f"{self.folder}/data/{n}")).getModificationTime() < (time.time() - older_than_s) * 1000]
        for n in old:
            fs.delete(path(f"{self.folder}/data/{n}"), True)
        return old

    def assert_unique(self) -> None:
        if self._graph(self.manifest()).nodes.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("an id has two nodes")

    def reset(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.folder), True)
        self.read = None
