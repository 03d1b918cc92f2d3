"""python -m kgloom COMMAND STORE ...: ingest, dedupe, curate, query, evaluate, site and doctor over a graph store."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import defaults as D
from .functions.text import year_range
from .operators import audit, export, graphs, resolve, retrieve
from .operators.extract import PatternExtractor
from .operators.vectors import VectorIndex
from .plans import answer as answers
from .plans.doctor import doctor
from .sources import files
from .streaming.ingest import ingest, ingest_some


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kgloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, **options: dict) -> None:
        c = sub.add_parser(name)
        c.add_argument("store")
        for f in flags:
            c.add_argument(f"--{f}", action="store_true")
        for o, kw in options.items():
            c.add_argument(o if kw.pop("positional", False) else f"--{o}", **kw)

    command("ingest", "reset", corpus={"required": True}, phrases={"required": True, "help": "JSON: words between names -> [type, relation, type]"}, limit={"type": int})
    command("dedupe", "clean", "confirm", "propose", "apply", groups={"default": "groups.json"})
    command("curate", "apply", "approve", aliases={}, nodes={}, edges={}, whitelist={}, groups={"default": "groups.json"}, approved={"help": "CSV of canonico"}, rejected={"help": "CSV of canonico"}, manual={"help": "JSON of groups"})
    command("query", "index", "rebuild", question={"positional": True, "nargs": "?"}, mode={"choices": ["plano", "grafo", "comparar"], "default": "grafo"})
    command("evaluate", "delete-extra", "add-missing", "review", "download", truth={"required": True}, aliases={}, responses={"help": "JSON lines (nombre, json) of career queries"})
    command("site", out={"default": "index.html"})
    command("doctor")
    return p


def _csv(spark: SparkSession, path: str):
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def _lines():
    """Questions from the terminal, until an empty line, an exit word or the end of input."""
    while True:
        try:
            line = input("> ").strip()
        except EOFError:
            return
        if line.lower() in ("", "salir", "exit", "quit"):
            return
        yield line


def _shown(rows: DataFrame, most: int = 1000) -> DataFrame:
    """Print the first rows, and say how many more there are."""
    rows.show(most, False)
    if (n := rows.count()) > most:
        print(f"... and {n - most} more rows")
    return rows


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("kgloom").getOrCreate()
    store = files.GraphStore(spark, a.store)
    if a.command == "doctor":
        wrong = doctor(spark, a.store)
        print("\n".join(wrong) or "all well")
        return int(bool(wrong))
    if a.command == "ingest":
        if a.reset:
            store.reset()
        with open(a.phrases, encoding="utf-8") as f:
            phrases = {k: tuple(v) for k, v in json.load(f).items()}
        if a.limit:
            print(ingest_some(spark, a.corpus, store, PatternExtractor(phrases), a.limit))
        else:
            print(*ingest(spark, a.corpus, store, PatternExtractor(phrases), f"{a.store}/checkpoint"), sep="\n")
        graphs.type_counts(store.load()).orderBy(F.desc("n")).show()
        graphs.relation_counts(store.load()).orderBy(F.desc("n")).show()
        return 0
    g = store.load()
    if a.command == "dedupe":
        if a.clean:
            resolve.noise(g.nodes).orderBy("motivo", "id").transform(_shown)
            if a.confirm:
                store.delete(nodes=resolve.noise(g.nodes).select("id"))
        if a.propose:
            found = resolve.propose(graphs.degree(g))
            files.write_groups(resolve.keep_decisions(found, files.read_groups(spark, a.groups)) if files.exists(spark, a.groups) else found, a.groups)
        if a.apply:
            store.save(resolve.apply(g, files.read_groups(spark, a.groups)))
    elif a.command == "curate" and a.approve:
        named = lambda path: _csv(spark, path).select("canonico") if path else spark.createDataFrame([], "canonico string")
        manual = files.read_groups(spark, a.manual) if a.manual else None
        marked = resolve.approve(files.read_groups(spark, a.groups), named(a.approved), manual, named(a.rejected))
        files.write_groups(marked, a.groups)
        files.read_groups(spark, a.groups).groupBy("detector", "aprobado").count().show()
    elif a.command == "curate":
        if a.aliases:
            aliases = _csv(spark, a.aliases).withColumn("ord", F.col("ord").cast("int"))
            graphs.present_aliases(g.nodes, aliases).transform(_shown)
            g = graphs.merge_aliases(g, aliases)
        if a.nodes:
            g = graphs.detach_delete(g, _csv(spark, a.nodes))
        if a.edges:
            graphs.existing_edges(g.edges, _csv(spark, a.edges)).transform(_shown)
            g = graphs.delete_edges(g, _csv(spark, a.edges))
        if a.whitelist:
            graphs.outside_whitelist(g.edges, _csv(spark, a.whitelist), "ENTRENO_A").transform(_shown)
            g = graphs.enforce_whitelist(g, _csv(spark, a.whitelist), "ENTRENO_A")
        graphs.year_groups(g.nodes).transform(_shown)
        if a.apply:
            store.save(graphs.merge_years(g))
    elif a.command == "query":
        embed = answers.hashing_embedder()
        if a.index:
            store.replace_docs(retrieve.embed_missing(g.docs if a.rebuild else g.docs.where("embedding is null"), embed, a.rebuild))
            g = store.load()
            retrieve.index_coverage(g.docs).show()
            VectorIndex.build(g.docs, f"{a.store}/vectors").coverage().show()
        index = VectorIndex(spark, f"{a.store}/vectors") if files.exists(spark, f"{a.store}/vectors/centres") else None
        lines = [a.question] if a.question else () if a.index else _lines()
        for line in lines:
            q = spark.createDataFrame([(1, line)], "question_id long, text string")
            for with_graph in {"plano": [False], "grafo": [True], "comparar": [False, True]}[a.mode]:
                r = answers.answer(g, q, embed, with_graph, index=index).first()
                print(f"\n[{'graph' if with_graph else 'chunks'}] {', '.join(r.fuentes)}; {r.hechos} facts, path: {r.camino}, {r.caracteres} characters\n{r.respuesta}")
    elif a.command == "evaluate" and (a.review or a.download):
        rows = files.careers(spark.read.schema("nombre string, json string").json(a.responses))
        audit.career_counts(rows).orderBy("nombre", "tipo").transform(_shown)
        if a.review:
            rows.withColumn("rango", year_range(F.col("inicio"), F.col("fin"))).orderBy("nombre", "tipo", "inicio").select("nombre", "tipo", "equipo", "rango").transform(_shown)
        if a.download:
            named = rows.select(F.col("tipo").alias("rel"), F.col("nombre").alias("persona"), "equipo")
            truth = audit.truth_lists(named).select("rel", "persona", F.explode("equipos").alias("equipo"))
            truth.orderBy("rel", "persona", "equipo").write.mode("overwrite").option("header", True).csv(a.truth)
    elif a.command == "evaluate":
        aliases = _csv(spark, a.aliases) if a.aliases else None
        found = audit.compare(g.edges, g.nodes, _csv(spark, a.truth), aliases)
        found.orderBy("rel", "persona").transform(_shown)
        audit.totals(audit.counted(g.edges, g.nodes, _csv(spark, a.truth), aliases)).show()
        if a.delete_extra:
            g = graphs.delete_edges(g, audit.extra_edges(found))
        if a.add_missing:
            g = graphs.repair(g, audit.missing_edges(found).withColumn("dst_tipo", F.lit("Club")))
        if a.delete_extra or a.add_missing:
            store.save(g)
    elif a.command == "site":
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(export.page(export.site_edges(g, D.CAREER_RELATIONS)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
