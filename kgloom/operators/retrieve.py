"""Retrieval: embeddings, nearest chunks, expansion with facts, entities in questions, routes and contexts for all questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import defaults as D
from ..functions.text import fact
from ..model import Graph
from ..plans.session import cut
from .gazetteer import forms, longest_spans, occurrences
from .graphs import undirected
from .paths import Landmarks, shortest_paths
from .vectors import nearest_of_all

SEPARATOR = "\n\n---\n\n"


def embed_missing(docs: DataFrame, embed: Callable, rebuild: bool = False) -> DataFrame:
    """Fill `embedding` where it is null (everywhere with `rebuild`); `embed` maps a text column to a vector column."""
    old = F.lit(None) if rebuild else F.col("embedding")
    return docs.withColumn("embedding", F.coalesce(old.cast("array<float>"), embed(F.col("text"))))


def index_coverage(docs: DataFrame) -> DataFrame:
    """One row: total, con_vector, dimension (of the first vector by id)."""
    first = F.min(F.when(F.col("embedding").isNotNull(), F.struct("doc_id", F.size("embedding").alias("n"))))
    return docs.agg(F.count("*").alias("total"), F.count("embedding").alias("con_vector"), first["n"].cast("long").alias("dimension"))


def top_k(docs: DataFrame, vectors: DataFrame, k: int = D.TOP_K) -> DataFrame:
    """vectors (question_id, vector), a stated set of questions, against all docs (doc_id, embedding): (question_id, doc_id, score,
    rank), the k nearest by cosine (six digits), then by id; see vectors.py, which also has the index."""
    return nearest_of_all(docs, vectors, k)


def chunk_facts(mentions: DataFrame, edges: DataFrame, most: int = D.MAX_CHUNK_FACTS, distinct_facts: bool = False) -> DataFrame:
    """(doc_id, hechos): facts that leave the entities a chunk mentions, then those that reach them, each list distinct and
    sorted; the first `most` of both."""
    text = fact(F.col("src"), F.col("rel"), F.col("dst")).alias("hecho")
    named = mentions.select("entity_id").distinct()
    w = Window.partitionBy("entity_id").orderBy("hecho")

    def side(end: str, n: int) -> DataFrame:
        """The first facts of a chunk are among the first of the entities it mentions, which are ranked once for all chunks."""
        own = edges.withColumn("entity_id", F.col(end)).join(named, "entity_id", "left_semi").select("entity_id", text).distinct()
        own = own.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("entity_id", "hecho")
        return mentions.join(own, "entity_id").select("doc_id", F.lit(n).alias("lado"), "hecho").distinct()

    both = side("src", 0).unionByName(side("dst", 1))
    if distinct_facts:
        both = both.groupBy("doc_id", "hecho").agg(F.min("lado").alias("lado"))
    # No more than `most` of a chunk come together: a mentioned hub's facts are ranked before they are gathered.
    w = Window.partitionBy("doc_id", "lado").orderBy("hecho")
    first = both.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    listed = first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lado", "hecho"))).alias("m"))
    return listed.select("doc_id", F.slice(F.transform("m", lambda x: x["hecho"]), 1, most).alias("hechos"))


def expanded(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, fuente, text, n_hechos): chunk texts followed by their facts."""
    n = F.coalesce(F.size("hechos"), F.lit(0))
    tail = F.when(n > 0, F.concat(F.lit("\n\n[Relaciones del grafo]\n"), F.array_join("hechos", "\n"))).otherwise(F.lit(""))
    return docs.join(facts, "doc_id", "left").select("doc_id", "fuente", F.concat("text", tail).alias("text"), F.when(F.col("hechos").isNull(), 0).otherwise(F.size("hechos")).cast("long").alias("n_hechos"))


def retrieved_chunks(g: Graph, near: DataFrame, with_graph: bool = True) -> DataFrame:
    """near (question_id, doc_id, rank) -> (question_id, rank, fuente, text, n_hechos): the texts of the chunks that were found, with the facts of what
    these mention; facts of other chunks aren't made."""
    near = cut(near.select("question_id", "doc_id", "rank"))
    wanted = near.select("doc_id").distinct()
    docs = g.docs.join(wanted, "doc_id", "left_semi")
    if with_graph:
        texts = expanded(docs, chunk_facts(g.mentions.join(wanted, "doc_id", "left_semi"), g.edges))
    else:
        texts = docs.select("doc_id", "fuente", "text", F.lit(0).cast("long").alias("n_hechos"))
    return near.join(texts, "doc_id").select("question_id", "rank", "fuente", "text", "n_hechos")


def detect_entities(questions: DataFrame, entities: DataFrame, least_length: int = D.MIN_ENTITY_LENGTH, spans: bool = False) -> DataFrame:
    """(question_id, id, norm): entities named in questions (question_id, text), at word borders; see gazetteer.py.

    Of several names with one form the one of highest degree (then the first) counts. Names within another found name's form are left out;
    with `spans` only where they stand inside it: a short name that also stands on its own is found."""
    found = occurrences(questions, forms(entities, least_length))
    if spans:
        return longest_spans(found).select("question_id", "id", "norm").distinct()
    hits = found.select("question_id", "id", "norm").distinct()
    other = hits.select("question_id", F.col("id").alias("id2"), F.col("norm").alias("norm2"))
    return hits.join(other, (hits.question_id == other.question_id) & (hits.id != other.id2) & F.contains(other.norm2, hits.norm), "left_anti")


def routes(questions: DataFrame, detected: DataFrame) -> DataFrame:
    """(question_id, n, ruta): path for two entities or more, neighbourhood for one, vectors alone for none."""
    n = detected.groupBy("question_id").agg(F.count("*").alias("n"))
    kind = F.when(F.col("n") >= 2, "path").when(F.col("n") == 1, "neighbourhood").otherwise("vectors")
    return questions.select("question_id").join(n, "question_id", "left").select("question_id", F.coalesce("n", F.lit(0)).alias("n")).select("question_id", "n", kind.alias("ruta"))


def entity_pairs(detected: DataFrame) -> DataFrame:
    """(pair_id, question_id, a, b), a before b: all pairs of the entities of one question (few by nature)."""
    x, y = detected.select("question_id", F.col("id").alias("a")), detected.select("question_id", F.col("id").alias("b"))
    return x.join(y, "question_id").where("a < b").select(F.concat_ws("|", F.col("question_id").cast("string"), "a", "b").alias("pair_id"), "question_id", "a", "b")


def neighbour_blocks(detected: DataFrame, edges: DataFrame, relations: list[str] | None = None, most: int = D.MAX_FACTS) -> DataFrame:
    """(question_id, bloque): the first facts around all entities of a question."""
    e = edges if relations is None else edges.where(F.col("rel").isin(relations))
    # A question's first facts are among the first of its entities: each entity's are ranked once, however many questions name it.
    asked = detected.select("question_id", F.col("id").alias("node")).distinct()
    own = undirected(e).join(asked.select("node").distinct(), "node", "left_semi").select("node", fact(F.col("src"), F.col("rel"), F.col("dst")).alias("hecho"))
    own = own.withColumn("n", F.dense_rank().over(Window.partitionBy("node").orderBy("hecho"))).where(F.col("n") <= most)
    # They go to the questions as one list an entity: there are no rows of questions times facts.
    lists = own.groupBy("node").agg(F.collect_set("hecho").alias("lista"))
    first = asked.join(lists, "node").groupBy("question_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lista")))), 1, most).alias("hechos"))
    return first.select("question_id", F.concat(F.lit("[Relaciones de las entidades de la pregunta]\n"), F.array_join("hechos", "\n")).alias("bloque"))


def path_blocks(detected: DataFrame, edges: DataFrame, relations: list[str] | None = None, max_hops: int | None = D.MAX_HOPS, marks: Landmarks | None = None) -> DataFrame:
    """(question_id, bloque): the shortest path of each pair of a question's entities, pairs in order. `marks` are landmarks of the same edges and relations."""
    pairs = entity_pairs(detected)
    paths = shortest_paths(edges, pairs, max_hops, relations, marks).join(pairs.select("pair_id", "question_id", F.col("a").alias("x"), F.col("b").alias("y")), "pair_id")
    line = F.concat("x", F.lit(" <-> "), "y", F.lit(":\n"), F.array_join(F.transform("pasos", lambda p: F.concat(F.lit("  "), p)), "\n"))
    one = paths.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("x", "y", line.alias("l")))).alias("m"))
    return one.select("question_id", F.concat(F.lit("[Camino mas corto entre las entidades de la pregunta]\n"), F.array_join(F.transform("m", lambda r: r["l"]), "\n")).alias("bloque"))


def contexts(questions: DataFrame, detected: DataFrame, edges: DataFrame, chunks: DataFrame, relations: list[str] | None = None, path_relations: list[str] | None = None, max_hops: int | None = D.MAX_HOPS, marks: Landmarks | None = None) -> DataFrame:
    """(question_id, contexto, fuentes, hechos, detectadas, camino, caracteres): path block, then neighbourhood, then chunks.

    chunks: (question_id, rank, fuente, text, n_hechos), the retrieved ones."""
    near, path = neighbour_blocks(detected, edges, relations), path_blocks(detected, edges, path_relations, max_hops, marks)
    per = chunks.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "fuente", "text"))).alias("c"), F.sum("n_hechos").alias("hechos"))
    names = detected.groupBy("question_id").agg(F.sort_array(F.collect_set("id")).alias("detectadas"))
    rows = questions.select("question_id").join(per, "question_id", "left").join(names, "question_id", "left")
    rows = rows.join(near.withColumnRenamed("bloque", "near"), "question_id", "left").join(path.withColumnRenamed("bloque", "path"), "question_id", "left")
    none = F.array().cast("array<string>")
    text = F.concat_ws(SEPARATOR, "path", "near", F.coalesce(F.transform("c", lambda r: r["text"]), none))
    out = rows.select("question_id", text.alias("contexto"), F.coalesce(F.transform("c", lambda r: r["fuente"]), none).alias("fuentes"), F.coalesce("hechos", F.lit(0)).alias("hechos"), F.coalesce("detectadas", none).alias("detectadas"), F.col("path").isNotNull().alias("camino"))
    return out.withColumn("caracteres", F.char_length("contexto").cast("long"))
