"""From chunks to a graph: a pluggable extractor in Arrow batches, a deterministic default, and the closed schema."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import defaults as D
from ..functions.chunking import chunks
from ..model import Graph
from ..plans.session import cut, ship


class Triple(NamedTuple):
    src: str
    src_tipo: str
    rel: str
    dst: str
    dst_tipo: str


#: An extractor maps a text to triples; it may raise, and the text is then reported and stays pending.
Extractor = Callable[[str], list[Triple]]


class PatternExtractor:
    """Names in capital letters around a phrase that stands for a relation, with the types that the schema gives its ends."""

    CAPITAL = r"(?:[A-ZÁÉÍÓÚÑÜ]\.|[A-ZÁÉÍÓÚÑÜ][\w'-]*)"  # a word or an initial with its dot
    NAME = rf"({CAPITAL}(?:\s+(?:de|del|la|los|y|{CAPITAL}))*)"

    def __init__(self, phrases: dict[str, tuple[str, str, str]]):
        """phrases: words between two names -> (source type, relation, target type)."""
        self.phrases = [(re.compile(rf"{self.NAME}\s+{re.escape(p)}\s+{self.NAME}"), t) for p, t in phrases.items()]

    def __call__(self, text: str) -> list[Triple]:
        return [Triple(m[1].rstrip(" ."), a, rel, m[2].rstrip(" ."), b) for pattern, (a, rel, b) in self.phrases for m in pattern.finditer(text)]


class GazetteerExtractor:
    """Triples of known names: two names of a dictionary (name -> type) that stand next to each other, with a phrase between them that the closed
    list (phrase -> relation) has. Names are found as written, at word borders, the longest at each place."""

    def __init__(self, names: dict[str, str], phrases: dict[str, str]):
        self.names, self.phrases = names, phrases
        self._found: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None}  # each worker builds its own

    def __call__(self, text: str) -> list[Triple]:
        if not self.names:
            return []
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for n in self.names:
                self._found.add_word(n, n)
            self._found.make_automaton()
        word = lambda at: 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")
        spans = sorted((end + 1 - len(n), -end - 1, n) for end, n in self._found.iter(text) if not word(end - len(n)) and not word(end + 1))
        kept: list[tuple[int, int, str]] = []
        for start, stop, n in spans:
            if not kept or start >= kept[-1][1]:
                kept.append((start, -stop, n))
        pairs = ((a, b, self.phrases.get(" ".join(text[a[1] : b[0]].split()))) for a, b in zip(kept, kept[1:], strict=False))
        return [Triple(a[2], self.names[a[2]], rel, b[2], self.names[b[2]]) for a, b, rel in pairs if rel]


def _triples(docs: DataFrame, extractor: Extractor) -> DataFrame:
    """(doc_id, src, src_tipo, rel, dst, dst_tipo, error): a row a triple, or one with the error."""
    columns = ["doc_id", *Triple._fields, "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                try:
                    rows += [(i, *t, None) for t in extractor(text or "")]
                except Exception as e:  # any failure of a model is this text's alone
                    rows.append((i, *[None] * 5, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=columns)

    return docs.select("doc_id", "text").mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def allowed_relations(spark: SparkSession, triples: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(D.TYPED_RELATIONS if triples is None else triples, "src_tipo string, rel string, dst_tipo string")


def extract(corpus: DataFrame, extractor: Extractor, allowed: DataFrame | None = None) -> tuple[Graph, DataFrame, DataFrame]:
    """corpus (fuente, text) -> a graph with chunks and mentions, the triples that the schema rejects, and (doc_id, error)."""
    spark = ship(corpus.sparkSession)
    allowed = allowed_relations(spark) if allowed is None else allowed
    docs = chunks(corpus, "fuente").select(F.concat_ws("#", "fuente", F.col("chunk").cast("string")).alias("doc_id"), "fuente", "chunk", "text", F.lit(None).cast("array<float>").alias("embedding"))
    found = cut(_triples(docs, extractor))  # the extractor runs once
    on = ["src_tipo", "rel", "dst_tipo"]
    good = found.where("error is null").join(allowed, on, "left_semi")
    ends = good.select("doc_id", F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("src_tipo").alias("tipo")), F.struct(F.col("dst").alias("id"), F.col("dst_tipo").alias("tipo")))).alias("n"))
    mentions = ends.select("doc_id", F.col("n.id").alias("entity_id")).distinct()
    g = model.graph(ends.select("n.id", "n.tipo"), good.select("src", "rel", "dst"), docs, mentions)
    rejected = found.where("error is null").join(allowed, on, "left_anti")
    return g, rejected, found.where("error is not null").select("doc_id", "error")
