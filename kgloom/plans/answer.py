"""Answering: contexts for a table of questions, and a model that is given them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import defaults as D
from ..model import Graph
from ..operators import graphs, retrieve
from ..operators.vectors import VectorIndex
from .session import ship

#: A model maps (context, question) to an answer.
AnswerModel = Callable[[str, str], str]


def context_only(context: str, question: str) -> str:
    """The default model: it answers with the context itself, which is all that may be claimed."""
    return context


#: A prompt for a text model: what may be claimed, and the two places that are filled in.
PROMPT = """Answer from the context alone. Facts are written as source -RELATION-> target; read each relation literally.
Don't infer that two people met or worked together because they share a target. Every claim needs a line of the context;
count only lines that support the count. If there is a path between entities, explain it step by step. If the context
doesn't hold the answer, say so.

CONTEXT:
{contexto}

QUESTION: {pregunta}

ANSWER:"""


def templated(generate: Callable[[str], str], template: str = PROMPT) -> AnswerModel:
    """An answer model from a text model: the template is filled with context and question, whatever braces they hold."""

    def say(context: str, question: str) -> str:
        before, _, rest = template.partition("{contexto}")
        middle, _, after = rest.partition("{pregunta}")
        return generate(before + context + middle + question + after)

    return say


def hashing_embedder(dimension: int = 256) -> Callable[[Column], Column]:
    """A deterministic embedder: words hashed into signed places, scaled to length one."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text):
            v = np.zeros(dimension, dtype=np.float32)
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dimension] += 1 if h >> 63 else -1
            n = float(np.linalg.norm(v))
            return (v / n if n else v).tolist()

        return texts.map(one)

    return embed


def answer(g: Graph, questions: DataFrame, embed: Callable[[Column], Column], with_graph: bool = True, k: int = D.TOP_K, model: AnswerModel | None = None, index: VectorIndex | None = None) -> DataFrame:
    """questions (question_id, text) -> (question_id, respuesta, fuentes, hechos, detectadas, camino, caracteres, contexto).

    Without the graph the context is the nearest chunks alone. The nearest chunks come from the index, if there is one."""
    ship(questions.sparkSession)
    vectors = questions.select("question_id", embed(F.col("text")).alias("vector"))
    near = retrieve.top_k(g.docs, vectors, k) if index is None else index.nearest(vectors, k)
    chunks = retrieve.retrieved_chunks(g, near, with_graph)
    entities = graphs.degree(g) if with_graph else graphs.degree(g).where("false")
    detected = retrieve.detect_entities(questions, entities)
    found = retrieve.contexts(questions, detected, g.edges, chunks, D.DOMAIN_RELATIONS, D.CAREER_RELATIONS)
    say = model or context_only

    @F.pandas_udf("string")
    def respond(context: pd.Series, question: pd.Series) -> pd.Series:
        return pd.Series([say(c, q) for c, q in zip(context, question, strict=True)])

    asked = found.join(questions.select("question_id", F.col("text").alias("pregunta")), "question_id")
    return asked.select("question_id", F.trim(respond("contexto", "pregunta")).alias("respuesta"), "fuentes", "hechos", "detectadas", "camino", "caracteres", "contexto")
