"""A dictionary of names found in texts, at word borders, by joins: all of a dictionary's names in all texts at once.

Names and texts are compared by their normal forms. A text is all windows of its words that have as many words as some name has; windows meet the
names in an equi-join. A small dictionary (PART_BYTES) is sent to every task, a larger one is shuffled as the windows are: no task and no
Python worker holds a dictionary that grows with the tables. Texts go by blocks of BLOCK words, so that none is a single long row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import defaults as D
from ..functions.text import normalize
from ..plans.session import written

#: Bytes of the names of a dictionary that is sent to every task (with what a name needs beside its characters), and bytes for that.
PART_BYTES, NAME_BYTES = 16 << 20, 64
#: Words of a text that are one row.
BLOCK = 64


def forms(names: DataFrame, least_length: int = D.MIN_ENTITY_LENGTH) -> DataFrame:
    """names (id, grado) -> (norm, id): normal forms of at least so many characters, with the name of highest degree, then the first."""
    keyed = names.select("id", "grado", normalize(F.col("id")).alias("norm")).where(F.char_length("norm") >= least_length)
    return keyed.groupBy("norm").agg(F.min(F.struct((-F.col("grado")).alias("g"), "id")).alias("m")).select("norm", F.col("m.id").alias("id"))


def _blocks(text: Column, beyond: int) -> Column:
    """A text's words in blocks of BLOCK (begin, words), each with the first `beyond` words of the next; begin is the place of its first word."""

    def cut(words: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(words), F.lit(BLOCK))
        length = lambda i: F.char_length(F.array_join(F.slice(words, i, BLOCK), " ")) + 1
        begins = F.aggregate(firsts, F.array(F.lit(0)), lambda at, i: F.concat(at, F.array(F.element_at(at, -1) + length(i))))
        return F.zip_with(firsts, F.slice(begins, F.lit(1), F.size(firsts)), lambda i, at: F.struct(at.alias("begin"), F.slice(words, i, BLOCK + beyond).alias("words")))

    return F.flatten(F.transform(F.array(F.split(text, " ")), cut))  # the words are bound once, not made anew at each use


def _windows(block: Column, lengths: list[int]) -> Column:
    """(start, norm) of all windows of so many words that begin among the first BLOCK words of a block."""
    words = block["words"]
    begins = F.aggregate(words, F.array(block["begin"]), lambda at, w: F.concat(at, F.array(F.element_at(at, -1) + F.char_length(w) + 1)))

    def of(n: int, at: Column) -> Column:
        last = F.least(F.lit(BLOCK), F.size(words) - (n - 1))
        one = lambda i: F.struct(F.get(at, i - 1).cast("long").alias("start"), F.array_join(F.slice(words, i, n), " ").alias("norm"))
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), one)).otherwise(F.array().cast("array<struct<start:bigint,norm:string>>"))

    return F.flatten(F.transform(F.array(begins), lambda at: F.concat(*(of(n, at) for n in lengths))))


def occurrences(texts: DataFrame, dictionary: DataFrame, key: str = "question_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """texts (key, text) and dictionary (norm, id) -> (key, id, norm, start, stop): every place where a form stands between word borders, in code
    points of the text's normal form. Null and empty texts have none; repeated rows are texts of their own with one key."""
    names = written(dictionary.select("norm", "id"))
    size, lengths = names.agg(F.sum(F.octet_length("norm") + F.octet_length("id") + NAME_BYTES), F.sort_array(F.collect_set(F.size(F.split("norm", " "))))).first()
    rows = texts.select(key, normalize(F.col("text")).alias("text")).where("text <> ''")
    blocks = rows.select(key, F.explode(_blocks(F.col("text"), max(lengths or [1]) - 1)).alias("block"))
    places = blocks.select(key, F.inline(_windows(F.col("block"), lengths or [1])))
    met = places.join(F.broadcast(names) if (size or 0) <= part_bytes else names.hint("shuffle_merge"), "norm")
    return met.select(key, "id", "norm", "start", (F.col("start") + F.char_length("norm")).alias("stop"))


def longest_spans(found: DataFrame, key: str = "question_id") -> DataFrame:
    """Of the places, those that don't lie within a longer one's: a short name counts where it stands on its own."""
    before = Window.partitionBy(key).orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    return found.distinct().withColumn("reach", F.max("stop").over(before)).where("reach is null or reach < stop").drop("reach")
