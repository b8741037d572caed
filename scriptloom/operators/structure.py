"""Paragraphs, sequence words, actions, roles and decisions of texts; classes of screen lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from .chunking import paragraph_parts


def paragraphs(docs: DataFrame) -> DataFrame:
    return paragraph_parts(docs).select("transcript_id", "pos", F.col("part").alias("paragraph"))


def sequence_counts(docs: DataFrame) -> DataFrame:
    low = F.lower("text")
    return docs.select("transcript_id", *[F.regexp_count(low, F.lit(p)).alias(f"family_{i}") for i, p in enumerate(L.SEQUENCE_PATTERNS)])


def sequence_hits(docs: DataFrame) -> DataFrame:
    """(transcript_id, family, indicator, position), family by family. A hit stands after the pieces and hits before it, so its position
    is the sum of their lengths, folded over the hits in order."""
    low = F.lower("text")
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("to"))

    def places(hits: Column, pieces: Column) -> Column:
        lengths = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("p"), F.length(h).alias("h")))
        return F.aggregate(lengths, start, lambda a, x: F.struct(F.array_append(a["at"], a["to"] + x["p"]).alias("at"), (a["to"] + x["p"] + x["h"]).alias("to")), lambda a: a["at"])

    families = [F.struct(F.lit(i).alias("family"), F.regexp_extract_all(low, F.lit(p), F.lit(0)).alias("hits"), F.split(low, p, -1).alias("pieces")) for i, p in enumerate(L.SEQUENCE_PATTERNS)]
    rows = docs.filter(F.col("text").isNotNull()).select("transcript_id", F.inline(F.array(*families))).filter(F.size("hits") > 0)
    found = F.arrays_zip(F.col("hits").alias("indicator"), places(F.col("hits"), F.col("pieces")).alias("position"))
    return rows.select("transcript_id", "family", F.inline(found).alias("indicator", "position"))


def structure(docs: DataFrame) -> DataFrame:
    low = F.lower("text")
    made = docs.select("transcript_id", T.word_count(F.col("text")).alias("words"), T.found(low, L.STRUCTURE_VERBS).alias("actions"), T.found(low, L.ROLES).alias("roles"), T.found(low, L.DECISIONS).alias("decisions"))
    return made.withColumn("suggested_steps", suggested_steps(F.col("words"), F.size("actions"), F.size("decisions")))


def suggested_steps(words: Column, actions: Column, decisions: Column) -> Column:
    base = F.greatest(F.lit(3), F.least(F.lit(15), F.floor(words / 100)))
    more = base + F.when(actions > 10, 2).otherwise(0) + F.when(decisions > 3, 1).otherwise(0)
    return F.greatest(F.lit(3), F.least(F.lit(15), more)).cast("int")


def screen_lines(lines: DataFrame, text_col: str = "text") -> DataFrame:
    return lines.withColumn("type", T.ui_class(F.col(text_col)))
