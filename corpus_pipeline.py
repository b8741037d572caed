"""A training corpus from the documents: quality rules, near duplicates, repeated passages, source mix, tokens."""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.bpe import bpe_encode
from scriptloom.llm.common import cut, read
from scriptloom.llm.mixing import mix_sources
from scriptloom.llm.ngram_join import ngram_components
from scriptloom.llm.quality_rules import quality_rules
from scriptloom.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their common lines. Null and empty texts fail the rules; a null source is one host. Null and
    repeated ids and equal rows are judged row by row. Columns beyond those of documents go, whatever their names; an empty table stays one."""
    judged = quality_rules(docs.select(*COLUMNS)).filter(F.col("_q")["kept"])
    text = F.col("_q")["kept_text"]
    return judged.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more: the one with the smallest id. Rows that share an id are one
    document: of the one that stays all different texts stay, each once, with the smallest lang, source and n_chars. Rows without an
    id are in no group and all stay, null texts too. Other columns go; an empty table stays one."""
    rows = docs.select(*COLUMNS)
    groups = ngram_components(docs, size=5, percent=80)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    kept = rows.join(first, "doc_id", "left_semi").groupBy("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.col("text").isNull().alias("none")).agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
    return kept.select("doc_id", "r.*").select(*COLUMNS).unionByName(rows.filter("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur anywhere else; a character of which only a part is left goes too. All
    rows stay, also those left without text; a null text becomes an empty one. Rows with equal texts of 200 bytes or more lose all of it, also
    under one id; null ids are allowed. Other columns go; an empty table stays one."""

    @F.pandas_udf("string")
    def pieces(kept: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        def joined(data: bytes, starts: list[int], ends: list[int]) -> str:
            made, at, last = [], 0, 0
            for start, end in zip(starts, ends, strict=True):
                made.append(data[at : at + start - last])
                at, last = at + start - last, end
            return "".join(x.decode("utf-8", "ignore") for x in [*made, data[at:]])

        return pd.Series([None if k is None else joined(k, s, e) for k, s, e in zip(kept, starts, ends, strict=True)], dtype=object)

    # smaller blocks than op4's: workers that have run the stages before share the executor's memory with this one
    found = suffix_dedup(docs, carry=("lang", "source"), block_bytes=2 << 20, shard_bytes=1 << 19)
    whole = F.when(F.col("n_removed") == 0, F.col("kept_bytes").cast("string")).otherwise(pieces("kept_bytes", "span_starts", "span_ends"))
    return found.select("doc_id", whole.alias("text"), F.col("carried.lang").alias("lang"), F.col("carried.source").alias("source")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, never, once or twice. Null and empty texts have no words and come as often as the whole
    passes of their source; a null source is a source. Of rows that repeat an id and its text as many are taken as the mix has room for; null ids are allowed.
    Other columns go; an empty table stays one."""
    mixed = mix_sources(docs.select(*COLUMNS)).filter(F.col("_m")["copies"] > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m")["copies"]))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of each row; no tokens for a null or empty text. Ids and sources may be null or repeat. Other columns go;
    an empty table stays one. Python workers still hold what earlier stages used, hence the small groups."""
    coded = bpe_encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), group_bytes=1 << 20, known_pieces=200_000).drop("text")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("tokens", tokens)]

#: SQL can't express the byte-pair encoding nor the fit of the mix; the tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is cut from its lineage, so that it is worked out once."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
