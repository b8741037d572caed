"""The registered queries of the operators, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .chat import format_chats, read_chats
from .common import read
from .hard_negatives import mine_hard_negatives
from .mixing import mix_sources
from .ngram_join import ngram_components
from .oracles import ORACLES
from .permutation_index import nearest_neighbours
from .quality_rules import quality_rules
from .rank_bpe import rank_decode, rank_encode
from .sharding import shard_documents
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .vector_codes import compress_vectors, label_errors
from .wrapper_induction import extract_main_text


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = read_chats(format_chats(rows, path), path)
    told = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_chars", "base_failed", "kept")
    return found.select("doc_id", *[F.col("_q")[x].alias(x) for x in names])


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    m = F.col("_m")
    return mixed.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["copies"] * m["size"]).alias("taken"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_decode(bpe_encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"), size=3, percent=90)


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    using = {"rank_file": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    coded = rank_decode(rank_encode(read(spark, sf_dir, "documents").select("doc_id", "text"), packed=True, **using).drop("text"), **using)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress_vectors(read(spark, sf_dir, "embeddings"), carry=("label",))
    code = F.array_join(F.transform("codes", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return label_errors(found.codes.select("vec_id", "label", code.alias("code"), "error")).select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", label)
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_quality_rules, op3_chat, op4_suffix_dedup, op5_wrapper_induction, op6_sharding, op7_mixing, op8_bpe, op9_permutation_index, op10_ngram_join, op11_rank_bpe, op12_vector_codes, op13_hard_negatives)
}
