"""Question-and-answer segments: density, records, filters, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import QaFilter

KEYS = ["transcript_id", "segment_id"]


def densities(rows: DataFrame, config: QaFilter = QaFilter()) -> DataFrame:
    """(keys, n_sentences, question_count, density, is_qa) per segment."""
    made = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("is_question").alias("question_count"), F.avg(F.col("is_question").cast("int")).alias("density"))
    return made.withColumn("is_qa", (F.col("density") >= config.min_density) & (F.col("question_count") >= config.min_questions))


def sections(rows: DataFrame, config: QaFilter = QaFilter()) -> DataFrame:
    """One row per dense segment: extent, counts, primary speaker and sorted speakers."""
    hit = densities(rows, config).filter("is_qa")
    own = rows.join(hit.select(*KEYS), KEYS, "left_semi")
    who = own.filter("speaker IS NOT NULL").groupBy(*KEYS, "speaker").agg(F.count(F.lit(1)).alias("n"), F.min("sentence_index").alias("first"))
    who = who.groupBy(*KEYS).agg(F.max_by("speaker", F.struct("n", -F.col("first"))).alias("primary_speaker"), F.sort_array(F.collect_set("speaker")).alias("speakers"))
    extent = own.groupBy(*KEYS).agg(F.min("sentence_index").alias("first_index"), F.max("sentence_index").alias("last_index"))
    return hit.join(extent, KEYS).join(who, KEYS, "left").drop("is_qa")


def without_qa(rows: DataFrame, config: QaFilter = QaFilter()) -> DataFrame:
    """The sentences of all other segments; of instructor-led ones only, if the configuration says so."""
    if not config.enabled:
        return rows
    kept = rows.join(densities(rows, config).filter("is_qa").select(*KEYS), KEYS, "left_anti")
    return kept.join(instructor_led(rows, config).filter("instructor_led").select(*KEYS), KEYS, "left_semi") if config.keep_instructor_only else kept


def instructor_led(rows: DataFrame, config: QaFilter = QaFilter()) -> DataFrame:
    """(keys, instructor_led): the primary speaker's first sentence with role instructor, or no role and few questions. Counts per speaker hold
    all that is needed, so sentences are read once; those without a speaker stand for a segment only where no one else speaks."""
    first_of = lambda role: F.min(F.when(role, F.col("sentence_index")))
    who = rows.groupBy(*KEYS, "speaker").agg(
        F.count(F.lit(1)).alias("n"), F.min("sentence_index").alias("first"), F.sum(F.col("is_question").cast("int")).alias("questions"), F.count("is_question").alias("judged"),
        first_of(F.col("speaker_role") == "instructor").alias("led"), first_of(F.col("speaker_role").isNull()).alias("open"),
    )
    primary = F.max_by(F.struct("led", "open"), F.struct(F.col("speaker").isNotNull(), "n", -F.col("first")))
    made = who.groupBy(*KEYS).agg(primary.alias("p"), F.try_divide(F.sum("questions"), F.sum("judged")).alias("density"))
    led, none = F.col("p.led"), F.col("p.open")
    few = none.isNotNull() & (F.col("density") < config.max_instructor_questions)
    return made.select(*KEYS, F.coalesce(F.when(led.isNotNull() & (none.isNull() | (led < none)), True).otherwise(few), F.lit(False)).alias("instructor_led"))


def statistics(rows: DataFrame, config: QaFilter = QaFilter()) -> DataFrame:
    """One row per transcript."""
    made = densities(rows, config).groupBy("transcript_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if("is_qa").alias("qa_segments"), F.sum("question_count").alias("questions"), F.sum("n_sentences").alias("sentences")
    )
    return made.withColumns({"kept": F.col("segments") - F.col("qa_segments"), "density": F.col("questions") / F.col("sentences"), "filter_rate": F.col("qa_segments") / F.col("segments")})
