"""Confidence of steps from their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KEYS = ["transcript_id", "step_index"]


def times(sources: DataFrame) -> Column:
    """How many sources a row stands for."""
    return F.col("times").cast("long") if "times" in sources.columns else F.lit(1).cast("long")


def step_confidence(sources: DataFrame) -> DataFrame:
    """(keys, n_sources, flags, confidence): the weighted mean of the best three, raised for number, variety and a strong one. Screens give
    support but no confidence. A row may stand for more sources (times), the others no better than a third of its kind."""
    heard = F.col("type").isin("transcript", "knowledge")
    rank = F.row_number().over(Window.partitionBy(*KEYS, heard).orderBy(F.desc("confidence")))
    rows = sources.withColumn("rn", F.when(heard, rank))
    made = rows.groupBy(*KEYS).agg(
        F.sum(times(sources)).alias("n_sources"), F.coalesce(F.sum(F.when(heard, times(sources))), F.lit(0)).alias("n"), *[F.coalesce(F.max(F.when(F.col("rn") == i, F.col("confidence"))), F.lit(0.0)).alias(f"c{i}") for i in (1, 2, 3)],
        *[F.coalesce(F.bool_or(F.col("type") == t), F.lit(False)).alias(f"has_{t}_support") for t in ("transcript", "knowledge", "visual")], F.coalesce(F.bool_or(heard & (F.col("confidence") > 0.5)), F.lit(False)).alias("strong"),
    )
    mean = F.when(F.col("n") == 1, F.col("c1")).when(F.col("n") == 2, F.col("c1") * 0.6 + F.col("c2") * 0.4).otherwise(F.col("c1") * 0.5 + F.col("c2") * 0.3 + F.col("c3") * 0.2)
    more = F.when(F.col("n") >= 4, 1.25).when(F.col("n") == 3, 1.15).when(F.col("n") == 2, 1.08).otherwise(1.0)
    total = mean * more * F.when(F.col("has_transcript_support") & F.col("has_knowledge_support"), 1.12).otherwise(1.0) * F.when(F.col("strong"), 1.10).otherwise(1.0)
    return made.withColumn("confidence", F.when(F.col("n") == 0, 0.0).otherwise(T.clamped(total))).drop("n", "c1", "c2", "c3", "strong")


def grounding(conf: DataFrame) -> DataFrame:
    """Adds is_grounded and warnings."""
    c, shown = F.col("confidence"), F.format_string("%.2f", F.col("confidence"))
    warnings = F.array(
        F.when(c < 0.3, F.concat(F.lit("confidence under 0.30: "), shown)).when(c < 0.5, F.concat(F.lit("confidence under 0.50: "), shown)).when(c < 0.7, F.concat(F.lit("confidence under 0.70: "), shown)),
        F.when(~F.col("has_transcript_support"), F.lit("nothing in the transcript supports it")),
        F.when(F.col("n_sources") == 0, F.lit("no source")).when(F.col("n_sources") == 1, F.lit("a single source")),
    )
    return conf.withColumns({"is_grounded": (c >= 0.4) & F.col("has_transcript_support") & (F.col("n_sources") >= 1), "warnings": F.filter(warnings, lambda w: w.isNotNull())})


def blended(confidence: Column, quality: Column) -> Column:
    x = confidence * 0.7 + quality * 0.3
    return T.clamped(F.when(quality >= 0.8, x * 1.10).when(quality >= 0.6, x * 1.05).when(quality < 0.3, x * 0.95).otherwise(x))


def bands(rows: DataFrame) -> DataFrame:
    """The four ladders of labels."""
    c = F.col("confidence")
    return rows.withColumns(
        {
            "indicator": T.band(c, [(0.7, "high"), (0.4, "medium")], "low"),
            "level": T.band(c, [(0.75, "Very High"), (0.55, "High"), (0.35, "Medium"), (0.20, "Low")], "Very Low"),
            "document_label": T.band(c, [(0.85, "Very High"), (0.7, "High"), (0.5, "Medium"), (0.3, "Low")], "Very Low"),
            "color": T.band(c, [(0.85, "green"), (0.7, "blue"), (0.5, "yellow")], "red"),
        }
    )


def step_records(sources: DataFrame) -> DataFrame:
    """One row per step with its sources as an array, best first, its support and confidence, and warnings."""
    own = sources.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("confidence", "type", "excerpt", "sentence_index")), asc=False).alias("sources"))
    return grounding(step_confidence(sources)).join(own, KEYS)


def source_summary(sources: DataFrame) -> DataFrame:
    """`transcript (n), knowledge (m)` per step, or `none`."""
    counts = sources.groupBy(*KEYS).agg(*[F.coalesce(F.sum(F.when(F.col("type") == t, times(sources))), F.lit(0)).alias(t) for t in ("transcript", "knowledge")])
    parts = [F.when(F.col(t) > 0, F.concat(F.lit(f"{t} ("), F.col(t).cast("string"), F.lit(")"))) for t in ("transcript", "knowledge")]
    text = F.concat_ws(", ", *parts)
    return counts.select(*KEYS, F.when(text == "", "none").otherwise(text).alias("summary"))


def source_label(kind: Column, sentence_index: Column, screenshot: Column) -> Column:
    return (
        F.when((kind == "transcript") & sentence_index.isNotNull(), F.concat(F.lit("Transcript (Sentence "), (sentence_index + 1).cast("string"), F.lit(")")))
        .when((kind == "visual") & screenshot.isNotNull(), F.concat(F.lit("Visual ("), screenshot, F.lit(")"))).when(kind == "visual", "Visual (Screenshot)").otherwise(F.initcap(kind))
    )
