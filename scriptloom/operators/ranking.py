"""Which topics are worth a step: procedural score, density, importance, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..config import Ranking
from ..functions import text as T
from ..plans.keep import kept
from .segmentation import coherence, segment_texts

KEYS = ["transcript_id", "segment_id"]


def scores(rows: DataFrame, config: Ranking = Ranking()) -> DataFrame:
    """(keys, n_sentences, verbs, procedural, action_density, coherence, three weighted parts, importance) per segment."""
    rows = kept(rows.select(*KEYS, "sentence_index", "text"))
    first = F.slice(T.words(F.lower("text")), 1, 2)
    imperative = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.arrays_overlap(first, T.literals(L.RANK_VERBS))).alias("imperative"))
    text = segment_texts(rows).select(*KEYS, T.n_found(F.lower("text"), L.RANK_VERBS).alias("verbs"), T.n_found(F.lower("text"), L.SEQUENCE_WORDS).alias("sequence"))
    made = imperative.join(text, KEYS).join(coherence(rows), KEYS)
    n = F.col("n_sentences")
    procedural = F.least(F.lit(1.0), F.col("verbs") / (n * 2)) * 0.5 + F.col("imperative") / n * 0.3 + F.least(F.lit(1.0), F.col("sequence") / F.greatest(F.lit(1.0), n / 3)) * 0.2
    made = made.withColumns({"procedural": F.least(F.lit(1.0), procedural), "action_density": F.least(F.lit(1.0), F.col("verbs") / n / 3.0)})
    made = made.withColumns({"part_procedural": F.col("procedural") * config.procedural, "part_density": F.col("action_density") * config.action_density, "part_coherence": F.col("coherence") * config.coherence})
    return made.withColumn("importance", F.col("part_procedural") + F.col("part_density") + F.col("part_coherence")).drop("imperative", "sequence")


def ranked(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("transcript_id").orderBy(F.desc(F.round("importance", 9)), "segment_id")
    return scored.withColumn("rank", F.row_number().over(order))


def important(scored: DataFrame, config: Ranking = Ranking(), threshold: float | None = None) -> DataFrame:
    """Segments at or above the threshold (0 means the default); with keep_top_n the best of them."""
    best = ranked(scored).filter(F.round("importance", 9) >= (threshold or config.min_importance))
    if config.keep_top_n:
        best = ranked(best.drop("rank")).filter(F.col("rank") <= config.keep_top_n)
    return best


def report(scored: DataFrame, config: Ranking = Ranking()) -> DataFrame:
    """One row per transcript: mean, extremes and spread of the importance, and how many are high, medium and low. The mean is taken
    over decimals, so that it doesn't depend on the order of rows."""
    x = F.col("importance")
    mean = F.round(F.avg(x.cast("decimal(18,9)")), 3).cast("double")
    return scored.groupBy("transcript_id").agg(
        F.count(F.lit(1)).alias("segments"), mean.alias("avg"), F.round(F.max(x), 3).alias("max"), F.round(F.min(x), 3).alias("min"), F.round(F.stddev_pop(x), 3).alias("std"),
        F.count_if(x >= config.high).alias("high"), F.count_if((x >= config.min_importance) & (x < config.high)).alias("medium"), F.count_if(x < config.min_importance).alias("low"),
    )
