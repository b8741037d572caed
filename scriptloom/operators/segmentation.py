"""Topic segments: boundary scores from the sentence before, then segment numbers as a running count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Segmentation
from ..functions import text as T
from ..plans.keep import kept


def in_order():
    return Window.partitionBy("transcript_id").orderBy("sentence_index")


def boundary_scores(sentences: DataFrame, config: Segmentation = Segmentation()) -> DataFrame:
    """Adds gap_score, speaker_score, transition_score, dissimilarity, boundary_score and is_boundary."""
    return scored(sentences.withColumns({"_ts": F.lag("timestamp").over(in_order()), "_role": F.lag("speaker_role").over(in_order()), "_before": F.lag(T.keywords(F.col("text"))).over(in_order()), "_own": T.keywords(F.col("text"))}), config)


def scored(rows: DataFrame, config: Segmentation) -> DataFrame:
    """The scores of rows that know the time, role and keywords of the sentence before as _ts, _role and _before, and their own keywords as _own."""
    gap = F.when(F.col("timestamp").isNull() | F.col("_ts").isNull(), 0.0).when(F.col("follows_long_pause"), 1.0).otherwise(F.least((F.col("timestamp") - F.col("_ts")) / config.long_pause, F.lit(1.0)))
    into = (F.col("_role") == "participant") & (F.col("speaker_role") == "instructor")
    speaker = F.when(~F.col("speaker_changed"), 0.0).when(into, 1.0).when(F.col("is_transition"), 0.8).otherwise(0.3)
    apart = F.when(F.col("_before").isNull() | (F.size("_before") == 0) | (F.size("_own") == 0), 0.5).otherwise(1.0 - T.jaccard(F.col("_before"), F.col("_own")))
    rows = rows.withColumns({"gap_score": gap, "speaker_score": speaker, "transition_score": F.when(F.col("is_transition"), 1.0).otherwise(0.0), "dissimilarity": apart})
    score = F.col("gap_score") * config.gap + F.col("speaker_score") * config.speaker + F.col("transition_score") * config.transition
    rows = rows.withColumn("boundary_score", F.least(F.lit(1.0), score + F.col("dissimilarity") * config.semantic if config.use_semantic else score))
    pause = F.col("follows_long_pause") & (F.col("timestamp") != 0)
    boundary = (F.col("sentence_index") == 0) | (F.col("boundary_score") > config.threshold) | F.coalesce(pause, F.lit(False)) | (F.col("is_transition") & (F.col("boundary_score") >= config.transition_threshold))
    return rows.withColumn("is_boundary", boundary).drop("_ts", "_role", "_before", "_own")


def numbered(rows: DataFrame, out: str = "segment_id") -> DataFrame:
    return rows.withColumn(out, (F.sum(F.col("is_boundary").cast("int")).over(in_order()) - 1).cast("int"))


def merged_small(rows: DataFrame, least: int = 2) -> DataFrame:
    """Segments below the least size join the one before: their boundary is cleared and the count runs again. A segment is large enough if the
    transcript goes on for as many sentences without a boundary, so rows stay in their order."""
    stays = F.col("sentence_index") == 0
    if least > 1:
        ahead = in_order().rowsBetween(1, least - 1)
        stays = stays | ((F.count(F.lit(1)).over(ahead) == least - 1) & ~F.coalesce(F.bool_or("is_boundary").over(ahead), F.lit(False)))
    else:
        stays = F.lit(True)
    return numbered(rows.withColumn("_kept", F.col("is_boundary") & stays).withColumn("is_boundary", F.col("_kept")).drop("_kept"))


def split_largest(rows: DataFrame, least: int = 3) -> DataFrame:
    """Where a transcript has fewer segments, its largest (the first of equals) is cut once into as many parts as are missing and
    one; adds fallback_split. The parts follow from where that segment begins and its size, so one order by segment serves all."""
    own, every = Window.partitionBy("transcript_id", "segment_id"), Window.partitionBy("transcript_id")
    rows = rows.withColumns({"_size": F.count(F.lit(1)).over(own), "_first": F.min("sentence_index").over(own)})
    rows = rows.withColumns({"_n": F.max("segment_id").over(every) + 1, "_most": F.max(F.struct("_size", (-F.col("segment_id")).alias("id"))).over(every)})
    size, largest = F.col("_most._size"), -F.col("_most.id")
    parts = F.lit(least) - F.col("_n") + 1
    each = F.greatest(F.lit(2), F.floor(size / parts))
    part = lambda pos: F.least(F.floor(pos / each), parts - 1)
    splits = (F.col("_n") < least) & (size >= 2)
    hit = splits & (F.col("segment_id") == largest)
    more = F.when(hit, part(F.col("sentence_index") - F.col("_first"))).when(splits & (F.col("segment_id") > largest), part(size - 1)).otherwise(0)
    names = [c for c in rows.columns if c not in ("segment_id", "_size", "_first", "_n", "_most")]
    return rows.select(*names, hit.alias("fallback_split"), (F.col("segment_id") + more).cast("int").alias("segment_id"))


def segmented(sentences: DataFrame, config: Segmentation = Segmentation()) -> DataFrame:
    """Sentences with their segment_id and fallback_split."""
    return split_largest(merged_small(boundary_scores(sentences, config), config.min_sentences), config.min_segments)


def segment_records(rows: DataFrame) -> DataFrame:
    """One row per segment."""
    keys = ["transcript_id", "segment_id"]
    first = F.min_by(F.col("is_transition"), "sentence_index")
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sentences"), F.min("sentence_index").alias("first_index"), F.max("sentence_index").alias("last_index"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"),
        F.count_if("is_question").alias("question_count"), first.alias("has_transition_start"), F.coalesce(F.bool_or(F.col("is_question") & (F.col("speaker_role") == "participant")), F.lit(False)).alias("has_qa_section"),
        F.bool_or("fallback_split").alias("fallback_split"),
    ).withColumn("duration", F.col("end_ts") - F.col("start_ts"))
    who = rows.filter("speaker IS NOT NULL").groupBy(*keys, "speaker").agg(F.count(F.lit(1)).alias("n"), F.min("sentence_index").alias("first"))
    who = who.groupBy(*keys).agg(F.max_by("speaker", F.struct("n", -F.col("first"))).alias("primary_speaker"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("speaker", "n")))).alias("speaker_counts"))
    return base.join(who, keys, "left")


def coherence(rows: DataFrame) -> DataFrame:
    """(transcript_id, segment_id, coherence): mean Jaccard similarity of the keyword sets of all pairs with words; 1 for a single
    sentence, 0.5 without pairs. Equal sets count together, and different ones meet only by a word in common, as rows of a
    join, so no task holds all pairs of a long segment."""
    keys = ["transcript_id", "segment_id"]
    texts = rows.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("c"))
    own = texts.select(*keys, "c", F.sort_array(T.keywords(F.col("text"))).alias("kw")).withColumn("set", F.array_join("kw", " "))
    sets = kept(own.groupBy(*keys, "set").agg(F.sum("c").alias("c"), F.first("kw").alias("kw")))
    c, some = F.col("c"), F.col("set") != ""
    counts = sets.groupBy(*keys).agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(some, c)), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(some, c * (c - 1) / 2)), F.lit(0.0)).alias("equal"))
    words = sets.filter(some).select(*keys, "set", "c", F.size("kw").alias("size"), F.explode("kw").alias("word"))
    left, right = words.withColumnsRenamed({"set": "a", "c": "ca", "size": "sa"}), words.withColumnsRenamed({"set": "b", "c": "cb", "size": "sb"})
    both = left.join(right, [*keys, "word"]).filter(F.col("a") < F.col("b")).groupBy(*keys, "a", "b", "ca", "cb", "sa", "sb").agg(F.count(F.lit(1)).alias("both"))
    apart = both.groupBy(*keys).agg(F.sum(F.col("both") / (F.col("sa") + F.col("sb") - F.col("both")) * F.col("ca") * F.col("cb")).alias("apart"))
    made = counts.join(apart, keys, "left")
    pairs = F.col("m") * (F.col("m") - 1) / 2
    mean = (F.col("equal") + F.coalesce("apart", F.lit(0.0))) / pairs
    return made.select(*keys, F.when(F.col("n") == 1, 1.0).when(pairs == 0, 0.5).otherwise(mean).alias("coherence"))


def segment_texts(rows: DataFrame) -> DataFrame:
    made = rows.groupBy("transcript_id", "segment_id").agg(F.sort_array(F.collect_list(F.struct("sentence_index", "text"))).alias("s"))
    return made.select("transcript_id", "segment_id", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))
