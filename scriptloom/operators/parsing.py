"""From raw lines to a sentence table with times, speakers and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ROWS_PER_PART = 50_000


def lines_of(transcripts: DataFrame) -> DataFrame:
    """(transcript_id, line_no, line): trimmed lines that aren't blank, numbered as they stand."""
    parts = F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))))
    return transcripts.select("transcript_id", parts.alias("line_no", "line")).filter("line != ''")


def stamped(lines: DataFrame) -> DataFrame:
    """Adds timestamp, speaker and the rest of the line."""
    line = F.btrim("line", F.lit(" \t\r"))
    cut = lines.withColumns({"timestamp": T.stamp_seconds(line), "_rest": T.after_prefix(line, T.stamp_prefix(line))})
    named = cut.withColumns({"speaker": T.speaker_name(F.col("_rest")), "rest": T.after_prefix(F.col("_rest"), F.regexp_extract("_rest", T.SPEAKER_PREFIX, 0))})
    return named.drop("_rest").filter("line != ''")


def sentence_rows(lines: DataFrame) -> DataFrame:
    """One row per sentence with its line's stamp and speaker, numbered from 0 in each transcript."""
    return in_order(lines).drop("line_no", "pos", "_ts", "_speaker")


def parts_of(rows: DataFrame) -> int:
    """Into how many parts rows are dealt before windows over them, by their number, as text shrinks too much in a shuffle for its size to tell
    how much a task has to sort."""
    return max(8, rows.count() // ROWS_PER_PART + 1)


def in_order(lines: DataFrame) -> DataFrame:
    """The sentences with their places (line_no, pos), numbers, and the time (_ts) and speaker (_speaker) of the one before."""
    cut = lines.select("transcript_id", "line_no", "line").repartition(parts_of(lines), "transcript_id")
    rows = stamped(cut).select("transcript_id", "line_no", "timestamp", "speaker", F.posexplode(T.sentences(F.col("rest"))).alias("pos", "text"))
    order = Window.partitionBy("transcript_id").orderBy("line_no", "pos")
    return rows.withColumns({"sentence_index": F.row_number().over(order) - 1, "_ts": F.lag("timestamp").over(order), "_speaker": F.lag("speaker").over(order)})


def flagged(rows: DataFrame, before_ts: Column, before_speaker: Column, long_pause: float) -> DataFrame:
    """Adds the flags of a sentence, given the time and the speaker of the one before."""
    both = (F.col("timestamp") != 0) & (before_ts != 0)
    return rows.withColumns(
        {
            "raw_text": F.col("text"),
            "is_question": T.is_question(F.col("text")),
            "is_transition": T.is_transition(F.col("text")),
            "has_emphasis": T.has_emphasis(F.col("text")),
            "follows_long_pause": F.coalesce(both & (F.col("timestamp") - before_ts > long_pause), F.lit(False)),
            "speaker_changed": F.coalesce(F.col("speaker") != before_speaker, F.lit(False)),
        }
    )


def parsed(lines: DataFrame, long_pause: float = 90.0) -> DataFrame:
    """The sentence table with all flags and roles. One exchange by transcript serves every window."""
    rows = flagged(in_order(lines), F.col("_ts"), F.col("_speaker"), long_pause).drop("line_no", "pos", "_ts", "_speaker")
    per_speaker = Window.partitionBy("transcript_id", "speaker")
    rows = rows.withColumns({"_n": F.when(F.col("speaker").isNotNull(), F.count(F.lit(1)).over(per_speaker)), "_first": F.min("sentence_index").over(per_speaker)})
    primary = F.max_by("speaker", F.when(F.col("speaker").isNotNull(), F.struct("_n", -F.col("_first")))).over(Window.partitionBy("transcript_id"))
    role = F.when(F.col("speaker").isNull(), None).when(F.col("speaker") == primary, "instructor").otherwise("participant")
    return rows.withColumn("speaker_role", role).drop("_n", "_first")


def speaker_order(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, speaker, n, first) per speaker, null speakers left out."""
    return rows.filter("speaker IS NOT NULL").groupBy(*keys, "speaker").agg(F.count(F.lit(1)).alias("n"), F.min("sentence_index").alias("first"))


def metadata(sentences: DataFrame) -> DataFrame:
    """One row per transcript: counts, speakers as they first appear, the primary speaker and its share, duration, flags."""
    base = sentences.groupBy("transcript_id").agg(
        F.count(F.lit(1)).alias("sentence_count"), F.count_if("is_question").alias("question_count"), F.count_if("is_transition").alias("transition_count"), F.max("timestamp").alias("duration"),
        F.coalesce(F.bool_or(F.col("timestamp").isNotNull()), F.lit(False)).alias("has_timestamps"),
        F.coalesce(F.bool_or(F.col("is_question") & (F.col("speaker_role") == "participant")), F.lit(False)).alias("has_qa_sections"),
    )
    who = speaker_order(sentences, "transcript_id").groupBy("transcript_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first", "speaker"))), lambda x: x["speaker"]).alias("speaker_names"), F.max_by("speaker", F.struct("n", -F.col("first"))).alias("primary_speaker"), F.max("n").alias("_n"),
    )
    made = base.join(who, "transcript_id", "left")
    names = F.coalesce("speaker_names", F.array().cast("array<string>"))
    return made.withColumns({"speaker_names": names, "speaker_count": F.size(names), "primary_ratio": F.coalesce(F.col("_n") / F.col("sentence_count"), F.lit(0.0))}).drop("_n")
