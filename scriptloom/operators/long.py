"""Sentences and topic segments of transcripts of any length, by a prefix scan over blocks of lines.

A transcript is cut into blocks by line number, and windows run inside a block only, so its rows may be any share of all rows. What a block
needs from those before it (the number of sentences, the last one, the number of open segments) is a carry: one row per block
of the transcripts that have more than one, scanned along the transcript and joined back. Results are those of `parsing` and `segmentation`.
Before windows, blocks are dealt into parts by the number of all rows (`parsing.parts_of`), so a task sorts as much whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Segmentation
from ..functions import text as T
from ..plans.keep import kept
from . import parsing, segmentation

BLOCK = ["transcript_id", "_block"]


def along(descending: bool = False):
    return Window.partitionBy("transcript_id").orderBy(F.desc("_block") if descending else F.col("_block"))


def earlier(descending: bool = False):
    """The blocks before (or behind) one."""
    return along(descending).rowsBetween(Window.unboundedPreceding, -1)


def joined(rows: DataFrame, carry: DataFrame, most: int = 200_000) -> DataFrame:
    """Rows with the carry of their block, null where it has none. A carry has a row or two for each block_lines lines at most; up to `most` rows
    (some 20 MB) it is broadcast, beyond that it is shuffled, and a block is a key of bounded size."""
    carry = kept(carry)
    return rows.join(F.broadcast(carry) if carry.count() <= most else carry, BLOCK, "left")


def several(spans: DataFrame) -> DataFrame:
    """The blocks of transcripts that have more than one."""
    return spans.withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy("transcript_id"))).filter("_blocks > 1").drop("_blocks")


def with_before(rows: DataFrame, last: Column, order: list[str], before: Column, parts: int) -> DataFrame:
    """Adds _n_before, the number of rows in earlier blocks, and _before: the struct `last` of the row before, over the edges of blocks (there null
    for the first row). `before` is the same struct by lag inside the block."""
    spans = rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"), F.max_by(last, F.struct(*order)).alias("last"))
    carry = several(spans).select(*BLOCK, F.coalesce(F.sum("n").over(earlier()), F.lit(0)).alias("_n_before"), F.lag("last").over(along()).alias("_last_before"))
    first = F.row_number().over(Window.partitionBy(*BLOCK).orderBy(*order)) == 1
    return joined(rows.repartition(parts, *BLOCK), carry).withColumns({"_before": F.when(first, F.col("_last_before")).otherwise(before), "_n_before": F.coalesce("_n_before", F.lit(0))}).drop("_last_before")


def parsed(lines: DataFrame, long_pause: float = 90.0, block_lines: int = 4096) -> DataFrame:
    """The sentence table of `parsing.parsed`, with the number of its block (_block). line_no is a whole number without repeats in a transcript."""
    parts = parsing.parts_of(lines)
    cut = lines.select("transcript_id", "line_no", "line").withColumn("_block", F.floor(F.col("line_no") / block_lines).cast("long")).repartition(parts, *BLOCK)
    rows = kept(parsing.stamped(cut).select(*BLOCK, "line_no", "timestamp", "speaker", F.posexplode(T.sentences(F.col("rest"))).alias("pos", "text")))
    own, order = Window.partitionBy(*BLOCK), Window.partitionBy(*BLOCK).orderBy("line_no", "pos")
    last = F.struct("timestamp", "speaker")
    made = with_before(rows, last, ["line_no", "pos"], F.lag(last).over(order), parts).withColumn("sentence_index", (F.row_number().over(order) - 1 + F.col("_n_before")).cast("int"))
    made = parsing.flagged(made, F.col("_before.timestamp"), F.col("_before.speaker"), long_pause)

    # who speaks most: inside the block where it holds the transcript, else over the counts of all blocks
    several_blocks = several(rows.select(*BLOCK).distinct())
    counts = rows.filter("speaker IS NOT NULL").groupBy(*BLOCK, "speaker").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "pos")).alias("first"))
    most = counts.groupBy("transcript_id", "speaker").agg(F.sum("n").alias("n"), F.min("first").alias("first")).groupBy("transcript_id").agg(F.min_by("speaker", F.struct(-F.col("n"), "first")).alias("_most"))
    made = joined(made, several_blocks.join(most, "transcript_id", "left").withColumn("_long", F.lit(True)))
    per_speaker = Window.partitionBy(*BLOCK, "speaker")
    made = made.withColumns({"_n": F.when(F.col("speaker").isNotNull(), F.count(F.lit(1)).over(per_speaker)), "_first": F.min("sentence_index").over(per_speaker)})
    here = F.max_by("speaker", F.when(F.col("speaker").isNotNull(), F.struct("_n", -F.col("_first")))).over(own)
    primary = F.when(F.col("_long"), F.col("_most")).otherwise(here)
    role = F.when(F.col("speaker").isNull(), None).when(F.col("speaker") == primary, "instructor").otherwise("participant")
    return made.withColumn("speaker_role", role).drop("line_no", "pos", "_n", "_first", "_most", "_long", "_before", "_n_before")


def boundary_scores(sentences: DataFrame, config: Segmentation, parts: int) -> DataFrame:
    """Those of `segmentation.boundary_scores`, for sentences with their blocks."""
    last = F.struct(F.col("timestamp").alias("ts"), F.col("speaker_role").alias("role"), T.keywords(F.col("text")).alias("words"))
    rows = with_before(sentences, last, ["sentence_index"], F.lag(last).over(Window.partitionBy(*BLOCK).orderBy("sentence_index")), parts)
    rows = rows.withColumnsRenamed({"_before": "_row"}).withColumns({"_ts": F.col("_row.ts"), "_role": F.col("_row.role"), "_before": F.col("_row.words"), "_own": T.keywords(F.col("text"))})
    return segmentation.scored(rows, config).drop("_row", "_n_before")


def merged_segments(rows: DataFrame, least: int, parts: int) -> DataFrame:
    """Adds segment_id, small segments merged into the one before. A segment that ends in its block is judged there; of the last one of a
    block the carry knows where the next boundary is."""
    order = Window.partitionBy(*BLOCK).orderBy("sentence_index")
    rows = rows.repartition(parts, *BLOCK).withColumn("_local", F.sum(F.col("is_boundary").cast("int")).over(order))
    rows = rows.withColumns({"_size": F.count(F.lit(1)).over(Window.partitionBy(*BLOCK, "_local")), "_top": F.max("_local").over(Window.partitionBy(*BLOCK))})
    at, ends = F.when(F.col("is_boundary"), F.col("sentence_index")), F.col("_local") < F.col("_top")
    stays = (F.col("sentence_index") == 0) | (F.col("_size") >= least)
    spans = rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.count_if(F.col("is_boundary") & ends & stays).alias("inner"))
    following = F.coalesce(F.last("first", ignorenulls=True).over(earlier(descending=True)), F.sum("n").over(Window.partitionBy("transcript_id")))
    spans = several(spans).withColumn("_last_size", following - F.col("last"))
    own = F.col("inner") + F.when(F.col("last").isNull(), 0).otherwise(((F.col("last") == 0) | (F.col("_last_size") >= least)).cast("int"))
    carry = spans.withColumn("own", own).select(*BLOCK, "_last_size", F.coalesce(F.sum("own").over(earlier()), F.lit(0)).alias("_segments_before"))
    rows = joined(rows, carry).withColumn("_size", F.when(ends, F.col("_size")).otherwise(F.coalesce("_last_size", "_size")))
    rows = rows.withColumn("is_boundary", F.col("is_boundary") & ((F.col("sentence_index") == 0) | (F.col("_size") >= least)))
    number = F.sum(F.col("is_boundary").cast("int")).over(order) - 1 + F.coalesce("_segments_before", F.lit(0))
    return rows.withColumn("segment_id", number.cast("int")).drop("_local", "_size", "_top", "_last_size", "_segments_before")


def split_largest(rows: DataFrame, least: int, parts: int) -> DataFrame:
    """As `segmentation.split_largest`. The parts of the largest segment follow from where it begins and its size, so no rank over the transcript
    is needed."""
    sizes = rows.groupBy("transcript_id", "segment_id").agg(F.count(F.lit(1)).alias("size"), F.min("sentence_index").alias("first"))
    largest = F.max_by(F.struct("segment_id", "size", "first"), F.struct("size", -F.col("segment_id")))
    long = several(rows.select(*BLOCK).distinct())
    found = sizes.join(long, "transcript_id", "left_semi").groupBy("transcript_id").agg((F.max("segment_id") + 1).alias("n"), largest.alias("largest"))
    rows = joined(rows.repartition(parts, *BLOCK), long.join(found, "transcript_id").select(*BLOCK, F.struct("n", "largest").alias("_over")))
    own, segment = Window.partitionBy(*BLOCK), Window.partitionBy(*BLOCK, "segment_id")
    rows = rows.withColumn("_s", F.struct("segment_id", F.count(F.lit(1)).over(segment).alias("size"), F.min("sentence_index").over(segment).alias("first")))
    here = F.struct((F.max("segment_id").over(own) + 1).alias("n"), F.max_by("_s", F.struct("_s.size", -F.col("segment_id"))).over(own).alias("largest"))
    rows = rows.withColumn("_t", F.coalesce("_over", here)).select(*[c for c in rows.columns if c not in ("_s", "_over")], F.col("_t.n").alias("_n"), *[F.col(f"_t.largest.{c}").alias(f"_{c}") for c in ("segment_id", "size", "first")])
    splits = (F.col("_n") < least) & (F.col("_size") >= 2)
    parts = F.lit(least) - F.col("_n") + 1
    each = F.greatest(F.lit(2), F.floor(F.col("_size") / parts))
    part = lambda pos: F.least(F.floor(pos / each), parts - 1)
    hit = splits & (F.col("segment_id") == F.col("_segment_id"))
    more = F.when(hit, part(F.col("sentence_index") - F.col("_first"))).when(splits & (F.col("segment_id") > F.col("_segment_id")), part(F.col("_size") - 1)).otherwise(0)
    return rows.withColumns({"segment_id": (F.col("segment_id") + more).cast("int"), "fallback_split": hit}).drop("_n", "_segment_id", "_size", "_first")


def segmented(sentences: DataFrame, config: Segmentation = Segmentation()) -> DataFrame:
    """Sentences (of `parsed` here) with their segment_id and fallback_split. What several steps read is a table between them."""
    parts = parsing.parts_of(sentences)
    scored = kept(boundary_scores(sentences, config, parts))
    return split_largest(kept(merged_segments(scored, config.min_sentences, parts)), config.min_segments, parts).drop("_block")
