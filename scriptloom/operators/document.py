"""What a document holds, as tables: sections, contents, references, statistics, code spans; run metrics."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .confidence import source_label

KEYS = ["transcript_id", "step_index"]
SPAN = re.compile(r"`([^`]+)`")


def contents(steps: DataFrame) -> DataFrame:
    """(transcript_id, position, entry): fixed sections around one entry per step."""
    numbered = steps.select("transcript_id", (F.lit(100) + F.col("step_index")).alias("position"), F.concat(F.lit("Step "), (F.col("step_index") + 1).cast("string"), F.lit(": "), F.col("title")).alias("entry"))
    fixed = steps.select("transcript_id").distinct().select("transcript_id", F.inline(F.array(*[F.struct(F.lit(p).alias("position"), F.lit(e).alias("entry")) for p, e in ((0, "Introduction"), (1_000_000, "Source References"), (1_000_001, "Document Statistics"))])))
    return numbered.unionByName(fixed)


def references(sources: DataFrame) -> DataFrame:
    """One row per step and text source, numbered in the step as they rank; steps without any don't appear."""
    rows = sources.filter(F.col("type").isin("transcript", "knowledge"))
    order = Window.partitionBy(*KEYS).orderBy(F.desc("confidence"), "type", "sentence_index", "excerpt")
    return rows.select(*KEYS, F.row_number().over(order).alias("number"), source_label(F.col("type"), F.col("sentence_index"), F.col("screenshot_ref")).alias("label"), "excerpt")


def time_text(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%.1f seconds", seconds)).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.floor(seconds % 60).cast("string"), F.lit("s")))


def statistics(steps: DataFrame, sources: DataFrame, usage: DataFrame) -> DataFrame:
    """One row per transcript: steps, source references, time text, tokens, cost. usage: transcript_id, seconds, total_tokens, cost."""
    n = steps.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("steps"))
    m = sources.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("references"))
    return n.join(m, "transcript_id", "left").join(usage, "transcript_id", "left").select("transcript_id", "steps", F.coalesce("references", F.lit(0)).alias("references"), time_text(F.col("seconds")).alias("time"), "total_tokens", "cost")


def code_spans(docs: DataFrame) -> DataFrame:
    """(transcript_id, number, start, end, code): inline spans of more than 50 characters between backticks. Spans of any length pair
    the backticks, so text between two short spans isn't one; offsets count characters and include the backticks. A task holds one text and some
    4 MB of spans beside the Arrow batch it reads."""

    schema = "transcript_id string, number int, start int, end int, code string"
    names = ["transcript_id", "number", "start", "end", "code"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                long = (m for m in SPAN.finditer(text.as_py() or "") if m.end() - m.start() > 52)
                for number, m in enumerate(long):
                    made.append((key.as_py(), number, m.start(), m.end(), m[1]))
                    held += m.end() - m.start() + 100
                    if held >= 4 << 20:
                        yield batch_of(made)
                        made, held = [], 0
        if made:
            yield batch_of(made)

    return docs.select("transcript_id", "text").mapInArrow(run, schema)


def knowledge_section(pages: DataFrame) -> DataFrame:
    """(transcript_id, position, text): a heading and the pages without error (transcript_id, url, title, content, type, error), numbered by
    url, each with the first 500 characters of its content; none for a transcript without such pages."""
    good = pages.filter("error IS NULL")
    number = F.row_number().over(Window.partitionBy("transcript_id").orderBy("url", "title", "content"))
    shown = F.when(F.length("content") > 500, F.concat(F.left("content", F.lit(500)), F.lit("..."))).when(F.length("content") > 0, F.col("content"))
    about = F.concat_ws("\n", F.concat(F.lit("Source "), number.cast("string"), F.lit(": "), F.coalesce("title", F.lit("Untitled"))), F.concat(F.lit("URL: "), F.coalesce("url", F.lit(""))), F.concat(F.lit("Type: "), F.initcap("type")), shown)
    heading = good.select("transcript_id").distinct().select("transcript_id", F.lit(0).alias("position"), F.lit("Knowledge Sources").alias("text"))
    return heading.unionByName(good.select("transcript_id", number.alias("position"), about.alias("text")))


def sections(title: DataFrame, steps: DataFrame, sources: DataFrame, stats: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(transcript_id, part, position, text): the whole document in order: title, contents, introduction, steps, references, knowledge
    (where pages are given), statistics."""
    made = title.select("transcript_id", F.lit(0).alias("part"), F.lit(0).alias("position"), F.col("title").alias("text"))
    toc = contents(steps).select("transcript_id", F.lit(1).alias("part"), "position", F.col("entry").alias("text"))
    intro = steps.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n")).select("transcript_id", F.lit(2).alias("part"), F.lit(0).alias("position"), F.concat(F.lit("This document has "), F.col("n").cast("string"), F.lit(" steps.")).alias("text"))
    body = steps.select("transcript_id", F.lit(3).alias("part"), F.col("step_index").alias("position"), F.concat_ws("\n", "title", "summary", "details", F.array_join(F.transform("actions", lambda a: F.concat(F.lit("- "), a)), "\n")).alias("text"))
    refs = references(sources).select("transcript_id", F.lit(4).alias("part"), (F.col("step_index") * 1000 + F.col("number")).alias("position"), F.concat_ws(" ", "label", "excerpt").alias("text"))
    end = stats.select("transcript_id", F.lit(6).alias("part"), F.lit(0).alias("position"), F.concat(F.lit("Steps: "), F.col("steps").cast("string"), F.lit(", references: "), F.col("references").cast("string")).alias("text"))
    known = [] if pages is None else [knowledge_section(pages).withColumn("part", F.lit(5))]
    for other in (toc, intro, body, refs, *known, end):
        made = made.unionByName(other)
    return made


def write_sections(made: DataFrame, path: str) -> None:
    made.repartition("transcript_id").sortWithinPartitions("transcript_id", "part", "position").write.mode("overwrite").parquet(path)


def run_metrics(accepted: DataFrame, confidence: DataFrame, sentences: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per transcript: accepted, rejected, mean confidence, high ones, sentences, words, sources."""
    from ..functions.text import word_count

    rows = accepted.join(confidence.select(*KEYS, "confidence"), KEYS, "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    own = rows.groupBy("transcript_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") >= 0.7).alias("high_confidence"))
    told = sentences.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(word_count(F.col("text"))).alias("words"))
    cited = sources.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("sources"))
    return told.join(own, "transcript_id", "left").join(cited, "transcript_id", "left").fillna(0, ["accepted", "rejected", "high_confidence", "sources"])
