"""From raw lines to accepted steps, for all transcripts at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Run
from ..functions import text as T
from ..operators import chunking, confidence, document, matching, parsing, qa, ranking, segmentation, steps, validation
from .keep import kept as table


@dataclass
class Result:
    sentences: DataFrame
    segments: DataFrame | None
    chunks: DataFrame
    steps: DataFrame
    sources: DataFrame
    accepted: DataFrame
    metrics: DataFrame
    status: DataFrame
    document: DataFrame | None = None


def cited(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(transcript_id, url, title, content, type, error): the pages of each transcript; where pages don't say whose they are, those that its
    sources cite."""
    named = pages if "type" in pages.columns else pages.withColumn("type", F.lit("web"))
    if "transcript_id" in pages.columns:
        return named.select("transcript_id", "url", "title", "content", "type", "error")
    url = F.regexp_extract("excerpt", r"\]\(([^\n]*)\)\n", 1)
    said = sources.filter("type = 'knowledge'").select("transcript_id", url.alias("url")).distinct()
    return said.join(named, "url").select("transcript_id", "url", "title", "content", "type", "error")


def assembled(judged: DataFrame, sources: DataFrame, config: Run, titles: DataFrame | None = None, usage: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(transcript_id, part, position, text): the documents of all transcripts, made of their accepted steps, numbered anew, and of what these
    cite. A transcript without an accepted step has none. titles: (transcript_id, title), else the id; usage: as for `document.statistics`."""
    order = Window.partitionBy("transcript_id").orderBy("step_index")
    number = judged.filter("accepted").select("transcript_id", "step_index", (F.row_number().over(order) - 1).cast("int").alias("_number"))
    keys = ["transcript_id", "step_index"]
    renumbered = lambda df: df.join(number, keys).withColumn("step_index", F.col("_number")).drop("_number")
    made, found = table(renumbered(judged)), table(renumbered(sources))
    own = made.select("transcript_id").distinct()
    title = own.withColumn("title", F.col("transcript_id")) if titles is None else own.join(titles, "transcript_id", "left").select("transcript_id", F.coalesce("title", "transcript_id").alias("title"))
    spent = usage if usage is not None else own.select("transcript_id", *[F.lit(None).cast(t).alias(c) for c, t in (("seconds", "double"), ("total_tokens", "bigint"), ("cost", "double"))])
    whole = document.sections(title, made, found, document.statistics(made, found, spent), None if pages is None else cited(pages, found).join(own, "transcript_id", "left_semi"))
    return whole if config.include_statistics else whole.filter("part != 6 AND NOT (part = 1 AND position = 1000001)")


def topic_chunks(sentences: DataFrame, config: Run) -> tuple[DataFrame, DataFrame]:
    """(kept segments, chunks): one chunk per segment that passes the gates; transcripts with too few get sentence chunks."""
    rows = table(segmentation.segmented(sentences, config.segmentation))
    kept = qa.without_qa(rows, config.qa) if config.filter_qa else rows
    if config.rank:
        kept = kept.join(ranking.important(ranking.scores(kept, config.ranking), config.ranking).select("transcript_id", "segment_id"), ["transcript_id", "segment_id"], "left_semi")
    texts = segmentation.segment_texts(kept)
    few = texts.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < config.min_steps).select("transcript_id")
    direct = texts.join(few, "transcript_id", "left_anti").select("transcript_id", (F.row_number().over(Window.partitionBy("transcript_id").orderBy("segment_id")) - 1).cast("int").alias("chunk_index"), "text")
    whole = kept.join(few, "transcript_id", "left_semi").groupBy("transcript_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_index", "text"))), lambda x: x["text"]), " ").alias("text"))
    target = max(config.min_steps, min(config.max_steps, config.target_steps))
    return kept, direct.unionByName(chunking.smart(whole, target))


def process(lines: DataFrame, config: Run = Run(), pages: DataFrame | None = None, responses: DataFrame | None = None, titles: DataFrame | None = None, usage: DataFrame | None = None) -> Result:
    """All stages, up to the documents. Flags come from the raw sentences, texts are cleaned after; generated steps may be given as responses, else each
    chunk gives its built-in step with its sentences as actions."""
    # what several stages read is a table between them, so no stage's plan holds those before it
    sentences = table(parsing.parsed(lines).withColumn("text", T.cleaned(F.col("text"))))
    if config.segments:
        segments, chunks = topic_chunks(sentences, config)
    else:
        whole = segmentation.segment_texts(sentences.withColumn("segment_id", F.lit(0))).select("transcript_id", "text")
        segments, chunks = None, chunking.smart(whole, max(config.min_steps, min(config.max_steps, config.target_steps)))
    made = steps.complete(steps.parsed_responses(responses)) if responses is not None else steps.from_chunks(chunks, with_actions=True)
    made = table(made)
    found = matching.transcript_sources(made, sentences, config.matching, reuse=True)
    if pages is not None:
        found = matching.all_sources(found, matching.knowledge_sources(made, pages))
    found = table(found)
    conf = confidence.step_confidence(found)
    scored = made.join(conf.select("transcript_id", "step_index", F.col("confidence").alias("confidence_score")), ["transcript_id", "step_index"], "left").fillna(0.0, ["confidence_score"])
    checked = validation.checked(scored, config.validation)
    judged = table(validation.accepted(checked, validation.action_check(made), conf, config.min_confidence))
    metrics = document.run_metrics(judged, conf, sentences, found)
    status = metrics.select("transcript_id", F.when(F.col("accepted") > 0, "completed").otherwise("failed").alias("run_status"), F.when(F.col("accepted") == 0, "no step was accepted").alias("reason"))
    whole = assembled(judged, found, config, titles, usage, pages) if config.assemble else None
    return Result(sentences, segments, chunks, made, found, judged, metrics, status, whole)
