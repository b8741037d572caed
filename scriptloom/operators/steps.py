"""The step table: parsing generated text, the built-in step per chunk, token totals and cost, alignment with sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T

KEYS = ["transcript_id", "step_index"]


def parsed_responses(responses: DataFrame) -> DataFrame:
    """Steps of generated texts (transcript_id, text): `STEP …: title` opens a step; OVERVIEW or SUMMARY, CONTENT or DETAILS, and
    KEY ACTIONS or ACTIONS switch the section; bullets are actions only in the actions section; of summary lines the
    first counts, details are joined. Lines are rows, so responses of any length and number are parsed together."""
    lines = responses.select("transcript_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r")))
    up = F.upper("line")
    head = F.rlike(up, F.lit(r"^STEP[^:]*:"))
    switch = F.when(head, "title").when(F.rlike(up, F.lit(r"^(OVERVIEW|SUMMARY):")), "summary").when(F.rlike(up, F.lit(r"^(CONTENT|DETAILS):")), "details").when(F.rlike(up, F.lit(r"^(KEY ACTIONS|ACTIONS):")), "actions")
    order = Window.partitionBy("transcript_id").orderBy("pos")
    lines = lines.withColumns({"switch": switch, "step": F.sum(head.cast("int")).over(order)}).filter("step > 0")
    lines = lines.withColumn("section", F.last("switch", ignorenulls=True).over(order))
    bullet = F.rlike("line", F.lit(r"^[-•*]"))
    body = F.when(F.col("switch").isNotNull(), F.trim(F.regexp_replace("line", r"^[^:]*:", ""))).when((F.col("section") == "actions") & bullet, F.trim(F.regexp_replace("line", r"^[-•*\s]+", ""))).when(F.col("section") != "actions", F.col("line"))
    lines = lines.withColumn("body", body).filter("body IS NOT NULL AND body != ''")

    def of(section: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct("pos", "body"))))
        return F.transform(rows, lambda x: x["body"])

    made = lines.groupBy("transcript_id", (F.col("step") - 1).alias("step_index")).agg(of("title").alias("_t"), of("summary").alias("_s"), of("details").alias("_d"), of("actions").alias("actions"))
    return made.select(
        "transcript_id", F.col("step_index").cast("int").alias("step_index"), F.coalesce(F.get("_t", F.lit(0)), F.lit("")).alias("title"), F.coalesce(F.get("_s", F.lit(0)), F.lit("")).alias("summary"),
        F.array_join("_d", " ").alias("details"), "actions",
    )


def complete(steps: DataFrame) -> DataFrame:
    return steps.filter((F.trim(F.coalesce("title", F.lit(""))) != "") & ((F.trim(F.coalesce("summary", F.lit(""))) != "") | (F.trim(F.coalesce("details", F.lit(""))) != "")))


def from_chunks(chunks: DataFrame, with_actions: bool = False) -> DataFrame:
    """One step per chunk without any generator: numbered title, the first 200 characters as summary, the chunk as details. Its
    sentences can serve as actions."""
    text = F.col("text")
    return chunks.select(
        "transcript_id", F.col("chunk_index").alias("step_index"), F.concat(F.lit("Step "), (F.col("chunk_index") + 1).cast("string"), F.lit(": Process from transcript")).alias("title"),
        F.when(F.length(text) > 200, F.concat(F.left(text, F.lit(200)), F.lit("..."))).otherwise(text).alias("summary"), text.alias("details"),
        (T.sentences(text) if with_actions else F.array().cast("array<string>")).alias("actions"),
    )


def token_totals(usage: DataFrame) -> DataFrame:
    """Per transcript: tokens in and out, their sum, and the cost at 0.15 and 0.60 a million."""
    made = usage.groupBy("transcript_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return made.withColumns({"total_tokens": F.col("input_tokens") + F.col("output_tokens"), "cost": F.round(F.col("input_tokens") / 1e6 * 0.15 + F.col("output_tokens") / 1e6 * 0.60, 4)})


def step_words() -> Column:
    """The distinct lower-case words of a step's title, summary and details, without outer punctuation, of over three characters."""
    own = F.transform(T.words(F.lower(F.concat_ws(" ", "title", "summary", "details"))), lambda w: F.btrim(w, F.lit(L.PUNCTUATION)))
    return F.array_distinct(F.filter(own, lambda w: F.length(w) > 3))


def aligned(steps: DataFrame, sentences: DataFrame, top: int = 3) -> DataFrame:
    """(keys, sentence_index, matches, rank): sentences that hold two or more of a step's words (see step_words, anywhere), the
    best three. A word finds its sentences by the words that contain it, so no step meets a sentence without cause. A step meets
    sentences of one text once; of their places the first `top` alone can be among the best."""
    same = Window.partitionBy("transcript_id", "text").orderBy("sentence_index")
    told = sentences.select("transcript_id", "sentence_index", "text").withColumns({"_place": F.row_number().over(same), "_first": F.min("sentence_index").over(same)}).filter(F.col("_place") <= top)
    places = told.select("transcript_id", "_first", "sentence_index")
    need = steps.select(*KEYS, F.explode(step_words()).alias("word"))
    have = told.filter("_place = 1").select("transcript_id", "_first", F.explode(F.array_distinct(T.words(F.lower("text")))).alias("token"))
    tokens = have.select("transcript_id", "token").distinct()
    inside = need.select("transcript_id", "word").distinct().join(tokens, "transcript_id").filter(F.contains("token", F.col("word")))
    # a word once per text, however many of the text's words hold it
    held = inside.join(have, ["transcript_id", "token"]).select("transcript_id", "word", "_first").distinct()
    hits = need.join(held, ["transcript_id", "word"]).groupBy(*KEYS, "_first").agg(F.count(F.lit(1)).alias("matches")).filter("matches >= 2")
    hits = hits.join(places, ["transcript_id", "_first"]).select(*KEYS, "sentence_index", "matches")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("matches"), "sentence_index"))).filter(F.col("rank") <= top)


def with_phrases(steps: DataFrame, sentences: DataFrame, best: int = 2) -> DataFrame:
    """Steps with `phrases`: of the best aligned sentences, in their rank, the runs of four words (three at the end) that hold a word of
    the step of over four characters. Details under 150 characters get the fixed closing sentence if the first phrase is under 50 and
    not in them. A step without phrases has an empty list; blank details stay."""
    long = F.filter(step_words(), lambda w: F.length(w) > 4)
    told = sentences.select("transcript_id", "sentence_index", T.words(F.lower("text")).alias("told"))
    near = aligned(steps, sentences, best).join(told, ["transcript_id", "sentence_index"]).join(steps.select(*KEYS, long.alias("long")), KEYS)
    places = F.when(F.size("told") >= 3, F.sequence(F.lit(1), F.size("told") - 2)).otherwise(F.array().cast("array<int>"))
    runs = F.filter(F.transform(places, lambda i: F.array_join(F.slice("told", i, F.lit(4)), " ")), lambda p: F.exists("long", lambda w: F.contains(p, w)))
    found = near.withColumn("runs", runs).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("rank", "runs"))).alias("r")).select(*KEYS, F.flatten(F.transform("r", lambda x: x["runs"])).alias("phrases"))
    made = steps.drop("phrases").join(found, KEYS, "left").withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))
    first = F.get("phrases", F.lit(0))
    short = (F.length("details") > 0) & (F.length("details") < 150) & (F.length(first) < 50) & ~F.contains(F.lower("details"), first)
    return made.withColumn("details", F.when(short, F.concat("details", F.lit(L.ALIGNED))).otherwise(F.col("details")))
