"""All registered queries of the transcript operators. Each reads whole tables; inputs that no table holds are derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lexicon as L
from .config import Matching, QaFilter, Run, Validation
from .functions import text as T
from .operators import chunking, cleaning, confidence, document, jobs, knowledge, long, matching, parsing, qa, ranking, segmentation, structure, validation, vectors
from .operators import steps as S
from .oracles import ORACLES
from .plans import run as plan
from .plans.keep import kept, new_folder
from .sources import crawl_table
from .sources.job_store import JobStore
from .streaming import intake

QUERIES: dict = {}
FLAGSHIP = "segments"


def now():
    return F.to_timestamp(F.lit("2026-01-01 00:00:00"))


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def two(x: Column) -> Column:
    return F.lpad(x.cast("int").cast("string"), 2, "0")


def hour_of(ts: str) -> Column:
    return F.concat(F.to_date(ts).cast("string"), F.lit("-"), two(F.hour(ts)))


def said_lines(e: DataFrame, transcript: Column, number: Column) -> DataFrame:
    """Stamped two-speaker lines, one per event."""
    sec = F.floor((F.minute("ts") * 60 + F.floor(F.second("ts"))) / 6).cast("int")
    odd = F.col("event_id") % 2 == 0
    said = (
        F.when(F.col("event_type") == "click", "Click the Create button. Then select the region from the list.")
        .when((F.col("event_type") == "view") & odd, "What does the overview page show? Is it the same for everyone?").when(F.col("event_type") == "view", "Open the overview page and check the settings.")
        .when(F.col("event_type") == "signup", "Enter your name and save the form. The form keeps the name.")
        .when((F.col("event_type") == "error") & odd, "Now let's look at the ERROR page. Reset the password again.").when(F.col("event_type") == "error", "The ERROR page is empty.").otherwise("That was really helpful. Thanks!")
    )
    stamp = F.concat(F.lit("[00:"), two(F.floor(sec / 60)), F.lit(":"), two(sec % 60), F.lit("] Speaker "), F.when(F.col("user_id") % 5 == 0, "2").otherwise("1"), F.lit(": "))
    return e.select(transcript.alias("transcript_id"), number.alias("line_no"), F.concat(stamp, said).alias("line"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """One transcript per hour of events. Hours are dealt into parts by the number of events before their lines are numbered."""
    e = table(spark, d, "events")
    e = e.withColumns({"_day": F.to_date("ts"), "_hour": F.hour("ts")}).repartition(parsing.parts_of(e), "_day", "_hour")
    number = F.row_number().over(Window.partitionBy("_day", "_hour").orderBy("ts", "event_id")) - 1
    return said_lines(e, hour_of("ts"), number)


def uneven_lines(spark: SparkSession, d: str) -> DataFrame:
    """The stamped lines, every third of them in one transcript, numbered by event."""
    one = table(spark, d, "events")
    return said_lines(one, F.when(F.col("event_id") % 3 == 0, "meeting").otherwise(hour_of("ts")), F.col("event_id"))


def chat_lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("transcript_id"), F.col("turn").alias("line_no"), F.concat(F.initcap("role"), F.lit(": "), "text").alias("line"))


def prose(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("transcript_id"), "text")


def paragraphed(spark: SparkSession, d: str) -> DataFrame:
    return prose(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def job_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("processing")
    made = F.to_timestamp("o_orderdate")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), status.alias("status"), made.alias("created_at"), (made + F.expr("make_interval(0,0,0,0,0,0,o_orderkey % 200000)")).alias("updated_at"),
        F.concat(F.lit('{"metrics":{"total_steps":'), (F.col("o_orderkey") % 9).cast("string"), F.lit("}}")).alias("result"), "o_totalprice",
    )


def rows_of(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.segmented(parsing.parsed(lines(spark, d)))


def steps_of(rows: DataFrame) -> DataFrame:
    """The built-in step of each segment, its sentences as actions."""
    texts = segmentation.segment_texts(rows).select("transcript_id", F.col("segment_id").alias("chunk_index"), "text")
    return S.from_chunks(texts, with_actions=True).withColumn("confidence_score", F.size("actions") / 10)


def step_rows(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(rows_of(spark, d))


def told(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(steps, sentences), each a table, so that lines are parsed once however often both are read."""
    sentences = kept(parsing.parsed(lines(spark, d)))
    return kept(steps_of(segmentation.segmented(sentences))), sentences


def crawl(spark: SparkSession, d: str) -> DataFrame:
    """Pages as crawled: an age from the id, an error for some."""
    p = table(spark, d, "pages")
    at = F.expr("timestamp'2026-01-01 00:00:00' - make_interval(0,0,0,0,0,0,(page_id % 40) * 3600)")
    return p.select("page_id", "url", at.alias("fetched_at"), F.when(F.col("page_id") % 7 == 0, "timeout").alias("error"), knowledge.html_title(F.col("html")).alias("title"), F.col("html").alias("content"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def d6(name: str) -> Column:
    """Rounded over decimals, so that values which end in an exact five are rounded alike everywhere."""
    return F.round(F.col(name).cast("decimal(18,12)"), 6).cast("double")


# sources and sinks


@query
def src_read_job(spark, d):
    j = job_rows(spark, d)
    one = j.orderBy("created_at", "id").select("id", "user_id").first()
    return jobs.read_job(j, one["id"], one["user_id"]).select("id", "user_id", "status", F.col("result")["metrics"]["total_steps"].alias("total_steps"))


def upsert_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, batch): jobs in progress are written twice in one batch, first as failed, then as completed; every fifth comes again under a new id."""
    j = job_rows(spark, d).select("id", "user_id", "status", "created_at", "updated_at")
    busy = j.filter("status = 'processing'")
    later = busy.withColumns({"status": F.lit("completed"), "updated_at": F.col("updated_at") + F.expr("interval 1 hour"), "created_at": F.col("created_at") + F.expr("interval 1 day")})
    again = F.when(F.col("id").cast("bigint") % 5 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id"))
    return j, busy.withColumn("status", F.lit("failed")).unionByName(later).withColumn("id", again)


@query
def snk_upsert(spark, d):
    j, new = upsert_batch(spark, d)
    return jobs.upserted(j, new, now()).select("id", "user_id", "status", F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("updated_at"))


@query
def snk_insert(spark, d):
    """Each row twice, with two statuses; every third id is new."""
    j = job_rows(spark, d).select("id", "status", "created_at")
    new = j.select(F.when(F.col("id").cast("bigint") % 3 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id")).alias("id"), "status", "created_at")
    new = new.unionByName(new.withColumns({"status": F.lit("queued"), "created_at": F.col("created_at") + F.expr("interval 1 hour")}))
    good, bad = jobs.inserted(j, new)
    return good.select(F.lit("inserted").alias("kind"), "id", "status").unionByName(bad.select(F.lit("rejected").alias("kind"), "id", "status"))


def job_store(jobs: DataFrame) -> JobStore:
    at = new_folder(jobs.sparkSession, "jobs")
    return JobStore.create(jobs, at.rpartition("/")[2].replace("-", "_"), at)


@query
def sto_read_job(spark, d):
    """The job of src_read_job from the bucketed store: one bucket is read."""
    j = job_rows(spark, d).drop("o_totalprice")
    one = j.orderBy("created_at", "id").select("id", "user_id").first()
    return job_store(j).read(one["id"], one["user_id"]).select("id", "user_id", "status", F.col("result")["metrics"]["total_steps"].alias("total_steps"))


@query
def sto_upsert(spark, d):
    """The batch of snk_upsert into the bucketed store."""
    j, new = upsert_batch(spark, d)
    store = job_store(j)
    store.upsert(new, now())
    return store.jobs().select("id", "user_id", "status", F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("updated_at"))


@query
def sto_recent(spark, d):
    """The list of job_recent from the bucketed store: the user's buckets are read."""
    j = job_rows(spark, d).drop("o_totalprice")
    busiest = j.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()
    return job_store(j).recent(busiest["user_id"], 60, "completed").select("id", "user_id", "status", F.get_json_object("result_metrics", "$.total_steps").alias("total_steps"))


@query
def snk_delete(spark, d):
    gone = job_rows(spark, d).filter("status = 'failed'").select("id")
    left = jobs.deleted({"jobs": (job_rows(spark, d), "id"), "documents": (table(spark, d, "lineitem").withColumn("job", F.col("l_orderkey").cast("string")), "job")}, gone)
    return left["jobs"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("jobs").alias("kind"), "n").unionByName(left["documents"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("kind"), "n"))


# cleaning


@query
def cln_stamps_speakers(spark, d):
    return lines(spark, d).select("transcript_id", "line_no", T.without_speakers(T.without_stamps(F.concat(F.col("line"), F.lit(" 00:01:02 - end <00:00:01>")))).alias("text"))


@query
def cln_fillers(spark, d):
    t = F.concat(F.lit("WEBVTT\nNOTE x\nUm, like I said, "), "text", F.lit("  you know !! Ok"))
    return table(spark, d, "documents").select("doc_id", T.tidy_space(T.repaired_punctuation(T.without_templates(T.without_fillers(T.without_webvtt(t))))).alias("text"))


@query
def cln_tags(spark, d):
    return lines(spark, d).select("transcript_id", "line_no", T.without_tags(F.concat("line", F.lit(" [inaudible] (laughs) [slide 2] [some words]"))).alias("text"))


@query
def cln_exact_duplicates(spark, d):
    return cleaning.merged_duplicates(prose(spark, d), threshold=1.0).select("transcript_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def cln_normalized(spark, d):
    """Whole chain with near-duplicate sentences, over transcripts of one text each."""
    whole = lines(spark, d).groupBy("transcript_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return cleaning.normalized(whole)


# parsing


@query
def prs_sentences(spark, d):
    return parsing.parsed(lines(spark, d))


@query
def prs_chats(spark, d):
    return parsing.parsed(chat_lines(spark, d)).groupBy("speaker", "speaker_role").agg(F.count(F.lit(1)).alias("n"), F.count_if("speaker_changed").alias("changes"), F.count_if("is_question").alias("questions"))


@query
def prs_metadata(spark, d):
    m = parsing.metadata(parsing.parsed(lines(spark, d)))
    return r6(m.withColumn("speaker_names", F.array_join("speaker_names", ",")), "primary_ratio")


# chunks


@query
def chk_sentences(spark, d):
    return chunking.by_sentences(prose(spark, d)).select("transcript_id", "chunk_index", F.md5("text").alias("digest"))


@query
def chk_paragraphs(spark, d):
    return chunking.by_paragraphs(paragraphed(spark, d)).select("transcript_id", "chunk_index", F.length("text").alias("chars"))


@query
def chk_smart(spark, d):
    return chunking.smart(paragraphed(spark, d)).groupBy("transcript_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query
def chk_statistics(spark, d):
    return chunking.statistics(chunking.by_sentences(prose(spark, d)))


@query
def chk_word_windows(spark, d):
    return chunking.word_windows(prose(spark, d), "transcript_id").groupBy("transcript_id").agg(F.count(F.lit(1)).alias("windows"), F.max(F.length("window")).alias("longest"))


@query
def chk_step_count(spark, d):
    return chunking.sentence_parts(prose(spark, d)).groupBy("transcript_id").agg(F.max("n").alias("n")).select("transcript_id", chunking.step_count(F.col("n"), 3, 15).alias("steps"))


# segments


def shown_segments(rows: DataFrame) -> DataFrame:
    return segmentation.segment_records(rows).withColumn("speaker_counts", F.to_json("speaker_counts")).select(
        "transcript_id", "segment_id", "n_sentences", "first_index", "last_index", "start_ts", "end_ts", "duration", "primary_speaker", "speaker_counts", "question_count", "has_transition_start", "has_qa_section", "fallback_split"
    )


@query
def segments(spark, d):
    return shown_segments(rows_of(spark, d))


@query
def segments_long(spark, d):
    """Every third line belongs to one transcript; lines are numbered by their event."""
    return shown_segments(long.segmented(kept(long.parsed(uneven_lines(spark, d), block_lines=1024))))


@query
def prs_long(spark, d):
    """The sentences of the same transcripts."""
    return long.parsed(uneven_lines(spark, d), block_lines=1024).drop("_block")


@query
def seg_scores(spark, d):
    return r6(segmentation.boundary_scores(parsing.parsed(lines(spark, d))), "gap_score", "boundary_score", "dissimilarity").select(
        "transcript_id", "sentence_index", "gap_score", "speaker_score", "transition_score", "dissimilarity", "boundary_score", "is_boundary"
    )


@query
def seg_coherence(spark, d):
    return r6(segmentation.coherence(rows_of(spark, d)), "coherence")


@query
def seg_texts(spark, d):
    return segmentation.segment_texts(rows_of(spark, d))


# questions and answers


@query
def qaf_sections(spark, d):
    return r6(qa.sections(rows_of(spark, d)), "density").withColumn("speakers", F.array_join("speakers", ","))


@query
def qaf_kept(spark, d):
    return qa.without_qa(rows_of(spark, d)).groupBy("transcript_id").agg(F.countDistinct("segment_id").alias("segments"), F.count(F.lit(1)).alias("sentences"))


@query
def qaf_instructor_led(spark, d):
    return qa.instructor_led(rows_of(spark, d), QaFilter())


@query
def qaf_statistics(spark, d):
    return r6(qa.statistics(rows_of(spark, d)), "density", "filter_rate")


# ranking


@query
def rnk_scores(spark, d):
    return r6(ranking.ranked(ranking.scores(rows_of(spark, d))), "procedural", "action_density", "coherence", "part_procedural", "part_density", "part_coherence", "importance")


@query
def rnk_important(spark, d):
    return ranking.important(ranking.scores(rows_of(spark, d)), threshold=0).select("transcript_id", "segment_id", F.round("importance", 6).alias("importance"))


@query
def rnk_report(spark, d):
    return ranking.report(r6(ranking.scores(rows_of(spark, d)), "importance"))


# structure


@query
def str_structure(spark, d):
    s = structure.structure(segmentation.segment_texts(rows_of(spark, d)).groupBy("transcript_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment_id", "text"))), lambda x: x["text"]), " ").alias("text")))
    return s.withColumns({c: F.array_join(c, ",") for c in ("actions", "roles", "decisions")})


@query
def str_sequence_counts(spark, d):
    return structure.sequence_counts(lines(spark, d).select("transcript_id", F.col("line").alias("text"))).groupBy("transcript_id").agg(*[F.sum(f"family_{i}").alias(f"family_{i}") for i in range(4)])


@query
def str_sequence_hits(spark, d):
    return structure.sequence_hits(lines(spark, d).select("transcript_id", F.col("line").alias("text")))


@query
def str_paragraphs(spark, d):
    return structure.paragraphs(paragraphed(spark, d)).groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("paragraph")).alias("chars"))


@query
def str_ui_classes(spark, d):
    return structure.screen_lines(parsing.parsed(lines(spark, d)).select("transcript_id", "sentence_index", "text")).select("transcript_id", "sentence_index", "type")


# steps


@query
def stp_from_chunks(spark, d):
    return S.complete(S.from_chunks(chunking.by_sentences(prose(spark, d)))).select("transcript_id", "step_index", "title", "summary")


@query
def stp_parsed(spark, d):
    """Generated texts made from whole documents: each solid line is in turn a title, a summary, details (bare and after a second
    heading) and actions (one per sentence), so that a text has as many steps as the document's length gives."""
    solid = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    actions = lambda x: F.array_join(F.transform(T.sentences(x), lambda y: F.concat(F.lit("- "), y)), "\n")
    part = lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("STEP "), F.floor(i / 4).cast("string"), F.lit(": "), x)).when(i % 4 == 1, F.concat(F.lit("OVERVIEW: "), x)).when(i % 4 == 2, F.concat(F.lit("CONTENT:\n"), x, F.lit("\nDETAILS: "), x)).otherwise(F.concat(F.lit("KEY ACTIONS:\n"), actions(x)))
    made = prose(spark, d).select("transcript_id", F.array_join(F.transform(solid, part), "\n").alias("text"))
    return S.parsed_responses(made).withColumn("actions", F.array_join("actions", "|"))


@query
def stp_tokens(spark, d):
    e = table(spark, d, "lineitem")
    return S.token_totals(e.select(F.col("l_orderkey").cast("string").alias("transcript_id"), F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens")))


@query
def stp_aligned(spark, d):
    return S.aligned(*told(spark, d))


@query
def stp_phrases(spark, d):
    """Phrases of the steps, whose details are their first sentence here, so that some are short."""
    steps, sentences = told(spark, d)
    steps = steps.withColumn("details", F.coalesce(F.get("actions", F.lit(0)), F.lit("")))
    return S.with_phrases(steps, sentences).select("transcript_id", "step_index", F.array_join("phrases", "|").alias("phrases"), "details")


# grounding


@query
def mat_technical(spark, d):
    return parsing.parsed(chat_lines(spark, d)).select("transcript_id", "sentence_index", F.round(T.technical_score(F.col("text")), 6).alias("score"))


def by_text(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, members): the first sentence of each text of a transcript, which stands for its equals, and what each sentence is told by."""
    first = F.min("sentence_index").over(Window.partitionBy("transcript_id", "text"))
    own = kept(sentences.select("transcript_id", "sentence_index", "text", first.alias("text_index")))
    return own.filter("sentence_index = text_index").select("transcript_id", "sentence_index", "text"), own.select("transcript_id", "sentence_index", "text_index")


def with_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of steps and texts, and a row for each sentence with the text_index that it belongs to."""
    made = pairs.withColumns({"kind": F.lit("pair"), "text_index": F.col("sentence_index")})
    return made.unionByName(members.withColumn("kind", F.lit("member")), allowMissingColumns=True)


@query
def mat_candidates(spark, d):
    """All pairs of steps and sentences of a transcript with enough words in common."""
    steps, sentences = told(spark, d)
    return r6(matching.every_candidate(steps, *by_text(sentences)), "word_overlap")


@query
def mat_sources(spark, d):
    return r6(matching.transcript_sources(*told(spark, d)), "confidence").select("transcript_id", "step_index", "sentence_index", "confidence")


@query
def mat_reuse(spark, d):
    return r6(matching.transcript_sources(*told(spark, d), reuse=True), "confidence").select("transcript_id", "step_index", "sentence_index", "confidence")


@query
def mat_keywords(spark, d):
    """Pairs of steps and sentence texts with enough words in common, each text by its first sentence, with the scores of keywords and phrases, and the
    sentences of each text."""
    steps, sentences = told(spark, d)
    texts, members = by_text(sentences)
    rows = matching.scored(steps, texts, Matching(word=0.4, semantic=0.0, keyword=0.4, phrase=0.2))
    shown = r6(rows, "word_overlap", "keyword_score", "base_score", "technical").select("transcript_id", "step_index", "sentence_index", "keyword_score", F.round("phrase_score", 6).alias("phrase_score"), "base_score", "technical")
    return with_members(shown, members)


def with_vector_id(rows: DataFrame, n: int, number: Column) -> DataFrame:
    """Rows with the id of one of n vectors, by the transcript's hour and a number."""
    hour = F.replace("transcript_id", F.lit("-"), F.lit("")).cast("long")
    return rows.withColumn("vector_id", (hour * 31 + number) % n)


@query
def mat_hybrid(spark, d):
    """Word overlap and vectors, half each; steps and sentences get vectors by their hour and number."""
    steps, sentences = told(spark, d)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("vector_id"), "embedding")
    n = e.count()
    found = matching.transcript_sources(with_vector_id(steps, n, F.col("step_index") * 7), with_vector_id(sentences, n, F.col("sentence_index") * 3), Matching(), vectors=e)
    return found.select("transcript_id", "step_index", "sentence_index", d6("confidence").alias("confidence"))


@query
def mat_all_sources(spark, d):
    """Sources of three kinds per step, and the confidence of steps that have any: sentences; pages, each in the transcript of the event that
    has its number, by the words that it shares with a step; screens, one per assistant turn of the conversation that has the number of an
    event of the transcript, in the order of the steps."""
    steps, sentences = told(spark, d)
    at = table(spark, d, "events").select(F.col("event_id").alias("number"), hour_of("ts").alias("transcript_id"))
    pages = crawl(spark, d).filter("error IS NULL").withColumnRenamed("page_id", "number").join(at, "number").select("transcript_id", T.match_words(F.col("content"), False).alias("v"))
    wanted = kept(steps.select("transcript_id", "step_index", T.match_words(matching.search_text(steps), True).alias("w")))
    known = matching.page_overlaps(wanted, pages).withColumn("type", F.lit("knowledge"))
    turns = table(spark, d, "conversations").filter("role = 'assistant'").join(at, F.col("conv_id") == F.col("number")).select("transcript_id", F.floor(F.col("turn") / 2).cast("int").alias("step_index"), F.concat(F.lit("turn-"), F.col("turn").cast("string"), F.lit(".png")).alias("screenshot_ref"))
    seen = matching.as_sources(turns.join(steps.select("transcript_id", "step_index"), ["transcript_id", "step_index"]).withColumn("confidence", F.lit(0.8)), "visual")
    every = kept(matching.all_sources(matching.transcript_sources(steps, sentences), known, seen).select("transcript_id", "step_index", "type", "confidence", F.coalesce("times", F.lit(1)).alias("times")))
    made = confidence.step_confidence(every).join(confidence.source_summary(every), ["transcript_id", "step_index"])
    return made.withColumn("confidence", d6("confidence"))


@query
def mat_cosine(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("center"))
    return e.join(first, "label").select("vec_id", F.round(matching.cosine(F.col("embedding"), F.col("center")), 5).alias("score"))


@query
def mat_most_similar(spark, d):
    """The ten most similar vectors of every twentieth, all lists visited."""
    found = vectors.most_similar(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, "vec_id", probe_all=True)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


@query
def mat_most_similar_by_lists(spark, d):
    """The same by as many lists as sample queries need."""
    found = vectors.most_similar(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, "vec_id")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


@query
def mat_patterns(spark, d):
    return matching.action_patterns(step_rows(spark, d))


@query
def mat_screens(spark, d):
    """Steps made of whole conversations against a screen per assistant turn, whose elements are the turn's sentences."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("transcript_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = c.groupBy("transcript_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).select("transcript_id", F.array_join(F.transform("turns", lambda x: x["text"]), "\n").alias("text"))
    steps = S.from_chunks(chunking.by_sentences(told), with_actions=True)
    elements = F.transform(T.sentences(F.col("text")), lambda x: F.struct(x.alias("text"), F.lit("text").alias("type")))
    screens = c.filter("role = 'assistant'").select("transcript_id", F.concat(F.lit("turn-"), F.col("turn").cast("string"), F.lit(".png")).alias("filename"), F.col("text").alias("content"), elements.alias("ui_elements"))
    return matching.screen_sources(steps, screens).select("transcript_id", "step_index", "screenshot_ref", "confidence")


@query
def mat_knowledge(spark, d):
    """Steps made of the benchmark items against all pages."""
    text = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("transcript_id"), F.lit(0).alias("chunk_index"), "text")
    own = S.from_chunks(text)
    pages = kept(knowledge.contents(table(spark, d, "pages").select("url", "html"))).withColumn("error", F.lit(None).cast("string"))
    return matching.all_sources(matching.knowledge_sources(own, pages)).select("transcript_id", "step_index", "type", "confidence")


# confidence


@query
def cnf_confidence(spark, d):
    c = confidence.grounding(confidence.step_confidence(matching.transcript_sources(*told(spark, d))))
    return r6(c, "confidence").select("transcript_id", "step_index", "n_sources", "confidence", "is_grounded", F.size("warnings").alias("n_warnings"))


@query
def cnf_bands(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 101 / 100).alias("confidence"))
    made = confidence.bands(o).withColumn("blended", F.round(confidence.blended(F.col("confidence"), F.col("o_orderkey") % 7 / 6), 6))
    return r6(made, "confidence")


@query
def cnf_summary(spark, d):
    return confidence.source_summary(matching.transcript_sources(*told(spark, d)))


@query
def cnf_records(spark, d):
    return confidence.step_records(matching.transcript_sources(*told(spark, d))).select("transcript_id", "step_index", "n_sources", F.size("sources").alias("listed"), "has_transcript_support")


# validation


@query
def val_checked(spark, d):
    c = validation.checked(step_rows(spark, d))
    return r6(c, "quality").select("transcript_id", "step_index", "is_valid", "n_errors", "has_duplicates", "quality", F.array_join(F.transform("issues", lambda x: x["type"]), ",").alias("issue_types"), F.size("suggested_fixes").alias("n_fixes"))


@query
def val_report(spark, d):
    return r6(validation.validation_report(r6(validation.checked(step_rows(spark, d)), "quality")), "rate", "avg_quality", "min_quality", "max_quality", "avg_actions", "avg_confidence")


@query
def val_issues(spark, d):
    return validation.issue_report(validation.checked(step_rows(spark, d)))


@query
def val_verbs(spark, d):
    return validation.action_verbs(step_rows(spark, d)).groupBy("verb", "class", "suggestion").agg(F.count(F.lit(1)).alias("n"))


@query
def val_actions(spark, d):
    return validation.action_check(kept(step_rows(spark, d)))


@query
def val_summary(spark, d):
    steps = kept(step_rows(spark, d))
    return validation.batch_summary(validation.action_check(steps), validation.action_verbs(steps)).withColumn("weak_verbs", F.array_join("weak_verbs", ","))


@query
def val_accepted(spark, d):
    steps, sentences = told(spark, d)
    conf = confidence.step_confidence(matching.transcript_sources(steps, sentences))
    return validation.accepted(validation.checked(steps, Validation(min_confidence=0.25)), validation.action_check(steps), conf).groupBy("accepted", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def val_corpus(spark, d):
    return r6(validation.corpus_report(kept(step_rows(spark, d))), "avg_actions", "avg_words")


# knowledge


@query
def knw_titles(spark, d):
    p = knowledge.with_validity(table(spark, d, "pages"))
    return p.select("page_id", "is_valid", knowledge.html_title(F.col("html")).alias("title"), knowledge.url_title(F.col("url")).alias("url_title"))


@query
def knw_text(spark, d):
    return knowledge.contents(table(spark, d, "pages")).select("url", "title", F.length("content").alias("chars"))


@query
def knw_to_fetch(spark, d):
    c = crawl(spark, d)
    return knowledge.still_to_fetch(c.select("url"), c.drop("title", "content"), now())


@query
def knw_upkeep(spark, d):
    """Three landings, each of two thirds of the pages as they were fetched at its time, the last one first; what the table then holds."""
    p, at = crawl(spark, d), new_folder(spark, "crawl")
    for n in (2, 0, 1):
        own = p.filter(F.col("page_id") % 3 != n).withColumn("fetched_at", F.col("fetched_at") - F.expr(f"interval {n * 5} hours")).withColumn("content", F.concat(F.lit(f"landing {n}: "), "content"))
        crawl_table.land(spark, at, own, now(), shards=8)
    return spark.read.parquet(at).select("page_id", "url", "key", F.col("fetched_at").cast("string").alias("fetched_at"), "gone", F.md5("content").alias("digest"))


@query
def knw_types(spark, d):
    return knowledge.typed(crawl(spark, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def knw_excerpts(spark, d):
    pages = kept(knowledge.contents(table(spark, d, "pages")))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return knowledge.excerpts(pages, asked).select("query_id", "url", "window_index", F.round("score", 6).alias("score"), "rank")


@query
def knw_text_excerpts(spark, d):
    """The benchmark items against the windows of all documents."""
    sources = prose(spark, d).select(F.col("transcript_id").alias("url"), F.col("text").alias("content"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return knowledge.excerpts(sources, asked).select("query_id", "url", "window_index", F.md5("window").alias("digest"), F.round("score", 6).alias("score"), "rank")


@query
def knw_near_excerpts(spark, d):
    """All vectors as windows of the pages in turn, and as queries that were given two pages each."""
    e, p = table(spark, d, "embeddings"), table(spark, d, "pages").select("page_id", "url")
    n = max(p.count(), 1)
    windows = e.withColumn("page_id", F.col("vec_id") % n).join(p, "page_id").select("url", F.floor(F.col("vec_id") / n).alias("window_index"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("window"), "embedding")
    given = e.select(F.col("vec_id").alias("query_id"), F.explode(F.array((F.col("vec_id") * 3 + 1) % n, (F.col("vec_id") * 5 + 2) % n)).alias("page_id")).join(p, "page_id")
    return r6(knowledge.near_excerpts(windows, e.select(F.col("vec_id").alias("query_id"), "embedding"), given), "score")


@query
def knw_digest(spark, d):
    return knowledge.digest(crawl(spark, d)).select("url", F.length("summary").alias("chars"))


@query
def knw_usage(spark, d):
    cited = crawl(spark, d).select(F.lit("knowledge").alias("type"), F.col("content").alias("excerpt"))
    return r6(knowledge.usage(crawl(spark, d), cited), "rate")


# documents


@query
def doc_contents(spark, d):
    return document.contents(step_rows(spark, d))


@query
def doc_references(spark, d):
    return document.references(r6(matching.transcript_sources(*told(spark, d)), "confidence")).select("transcript_id", "step_index", "number", "label")


@query
def doc_statistics(spark, d):
    steps, sentences = told(spark, d)
    found = kept(matching.transcript_sources(steps, sentences))
    usage = lines(spark, d).groupBy("transcript_id").agg((F.count(F.lit(1)) * 7.5).alias("seconds"), F.sum(F.length("line")).alias("total_tokens")).withColumn("cost", F.round(F.col("total_tokens") / 1e6 * 0.15, 4))
    return document.statistics(steps, found, usage)


@query
def doc_code_spans(spark, d):
    marked = prose(spark, d).select("transcript_id", F.concat(F.lit("`"), F.replace("text", F.lit("`"), F.lit("")), F.lit("` and `short`")).alias("text"))
    return document.code_spans(marked).select("transcript_id", "number", "code")


@query
def doc_code_spans_whole(spark, d):
    """Whole documents as one span each, then each of their solid lines as a span, with offsets."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("`"), F.lit(""))
    inner = F.transform(F.split(text, "\n"), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit("`"), x, F.lit("`"))))
    marked = prose(spark, d).select("transcript_id", F.concat(F.lit("`"), text, F.lit("`\n"), F.array_join(inner, "\n")).alias("text"))
    return document.code_spans(marked).select("transcript_id", "number", "start", "end", F.sha2("code", 256).alias("code_sha256"))


@query
def doc_sections(spark, d):
    steps, sentences = told(spark, d)
    found = kept(matching.transcript_sources(steps, sentences))
    usage = lines(spark, d).groupBy("transcript_id").agg(F.lit(1.0).alias("seconds"), F.count(F.lit(1)).alias("total_tokens"), F.lit(0.0).alias("cost"))
    title = lines(spark, d).select("transcript_id").distinct().withColumn("title", F.col("transcript_id"))
    # a page belongs to the transcript of the event that has its number
    events = table(spark, d, "events").select(F.col("event_id").alias("page_id"), F.date_format("ts", "yyyy-MM-dd-HH").alias("transcript_id"))
    pages = knowledge.typed(crawl(spark, d)).join(events, "page_id")
    return document.sections(title, steps, found, document.statistics(steps, found, usage), pages).select("transcript_id", "part", "position", F.length("text").alias("chars"))


@query
def run_metrics(spark, d):
    """The whole run over all transcripts."""
    return plan.process(lines(spark, d), Run(assemble=False)).metrics


@query
def run_document(spark, d):
    """The documents of the whole run over all transcripts."""
    return plan.process(lines(spark, d)).document


# jobs


@query
def job_recent(spark, d):
    j = job_rows(spark, d)
    busiest = j.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()
    return jobs.recent(j, busiest["user_id"], 60, "completed").select("id", "user_id", "status", F.get_json_object("result_metrics", "$.total_steps").alias("total_steps"))


@query
def job_recent_of_all(spark, d):
    return jobs.recent_of_all(job_rows(spark, d), 3).select("user_id", "id", "status", "rank")


@query
def job_history(spark, d):
    return jobs.history(job_rows(spark, d)).groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").cast("string").alias("latest"))


@query
def job_active(spark, d):
    return jobs.active(job_rows(spark, d), F.to_timestamp(F.lit("1998-01-01 00:00:00")), 5).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def job_stages(spark, d):
    stage = F.get(T.literals(jobs.STAGES), (F.col("event_id") % 13).cast("int"))
    e = table(spark, d, "events").select("event_id", stage.alias("stage"))
    return e.select("event_id", "stage", jobs.status_of(F.col("stage")).alias("status"), F.round(jobs.progress_of(F.col("stage")), 6).alias("progress"))


@query
def job_state(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("stage"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("step"))
    return jobs.state(e, order=("ts", "event_id")).select("id", "stage", "step", F.col("event_id").alias("last_event"))


def landed(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of their files; a pattern, as the table may be one file or a folder."""
    return spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]")


@query
def stm_state(spark, d):
    """The log of job_state as a stream; the table that its changes stand for."""
    e = landed(spark, d).select(F.col("user_id").alias("id"), "ts", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("stage"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("step"))
    at = new_folder(spark, "states")
    intake.track_state(e, f"{at}/checkpoint", f"{at}/changes", order=("ts", "event_id")).awaitTermination()
    return intake.current_state(spark.read.parquet(f"{at}/changes"), order=("ts", "event_id")).select("id", "stage", "step", F.col("event_id").alias("last_event"))


@query
def stm_messages(spark, d):
    """Messages made of the events, some broken and many repeated: each job that was handled, and the dead letters."""
    job = F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type")
    whole = F.to_json(F.struct(job.alias("job_id"), F.col("user_id").cast("string").alias("user_id")))
    value = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).when(F.col("event_id") % 11 == 0, F.concat(F.lit('{"user_id":"'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise(whole)
    at = new_folder(spark, "messages")
    raw = landed(spark, d).select(value.alias("value"), F.current_timestamp().alias("arrived"))
    intake.consume(raw, f"{at}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{at}/handled/batch={n}"), f"{at}/dead").awaitTermination()
    good, dead = spark.read.parquet(f"{at}/handled"), spark.read.parquet(f"{at}/dead")
    return good.select(F.lit("handled").alias("kind"), F.col("job_id").alias("message")).unionByName(dead.select(F.col("reason").alias("kind"), F.col("value").alias("message")))


@query
def job_times(spark, d):
    return jobs.with_times(job_rows(spark, d), now()).select("id", "duration", "age")


@query
def job_results(spark, d):
    return jobs.flat_results(job_rows(spark, d))
