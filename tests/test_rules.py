"""Small exact cases of the text rules and the operators on them."""

import pytest
from pyspark.sql import functions as F

from scriptloom.config import Matching, Ranking, Run, Segmentation, Validation
from scriptloom.functions import text as T
from scriptloom.operators import chunking, cleaning, confidence, document, jobs, knowledge, matching, parsing, qa, segmentation, structure, validation
from scriptloom.operators import steps as S
from scriptloom.plans import run as plan


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "f,text,want",
    [
        (T.without_stamps, "[00:01:02] a (0:00:01.123) b <00:00:03> 00:00:04 - c", " a  b  c"),
        (T.without_speakers, "Speaker 1: hi\nJOHN: yo\n[Ann]: x\n>> Bob: y\n**Eve**: z", "hi\nyo\nx\ny\nz"),
        (T.without_tags, "a [inaudible] b (laughs) [slide 3] [some words]", "a  b  [slide 3] "),
        (T.without_fillers, "Um, you know it is ok, umbrella", ",  it is , umbrella"),
        (T.repaired_punctuation, "a.b , c!!? d", "a. b, c? d"),
        (T.tidy_space, "  a   b  \n\n\n\n c ", "a b\n\nc"),
        (T.without_webvtt, "WEBVTT\n\nNOTE x y\n<v Bob>hi</v>", "hi"),
        (T.sentences, "One two. Three! four? Ok. No", ["One two.", "Three! four?"]),
        (T.is_question, "how to do it", True),
        (T.is_question, "however it is", False),
        (T.is_transition, "OK so let's go on", True),
        (T.has_emphasis, "this is VERY bold", True),
        (T.has_emphasis, "no Emphasis here", False),
        (T.stamp_seconds, "<01:02:03 x", 3723.0),
        (T.speaker_name, ">> Mary: x", "Mary"),
        (T.speaker_name, "Mary Ann: x", None),
        (T.ui_class, "Save it", "button"),
        (T.ui_class, "File > Open", "menu_item"),
        (T.ui_class, "Name", "label"),
        (lambda c: T.duration_text(c.cast("double")), "125", "2 min 5 sec"),
        (lambda c: T.duration_text(c.cast("double")), "3600", "1 hr"),
        (lambda c: T.relative_text(c.cast("double")), "90000", "1 day ago"),
        (knowledge.url_title, "https://a.example/docs/how-to_use.html", "How To Use"),
        (knowledge.url_title, "https://a.example/", "a.example"),
    ],
)
def test_columns(spark, f, text, want):
    assert value(spark, text, f) == want


def transcript(spark, *texts):
    return parsing.lines_of(spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(texts)], "transcript_id string, text string"))


def test_parsed_flags(spark):
    text = "[00:00:05] Speaker 1: Open the page. Now let's look.\n\n[00:02:00] Speaker 2: What is THIS\nplain words"
    rows = sorted(parsing.parsed(transcript(spark, text)).collect(), key=lambda r: r.sentence_index)
    assert [(r.timestamp, r.speaker, r.speaker_role) for r in rows] == [(5.0, "Speaker 1", "instructor")] * 2 + [(120.0, "Speaker 2", "participant"), (None, None, None)]
    assert [r.follows_long_pause for r in rows] == [False, False, True, False] and [r.speaker_changed for r in rows] == [False, False, True, False]
    assert [r.is_question for r in rows] == [False, False, True, False] and rows[1].is_transition and rows[2].has_emphasis
    m = parsing.metadata(parsing.parsed(transcript(spark, text))).first()
    assert m.speaker_names == ["Speaker 1", "Speaker 2"] and m.primary_speaker == "Speaker 1" and m.primary_ratio == 0.5 and m.duration == 120.0 and m.has_qa_sections


def test_order_of_input_rows_does_not_matter(spark):
    lines = transcript(spark, *["\n".join(f"[00:{i:02d}:00] Speaker {1 + i % 2}: Click item {i}. Next, we will go on?" for i in range(12))] * 3)
    a = segmentation.segmented(parsing.parsed(lines)).orderBy("transcript_id", "sentence_index").collect()
    b = segmentation.segmented(parsing.parsed(lines.repartition(5).orderBy(F.rand(3)))).orderBy("transcript_id", "sentence_index").collect()
    assert a == b


def test_minimum_segments(spark):
    text = "\n".join(f"Speaker 1: Sentence number {i} goes here." for i in range(9))
    rows = segmentation.segmented(parsing.parsed(transcript(spark, text)))
    assert [r["count"] for r in rows.groupBy("segment_id").count().orderBy("segment_id").collect()] == [3, 3, 3]
    assert rows.filter("fallback_split").count() == 9


def test_qa_statistics(spark):
    rows = [("t", s, i, s == 0 and i < 2, "A", "instructor") for s in (0, 1) for i in range(2 if s == 0 else 3)]
    df = spark.createDataFrame(rows, "transcript_id string, segment_id int, sentence_index int, is_question boolean, speaker string, speaker_role string")
    s = qa.statistics(df).first()
    assert (s.segments, s.qa_segments, s.density, s.filter_rate) == (2, 1, 0.4, 0.5)
    assert qa.without_qa(df).count() == 3 and qa.instructor_led(df).filter("instructor_led").count() == 2


def test_near_duplicate_sentences(spark):
    text = "Click the big red button now. Click the big red button now! Open it. click the big red button now. Other words"
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "transcript_id string, text string")
    found = {r.transcript_id: r.text for r in cleaning.merged_duplicates(df).collect()}
    assert found == {"a": "Click the big red button now. Click the big red button now! Open it. Other words", "b": "", "c": ""} or found["a"] == "Click the big red button now. Open it. Other words"


def test_chunks(spark):
    docs = spark.createDataFrame([("a", " ".join(f"Sentence number {i}." for i in range(20))), ("b", "Only one sentence.")], "transcript_id string, text string")
    n = {r.transcript_id: r["count"] for r in chunking.by_sentences(docs, 8).groupBy("transcript_id").count().collect()}
    assert n == {"a": 7, "b": 1}
    w = chunking.word_windows(spark.createDataFrame([("a", " ".join(f"w{i:03d}" for i in range(50)))], "id string, text string"), "id", size=100).orderBy("window_index").collect()
    assert w[0].window.split()[-4:] == w[1].window.split()[:4] and all(len(x.window) <= 100 for x in w) and w[-1].window.endswith("w049")


def test_structure(spark):
    r = structure.structure(spark.createDataFrame([("a", "If the user clicks open, then select")], "transcript_id string, text string")).first()
    assert r.actions == ["click", "open", "select"] and r.roles == ["user"] and r.decisions == ["if", "select"] and r.suggested_steps == 3
    hits = structure.sequence_hits(spark.createDataFrame([("a", "First this, then that, last")], "transcript_id string, text string")).collect()
    assert [(h.family, h.indicator, h.position) for h in hits] == [(0, "first", 0), (1, "then", 12), (3, "last", 23)]


def test_parsed_responses(spark):
    text = "noise\nSTEP 1: Set up\nSUMMARY: first\nsecond\nDETAILS: long text\nmore\nACTIONS:\n- one\n* two\nnot a bullet\nSTEP 2: Next\nOVERVIEW: o"
    rows = S.parsed_responses(spark.createDataFrame([("r", text)], "transcript_id string, text string")).orderBy("step_index").collect()
    assert [(r.title, r.summary, r.details, r.actions) for r in rows] == [("Set up", "first", "long text more", ["one", "two"]), ("Next", "o", "", [])]


def steps_frame(spark, rows):
    return spark.createDataFrame(rows, "transcript_id string, step_index int, title string, summary string, details string, actions array<string>, confidence_score double")


def test_validation(spark):
    df = steps_frame(spark, [("t", 0, "Configure the server", "s", "x" * 60, ["Open it", "Set it", "Save it"], 0.5), ("t", 1, "Step 1", "s", "", ["a", " ", "A"], 0.1), ("t", 2, "", "s", "short", ["Review x"], 0.3)])
    found = {r.step_index: r for r in validation.checked(df).collect()}
    assert found[0].is_valid and found[0].issues == []
    assert {i.type for i in found[1].issues} == {"empty_actions", "short_title", "generic_title", "missing_details", "very_low_confidence", "duplicate_actions"}
    assert {i.type for i in found[2].issues} == {"insufficient_actions", "missing_title", "insufficient_details", "low_confidence"} and len(found[2].suggested_fixes) == 2
    verbs = {(r.step_index, r.pos): r["class"] for r in validation.action_verbs(df).collect()}
    assert verbs[0, 0] == "strong" and verbs[1, 1] == "empty" and verbs[2, 0] == "weak"
    assert validation.validation_report(validation.checked(df)).first().valid == 1


def test_blend(spark):
    r = spark.range(1).select(confidence.blended(F.lit(0.8), F.lit(0.2)).alias("x")).first()
    assert r.x == pytest.approx(0.62 * 0.95)


def test_confidence_of_sources(spark):
    rows = [("t", 0, "transcript", 0.6), ("t", 0, "knowledge", 0.4), ("t", 0, "visual", 0.8), ("t", 1, "visual", 0.8)]
    df = spark.createDataFrame([(*r[:3], "e", 1, None, None, r[3]) for r in rows], "transcript_id string, step_index int, type string, excerpt string, sentence_index int, screenshot_ref string, ui_elements array<string>, confidence double")
    c = {r.step_index: r for r in confidence.grounding(confidence.step_confidence(df)).collect()}
    assert c[0].confidence == pytest.approx((0.6 * 0.6 + 0.4 * 0.4) * 1.08 * 1.12 * 1.10) and c[1].confidence == 0.0 and not c[1].is_grounded
    assert {r.summary for r in confidence.source_summary(df).collect()} == {"transcript (1), knowledge (1)", "none"}
    assert [r.label for r in document.references(df).collect()] == ["Transcript (Sentence 2)", "Knowledge"]


def test_matching_with_reuse(spark):
    s = spark.createDataFrame([("t", i, "Click the create button in the region list") for i in range(1)], "transcript_id string, sentence_index int, text string")
    steps = steps_frame(spark, [("t", i, "create button", "region list", "click", ["Click the Create button"], 0.0) for i in range(4)])
    once = matching.transcript_sources(steps, s).orderBy("step_index").collect()
    again = matching.transcript_sources(steps, s, reuse=True).orderBy("step_index").collect()
    assert len({r.confidence for r in once}) == 1 and once[0].confidence == again[0].confidence
    assert [r.confidence for r in again] == sorted((r.confidence for r in again), reverse=True) and again[0].confidence > again[-1].confidence
    p = matching.action_patterns(steps).first()
    assert (p.verb, p.target) == ("click", "create button")


def test_jobs(spark):
    old = spark.createDataFrame([("1", "u", "processing", "2024-01-01"), ("2", "u", "completed", "2024-01-02")], "id string, user_id string, status string, created_at string").withColumn("created_at", F.to_timestamp("created_at")).withColumn("updated_at", F.col("created_at"))
    new = old.filter("id = '1'").withColumn("status", F.lit("completed")).withColumn("created_at", F.lit(None).cast("timestamp"))
    rows = {r.id: r for r in jobs.upserted(old, new, F.to_timestamp(F.lit("2025-05-05"))).collect()}
    assert rows["1"].status == "completed" and rows["1"].created_at.year == 2024 and rows["1"].updated_at.year == 2025 and len(rows) == 2
    good, bad = jobs.inserted(old, new)
    assert good.count() == 0 and bad.count() == 1
    log = spark.createDataFrame([("1", 1, "a", None), ("1", 2, None, 5), ("1", 3, "b", None)], "id string, updated_at int, stage string, step int")
    r = jobs.state(log).first()
    assert (r.stage, r.step, r.updated_at) == ("b", 5, 3)
    j = spark.createDataFrame([("1", "u", "{bad", "x")], "id string, user_id string, config string, status string")
    assert jobs.read_job(j, "1", "u").first().config["min_steps"] is None if jobs.read_job(j, "1", "u").first().config else True


def test_pages():
    title, text = knowledge.page_text("<html><head><title> A  b</title></head><body><nav>n</nav><main><p>x</p><script>s</script> y</main><article>z</article></body></html>")
    assert (title, text) == ("A b", "x y")
    assert knowledge.page_text(None) == ("", "")


def test_config():
    with pytest.raises(ValueError):
        Segmentation(gap=0.9)
    with pytest.raises(ValueError):
        Ranking(procedural=1.0)
    with pytest.raises(ValueError):
        Validation(weight_actions=0.9)
    assert Matching(word=1.0, semantic=1.0).normalised().word == 0.5 and Run(segment=False, filter_qa=True).segments


def test_whole_run(spark):
    text = "\n".join(f"[00:{i:02d}:00] Speaker {1 + (i % 7 == 0)}: Click the Create button number {i}. Then select region {i} from the list." for i in range(30))
    r = plan.process(transcript(spark, text, "x"))
    assert r.chunks.count() >= 3 and r.steps.count() == r.chunks.count()
    m = {x.transcript_id: x for x in r.metrics.collect()}
    assert m["t0"].sentences == 60 and m["t0"].accepted + m["t0"].rejected == r.steps.count()
    spark.catalog.clearCache()
