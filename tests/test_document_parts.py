"""Aligned phrases, cosine excerpts and the knowledge section, against plain Python or stated rows."""

import math

from scriptloom import lexicon as L
from scriptloom.config import Run
from scriptloom.operators import document, knowledge, parsing, steps
from scriptloom.plans import run

STEP = "transcript_id string, step_index int, title string, summary string, details string, actions array<string>"


def aligned_phrases(step, sentences):
    """(phrases, details) of one step, in loops."""
    words = {w.strip(L.PUNCTUATION) for w in " ".join(step[2:5]).lower().split()}
    words = {w for w in words if len(w) > 3}
    hits = sorted(((-sum(w in s.lower() for w in words), i) for i, s in enumerate(sentences)))
    phrases = []
    for n, i in [h for h in hits if -h[0] >= 2][:2]:
        told = sentences[i].lower().split()
        runs = [" ".join(told[k : k + 4]) for k in range(len(told) - 2)]
        phrases += [r for r in runs if any(w in r for w in words if len(w) > 4)]
    d = step[4]
    if phrases and d and len(d) < 150 and len(phrases[0]) < 50 and phrases[0] not in d.lower():
        d += L.ALIGNED
    return phrases, d


def test_phrases_of_aligned_sentences(spark):
    told = ["Open the (settings) page, then choose a region.", "Nothing here.", "Settings: the page again!", "Regions and settings pages matter", "a b"]
    made = [
        ("t", 0, "Settings,", "Open page.", "Choose it.", []), ("t", 1, "Nothing", "", "", []), ("t", 2, "settings page", "", "open the (settings) page, then", []),
        ("t", 3, "settings page", "", "x" * 150, []), ("u", 0, "settings page", "", "No sentences.", []),
    ]
    rows = steps.with_phrases(spark.createDataFrame(made, STEP), spark.createDataFrame([("t", i, s) for i, s in enumerate(told)], "transcript_id string, sentence_index int, text string")).collect()
    assert {(r.transcript_id, r.step_index): (r.phrases, r.details) for r in rows} == {m[:2]: aligned_phrases(m, told if m[0] == "t" else []) for m in made}
    assert any(r.details.endswith(L.ALIGNED) for r in rows)


def test_outer_punctuation_is_no_part_of_a_word(spark):
    one = spark.createDataFrame([("t", 0, "Settings,", "(page)", "", [])], STEP)
    told = spark.createDataFrame([("t", 0, "The settings page")], "transcript_id string, sentence_index int, text string")
    assert [r.matches for r in steps.aligned(one, told).collect()] == [2]


def test_excerpts_by_cosine(spark):
    vectors = {("a", 0): [1.0, 0.0], ("a", 1): [1.0, 1.0], ("a", 2): [0.9, 0.1], ("a", 3): [1.0, 0.2], ("b", 0): [0.0, 1.0], ("b", 1): [2.0, 0.0], ("b", 2): [0.0, 0.0], ("b", 3): None, ("c", 0): [1.0, 0.0]}
    windows = spark.createDataFrame([(u, i, f"{u}{i}", v) for (u, i), v in vectors.items()], "url string, window_index int, window string, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "query_id string, embedding array<double>")
    given = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("none", "a")], "query_id string, url string")
    rows = knowledge.near_excerpts(windows, queries, given).collect()

    def score(v):
        return max(0.0, v[0] / math.hypot(*v)) if v and any(v) else 0.0

    want = []
    for url in "ab":
        own = sorted(((-score(v), url, i) for (u, i), v in vectors.items() if u == url))[:3]
        want += [x for x in own if -x[0] > 0.1]
    want = sorted(want)[:5]
    assert [(r.url, r.window_index, r.window) for r in sorted(rows, key=lambda r: r["rank"])] == [(u, i, f"{u}{i}") for _, u, i in want]
    assert all(r.query_id == "q" for r in rows)


def test_knowledge_section(spark):
    pages = [("t", "u2", "Two", "y" * 501, "web", None), ("t", "u1", None, "", "pdf", None), ("t", "u0", "Bad", "z", "error", "timeout"), ("v", "u3", "Bad", "z", "error", "timeout")]
    df = spark.createDataFrame(pages, "transcript_id string, url string, title string, content string, type string, error string")
    found = {(r.transcript_id, r.position): r.text for r in document.knowledge_section(df).collect()}
    assert found == {("t", 0): "Knowledge Sources", ("t", 1): "Source 1: Untitled\nURL: u1\nType: Pdf", ("t", 2): "Source 2: Two\nURL: u2\nType: Web\n" + "y" * 500 + "..."}


def test_sections_are_written_in_order(spark, tmp_path):
    one = spark.createDataFrame([("t", 0, "First", "s", "d", ["go"])], STEP)
    sources = spark.createDataFrame([("t", 0, "transcript", "said", 0, None, None, 0.5)], "transcript_id string, step_index int, type string, excerpt string, sentence_index int, screenshot_ref string, ui_elements array<string>, confidence double")
    usage = spark.createDataFrame([("t", 1.0, 5, 0.0)], "transcript_id string, seconds double, total_tokens int, cost double")
    pages = spark.createDataFrame([("t", "u", "Page", "text", "web", None)], "transcript_id string, url string, title string, content string, type string, error string")
    made = document.sections(spark.createDataFrame([("t", "Title")], "transcript_id string, title string"), one, sources, document.statistics(one, sources, usage), pages)
    document.write_sections(made, str(tmp_path / "out"))
    texts = [r.text for r in spark.read.parquet(str(tmp_path / "out")).orderBy("part", "position").collect()]
    assert texts[0] == "Title" and texts[-3:-1] == ["Knowledge Sources", "Source 1: Page\nURL: u\nType: Web\ntext"] and texts[-1] == "Steps: 1, references: 1"


def test_a_run_ends_with_its_documents(spark):
    """The document has the accepted steps only, numbered anew, and what they cite; a transcript without any has none."""
    judged = spark.createDataFrame(
        [("t", 0, "Zero", "s0", "d0", ["a"], False), ("t", 1, "One", "s1", "d1", ["b", "c"], True), ("t", 3, "Three", "s3", "d3", [], True), ("none", 0, "No", "s", "d", [], False)],
        "transcript_id string, step_index int, title string, summary string, details string, actions array<string>, accepted boolean",
    )
    kinds = "transcript_id string, step_index int, type string, excerpt string, sentence_index int, screenshot_ref string, ui_elements array<string>, confidence double"
    sources = spark.createDataFrame([("t", 0, "transcript", "lost", 0, None, None, 0.9), ("t", 3, "transcript", "said", 4, None, None, 0.5), ("t", 3, "knowledge", "[Page (1)](http://x.org/a_(b))\ntext", None, None, None, 0.4), ("none", 0, "knowledge", "[No](http://x.org/no)\n", None, None, None, 0.4)], kinds)
    pages = spark.createDataFrame([("http://x.org/a_(b)", "Page (1)", "text", None), ("http://x.org/no", "No", "text", None)], "url string, title string, content string, error string")
    titles = spark.createDataFrame([("t", "The title")], "transcript_id string, title string")
    made = run.assembled(judged, sources, Run(), titles, None, pages).orderBy("part", "position").collect()
    assert {r.transcript_id for r in made} == {"t"}
    parts = {}
    for r in made:
        parts.setdefault(r.part, []).append((r.position, r.text))
    assert parts[0] == [(0, "The title")]
    assert [x for _, x in parts[1]] == ["Introduction", "Step 1: One", "Step 2: Three", "Source References", "Document Statistics"]
    assert parts[2] == [(0, "This document has 2 steps.")] and [x for _, x in parts[3]] == ["One\ns1\nd1\n- b\n- c", "Three\ns3\nd3\n"]
    assert [p for p, _ in parts[4]] == [1001, 1002] and [x for _, x in parts[5]] == ["Knowledge Sources", "Source 1: Page (1)\nURL: http://x.org/a_(b)\nType: Web\ntext"]
    assert parts[6] == [(0, "Steps: 2, references: 2")]
    short = run.assembled(judged, sources, Run(include_statistics=False)).collect()
    assert {r.part for r in short} == {0, 1, 2, 3, 4} and "Document Statistics" not in {r.text for r in short}
    assert run.assembled(judged.filter("NOT accepted"), sources, Run(), titles, None, pages).count() == 0


def test_a_whole_run_gives_the_document_of_its_parts(spark):
    text = "\n".join(f"[00:0{i}:00] Speaker 1: Now, click the Create button number {i}. Select the region {i} from the list of regions. Save the form {i} and check the settings page." for i in range(8))
    made = run.process(parsing.lines_of(spark.createDataFrame([("x", text)], "transcript_id string, text string")), Run(min_confidence=0.0))
    accepted = made.accepted.filter("accepted").orderBy("step_index").collect()
    found = made.document.filter("part = 3").orderBy("position").collect()
    assert [r.text.split("\n")[0] for r in found] == [r.title for r in accepted]
    assert run.process(parsing.lines_of(spark.createDataFrame([("x", text)], "transcript_id string, text string")), Run(assemble=False)).document is None
