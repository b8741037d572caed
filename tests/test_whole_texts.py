"""Queries that make spans, responses and screens of whole texts, against plain Python or their SQL."""

import os

import pytest

from scriptloom import oracles
from scriptloom.operators import document, knowledge
from scriptloom.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()


def test_spans_pair_their_backticks(spark):
    long, other = "x" * 51, "é" * 5000
    text = f"`a` {long} `b` and `{long}`\n`{other}`{long}"
    rows = document.code_spans(spark.createDataFrame([("t", text), ("u", None)], "transcript_id string, text string")).collect()
    assert [(r.number, r.code, text[r.start : r.end]) for r in rows] == [(0, long, f"`{long}`"), (1, other, f"`{other}`")]


@needs_data
def test_spans_of_whole_documents(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    names = ["transcript_id", "number", "start", "end", "code_sha256"]
    found = sorted(map(tuple, QUERIES["doc_code_spans_whole"](spark, DATA).select(*names).collect()))
    want = db.execute(f'SELECT transcript_id, number, start, "end", code_sha256 FROM ({oracles.ORACLES["doc_code_spans_whole"]})').fetchall()
    assert found == sorted(want) and len(found) > 2 * len({r[0] for r in found})


@needs_data
def test_responses_hold_whole_documents(spark):
    want = {}
    for r in documents(spark):
        solid = [x for x in (y.strip(" \t\r") for y in (r.text or "").split("\n")) if x]
        want |= {(str(r.doc_id), i // 4): (solid[i], solid[i + 1] if i + 1 < len(solid) else "", " ".join([solid[i + 2]] * 2) if i + 2 < len(solid) else "") for i in range(0, len(solid), 4)}
    found = {(r.transcript_id, r.step_index): r for r in QUERIES["stp_parsed"](spark, DATA).collect()}
    assert {k: (r.title, r.summary, r.details) for k, r in found.items()} == want
    assert len({r.title for r in found.values()}) > 100 and any("|" in r.actions for r in found.values())


@needs_data
def test_screens_differ(spark):
    rows = QUERIES["mat_screens"](spark, DATA).collect()
    assert len({r.screenshot_ref for r in rows}) > 1 and {r.confidence for r in rows} - {0.8}


def test_excerpts_come_from_the_whole_page(spark):
    html = f"<html><head><title>t</title></head><body><main><p>{'filler words here ' * 8000}</p><p>violet kangaroo sings</p></main></body></html>"
    assert knowledge.page_text(html)[1].endswith("violet kangaroo sings")
    pages = knowledge.contents(spark.createDataFrame([("u", html)], "url string, html string"))
    found = knowledge.excerpts(pages, spark.createDataFrame([(1, "violet kangaroo sings")], "query_id int, text string")).collect()
    assert {r.window for r in found if r.score == 1.0} and all("violet kangaroo sings" in r.window for r in found if r.score == 1.0)
