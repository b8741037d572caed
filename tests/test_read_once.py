"""Sentences are read once where counts suffice, and steps meet counts without their texts."""

import random

from pyspark.sql import functions as F

from scriptloom.config import QaFilter
from scriptloom.operators import qa, validation


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def expected(rows, most):
    """In plain Python: (transcript, segment) to whether an instructor leads it."""
    found = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])
        named = [r for r in own if r[3] is not None]
        count = lambda who: sum(r[3] == who for r in named)
        primary = max(named, key=lambda r: (count(r[3]), -next(x[2] for x in named if x[3] == r[3])))[3] if named else None
        role = next((r[4] or "none" for r in own if r[3] == primary and r[4] in (None, "instructor")), None)
        found[key] = role == "instructor" or (role == "none" and sum(r[5] for r in own) / len(own) < most)
    return found


def test_instructor_led_reads_sentences_once(spark):
    rng, rows = random.Random(5), []
    for t in ("a", "b", "c"):
        for i in range(300):
            who = rng.choice(["Anna", "Ben", None, None]) if t != "c" else None
            rows.append((t, i // rng.choice([3, 3, 4]), i, who, rng.choice(["instructor", "participant", None]), rng.random() < 0.3))
    df = spark.createDataFrame(rows, "transcript_id string, segment_id int, sentence_index int, speaker string, speaker_role string, is_question boolean")
    made = qa.instructor_led(df, QaFilter())
    assert {tuple(r)[:2]: r["instructor_led"] for r in made.collect()} == expected(rows, QaFilter().max_instructor_questions)
    assert len({r for r in expected(rows, 0.2).values()}) == 2
    assert not any(x.nodeName() == "Join" for x in nodes(optimized(made)))


def test_no_text_of_a_step_meets_its_counts(spark):
    steps = spark.createDataFrame(
        [("a", 0, "Step 1", "Click it", "x " * 60, ["Click it", "do this", " "]), ("a", 1, "", "", "", []), ("b", 0, "Click it", "Click it", None, ["Open it", "Save it", "Run it"])],
        "transcript_id string, step_index int, title string, summary string, details string, actions array<string>",
    )
    made = validation.action_check(steps)
    shown = {tuple(r)[:2]: tuple(r)[2:] for r in made.collect()}
    assert (shown["a", 0][0], shown["a", 0][3]) == (3, 60) and shown["a", 1][:4] == (0, 0, 0, 0) and shown["b", 0][0] == 3
    sides = [x.children().apply(0).output().mkString(",") for x in nodes(optimized(made)) if x.nodeName() == "Join"]
    assert sides and not any(name in side for side in sides for name in ("details", "summary", "title#"))
    assert made.agg(F.count(F.lit(1))).first()[0] == 3
