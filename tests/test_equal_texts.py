"""Sentences of one text, and steps of one wording, meet once: results are those of every place, the work is not."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptloom import oracles, queries
from scriptloom.config import Matching
from scriptloom.operators import cleaning, matching, steps

STEP = "transcript_id string, step_index int, title string, summary string, details string, actions array<string>"
TOLD = ["Open the settings page now.", "Save the form.", "The form keeps the settings.", "Nothing here.", "open the settings page now."]


def rows_of(spark, seed, n_steps, n_sentences):
    rng = random.Random(seed)
    made, told = [], []
    for t in ("a", "b"):
        told += [(t, i, rng.choice(TOLD)) for i in range(n_sentences)]
        for i in range(n_steps):
            own = rng.sample(TOLD, 2)
            made.append((t, i, f"Step {i + 1}: Process from transcript", own[0], " ".join(own), own))
    return spark.createDataFrame(made, STEP), spark.createDataFrame(told, "transcript_id string, sentence_index int, text string"), made, told


def words(step):
    return {w for w in (x.strip(".,!?;:()[]{}\"'") for x in " ".join(step[2:5]).lower().split()) if len(w) > 3}


def test_aligned_equals_every_place(spark):
    made, told, steps_, sentences = rows_of(spark, 1, 6, 40)
    want = []
    for s in steps_:
        own = words(s)
        hits = sorted((-n, i) for t, i, x in sentences if t == s[0] and (n := sum(w in x.lower() for w in own)) >= 2)
        want += [(*s[:2], i, -n, r + 1) for r, (n, i) in enumerate(hits[:3])]
    assert sorted((r.transcript_id, r.step_index, r.sentence_index, r.matches, r.rank) for r in steps.aligned(made, told).collect()) == sorted(want)


def test_aligned_meets_a_text_once(spark):
    """Rows that leave the joins by words, of 2 x 30 steps and 2 x 400 sentences of five texts."""
    made, told, _, _ = rows_of(spark, 2, 30, 400)
    found = steps.aligned(made, told)
    found.collect()
    node, most = found._jdf.queryExecution().executedPlan(), 0
    todo = [node]
    while todo:
        one = todo.pop()
        if one.nodeName() == "AdaptiveSparkPlan":
            todo.append(one.executedPlan())
            continue
        if hasattr(one, "plan") and "QueryStage" in one.nodeName():
            todo.append(one.plan())
        got = one.metrics().get("numOutputRows")
        if "Join" in one.nodeName() and got.isDefined():
            most = max(most, got.get().value())
        children = one.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert 0 < most < 30 * 2 * len(TOLD) * 12


def test_a_pair_of_texts_is_compared_once(spark):
    """Thirty transcripts hold the same near duplicates."""
    rows = [(f"t{k}", i, s, s) for k in range(30) for i, s in enumerate(["open the overview page and save the form", "open the overview page and save the forms", "nothing like the others"])]
    first = spark.createDataFrame(rows, "transcript_id string, pos int, sentence string, low string")
    pairs, _ = cleaning.text_pairs(cleaning.named_texts(first, "transcript_id"), "transcript_id", 0.9)
    assert [(r.x, r.y) for r in pairs.collect()] == [(rows[1][3], rows[0][3])]
    assert cleaning.near_pairs(first, "transcript_id", 0.9).count() == 30


def test_choices_by_texts_equal_choices_by_places(spark):
    """Few places and many steps, so that places are used many times over; scores that reach one and ties between texts."""
    rng = random.Random(3)
    texts = {"a": 7, "b": 2, "c": 11, "d": 1}
    places, at = [], list(range(sum(texts.values())))
    rng.shuffle(at)
    for text, n in texts.items():
        places += [("t", text, at.pop()) for _ in range(n)]
    rows = [("t", step, text, rng.choice([0.2, 0.5, 0.9, 1.1]), rng.choice([0.0, 0.3, 1.0])) for step in range(25) for text in texts if rng.random() < 0.8]
    rows += [("u", step, "a", 0.5, 0.0) for step in range(4)]
    places += [("u", "a", i) for i in range(9)]
    by_text = spark.createDataFrame(rows, "transcript_id string, step_index int, text_id string, base_score double, technical double")
    at = spark.createDataFrame(places, "transcript_id string, text_id string, sentence_index int")
    every = by_text.join(at, ["transcript_id", "text_id"]).select("transcript_id", "step_index", "sentence_index", "base_score", "technical")
    shown = lambda df: sorted((r.transcript_id, r.step_index, r.sentence_index, r.base_score, round(r.confidence, 9)) for r in df.collect())
    assert shown(matching.chosen_in_order(by_text, at, Matching())) == shown(matching.reused(every, Matching()))


def test_pairs_of_texts_and_their_sentences_are_all_pairs(spark):
    made, told, _, _ = rows_of(spark, 4, 5, 30)
    texts, members = queries.by_text(told)
    rows = queries.with_members(matching.candidates(made, texts), members)
    pairs, member = rows.filter("kind = 'pair'").collect(), rows.filter("kind = 'member'").collect()
    of = {}
    for m in member:
        of.setdefault((m.transcript_id, m.text_index), []).append(m.sentence_index)
    every = sorted((p.transcript_id, p.step_index, i, p.shared) for p in pairs for i in of[p.transcript_id, p.text_index])
    assert every == sorted((r.transcript_id, r.step_index, r.sentence_index, r.shared) for r in matching.candidates(made, told).collect())
    assert 0 < len(pairs) < len(every) / 3


def test_vectors_meet_in_blocks_and_equal_every_pair(spark):
    made, told, _, _ = rows_of(spark, 5, 9, 400)
    rng = random.Random(6)
    odd = [None, [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 0.0, 0.0]]
    vector = lambda: rng.choice(odd) if rng.random() < 0.1 else [float(rng.randint(-2, 2)) for _ in range(4)]
    with_vector = lambda df, key: df.join(spark.createDataFrame([(t, i, vector()) for t in "ab" for i in range(400)], f"transcript_id string, {key} int, embedding array<double>"), ["transcript_id", key])
    made, told = with_vector(made, "step_index").localCheckpoint(), with_vector(told, "sentence_index").localCheckpoint()
    every = matching.scored(made, told).withColumn("c", matching.adjusted(F.col("base_score"), F.col("technical"), F.lit(0))).filter("c >= 0.15")
    best = Window.partitionBy("transcript_id", "step_index").orderBy(F.desc(F.round("c", 9)), "sentence_index")
    want = every.withColumn("r", F.row_number().over(best)).filter("r <= 5").select("transcript_id", "step_index", "sentence_index", "c")
    found = matching.transcript_sources(made, told).select("transcript_id", "step_index", "sentence_index", "confidence")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    near = matching.near_rows(made, told, Matching(), block=64, side=4)
    assert near.count() * 10 < every.count()
    assert want.join(near, ["transcript_id", "step_index", "sentence_index"], "left_anti").count() == 0


def test_candidates_are_pairs_of_steps_and_sentences(spark, tmp_path):
    """Each sentence of a text that is told many times over is a candidate of its own, in query and SQL."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 7, ("click", "view", "error", "signup")[i // 2 % 4]) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = queries.QUERIES["mat_candidates"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    sql = db.execute(oracles.ORACLES["mat_candidates"])
    names = [c[0] for c in sql.description]
    assert sorted(names) == sorted(found.columns) and "step_index" in names and "kind" not in names
    got = sorted(tuple(r[n] for n in names) for r in found.collect())
    assert got == sorted(sql.fetchall())
    steps_, sentences = queries.told(spark, str(tmp_path))
    assert len(got) == matching.candidates(steps_, sentences).count() > 3 * matching.candidates(steps_, queries.by_text(sentences)[0]).count() > 0
