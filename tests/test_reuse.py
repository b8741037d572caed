"""Choices that count earlier choices, against choosing step by step."""

import random

import pytest

from scriptloom.config import Matching
from scriptloom.operators import matching


def brute(rows, config):
    chosen = []
    for t in sorted({r[0] for r in rows}):
        uses = {}
        for step in sorted({r[1] for r in rows if r[0] == t}):
            found = []
            for _, _, s, base, technical in (r for r in rows if r[:2] == (t, step)):
                x = base * (1 - min(0.6, (uses.get(s, 0) + 1) * 0.15))
                x = min(1.0, x + technical * 0.2 if x >= 0.1 else x)
                if x >= config.min_score:
                    found.append((-round(x, 9), s))
            for x, s in sorted(found)[: config.top]:
                uses[s] = uses.get(s, 0) + 1
                chosen.append((t, step, s, -x))
    return sorted(chosen)


@pytest.mark.parametrize("most", [200_000, 0])
def test_rounds_equal_step_by_step(spark, most):
    rng = random.Random(4)
    rows = [(t, step, s, round(rng.uniform(0.15, 1.0), 2), rng.choice([0.0, 0.05, 0.3])) for t, steps in (("a", 9), ("b", 3), ("c", 1), ("chain", 14)) for step in range(steps) for s in range(12) if t == "chain" and s < 7 or rng.random() < 0.6]
    rows += [("same", step, s, 0.5, 0.0) for step in range(5) for s in range(8)]  # all alike: ties by sentence
    df = spark.createDataFrame(rows, "transcript_id string, step_index int, sentence_index int, base_score double, technical double").repartition(3)
    found = matching.reused(df, Matching(), most)
    assert sorted((r.transcript_id, r.step_index, r.sentence_index, round(r.confidence, 9)) for r in found.collect()) == brute(rows, Matching())


def test_no_candidates(spark):
    assert matching.reused(spark.createDataFrame([], "transcript_id string, step_index int, sentence_index int, base_score double, technical double"), Matching()).count() == 0
