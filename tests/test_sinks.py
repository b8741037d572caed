"""Batches that repeat a key, against writing the rows one after the other."""

import random
from collections import Counter

from pyspark.sql import functions as F

from scriptloom.operators import jobs

SCHEMA = "id string, user_id string, status string, created_at timestamp, updated_at timestamp"


def rows(n, seed, ids):
    import datetime as dt

    rng = random.Random(seed)
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)
    return [(f"{rng.choice(ids)}", f"u{i % 3}", rng.choice(["failed", "completed", "processing"]), day(i) if rng.random() < 0.8 else None, day(rng.randrange(10**5))) for i in range(n)]


def test_upserts_of_repeated_ids(spark):
    old = rows(6, 1, ["a", "b", "c"])
    old = list({r[0]: r for r in old}.values())
    new = rows(400, 2, ["a", "x", "y", *"defgh"]) + [("hot", "u", "completed", None, old[0][4])] * 300
    now = F.to_timestamp(F.lit("2025-05-05"))
    found = jobs.upserted(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new + [(None, "u", "failed", None, None)], SCHEMA), now).collect()
    state = {r[0]: (r[1], r[2], r[3]) for r in old}
    told = set()
    at = "2025-05-05"
    for i, user, status, made, _ in sorted(new, key=lambda r: r[4]):
        state[i] = (user, status, (state[i][2] if i in state else None) or made or at)
        told.add(i)
    got = {r.id: (r.user_id, r.status, at if r.created_at and r.created_at.year == 2025 else r.created_at) for r in found}
    assert len(found) == len(state) and got == state
    assert all((r.updated_at.year == 2025) == (r.id in told) for r in found)


def test_inserts_of_repeated_ids(spark):
    old = [("a", "u", "failed", None, None), ("b", "u", "failed", None, None)]
    new = [("a", "u", "failed", None, None)] * 3 + rows(200, 3, ["b", "x", "y"]) + [("hot", "u", "completed", None, None)] * 500 + [(None, "u", "failed", None, None)] * 2
    new = [r if r[3] else (*r[:3], None, r[4]) for r in new]
    good, bad = (x.collect() for x in jobs.inserted(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)))
    assert sorted(r.id for r in good) == ["hot", "x", "y"]
    for i in ("x", "y"):
        made = [r[3] for r in new if r[0] == i]
        assert next(r for r in good if r.id == i).created_at == min(made, key=lambda t: (t is not None, t))
    assert Counter(tuple(r) for r in good) + Counter(tuple(r) for r in bad) == Counter(new)
    assert sum(r.id == "hot" for r in bad) == 499 and sum(r.id is None for r in bad) == 2


def test_empty_batches(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("a", "u", "failed", None, None)], SCHEMA)
    now = F.current_timestamp()
    assert jobs.upserted(none, none, now).count() == 0 and jobs.upserted(one, none, now).count() == 1 and jobs.upserted(none, one, now).count() == 1
    assert [x.count() for x in jobs.inserted(one, none)] == [0, 0] and [x.count() for x in jobs.inserted(one, one)] == [0, 1]
