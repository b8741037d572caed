"""The bucketed job store: results of the plain operators, one bucket per read, no shuffle of the table."""

import datetime as dt
import random
import re
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scriptloom.operators import jobs
from scriptloom.plans.keep import kept
from scriptloom.sources import job_store
from scriptloom.sources.job_store import JobStore

SCHEMA = "id string, user_id string, status string, config string, result string, created_at timestamp, updated_at timestamp"


def day(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)


def rows(n, seed, most=200):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        k = rng.randrange(most)
        made.append((f"j{k}", "hot" if k % 3 == 0 else f"u{k % 40}", rng.choice(["failed", "completed", "processing"]), '{"min_steps": 2}', "{bad", day(i) if rng.random() < 0.7 else None, day(rng.randrange(10**5))))
    return made


def frame(spark, made):
    return spark.createDataFrame(made, SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shown(df):
    return sorted(map(tuple, df.select("id", "user_id", "status", "created_at", "updated_at").collect()), key=str)


@pytest.fixture()
def place(tmp_path):
    return f"jobs_{uuid.uuid4().hex}", f"file://{tmp_path}/store"


def test_batches_equal_plain_upserts(spark, place):
    old = list({r[0]: r for r in rows(300, 1)}.values())
    store, table, now = JobStore.create(frame(spark, old), *place, buckets=8), frame(spark, old), F.lit(day(10**6))
    assert shown(store.jobs()) == shown(table)
    for seed in (2, 3, 4):
        new = frame(spark, rows(150, seed, 260))
        store.upsert(new, now)
        table = spark.createDataFrame(jobs.upserted(table, new, now).select(*table.columns).collect(), SCHEMA)
        assert shown(store.jobs()) == shown(table)
    written = spark.read.parquet(f"{place[1]}/data").groupBy("_generation").count().collect()
    assert len(written) == 4 and sum(r["count"] for r in written) < 4 * 150 + len(old)

    assert shown(JobStore.opened(spark.newSession(), *place).jobs()) == shown(table)
    assert shown(store.recent("hot", 20)) == shown(jobs.recent(table, "hot", 20).join(table.select("id"), "id"))
    store.compact()
    assert len(store.generations()[1]) == 1 and shown(store.jobs()) == shown(table)


def test_reads_take_their_buckets_and_nothing_is_shuffled(spark, place, monkeypatch):
    old = list({r[0]: r for r in rows(400, 5)}.values())
    store = JobStore.create(frame(spark, old), *place, buckets=16, spread=4)
    store.upsert(frame(spark, rows(50, 6)), F.lit(day(10**6)))
    one = store.read("j3", "hot")
    told = plan(one)
    assert re.search(r"SelectedBucketsCount: 1 out of 16", told) and "Exchange" not in told and "PartitionFilters: [_generation" in told
    assert one.first().config["min_steps"] == 2 and (one.first().result is None or one.first().result["metrics"] is None)
    assert re.search(r"SelectedBucketsCount: [1-4] out of 16", plan(store.recent("hot")))
    whole = store.jobs()
    assert "Exchange" not in plan(whole) and "SelectedBucketsCount: 16 out of 16" in plan(whole)
    # a busy user has several buckets
    assert spark.table(place[0]).filter("user_id = 'hot'").select("_owner").distinct().count() == 4
    # an insert finds the ids that are there by a shuffle of the batch only: all exchanges lie above the batch, none above the table
    seen = []
    kept(frame(spark, []))
    monkeypatch.setattr(job_store, "kept", lambda df: seen.append(plan(df)) or df.checkpoint())
    asked = store.known(frame(spark, rows(20, 7)))
    batch_side, _, table_side = seen[0].partition("Exchange hashpartitioning")[2].partition("SortAggregate")
    assert "SortMergeJoin" in seen[0] and "FileScan" in table_side and "Exchange" not in table_side and "SelectedBucketsCount: 16 out of 16" in table_side
    assert {r.id for r in asked.collect()} == {r[0] for r in rows(20, 7)} & {r.id for r in whole.collect()}


def test_inserts_deletes_and_coming_back(spark, place):
    old = [(f"j{i}", "u", "completed", None, None, day(i), day(i)) for i in range(5)]
    store = JobStore.create(frame(spark, old), *place, buckets=4)
    new = [("j1", "u", "failed", None, None, day(50), None), ("x", "u", "failed", None, None, day(60), None), ("x", "u", "queued", None, None, day(61), None)] + [("y", "v", "queued", None, None, None, None)] * 200
    good, bad = store.insert(frame(spark, new))
    assert sorted(r.id for r in good.collect()) == ["x", "y"] and bad.count() == 2 + 199
    assert {r.id for r in store.jobs().collect()} == {"x", "y", *(f"j{i}" for i in range(5))}
    store.delete(spark.createDataFrame([("j2", "u"), ("x", "u"), ("none", "u")], "id string, user_id string"))
    assert {r.id for r in store.jobs().collect()} == {"y", "j0", "j1", "j3", "j4"}
    store.upsert(frame(spark, [("j2", "u", "queued", None, None, day(70), None), ("j3", "u", "queued", None, None, day(70), None)]), F.lit(day(90)))
    made = {r.id: r for r in store.jobs().collect()}
    assert made["j2"].created_at == day(70) and made["j3"].created_at == day(3) and made["j3"].updated_at == day(90)
    assert [x.count() for x in store.insert(frame(spark, [("x", "u", "queued", None, None, None, None)]))] == [1, 0]
    store.compact()
    assert len(shown(store.jobs())) == 7


def test_a_write_without_its_manifest_counts_nowhere(spark, place, monkeypatch):
    store = JobStore.create(frame(spark, rows(10, 8)), *place, buckets=4)
    before, same = shown(store.jobs()), store.generations()
    monkeypatch.setattr(JobStore, "generations", lambda self: (-1, same[1]))  # another writer has written since
    with pytest.raises(AnalysisException):
        store.upsert(frame(spark, rows(10, 9)), F.lit(day(1)))
    monkeypatch.undo()
    spark.catalog.refreshTable(place[0])
    assert store.generations() == same and shown(store.jobs()) == before
    assert JobStore.create(frame(spark, []), f"{place[0]}_none", f"{place[1]}_none").jobs().count() == 0
