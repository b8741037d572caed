import json
import random

import pytest


from scriptloom.operators import jobs
from scriptloom.sources import files
from scriptloom.streaming import intake


def test_files(spark, tmp_path):
    (tmp_path / "my_first talk.txt").write_text("Hello\nworld")
    (tmp_path / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "x.pdf").write_bytes(b"%PDF" + b"0" * 100)
    rows = {r.title: r.text for r in files.transcripts(spark, f"{tmp_path}/my*.txt").collect()}
    assert rows == {"My First Talk": "Hello\nworld"}
    stored = files.objects(spark, str(tmp_path))
    texts, rejected = files.decoded(stored)
    assert {r.text for r in texts.collect()} == {"Hello\nworld", "café"} and rejected.first().reason == "Unsupported file type: .pdf"
    assert {r.content_type for r in files.listing(stored, "x").collect()} == {"application/pdf"}
    assert files.within_size(stored, 50 / 1024 / 1024).count() == 2


def test_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = [json.dumps({"job_id": f"j{i}", "user_id": "u", "transcript_url": "x", "config": "{}"}) for i in (1, 2, 1)]
    (tmp_path / "in/a.json").write_text("\n".join([*good, "not json", '{"user_id": "u"}']))
    raw = intake.messages(spark, f"{tmp_path}/in")
    seen = []
    intake.consume(raw, f"{tmp_path}/c", lambda df, n: seen.extend(r.job_id for r in df.collect()), f"{tmp_path}/dead").awaitTermination()
    assert sorted(seen) == ["j1", "j2"]
    assert sorted(r.reason for r in spark.read.parquet(f"{tmp_path}/dead").collect()) == ["invalid JSON", "missing job_id"]


def test_unique(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"job_id": j, "user_id": "u"}) for j in ("a", "b", "a")))
    stream = intake.unique(intake.routed(intake.messages(spark, f"{tmp_path}/in"))[0]).writeStream.format("memory").queryName("unique_jobs").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    stream.awaitTermination()
    assert sorted(r.job_id for r in spark.table("unique_jobs").collect()) == ["a", "b"]


SCHEMA = "id string, updated_at int, stage string, step int"
NAMES = ["id", "updated_at", "stage", "step"]


def rows_of(df):
    return sorted(map(tuple, df.select(*NAMES).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_state_is_that_of_the_log(spark, tmp_path, seed):
    """Events in any order and any batches leave what one aggregate over the log leaves; a batch writes the jobs that it touches."""
    rng = random.Random(seed)
    log = [(f"j{rng.randrange(40)}", at, rng.choice([None, "a", "b", "complete"]), rng.choice([None, at])) for at in range(400)]
    log += [("hot", 1000 + at, None, at) for at in range(200)]
    rng.shuffle(log)
    batches, at = [], 0
    while at < len(log):
        n = rng.choice([1, 40, 200])
        batches.append(log[at : at + n])
        at += n
    for i, own in enumerate(batches):
        spark.createDataFrame(own + [(None, 1, "a", 1), ("j1", None, "x", 1)], SCHEMA).coalesce(1).write.json(f"{tmp_path}/log/f{i:02}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/log/*")
    intake.track_state(stream, f"{tmp_path}/c", f"{tmp_path}/t").awaitTermination()
    want = rows_of(jobs.state(spark.createDataFrame(log, SCHEMA)))
    changes = spark.read.parquet(f"{tmp_path}/t")
    assert rows_of(intake.current_state(changes)) == want
    assert rows_of(intake.stored_state(spark, f"{tmp_path}/c")) == want
    assert rows_of(intake.current_state(intake.compacted(spark, f"{tmp_path}/t", f"{tmp_path}/small"))) == want
    written = {r.batch: r["count"] for r in changes.groupBy("batch").count().collect()}
    assert sorted(written.values()) == sorted(len({r[0] for r in own}) for own in batches)


def test_finished_jobs_leave_the_store_and_may_come_back(spark, tmp_path):
    log = [[("a", 1, "complete", 7), ("b", 1, "run", 1)], [("b", 2, "run", 2)], [("b", 3, None, 3)], [("a", 4, "again", None)]]
    held = []
    for i, own in enumerate(log):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.json(f"{tmp_path}/log/f{i}")
        stream = spark.readStream.schema(SCHEMA).json(f"{tmp_path}/log/*")
        intake.track_state(stream, f"{tmp_path}/c", f"{tmp_path}/t", keep_ms=1).awaitTermination()
        held.append({r.id for r in intake.stored_state(spark, f"{tmp_path}/c").collect()})
    assert held[0] >= {"b"} and held[2] == {"b"} and held[3] == {"a", "b"}
    assert rows_of(intake.current_state(spark.read.parquet(f"{tmp_path}/t"))) == [("a", 4, "again", 7), ("b", 3, "run", 3)]


def test_jobs_are_forgotten_after_a_while(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for name, ids in (("a", "xx"), ("b", "y"), ("c", "z"), ("d", "x")):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps({"job_id": j, "user_id": "u"}) for j in ids))
        intake.consume(intake.messages(spark, f"{tmp_path}/in"), f"{tmp_path}/c", lambda df, n: seen.extend(r.job_id for r in df.collect()), f"{tmp_path}/dead", keep_ms=1).awaitTermination()
    assert seen == ["x", "y", "z", "x"]
