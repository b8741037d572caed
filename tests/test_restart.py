"""Streams that go on in a new session."""

import json

from scriptloom.operators import jobs
from scriptloom.streaming import intake


def test_state_after_a_restart(spark, tmp_path):
    schema = "id string, updated_at int, stage string, step int"
    log = [("1", 1, "a", None), ("2", 2, "x", 1), ("3", 3, "b", None), ("1", 4, None, 7)]
    for i, name in enumerate(("first", "second")):
        own = spark.newSession()
        own.createDataFrame(log[2 * i : 2 * i + 2], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/log")
        intake.track_state(own.readStream.schema(schema).json(f"{tmp_path}/log"), f"{tmp_path}/c", f"{tmp_path}/t").awaitTermination()
    names = ["id", "updated_at", "stage", "step"]
    got = sorted(map(tuple, intake.stored_state(spark, f"{tmp_path}/c").select(*names).collect()))
    assert got == sorted(map(tuple, jobs.state(spark.createDataFrame(log, schema)).select(*names).collect())) and len(got) == 3
    assert got == sorted(map(tuple, intake.current_state(spark.read.parquet(f"{tmp_path}/t")).select(*names).collect()))


def test_jobs_are_handled_once_over_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for name, ids in (("a", "xyx"), ("b", "yz"), ("c", "xzw")):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps({"job_id": j, "user_id": "u"}) for j in ids))
        raw = intake.messages(spark.newSession(), f"{tmp_path}/in")
        intake.consume(raw, f"{tmp_path}/c", lambda df, n: seen.append(sorted(r.job_id for r in df.collect())), f"{tmp_path}/dead").awaitTermination()
    assert seen == [["x", "y"], ["z"], ["w"]]
