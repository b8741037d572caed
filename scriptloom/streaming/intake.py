"""Streams of job messages and status events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..plans.keep import kept

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGES = "value string, job_id string, user_id string, transcript_url string, config string, arrived timestamp, reason string"
ROUTED = [x.split()[0] for x in MESSAGES.split(", ")]
MESSAGE = "job_id string, user_id string, transcript_url string, config string"


def messages(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(value, arrived): one JSON message per line of the files that land in the folder."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path).select("value", F.current_timestamp().alias("arrived"))


def routed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, dead): parsed messages, and those that aren't JSON or lack an id, with the reason."""
    parsed = parsed_messages(raw)
    return parsed.filter("reason IS NULL").select("job_id", "user_id", "transcript_url", "config", "arrived"), parsed.filter("reason IS NOT NULL").select("value", "reason", "arrived")


def parsed_messages(raw: DataFrame) -> DataFrame:
    """(value, job_id, user_id, transcript_url, config, arrived, reason): reason is null for good messages."""
    parsed = raw.withColumn("m", F.from_json("value", f"{MESSAGE}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("m").isNull() | F.col("m._corrupt").isNotNull()
    reason = F.when(bad, "invalid JSON").when(F.col("m.job_id").isNull(), "missing job_id")
    return parsed.withColumn("reason", reason).select("value", "m.job_id", "m.user_id", "m.transcript_url", "m.config", "arrived", "reason")


def unique(good: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each job once, for repeats within the delay."""
    return good.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["job_id"])


def with_store(spark: SparkSession) -> None:
    """State of arbitrary shape needs this store; a stream that goes on from a checkpoint must find the same one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def clocked(rows: DataFrame, arrived: str, keep_ms: int | None) -> tuple[DataFrame, str]:
    """Rows with a watermark on the time they arrived, which is never late, and the time mode; without keep_ms no clock is needed. Timers run
    on this clock: when a later batch has arrived, those that are due expire."""
    return (rows, "None") if keep_ms is None else (rows.withWatermark(arrived, "0 seconds"), "EventTime")


class Once(StatefulProcessor):
    """Lets the first message of a job through; dead letters always. A job is remembered for keep_ms after its message, for ever if None."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N803
        first = None
        for row in rows:
            if row["reason"] is not None:
                yield Row(**{c: row[c] for c in ROUTED})
            elif first is None or row["value"] < first["value"]:
                first = row
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            if self.keep_ms is not None:
                self.handle.registerTimer(max(int(first["arrived"].timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
            yield Row(**{c: first[c] for c in ROUTED})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def consume(raw: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], dead_path: str, keep_ms: int | None = None) -> StreamingQuery:
    """Runs `handle` on each batch of good messages, each job once over all batches and restarts, and appends the others to the
    dead-letter table; goes through what has landed, then ends. Which jobs have been let through is in the state store, so a batch reads and writes
    its own jobs only; with keep_ms a job is forgotten so long after its message. A batch that fails is repeated as it was: `handle` gets
    its jobs again, and its dead letters are overwritten. Of messages of one job in a batch the least by text counts."""
    with_store(raw.sparkSession)
    both, mode = clocked(parsed_messages(raw), "arrived", keep_ms)
    # dead letters ask nothing of the state, so they pass beside it
    good, dead = both.filter("reason IS NULL"), both.filter("reason IS NOT NULL").select(*ROUTED)
    fresh = good.withColumn("key", F.col("job_id")).groupBy("key").transformWithState(Once(keep_ms), MESSAGES, "Append", mode).unionByName(dead)

    def step(batch: DataFrame, number: int) -> None:
        batch = kept(batch)
        dead = batch.filter("reason IS NOT NULL").select("value", "reason", "arrived")
        dead.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(dead_path)
        handle(batch.filter("reason IS NULL").select("job_id", "user_id", "transcript_url", "config", "arrived"), number)

    return fresh.writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LastKnown(StatefulProcessor):
    """Keeps of each column of a job the last value that isn't null and what it is ordered by, and gives what is known after each batch. A
    job whose stage is one of `ends` is forgotten keep_ms after its last event."""

    def __init__(self, key: str, columns: list[str], order: list[str], schema: str, stage: str, ends: tuple[str, ...], keep_ms: int | None) -> None:
        self.columns, self.order, self.schema, self.stage, self.ends, self.keep_ms = columns, order, schema, stage, ends, keep_ms
        self.names = [key, *(x for c in columns for x in (c, *[f"{c}_{o}" for o in order]))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N803
        width = 1 + len(self.order)
        held = list(self.job.get()) if self.job.exists() else [None] * (width * len(self.columns))
        known = {c: (tuple(held[i * width + 1 : (i + 1) * width]), held[i * width]) for i, c in enumerate(self.columns)}
        arrived = 0
        for row in rows:
            at = tuple(row[o] for o in self.order)
            arrived = max(arrived, int(row["_arrived"].timestamp() * 1000))
            for c in self.columns:
                if row[c] is not None and (known[c][1] is None or at > known[c][0]):
                    known[c] = (at, row[c])
        flat = [x for c in self.columns for x in (known[c][1], *(known[c][0] if known[c][1] is not None else [None] * len(self.order)))]
        self.job.update(tuple(flat))
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if self.stage in known and known[self.stage][1] in self.ends:
                self.handle.registerTimer(max(arrived, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
        yield Row(**dict(zip(self.names, [*key, *flat], strict=True)))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        self.job.clear()
        return iter([])

    def close(self) -> None:
        pass


def track_state(events: DataFrame, checkpoint: str, changes: str, key: str = "id", order: tuple[str, ...] = ("updated_at",), stage: str = "stage", ends: tuple[str, ...] = ("complete", "error"), keep_ms: int | None = None) -> StreamingQuery:
    """Running job states: the state of each job is a value in the state store, and each batch writes the jobs that it changed to the folder
    `changes`, so what a batch writes follows the batch, not the table. Events may come in any order, over batches too: a
    value gives way to later ones only. Events without a key or an order are left out. `current_state` reads the table, `stored_state` the store.
    With keep_ms, jobs at an end leave the store that long after their last event; their rows stay in the table."""
    with_store(events.sparkSession)
    columns, kinds = [c for c in events.columns if c != key], dict(events.dtypes)
    flat = ", ".join(f"`{c}` {kinds[c]}, " + ", ".join(f"`{c}_{o}` {kinds[o]}" for o in order) for c in columns)
    good = events.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (key, *order)))
    timed, mode = clocked(good.withColumn("_arrived", F.current_timestamp()), "_arrived", keep_ms)
    told = timed.groupBy(key).transformWithState(LastKnown(key, columns, list(order), flat, stage, ends, keep_ms), f"`{key}` {kinds[key]}, {flat}", "Update", mode)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    return told.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_state(changes: DataFrame, key: str = "id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The table that a folder of changes stands for: of each column the value with the last order. Jobs that were forgotten and came
    back are whole again."""
    columns = [c for c in changes.columns if f"{c}_{order[0]}" in changes.columns and c != key]
    return changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*[f"{c}_{o}" for o in order]))).alias(c) for c in columns])


def compacted(spark: SparkSession, changes: str, to: str, key: str = "id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Writes one row per job, with its orders, to the folder `to`, from which the next changes may be read along."""
    rows = spark.read.parquet(changes).drop("batch")
    columns = [c for c in rows.columns if f"{c}_{order[0]}" in rows.columns and c != key]
    both = rows.groupBy(key).agg(*[F.max_by(F.struct(c, *[f"{c}_{o}" for o in order]), F.when(F.col(c).isNotNull(), F.struct(*[f"{c}_{o}" for o in order]))).alias(c) for c in columns])
    both.select(key, *[F.col(c).getField(x).alias(x) for c in columns for x in (c, *[f"{c}_{o}" for o in order])]).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def stored_state(spark: SparkSession, checkpoint: str, key: str = "id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The jobs in the state store of a checkpoint, as a batch."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "job").load()
    names = rows.select("value.*").columns
    return rows.select(F.col("key").getField(key).alias(key), *[F.col("value").getField(c).alias(c) for c in names if f"{c}_{order[0]}" in names])
