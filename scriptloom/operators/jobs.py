"""Job tables: reads, upserts, deletes, listings, state from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CONFIG = "min_steps int, target_steps int, max_steps int, use_topic_segmentation boolean, document_title string"
RESULT = "document_url string, filename string, metrics struct<total_steps:int,average_confidence:double,high_confidence_steps:int,token_usage:struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>>"
STAGES = [
    "pending", "load_transcript", "clean_transcript", "fetch_knowledge", "azure_di_analysis", "determine_steps", "generate_steps", "build_sources", "validate_steps", "create_document", "upload_document", "complete", "error",
]


def read_job(jobs: DataFrame, job_id: str, user_id: str) -> DataFrame:
    """The job of this id and user, its JSON columns parsed; bad JSON gives null."""
    made = jobs.filter((F.col("id") == job_id) & (F.col("user_id") == user_id))
    kinds = {"config": CONFIG, "result": RESULT}
    return made.withColumns({c: F.from_json(F.col(c), k, {"mode": "PERMISSIVE"}) for c, k in kinds.items() if c in jobs.columns})


def written_order(new: DataFrame, order: tuple[str, ...]) -> Column:
    """What the rows of a batch are ordered by: the columns named, then all others, so that reruns agree."""
    return F.struct(*[F.col(c) for c in order if c in new.columns], *[F.col(c).cast("string").alias(f"_{c}") for c in new.columns])


def last_written(new: DataFrame, order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """One row per id, the last one of the batch, with the created_at of its first: what writing them one after the other leaves. Rows
    without an id are left out. Combined before it is shuffled, so an id may repeat in any share of the rows."""
    at = written_order(new, order)
    made = new.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "id"]), at).alias("_row"), F.min_by("created_at", at).alias("_first"))
    return made.select(*[F.col("id") if c == "id" else F.col("_first").alias(c) if c == "created_at" else F.col("_row").getField(c).alias(c) for c in new.columns])


def upserted(old: DataFrame, new: DataFrame, now: Column, order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Old rows with the new ones over them by id: updated_at is now, created_at is kept, else given, else now. Of new rows of one id the
    last by `order` wins; each id comes out once if it was once in old."""
    last = last_written(new, order)
    kept = old.select("id", F.col("created_at").alias("_made"))
    rows = last.join(kept, "id", "left").withColumn("created_at", F.coalesce("_made", "created_at", now)).withColumn("updated_at", now).drop("_made")
    return old.join(last.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, order: tuple[str, ...] = ("created_at",)) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows rejected). Of new rows of one id the first by `order` goes in, unless old has the id; all others are rejected,
    each as often as it comes, and so are rows without an id."""
    names = new.columns
    alike = new.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    first = new.filter("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct(*names), written_order(new, order)).alias("_row")).select("_row.*")
    good = first.join(old.select("id"), "id", "left_anti").select(*names)
    own = good.select(*[F.col(c).alias(f"_{c}") for c in names], F.lit(1).alias("_in"))
    # equal in all columns, so rows of one id meet by all they hold, not in one task
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    left = alike.join(own, same, "left").withColumn("_n", F.col("_n") - F.coalesce("_in", F.lit(0))).filter("_n > 0")
    return good, left.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")).drop("_copy")


def deleted(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame) -> dict[str, DataFrame]:
    """Each table (with the name of its job-id column) without the rows of these ids."""
    return {name: df.join(keys.select(F.col("id").alias(c)), c, "left_anti") for name, (df, c) in tables.items()}


def recent(jobs: DataFrame, user_id: str, limit: int = 10, status: str | None = None) -> DataFrame:
    made = jobs.filter(F.col("user_id") == user_id)
    if status:
        made = made.filter(F.col("status") == status)
    names = [c for c in ("id", "user_id", "status", "progress", "stage", "created_at", "updated_at", "error") if c in jobs.columns]
    extra = [F.get_json_object("result", "$.metrics").alias("result_metrics")] if "result" in jobs.columns else []
    return made.select(*names, *extra).orderBy(F.desc("created_at"), "id").limit(min(limit, 50))


def recent_of_all(jobs: DataFrame, n: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id"))
    return jobs.withColumn("rank", rank).filter(F.col("rank") <= n)


def history(jobs: DataFrame, status: str | None = None) -> DataFrame:
    return jobs.filter(F.col("status") == status if status else F.col("status").isin("completed", "failed"))


def active(jobs: DataFrame, now: Column, seconds: int = 5) -> DataFrame:
    """Queued and processing jobs, and those completed within the last seconds."""
    just = (F.col("status") == "completed") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") <= seconds)
    return jobs.filter(F.col("status").isin("queued", "processing") | just)


def status_of(stage: Column) -> Column:
    return F.when(stage == "complete", "completed").when(stage == "error", "failed").otherwise("processing")


def progress_of(stage: Column) -> Column:
    """Stages weigh the same; complete is 1, and an error has none of its own."""
    steps = STAGES[:-1]
    made = F.when(stage == steps[0], 0.0)
    for i, name in enumerate(steps[1:], 1):
        made = made.when(stage == name, i / (len(steps) - 1))
    return made


def state(events: DataFrame, key: str = "id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The state that a log of partial updates leaves: of each column the last value that isn't null. An aggregate, so a busy key
    is combined before it is shuffled."""
    at = F.struct(*order)
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest])


def with_times(jobs: DataFrame, now: Column) -> DataFrame:
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    took = F.unix_timestamp("updated_at") - F.unix_timestamp("created_at")
    return jobs.withColumns({"duration": T.duration_text(took), "age": T.relative_text(age)})


def flat_results(jobs: DataFrame) -> DataFrame:
    """(id, metrics and token counts): nested results as flat columns, 0 where missing."""
    r = F.from_json("result", RESULT)
    m = r["metrics"]
    return jobs.select(
        "id", F.coalesce(m["total_steps"], F.lit(0)).alias("total_steps"), F.coalesce(m["average_confidence"], F.lit(0.0)).alias("average_confidence"), F.coalesce(m["high_confidence_steps"], F.lit(0)).alias("high_confidence_steps"),
        *[F.coalesce(m["token_usage"][c], F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")],
    )
