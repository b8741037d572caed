"""Jobs as a bucketed table of generations, with a manifest.

Rows are bucketed by owner: the user and, so that a busy user isn't one bucket, a salt from the job's id. Each write adds a generation that
holds the rows of its batch only; the manifest lists the generations that count, oldest first. A read takes one bucket where the user is known,
and puts the generations together by job inside the buckets, so neither a read nor a compaction shuffles the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators.jobs import CONFIG, RESULT
from ..plans.keep import kept

OWN = ["_owner", "_gone", "_generation"]


class JobStore:
    """`name`: of the catalog table; `path`: of its folder, which all executors share. Use `create` or `opened`. A job's user doesn't change,
    and one writer writes at a time: a second one that started from the same manifest fails."""

    def __init__(self, spark: SparkSession, name: str, path: str, columns: list[str], buckets: int, spread: int) -> None:
        self.spark, self.name, self.path, self.columns, self.buckets, self.spread = spark, name, path, columns, buckets, spread

    @classmethod
    def create(cls, jobs: DataFrame, name: str, path: str, buckets: int = 16, spread: int = 4) -> JobStore:
        """A new store with these jobs (id, user_id, created_at, updated_at and any others); of rows that repeat an id the last by updated_at."""
        store = cls(jobs.sparkSession, name, path, jobs.columns, buckets, spread)
        store._add(J.last_written(jobs), [], 0)
        return store

    @classmethod
    def opened(cls, spark: SparkSession, name: str, path: str) -> JobStore:
        """A store that another session wrote, as a table of this one."""
        about = spark.read.parquet(f"{path}/manifest/v={cls._last(spark, path)}").first()
        if not spark.catalog.tableExists(name):
            kinds = spark.read.parquet(f"{path}/data").drop("_generation").schema
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
            spark.sql(f"CREATE TABLE {name} ({fields}, _generation STRING) USING parquet OPTIONS (path '{path}/data') PARTITIONED BY (_generation) CLUSTERED BY (_owner) SORTED BY (_owner, id) INTO {about['buckets']} BUCKETS")
        return cls(spark, name, path, [c for c in spark.table(name).columns if c not in OWN], about["buckets"], about["spread"])

    @staticmethod
    def _last(spark: SparkSession, path: str) -> int:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/v=*/_SUCCESS")
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        return max([int(f.getPath().getParent().getName()[2:]) for f in found or []], default=-1)

    def generations(self) -> tuple[int, list[str]]:
        """The number of the manifest and the generations in it."""
        version = self._last(self.spark, self.path)
        return version, sorted(r["generation"] for r in self.spark.read.parquet(f"{self.path}/manifest/v={version}").collect())

    def _owner(self, user: Column, job: Column) -> Column:
        return F.concat_ws("#", user, F.pmod(F.xxhash64(job), F.lit(self.spread)).cast("string"))

    def _add(self, rows: DataFrame, before: list[str], version: int) -> None:
        """Writes rows as a generation and a manifest that has it after those before. Files of a write that ended before its manifest are in no manifest."""
        mark = f"{version:08d}-{uuid.uuid4().hex}"
        gone = F.col("_gone") if "_gone" in rows.columns else F.lit(False)
        made = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in self.columns], self._owner(F.col("user_id"), F.col("id")).alias("_owner"), gone.alias("_gone"), F.lit(mark).alias("_generation"))
        made.repartition(self.buckets, "_owner").write.format("parquet").mode("append").option("path", f"{self.path}/data").partitionBy("_generation").bucketBy(self.buckets, "_owner").sortBy("_owner", "id").saveAsTable(self.name)
        told = self.spark.createDataFrame([(g, self.buckets, self.spread) for g in (*before, mark)], "generation string, buckets int, spread int")
        told.coalesce(1).write.parquet(f"{self.path}/manifest/v={version}")
        self.spark.catalog.refreshTable(self.name)

    def _rows(self, owners: list[Column] | None = None) -> DataFrame:
        rows = self.spark.table(self.name).filter(F.col("_generation").isin(self.generations()[1]))
        return rows if owners is None else rows.filter(F.col("_owner").isin(*owners))

    def _together(self, rows: DataFrame) -> DataFrame:
        """One row per job: its last one, with the first created_at since it was last deleted."""
        rest = [c for c in self.columns if c not in ("id", "created_at")]
        steps = F.array_sort(F.collect_list(F.struct(F.col("_generation").alias("g"), F.col("_gone").alias("gone"), F.col("created_at").alias("at"))))
        made = rows.groupBy("_owner", "id").agg(F.max_by(F.struct("_gone", *rest), "_generation").alias("r"), steps.alias("s")).filter("NOT r._gone")
        ended = F.coalesce(F.array_max(F.transform(F.filter("s", lambda x: x["gone"]), lambda x: x["g"])), F.lit(""))
        first = F.get(F.filter("s", lambda x: (x["g"] > ended) & x["at"].isNotNull()), F.lit(0))["at"]
        return made.withColumn("created_at", first).select(*[F.col(c) if c in ("id", "created_at") else F.col("r").getField(c).alias(c) for c in self.columns])

    def jobs(self) -> DataFrame:
        return self._together(self._rows())

    def read(self, job_id: str, user_id: str) -> DataFrame:
        """One job, its JSON columns parsed: reads one bucket."""
        found = self._together(self._rows([self._owner(F.lit(user_id), F.lit(job_id))]).filter(F.col("id") == job_id).filter(F.col("user_id") == user_id))
        kinds = {"config": CONFIG, "result": RESULT}
        return found.withColumns({c: F.from_json(F.col(c), k, {"mode": "PERMISSIVE"}) for c, k in kinds.items() if c in self.columns})

    def recent(self, user_id: str, limit: int = 10, status: str | None = None) -> DataFrame:
        """The newest jobs of a user: reads as many buckets as a user is spread over."""
        own = self._rows([F.concat_ws("#", F.lit(user_id), F.lit(str(i))) for i in range(self.spread)]).filter(F.col("user_id") == user_id)
        return J.recent(self._together(own), user_id, limit, status)

    def upsert(self, new: DataFrame, now: Column, order: tuple[str, ...] = ("updated_at",)) -> None:
        """As `jobs.upserted`; old rows aren't read, as a read puts created_at together."""
        version, before = self.generations()
        last = J.last_written(new, order)
        self._add(last.withColumns({"created_at": F.coalesce("created_at", now), "updated_at": now}), before, version + 1)

    def known(self, new: DataFrame) -> DataFrame:
        """(id): the ids of a batch that the store has. The batch is shuffled to the buckets, the table stays where it is; for that a join
        by owner and id may lie by owner alone, which the session must be told. Worked out at once."""
        table = self._rows().groupBy("_owner", "id").agg(F.max_by("_gone", "_generation").alias("gone")).filter("NOT gone")
        keyed = new.select(self._owner(F.col("user_id"), F.col("id")).alias("_owner"), "id").distinct()
        setting = "spark.sql.requireAllClusterKeysForCoPartition"
        was = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")
        try:
            return kept(keyed.join(table.hint("merge"), ["_owner", "id"], "left_semi").select("id"))
        finally:
            self.spark.conf.set(setting, was)

    def insert(self, new: DataFrame, order: tuple[str, ...] = ("created_at",)) -> tuple[DataFrame, DataFrame]:
        """As `jobs.inserted`, of which it returns the result and writes the good rows."""
        version, before = self.generations()
        good, bad = (kept(x) for x in J.inserted(self.known(new), new, order))
        self._add(good, before, version + 1)
        return good, bad

    def delete(self, keys: DataFrame) -> None:
        """Deletes the jobs (id, user_id) by rows that say so."""
        version, before = self.generations()
        self._add(keys.select("id", "user_id").distinct().withColumn("_gone", F.lit(True)), before, version + 1)

    def compact(self) -> None:
        """Writes all jobs as one generation, from bucket to bucket; files of the others may then be removed."""
        version, _ = self.generations()
        self._add(self.jobs(), [], version + 1)
