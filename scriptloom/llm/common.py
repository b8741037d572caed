"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are compared; null ids sort before all others.
NO_ID = -(2**63)
#: The ASCII white space that separates words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir. Only a session without executors of its own (master local)
    may leave that unset; it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a reliable checkpoint in the session's checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def parts(total_bytes: int | None, each: int) -> int:
    """How many parts of about so many bytes the total makes, one at least."""
    return max(1, math.ceil((total_bytes or 0) / each))
