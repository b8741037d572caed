"""Files as tables: transcripts, uploads, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Content types by extension.
CONTENT_TYPES = {
    ".txt": "text/plain",
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".json": "application/json",
    ".xml": "application/xml",
    ".html": "text/html",
}


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(transcript_id, title, text): whole files; the title is the file's stem in title case."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    stem = F.regexp_replace(F.element_at(F.split(F.url_decode("path"), "/"), -1), r"\.[^.]*$", "")
    return rows.select(F.col("path").alias("transcript_id"), F.initcap(F.replace(stem, F.lit("_"), F.lit(" "))).alias("title"), F.col("value").alias("text"))


def objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def listing(files: DataFrame, prefix: str = "") -> DataFrame:
    """(name, size, modified, content_type) of stored objects; the content isn't read."""
    name = F.element_at(F.split("path", "/"), -1)
    kinds = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return files.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.coalesce(kinds[extension], F.lit("application/octet-stream")).alias("content_type")).filter(F.startswith("name", F.lit(prefix)))


def within_size(files: DataFrame, megabytes: float = 5) -> DataFrame:
    return files.filter(F.col("length") <= megabytes * 1024 * 1024)


def decoded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, rejected): .txt files as UTF-8 where they are, else as Latin-1; files of other kinds are rejected with a reason."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    utf = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(utf), utf).otherwise(F.decode("content", "ISO-8859-1"))
    return files.filter(extension == ".txt").select("path", text.alias("text")), files.filter(extension != ".txt").select("path", F.concat(F.lit("Unsupported file type: "), extension).alias("reason"))


