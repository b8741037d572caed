"""Grouping sentences, paragraphs and words into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T

SPACE = re.compile(r"[ \t\n\r\f\x0b]+")


def _grouped(rows: DataFrame, part_col: str, size: Column, joint: str) -> DataFrame:
    """rows: transcript_id, pos, part_col, n (parts of the transcript)."""
    chunk = F.floor(F.col("pos") / size).cast("int")
    made = rows.groupBy("transcript_id", chunk.alias("chunk_index")).agg(F.sort_array(F.collect_list(F.struct("pos", part_col))).alias("parts"))
    return made.select("transcript_id", "chunk_index", F.array_join(F.transform("parts", lambda x: x[part_col]), joint).alias("text"))


def _parts(docs: DataFrame, cut: Column) -> DataFrame:
    """(transcript_id, n, pos, part) for an array of parts per text. The array comes out of a generator of its own: a projection
    would be worked out again for each part, as nothing keeps it below the one that explodes it."""
    whole = docs.select("transcript_id", F.explode(F.array(cut)).alias("parts"))
    return whole.select("transcript_id", F.size("parts").alias("n"), "parts").select("transcript_id", "n", F.posexplode("parts").alias("pos", "part"))


def sentence_parts(docs: DataFrame) -> DataFrame:
    return _parts(docs, T.sentences(F.col("text")))


def paragraph_parts(docs: DataFrame) -> DataFrame:
    return _parts(docs, F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != ""))


def by_sentences(docs: DataFrame, target: int = 8, least: int = 2, most: int = 20) -> DataFrame:
    """(transcript_id, chunk_index, text): equal counts of sentences, as many chunks as the target about."""
    n = F.col("n")
    size = F.when(n <= target, 1).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(n / target))))
    return _grouped(sentence_parts(docs), "part", size, " ")


def by_paragraphs(docs: DataFrame, target: int = 8) -> DataFrame:
    n = F.col("n")
    return _grouped(paragraph_parts(docs), "part", F.when(n <= target, 1).otherwise(F.ceil(n / target)), "\n\n")


def smart(docs: DataFrame, target: int = 8) -> DataFrame:
    """Paragraph chunks where their number is within one of the target, else sentence chunks."""
    p = by_paragraphs(docs, target).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("transcript_id"))).filter(F.abs(F.col("_n") - target) <= 1).drop("_n")
    return p.unionByName(by_sentences(docs, target).join(p.select("transcript_id").distinct(), "transcript_id", "left_anti"))


def statistics(chunks: DataFrame) -> DataFrame:
    text = F.col("text")
    preview = F.when(F.length(text) > 100, F.concat(F.left(text, F.lit(100)), F.lit("..."))).otherwise(text)
    return chunks.select("transcript_id", "chunk_index", F.length(text).alias("chars"), T.word_count(text).alias("words"), F.size(T.sentences(text)).alias("sentences"), preview.alias("preview"))


def windows_of(text: str, size: int) -> Iterator[str]:
    """Windows of one text. Where they end is looked up in the running sum of word lengths, so each takes the time of its own words."""
    words = [w for w in SPACE.split(text) if w]
    ends = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]) if words else np.zeros(1, np.int64)
    start, first = 0, 0  # of the window, and of its words that no window has yet
    while first < len(words):
        end = max(first + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
        yield " ".join(words[start:end])
        start, first = end - max(1, (end - start) // 5), end


def word_windows(rows: DataFrame, key: str, text_col: str = "text", size: int = 500) -> DataFrame:
    """(key, window_index, window): words are added until the size in characters (each word and one) is full; the next window
    begins with the last fifth of the words, one at least. A null or blank text has none. Texts come and windows go in Arrow batches, a text of any length in
    time that grows with it alone."""
    source = rows.select(F.col(key), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = K.StructType([source.schema[0], K.StructField("window_index", K.IntegerType(), False), K.StructField("window", K.StringType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, made, held = [], [], [], 0
            for i, text in enumerate(batch.column(1)):
                for n, window in enumerate(windows_of(text.as_py(), size)):
                    at.append(i)
                    index.append(n)
                    made.append(window)
                    held += len(window)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(index, pa.int32()), pa.array(made, pa.string())], names=schema.names)
                        at, index, made, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(made, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def step_count(wanted: Column, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), wanted))
