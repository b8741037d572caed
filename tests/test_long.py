"""Long transcripts by blocks give what windows over whole transcripts give."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from scriptloom import queries
from scriptloom.config import Segmentation
from scriptloom.operators import long, parsing, segmentation

SAID = ["Click the Create button. Then select the region.", "What does it show? Is it the same?", "Now let's look at the ERROR page.", "That was helpful.", "ok", "Next, we open the settings. Save the form now.", "The form keeps the name, the value and the form."]


def lines(seed, n=160):
    rng, rows = random.Random(seed), []
    for t, size in (("long", n), ("short", 7), ("plain", 60), ("one", 1)):
        clock = 0
        for i in range(size):
            clock += rng.choice([0, 5, 20, 100])
            stamp = f"[{clock // 3600:02}:{clock // 60 % 60:02}:{clock % 60:02}] " if t != "plain" and rng.random() < 0.9 else ""
            who = rng.choice(["Speaker 1: ", "Speaker 2: ", "Anna: ", ""]) if t != "plain" else ""
            rows.append((t, i * (3 if t == "long" else 1), stamp + who + (rng.choice(SAID) if t != "plain" else "That was helpful today.")))
    return rows


def shown(df):
    names = sorted(df.columns)
    return sorted((tuple(str(r[c]) for c in names) for r in df.collect())), names


@pytest.mark.parametrize("seed,block_lines", [(1, 4), (3, 1)])
def test_blocks_change_nothing(spark, seed, block_lines):
    df = spark.createDataFrame(lines(seed), "transcript_id string, line_no long, line string").repartition(3)
    whole = parsing.parsed(df)
    blocks = long.parsed(df, block_lines=block_lines)
    assert shown(blocks.drop("_block")) == shown(whole)
    # without boundaries a transcript is one segment, which is then split over blocks; with many, segments are merged over the edges
    for config in (Segmentation(threshold=1.0, transition_threshold=1.0), Segmentation(min_sentences=5, min_segments=9)):
        rows = segmentation.segmented(whole, config)
        assert shown(long.segmented(blocks, config)) == shown(rows)
    assert segmentation.segmented(whole, Segmentation(threshold=1.0, transition_threshold=1.0)).filter("fallback_split").count() > 10


def test_no_lines(spark):
    none = spark.createDataFrame([], "transcript_id string, line_no long, line string")
    assert long.segmented(long.parsed(none)).count() == 0


def test_no_task_gathers_a_long_transcript(spark):
    """A third of all lines is one transcript: the rows that meet in a task stay within twice the median."""
    rows = long.parsed(queries.uneven_lines(spark, "/root/testdata/sf0.01"), block_lines=64)
    counts = [r["count"] for r in rows.repartition(8, *long.BLOCK).groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == 8 and max(counts) <= 2 * median(counts)
    assert rows.groupBy("transcript_id").count().agg(F.max("count")).first()[0] > 0.3 * rows.count()


def test_parts_grow_with_the_rows(spark, monkeypatch):
    """What a task sorts depends on its part alone: with ten times the rows there are more parts, not larger ones."""
    monkeypatch.setattr(parsing, "ROWS_PER_PART", 100)
    blocks = long.parsed(spark.createDataFrame(lines(2, n=1600), "transcript_id string, line_no long, line string"), block_lines=8)
    for rows in (blocks, long.segmented(blocks)):
        counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) > 2000 and len(counts) > 10 and max(counts) <= 500


def test_hours_are_dealt_by_their_number_of_lines(spark, monkeypatch):
    whole = {tuple(r) for r in queries.lines(spark, "/root/testdata/sf0.01").collect()}
    monkeypatch.setattr(parsing, "ROWS_PER_PART", 500)
    rows = queries.lines(spark, "/root/testdata/sf0.01")
    assert {tuple(r) for r in rows.collect()} == whole and len(whole) == 10_000
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) > 15 and max(counts) <= 1500
