"""Mixing sources to target weights by subset-sum budget fitting.

The only thing gathered per source is how many documents there are of each exact length. From that the number to
take of each length is fitted: whole passes first, then the same share of every length, then a seeded fill, and
for the rest of the budget a bounded-knapsack program over the remaining documents. Which documents of a length are
taken follows a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, text_of


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, table: int = 4096) -> np.ndarray:
    """How many documents of each length (distinct, positive) to take, each once at most, for a sum near the budget, never above."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (budget / total)).astype(np.int64)
    rest = budget - int((lengths * take).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    for i in order:  # a seeded fill down to what the table covers
        if rest <= table:
            break
        n = min(counts[i] - take[i], (rest - table // 2) // lengths[i])
        if n > 0:
            take[i] += n
            rest -= int(n * lengths[i])
    if rest > table:
        # every length with documents left is above rest - table // 2, so of those that fit one alone fits: the longest
        fits = np.flatnonzero((take < counts) & (lengths <= rest))
        if len(fits):
            take[fits[np.argmax(lengths[fits])]] += 1
        return take
    if rest <= 0:
        return take
    # which sums up to the rest can be reached: bit s of `reach`; lengths in binary multiples, as each has a bounded count
    bound = rest
    reach, full, steps = 1, (1 << (bound + 1)) - 1, []
    for i in np.argsort(lengths):
        left, size = min(int(counts[i] - take[i]), bound // int(lengths[i])), 1
        while left > 0:
            n = min(size, left)
            more = (reach | (reach << (n * int(lengths[i])))) & full
            if more != reach:
                steps.append((int(i), n, reach))
                reach = more
            left -= n
            size *= 2
        if reach >> bound & 1:
            break
    goal = reach.bit_length() - 1
    for i, n, was in reversed(steps):
        if not was >> goal & 1:
            take[i] += n
            goal -= n * int(lengths[i])
    return take


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) for (source, source_size): weights repeat over the sources by code point, null last; a target
    stops at cap times its source's size and the excess goes to the others by weight, which is a common level of
    target per weight for all sources that don't stop. One row per source is ordered here, never documents."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int")))
    w = w.withColumns({"most": cap * F.col("source_size"), "stop": cap * F.col("source_size") / F.col("weight")})
    upto = Window.orderBy("stop", "source").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    w = w.withColumns({"_most": F.sum("most").over(upto), "_w": F.sum("weight").over(everything) - F.sum("weight").over(upto), "_budget": share * F.sum("source_size").over(everything)})
    w = w.withColumn("stops", F.col("_most") + F.col("stop") * F.col("_w") <= F.col("_budget"))
    level = (F.col("_budget") - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0.0)).over(everything)) / F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything)
    return w.withColumn("_level", level).select("source", "source_size", F.when(F.col("stops") | (F.col("source_size") == 0), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("_level"))).alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, bucket_rows: int = 1024, broadcast_rows: int = 300_000
) -> DataFrame:
    """One row per input row: its columns, then _m with the fields size (words), source_size, target and copies: how
    often the mix takes the document. Words taken of a source are as near below its target as the fit finds, which is the
    target rounded wherever the lengths allow it; a document is taken cap times at most (cap a whole number).

    Null text: no words, taken as often as the whole passes of its source. A null source is a source, the last. Of rows that
    repeat an id and its text as many are taken as the plan has room for, whichever; null ids are allowed. A column _m is replaced, other columns may have any name. An empty
    table gives no rows. Reruns give the same mix. A task holds the distinct lengths of one source, or about bucket_rows documents
    of one length. The rows meet the plan, one entry per source and length, by a broadcast if it has no more than broadcast_rows
    entries (some 30 MB), else by a shuffle of the rows.
    """
    docs = docs.drop("_m")
    text = text_of(text_col)
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"{SPACE}+"))).cast("long").alias("size"),
        F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.md5(text)).alias("draw"),
    )
    lengths = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(int(cap), int(target // whole)) if whole else 0
        budget = round(target) - passes * whole if passes < int(cap) else 0
        pdf["passes"], pdf["extra"] = passes, 0
        some = (pdf["size"] > 0).to_numpy()
        if budget > 0 and some.any():
            pdf.loc[some, "extra"] = fit(pdf["size"].to_numpy(np.int64)[some], pdf["n"].to_numpy(np.int64)[some], budget, seed)
        return pdf[["source", "size", "n", "source_size", "target", "passes", "extra"]]

    joined = lengths.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = cut(joined.groupBy("source").applyInPandas(fitted, "source string, size bigint, n bigint, source_size bigint, target double, passes bigint, extra bigint"))
    small = plan.count() <= broadcast_rows

    def told(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    # documents of one length fall into buckets by their draw; whole buckets are in or out, in one the draws are counted in order
    key = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "source_size", "target", "passes", "extra")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    bucket = F.pmod("draw", F.ceil(F.col("n") / bucket_rows))
    some = rows.select("source", "size", "draw").join(told(key.filter("extra > 0 AND extra < n").select("_s", "_z", "n", "extra")), same).drop("_s", "_z").withColumn("bucket", bucket)
    counts = some.groupBy("source", "size", "extra", "bucket").agg(F.count(F.lit(1)).alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("before", before).filter("before < extra AND before + here >= extra").select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("bucket").alias("_b"), "before")
    # rows that repeat an id and its text share a draw: of those at the limit only as many are in as are left
    draws = some.join(edge, same & (F.col("bucket") == F.col("_b"))).groupBy("_s", "_z", "extra", "before", "bucket", "draw").agg(F.count(F.lit(1)).alias("tied"))
    less = F.col("before") + F.coalesce(F.sum("tied").over(Window.partitionBy("_s", "_z").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = draws.withColumn("left", F.col("extra") - less).filter("left > 0 AND left <= tied")
    last = cut(at.select("_s", "_z", F.col("bucket").alias("last_bucket"), F.col("draw").alias("last_draw"), "left", (F.col("tied") > F.col("left")).alias("ties")))
    limits = key.join(last.withColumnsRenamed({"_s": "_s2", "_z": "_z2"}), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_z") == F.col("_z2")), "left").drop("_s2", "_z2")
    drawn = rows.join(told(limits), same)
    before_last = (bucket < F.col("last_bucket")) | ((bucket == F.col("last_bucket")) & (F.col("draw") < F.col("last_draw")))
    at_last = F.coalesce(F.col("ties") & (F.col("extra") < F.col("n")) & (bucket == F.col("last_bucket")) & (F.col("draw") == F.col("last_draw")), F.lit(False))
    within = F.when(F.col("extra") == F.col("n"), F.col("extra") > 0).otherwise(F.coalesce(before_last | (F.col("draw") == F.col("last_draw")), F.lit(False)))
    shown = lambda df: df.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.struct("size", "source_size", "target", (F.col("passes") + F.col("more")).alias("copies")).alias("_m"))
    both = drawn.withColumn("more", within.cast("long"))
    if last.filter("ties").isEmpty():
        return shown(both)
    return shown(both.filter(~at_last)).unionByName(shown(numbered(cut(drawn.filter(at_last))).withColumn("more", (F.col("number") <= F.col("left")).cast("long"))))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds the number of each row among those of its source and size, from 1. `rows` is a table that was cut, so its partitions stay as they are: rows
    are numbered in their partition, and partitions follow each other, so no task gathers a frequent row."""
    own = ["_s", "_z"]
    rows = rows.withColumn("part", F.spark_partition_id())
    counts = rows.groupBy(*own, "part").agg(F.count(F.lit(1)).alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_s").alias("_s4"), F.col("_z").alias("_z4"), F.col("part").alias("_part"), before.alias("before"))
    placed = rows.withColumn("own", F.row_number().over(Window.partitionBy(*own, "part").orderBy("draw")))
    met = placed.join(starts, F.col("_s").eqNullSafe(F.col("_s4")) & (F.col("_z") == F.col("_z4")) & (F.col("part") == F.col("_part")))
    return met.withColumn("number", F.col("before") + F.col("own"))
