"""Removal of near-duplicate sentences; the other cleaning rules are columns in functions.text."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..plans.keep import kept
from .postings import ratio_from


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching characters of two texts, twice, over their lengths (Ratcliff and Obershelp)."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def alike(a: Column, b: Column, least: float) -> Column:
    """The similarity of two texts where it is `least` or more, else 0. Bounds come first: the lengths, then the characters and grams in common."""

    @F.pandas_udf(DoubleType())
    def bounded(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio_from(x or "", y or "", least) for x, y in zip(a, b, strict=True)], dtype=float)

    return F.when(longest(a, b) >= least, bounded(a, b)).otherwise(0.0)


def longest(a: Column, b: Column) -> Column:
    """What the similarity of two texts of such lengths can be at most; 1 for two empty ones."""
    n, m = F.length(a), F.length(b)
    return F.when(n + m == 0, 1.0).otherwise(2 * F.least(n, m) / (n + m))


def merged_duplicates(docs: DataFrame, key: str = "transcript_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """(key, text): sentences (between `. `) too similar to an earlier kept one are dropped. Exact repeats go first; only pairs
    that share a rare gram are compared, and the choice is made in rounds over the similar pairs."""
    part = F.posexplode(F.transform(F.split(text_col, r"\. "), lambda x: F.btrim(x, F.lit(" \t\r\n"))))
    rows = docs.select(key, part.alias("pos", "sentence")).filter("sentence != ''").withColumn("low", F.lower("sentence"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, "low").orderBy("pos"))).filter("n = 1").drop("n")
    if threshold >= 1:  # equal texts only
        joined = first.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), ". ").alias("text"))
        return docs.select(key).join(joined, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
    first = kept(first.drop("low")).withColumn("low", F.lower("sentence"))  # what comes before, patterns over whole texts, is worked out once
    gone = first_kept(near_pairs(first, key, threshold), key)
    left = first.join(gone, [key, "pos"], "left_anti")
    joined = left.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), ". ").alias("text"))
    return docs.select(key).join(joined, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


class Grams:
    """Pairs of neighbouring characters, or single ones, of a text with a number for each repeat, as whole numbers; and how many of them two texts must share.

    Two texts of n and m characters with a similarity of t have M >= t (n + m) / 2 characters in common, in order. Each of the other n + m - 2 M
    characters breaks two pairs of its own text at most, or one of the other's, so that 3 M - (n + m) - 1 pairs are in both. Where that is
    below one, single characters (M of them) are counted instead. Of k grams of which c must be shared, two texts share e of their first
    k - c + e in any common order; here the rarest come first.
    """

    def __init__(self, threshold: float, buckets: int = 1 << 16, met: int = 6) -> None:
        self.t, self.buckets, self.met = threshold, buckets, met
        slope = 1.5 * threshold - 1
        #: from this length on pairs are counted
        self.least = 2 / (slope * 2 / (2 - threshold)) if slope > 0 else math.inf

    def of(self, text: str, q: int) -> list[int]:
        seen: dict[str, int] = {}
        made = []
        for i in range(len(text) - q + 1):
            gram = text[i : i + q]
            seen[gram] = n = seen.get(gram, 0) + 1
            made.append(ord(gram[0]) << 42 | (ord(gram[1]) << 21 if q == 2 else 0) | min(n, (1 << 21) - 1))
        return made

    def bucket(self, gram: int) -> int:
        return (gram * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40 & self.buckets - 1

    def shared(self, n: float, m: float, q: int) -> int:
        common = self.t * (n + m) / 2
        return math.ceil((common if q == 1 else 3 * common - (n + m) - 1) - 1e-9)

    def kinds(self, n: int) -> list[int]:
        """Which grams a text of this length gives: pairs for those it can meet by pairs, single characters for shorter ones."""
        return [q for q, given in ((2, n >= self.least), (1, n * self.t / (2 - self.t) < self.least)) if given]

    def prefix(self, text: str, rarity: np.ndarray) -> dict[int, list[int]]:
        n, made = len(text), {}
        for q in self.kinds(n):
            own = sorted(self.of(text, q), key=lambda g: (rarity[self.bucket(g)], g))
            least = self.least_shared(n, q)
            made[q] = own[: len(own) - least + min(self.met, least)]
        return made

    def least_shared(self, n: int, q: int) -> int:
        """With the shortest text that this one can meet by these grams."""
        return self.shared(n, max(n * self.t / (2 - self.t), self.least if q == 2 else 0), q)


def gram_counts(rows: DataFrame, grams: Grams) -> np.ndarray:
    """In how many places grams of each bucket occur; as many numbers as there are buckets reach the driver."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(grams.buckets, np.int64)
        for batch in batches:
            found = [grams.bucket(g) for x in batch.column(0).to_pylist() for q in grams.kinds(len(x)) for g in grams.of(x, q)]
            total += np.bincount(np.array(found, np.int64), minlength=grams.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    made = np.zeros(grams.buckets, np.int64)
    for bucket, n in rows.select("low").mapInArrow(partial, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        made[bucket] = n
    return made


def tokens_of(n: Column, grams: Grams) -> Column:
    """About how many grams a text of n characters sends to the join: those that two similar texts may differ in."""
    return F.ceil(n * (3 - 3 * grams.t)) + grams.met


def candidate_pairs(first: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, i, j), j before i: the pairs whose lengths allow the threshold and, in keys of many short texts, that share enough of their rarest
    grams. Where pairing the rows of a key gives fewer rows than their grams would be, the pairs are made without grams."""
    grams = Grams(threshold)
    cost = first.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.sum(tokens_of(F.length("low"), grams)).alias("tokens"))
    few = kept(cost.filter("c * c / 2 <= tokens").select(key))
    fits = 2 * F.least("n_i", "n_j") >= threshold * (F.col("n_i") + F.col("n_j")) - 1e-9
    short = first.join(few, key, "left_semi").select(key, "pos", F.length("low").alias("n"))
    direct = short.withColumnsRenamed({"pos": "i", "n": "n_i"}).join(short.withColumnsRenamed({"pos": "j", "n": "n_j"}), key).filter((F.col("j") < F.col("i")) & fits).select(key, "i", "j")
    rest = first.join(few, key, "left_anti")
    if rest.isEmpty():
        return direct
    rarity = gram_counts(rest, grams)

    @F.pandas_udf("array<struct<gram:bigint,q:int,least:int>>")
    def rarest(texts: pd.Series) -> pd.Series:
        made = []
        for x in texts:
            own = grams.prefix(x, rarity)
            made.append([{"gram": g, "q": q, "least": min(grams.met, grams.least_shared(len(x), q))} for q, some in own.items() for g in some])
        return pd.Series(made, dtype=object)

    tokens = rest.select(key, "pos", F.length("low").alias("n"), F.inline(rarest("low")))
    later, sooner = tokens.withColumnsRenamed({"pos": "i", "n": "n_i", "least": "l_i"}), tokens.withColumnsRenamed({"pos": "j", "n": "n_j", "least": "l_j"})
    met = later.join(sooner, [key, "gram", "q"]).filter((F.col("j") < F.col("i")) & fits).groupBy(key, "i", "j", "q").agg(F.count(F.lit(1)).alias("met"), F.first(F.least("l_i", "l_j")).alias("least"))
    return direct.unionByName(met.filter("met >= least").select(key, "i", "j").distinct())


def named_texts(first: DataFrame, key: str) -> DataFrame:
    """(key, pos, digest, low): rows with the digest that stands for their text."""
    return first.select(key, "pos", F.unhex(F.sha2("low", 256)).alias("digest"), "low")


def counted(texts: list[str], q: int, buckets: int) -> np.ndarray:
    """How many runs of q characters of each text fall into each bucket."""
    made = np.zeros((len(texts), buckets), np.int32)
    for i, x in enumerate(texts):
        codes = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for _ in range(q - 1):
            codes = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
        made[i] = np.bincount(((codes * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    return made


def alike_texts(named: DataFrame, key: str, threshold: float, rows: int = 2048, chars: int = 8 << 20) -> DataFrame:
    """(x_digest, y_digest), the later one first: the pairs of texts of a key whose lengths, characters and pairs of characters allow the threshold. The
    texts of a key lie in blocks in the order of their lengths, of so many rows and characters at most; two blocks that can hold such a pair meet
    inside a task, and what can't be similar is never a row."""
    in_order = Window.partitionBy(key).orderBy("n", "pos")
    own = named.withColumn("n", F.length("low"))
    own = own.withColumn("_block", F.floor((F.row_number().over(in_order) - 1) / rows + F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)) / chars))
    own = own.withColumn("_block", F.coalesce("_block", F.lit(0).cast("long")))
    spans = own.groupBy(key, "_block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    fits = (F.col("_a") <= F.col("_b")) & (F.col("lo") * threshold <= F.col("hi") * (2 - threshold) + 1e-6)
    met = spans.select(key, F.col("_block").alias("_a"), "hi").join(spans.select(key, F.col("_block").alias("_b"), "lo"), key).filter(fits).select(key, "_a", "_b")
    sides = met.select(key, "_a", "_b", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_block"))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("pos", "ascending")])
        texts, n, pos, block = table.column("low").to_pylist(), *(table.column(c).to_numpy() for c in ("n", "pos", "_block"))
        a, b = table.column("_a")[0].as_py(), table.column("_b")[0].as_py()
        letters, pairs = counted(texts, 1, 64), counted(texts, 2, 512)
        right = np.flatnonzero(block == b)
        found = []
        for i in np.flatnonzero(block == a):
            # texts that are longer, or as long and behind this one, up to the length that the threshold allows
            js = right[np.searchsorted(right, i, "right") : np.searchsorted(n[right], n[i] * (2 - threshold) / threshold + 1e-6, "right")]
            both = n[i] + n[js]
            able = (2 * n[i] >= threshold * both - 1e-9) & (np.minimum(letters[js], letters[i]).sum(axis=1) >= threshold / 2 * both - 1e-9)
            js, both = js[able], both[able]
            js = js[np.minimum(pairs[js], pairs[i]).sum(axis=1) >= (1.5 * threshold - 1) * both - 1 - 1e-9]
            found += [(j, i) if pos[j] > pos[i] else (i, j) for j in js.tolist()]
        of = table.column("digest")
        return pa.table({f"{c}_digest": of.take(pa.array([x[k] for x in found], pa.int64())) for k, c in enumerate("xy")})

    return own.join(sides, [key, "_block"]).groupBy(key, "_a", "_b").applyInArrow(meet, "x_digest binary, y_digest binary")


def at_places(pairs: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """(key, i, j, x_digest, y_digest), j before i: where a key holds both texts of a pair in their order."""
    later, sooner = (named.select(key, F.col("pos").alias(p), F.col("digest").alias(d)) for p, d in (("i", "x_digest"), ("j", "y_digest")))
    return pairs.select("x_digest", "y_digest").join(later, "x_digest").join(sooner, [key, "y_digest"]).filter("j < i").select(key, "i", "j", "x_digest", "y_digest")


def text_pairs(named: DataFrame, key: str, threshold: float, most: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(pairs, met): (x_digest, y_digest, x, y), each pair of different texts once however many keys hold it, whose similarity has to be worked
    out; and (key, i, j, x_digest, y_digest), the places that stand behind them. Up to `most` texts of a key meet in blocks, those of larger
    keys by their rarest grams."""
    texts = kept(named.groupBy("digest").agg(F.first("low").alias("low")))
    large = kept(named.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most).select(key))
    if large.isEmpty():
        rows = alike_texts(named, key, threshold)
    else:
        rest, at = named.join(large, key, "left_semi"), named.select(key, "pos", "digest")
        by_grams = candidate_pairs(rest, key, threshold).join(at.withColumnsRenamed({"pos": "i", "digest": "x_digest"}), [key, "i"]).join(at.withColumnsRenamed({"pos": "j", "digest": "y_digest"}), [key, "j"])
        rows = alike_texts(named.join(large, key, "left_anti"), key, threshold).unionByName(by_grams.select("x_digest", "y_digest"))
    left = kept(rows.distinct())
    # rows with much work each: dealt out by number, as their size would put them in a task or two; up to 32 MB of texts go to the pairs
    parts = max(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64, left.count() // 100_000)
    small = (texts.agg(F.sum(F.length("low"))).first()[0] or 0) <= 32 << 20
    low = lambda d, c: (F.broadcast if small else lambda x: x)(texts.select(F.col("digest").alias(d), F.col("low").alias(c)))
    pairs = (left.repartition(parts) if small else left).join(low("x_digest", "x"), "x_digest").join(low("y_digest", "y"), "y_digest")
    return pairs if small else pairs.repartition(parts), at_places(left, named, key)


def compared_pairs(first: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, i, j, x, y): candidates that also share enough grams in all: those whose similarity has to be known."""
    pairs, met = text_pairs(named_texts(first, key), key, threshold)
    return met.join(pairs, ["x_digest", "y_digest"]).select(key, "i", "j", "x", "y")


def near_pairs(first: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, i, j), j before i: the pairs of the threshold's similarity or more. Two texts are compared once, whatever number of keys has both."""
    named = named_texts(first, key)
    pairs, _ = text_pairs(named, key, threshold)

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            near = pa.array([ratio_from(a, b, threshold) >= threshold for a, b in zip(x, y, strict=True)], pa.bool_())
            yield batch.select(["x_digest", "y_digest"]).filter(near)

    # no filter: that would be worked out before pairs are dealt out
    near = kept(pairs.select("x_digest", "y_digest", "x", "y").mapInArrow(compared, "x_digest binary, y_digest binary"))
    return at_places(near, named, key).select(key, "i", "j")


def first_kept(pairs: DataFrame, key: str) -> DataFrame:
    """(key, pos): sentences to drop, so that of similar ones the first stays; a sentence that was dropped drops none. In
    rounds: those with no earlier one left stay, what is like them goes, and so do the pairs of what went."""
    left, gone = kept(pairs), []
    while not left.isEmpty():
        later = left.select(key, F.col("i").alias("j")).distinct()
        out = kept(left.join(later, [key, "j"], "left_anti").select(key, F.col("i").alias("pos")).distinct())
        gone.append(out)
        left = left.join(out.withColumnRenamed("pos", "i"), [key, "i"], "left_anti").join(out.withColumnRenamed("pos", "j"), [key, "j"], "left_anti")
        left = kept(left)
    made = pairs.select(key, F.col("i").alias("pos")).limit(0)
    for out in gone:
        made = made.unionByName(out)
    return made


def normalized(docs: DataFrame, key: str = "transcript_id", text_col: str = "text", remove_duplicates: bool = True, custom_fillers: tuple[str, ...] = ()) -> DataFrame:
    """(key, text): the whole cleaning chain in its fixed order."""
    c = T.without_templates(T.without_fillers(T.without_tags(T.without_speakers(T.without_stamps(T.without_webvtt(F.col(text_col))))), custom_fillers))
    made = docs.select(key, c.alias("text"))
    if remove_duplicates:
        made = merged_duplicates(made, key)
    return made.select(key, T.tidy_space(T.repaired_punctuation(F.col("text"))).alias("text"))
