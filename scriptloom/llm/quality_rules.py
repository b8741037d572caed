"""Quality rules with cross-document line frequency, from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, parts, text_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"


def words_in(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def line_hashes(text: Column) -> Column:
    """The hash of each trimmed line in lower case."""
    return F.transform(F.split(text, "\n"), lambda x: F.xxhash64(F.lower(F.btrim(x, F.lit(SPACES)))))


def line_chars(text: Column) -> Column:
    """Characters of each line that aren't white space."""
    return F.transform(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")))


def repeat_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words in windows of three that occur twice or more in the text: windows are sorted by hash, equal
    neighbours are repeats, and the union of their places is counted in order."""
    n = F.size(words)
    w = F.col(words)
    windows = F.transform(F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    docs = docs.withColumn("_sorted", F.sort_array(windows))
    s, m = F.col("_sorted"), F.size("_sorted")
    found = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < m - 1) & (F.get(s, i + 1)["h"] == x["h"])))
    docs = docs.withColumn("_places", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(
        "_places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"]
    )
    return docs.withColumn(out, covered.cast("long")).drop("_sorted", "_places")


def common_lines(texts: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, common): the hashes of lines in more than min_docs distinct texts of the host and in more than `share` of them, for
    texts (host, digest, hashes). Copies of a text count once, so a copied document doesn't make its own lines
    common. A host has at most 1 / share times as many such lines as its texts have on average."""
    lines = texts.select("host", "digest", F.explode("hashes").alias("h")).distinct()
    per_line = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > min_docs)
    per_host = texts.select(F.col("host").alias("_h"), "digest").distinct().groupBy("_h").agg(F.count(F.lit(1)).alias("host_docs"))
    return per_line.join(per_host, F.col("host").eqNullSafe(F.col("_h"))).filter(F.col("n_docs") > share * F.col("host_docs")).groupBy("host").agg(F.collect_list("h").alias("_common"))


def quality_rules(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 20, share: float = 0.1, max_removed_percent: int = 50, part_rows: int = 20_000
) -> DataFrame:
    """One row per input row: all columns given, then the struct _q with the fields n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_removed_chars, base_failed, kept, kept_text.

    Base rules: under min_words words, or more than max_repeat_percent of the words in repeated windows of three,
    fail. Lines are hashed in lower case without outer white space; those in more than min_docs distinct texts of a host
    and in more than `share` of its texts are removed; a document that loses more than max_removed_percent of its
    characters (white space not counted) is depleted. kept: neither failed nor depleted. kept_text: the text without its
    removed lines. Null text counts as empty, a null host as one host. Equal rows get equal results; an empty table gives
    no rows; a column _q is replaced. A text is one row throughout, so memory follows the longest text.
    """
    names, n_parts = [c for c in docs.columns if c != "_q"], parts(docs.count(), part_rows)
    text, host = text_of(text_col), F.col(host_col).cast("string")
    base = docs.select(*[F.col(f"`{c}`").alias(f"_in_{c}") for c in names], text.alias("_text"), host.alias("_host"), words_in(text).alias("_words"), line_hashes(text).alias("_h"), line_chars(text).alias("_c"))
    base = base.withColumn("_solid", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    base = repeat_words(base, "_words", "n_repeat_words").select(
        *[f"`_in_{c}`" for c in names], "_text", "_host", "_h", "_c", "n_repeat_words", F.pmod(F.xxhash64("_text"), F.lit(n_parts)).alias("_part"),
        # nothing is pushed through a projection that isn't deterministic: a filter on the verdict would else work these out anew
        (F.size("_words") + F.monotonically_increasing_id() * 0).cast("long").alias("n_words"),
        F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x).alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_solid") - F.size(F.array_distinct("_solid"))).cast("long").alias("n_dup_lines"),
    )
    solid_hashes = F.transform(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda x: F.xxhash64(F.lower(F.btrim(x, F.lit(SPACES)))))
    texts = docs.select(host.alias("host"), F.unhex(F.md5(text)).alias("digest"), F.array_distinct(solid_hashes).alias("hashes"))
    common = common_lines(texts, min_docs, share)
    # a host's rows go to as many parts as they fill, each with a copy of the host's common lines
    part = F.pmod(F.xxhash64(text), F.lit(n_parts))
    spread = docs.select(host.alias("host"), part.alias("part")).distinct().join(common.withColumnRenamed("host", "_host2"), F.col("host").eqNullSafe(F.col("_host2"))).drop("_host2")
    joined = base.join(spread, base["_host"].eqNullSafe(spread["host"]) & (base["_part"] == spread["part"]), "left")

    def goes(h: Column, c: Column) -> Column:
        return (c > 0) & F.array_contains("_common", h)

    gone = F.aggregate(F.zip_with("_h", "_c", lambda h, c: F.when(goes(h, c), c).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    made = joined.withColumn("n_removed_chars", F.when(F.col("_common").isNull(), F.lit(0).cast("long")).otherwise(gone))
    left = F.filter(F.split("_text", "\n"), lambda x, i: ~goes(F.get("_h", i), F.get("_c", i)))
    kept_text = F.when(F.col("n_removed_chars") == 0, F.col("_text")).otherwise(F.array_join(left, "\n"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_chars"]
    kept = ~failed & (100 * F.col("n_removed_chars") <= max_removed_percent * F.col("word_chars"))
    return made.select(*[F.col(f"`_in_{c}`").alias(c) for c in names], F.struct(*fields, failed.alias("base_failed"), kept.alias("kept"), kept_text.alias("kept_text")).alias("_q"))
