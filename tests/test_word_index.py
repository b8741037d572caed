"""Word windows in linear time, and excerpts by rare words against joining every word."""

import random
import time

from pyspark.sql import functions as F

from scriptloom import queries
from scriptloom.functions import text as T
from scriptloom.operators import chunking, knowledge
from scriptloom.plans.keep import kept


def windows(text, size):
    """Word by word."""
    done, own, n = [], [], 0
    for w in text.split():
        if n + len(w) + 1 > size and own:
            done.append(own)
            own = own[-max(1, len(own) // 5) :]
            n = sum(len(x) + 1 for x in own)
        own = [*own, w]
        n += len(w) + 1
    return [" ".join(x) for x in ([*done, own] if own else done)]


def test_windows_equal_a_loop(spark):
    rng = random.Random(1)
    texts = ["", None, "  ", "one", "x" * 900, " ".join("w" * rng.randrange(1, 40) for _ in range(700)), "a\tb\nc  d " * 90, " ".join(["y" * 600] * 5 + ["z"] * 40), "é漢 " * 300]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc long, text string, window int")
    for size in (500, 30):
        found = {}
        for r in chunking.word_windows(df, "doc", size=size).collect():
            found.setdefault(r.doc, []).append((r.window_index, r.window))
        assert found == {i: list(enumerate(w)) for i, t in enumerate(texts) if (w := windows(t or "", size))}
    assert chunking.word_windows(df.limit(0), "doc").count() == 0


def test_a_long_text_takes_linear_time():
    took = []
    for n in (200_000, 2_000_000):
        text = "abcd " * n  # 1 MB and 10 MB
        start = time.time()
        assert sum(1 for _ in chunking.windows_of(text, 500)) > n / 100
        took.append(time.time() - start)
    assert took[1] < 25 * max(took[0], 0.05)


def every_word(sources, asked, size=500, per_source=3, top=5, least=0.1):
    have = chunking.word_windows(sources, "url", "content", size)
    have = have.select("url", "window_index", F.explode(F.array_distinct(T.words(F.lower("window")))).alias("word"))
    own = asked.select("query_id", F.array_distinct(T.words(F.lower("text"))).alias("w"))
    rows = own.select("query_id", F.size("w").alias("n"), F.explode("w").alias("word")).join(have, "word")
    hits = rows.groupBy("query_id", "n", "url", "window_index").agg(F.count(F.lit(1)).alias("k")).withColumn("score", F.col("k") / F.col("n"))
    return rows, knowledge.best_excerpts(hits, per_source, top, least)


def shown(df):
    return sorted((r.query_id, r["rank"], r.url, r.window_index, round(r.score, 9)) for r in df.collect())


def test_rare_words_find_what_all_words_find(spark):
    rng = random.Random(3)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n))
    sources = spark.createDataFrame([(f"u{i}", text(rng.randrange(0, 400))) for i in range(30)] + [("same1", "c1 c2 c3 r1"), ("same2", "c1 c2 c3 r1"), ("none", None)], "url string, content string")
    asked = spark.createDataFrame([(i, text(n)) for i, n in enumerate((1, 2, 5, 9, 10, 11, 30, 60))] + [(90, "C1 c2 R1"), (91, "unknown words"), (92, ""), (93, None), (94, "c1")], "query_id long, text string")
    for least in (0.1, 0.0, 0.5, 0.9):
        for top in (5, 1, 50):
            assert shown(knowledge.excerpts(sources, asked, 120, 3, top, least)) == shown(every_word(sources, asked, 120, 3, top, least)[1])
        if least != 0.1:
            break
    assert shown(knowledge.excerpts(sources, asked, 120, least=0.5)) == shown(every_word(sources, asked, 120, least=0.5)[1])


def test_frequent_words_join_nothing(spark):
    """Rows that meet over words, of those when every word joins, on whole documents."""
    d = "/root/testdata/sf0.01"
    sources = queries.prose(spark, d).select(F.col("transcript_id").alias("url"), F.col("text").alias("content"))
    asked = queries.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    have = kept(chunking.word_windows(sources, "url", "content").select("url", "window_index", F.explode(F.array_distinct(T.words(F.lower("window")))).alias("word")))
    words = knowledge.split_words(asked, have.groupBy("word").agg(F.count(F.lit(1)).alias("windows")), 0.1)
    met, every = words.filter("rare").join(have, "word").count(), every_word(sources, asked)[0].count()
    print(met, every)
    assert met < 0.75 * every


def test_parts_and_blocks_find_the_same(spark):
    """No pair of a query and a window is a row unless it is among the best few of its part."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(n))
    sources = spark.createDataFrame([(f"u{i}", text(200)) for i in range(40)], "url string, content string")
    asked = spark.createDataFrame([(i, text(12)) for i in range(9)], "query_id long, text string")
    windows = chunking.word_windows(sources, "url", "content", 120)
    found = kept(knowledge.found_windows(windows, asked, 4, 2, 3, 0.1, block=2))
    assert 0 < found.count() <= 4 * 3 * 9
    assert shown(knowledge.best_excerpts(found, 2, 3, 0.1, "_said")) == shown(every_word(sources, asked, 120, 2, 3)[1])


def test_sources_of_one_url_stay_apart(spark):
    sources = spark.createDataFrame([("u", "a b c d"), ("u", "e f g h"), ("v", None), (None, "a b e f")], "url string, content string")
    rows = knowledge.excerpts(sources, spark.createDataFrame([(1, "a b e f")], "query_id long, text string")).collect()
    assert sorted((r.url, r.window_index, r.window, r.score) for r in rows) == [("u", 0, "a b c d", 0.5), ("u", 0, "e f g h", 0.5)] and sorted(r["rank"] for r in rows) == [1, 2]
