"""Most similar vectors by lists against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.operators import vectors

NAN, INF = float("nan"), float("inf")


def brute(x, queries, k):
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(1))[:, None]
    made = {}
    for q in queries:
        s = np.clip(y @ y[q], 0, 1)
        s[q] = -1
        made[q] = np.lexsort((np.arange(len(y)), -np.round(s, 9)))[:k].tolist()
    return made


def found_of(df):
    made = {}
    for r in df.orderBy("query_id", "rank").collect():
        made.setdefault(r.query_id, []).append(r.id)
    return made


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, embedding array<float>")


@pytest.mark.parametrize("n", [1000, 4000])
@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_recall_at_two_sizes(spark, n, kind):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24))
    if kind == "clustered":
        x = rng.normal(size=(40, 24))[rng.integers(40, size=n)] + 0.2 * x
        x[::3] = x[0]  # a third of all rows are one vector
    x = x.astype(np.float32)
    queries = range(1, n, n // 50)
    df = frame(spark, x)
    got = found_of(vectors.most_similar(df, F.col("id") % (n // 50) == 1, chunk_rows=200, lane_queries=16))
    want = brute(x, queries, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in queries]) >= 0.95
    if n == 1000:
        assert found_of(vectors.most_similar(df, F.col("id") % (n // 50) == 1, probe_all=True, chunk_rows=100, lane_queries=7)) == want


def test_clusters_need_few_lists(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 24))[rng.integers(30, size=2000)] + 0.1 * rng.normal(size=(2000, 24))
    good = vectors.usable(frame(spark, x.astype(np.float32)), "id", "embedding")
    middle = vectors.centres(good, 45)
    placed = vectors.assigned(good, middle, 1, "near").select("id", "v", F.get("near", F.lit(0)).alias("list"))
    assert vectors.lists_to_visit(good.filter("id % 20 = 0"), placed, middle, 10, 0.98) < 12


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [NAN, 1.0]), (6, [0.0, 0.0]), (7, [INF, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [None, 1.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    got = found_of(vectors.most_similar(df, F.col("id") >= 1, k=2, probe_all=True))
    assert got == {1: [2, 3], 2: [1, 3], 3: [1, 2], 10: [1, 2]}
    assert vectors.most_similar(df.limit(0), F.lit(True)).count() == 0
    assert vectors.most_similar(df.filter("id = 1"), F.lit(True)).count() == 0
    assert vectors.most_similar(df, F.col("id") == 4).count() == 0
