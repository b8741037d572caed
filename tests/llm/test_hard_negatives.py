import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm.common import NO_ID, cut
from scriptloom.llm.hard_negatives import Windows, between, chosen, hilbert, mine_hard_negatives, products, written_blocks
from scriptloom.llm.vector_codes import LIMIT

NAN, INF = float("nan"), float("inf")


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    good = [(i, v, label) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    length = min({len(v) for _, v, _ in good}, key=lambda n: (-sum(len(v) == n for _, v, _ in good), n))
    kept = [(NO_ID if i is None else i, [max(-LIMIT, min(LIMIT, math.floor(float(np.float32(x)) * scale))) for x in v], label) for i, v, label in good if len(v) == length]
    shown = lambda i: None if i == NO_ID else i
    found = []
    for n, (i, a, label) in enumerate(kept):
        if not is_anchor(shown(i)):
            continue
        ranked = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), j, other) for m, (j, v, other) in enumerate(kept) if m != n)
        for score, j, _ in [r for r in ranked if r[2] == label][:positives]:
            window = [r for r in ranked if r[2] != label and low * -score <= 100 * -r[0] <= high * -score][:negatives]
            found += [(i, shown(j), rank, shown(k), -score, -s) for rank, (s, k, _) in enumerate(window, 1)]
    return sorted(found, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "b", 2) for i, v, label in rows], "vec_id bigint, embedding array<float>, label int, row int, block string, score int")


def table(n=400, d=6, clusters=12):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(clusters, d))
    x = centers[rng.integers(clusters, size=n)] + 0.2 * rng.normal(size=(n, d))
    x[::3] = x[0]  # a third of all rows are one vector
    label = rng.integers(4, size=n)
    label[::3] = np.where(np.arange(n)[::3] % 2, 0, 1)
    return [(i, v, int(y)) for i, (v, y) in enumerate(zip(x.astype(np.float32).tolist(), label, strict=True))]


ODD = [(1000, None, 1), (1010, [NAN] * 6, 1), (1020, [INF] + [0.0] * 5, 1), (1030, [None] + [0.0] * 5, 1), (1040, [1.0] * 6, None), (1050, [1.0] * 4, 1), (1060, [], 2), (None, [0.5] * 6, 1), (None, [0.25] * 6, 2), (20, [0.5, 0.1, 0.0, -0.5, 0.2, 0.3], 3), (20, [0.5, 0.1, 0.0, -0.5, 0.2, 0.3], 3), (1070, [0.0] * 6, 1)]


@pytest.mark.parametrize("lane_anchors", [16384, 5])
def test_equals_brute_force(spark, lane_anchors):
    rows = table() + ODD
    df = frame(spark, rows)
    found = mine_hard_negatives(df, F.col("vec_id") % 10 == 0, block_rows=16, most_shelf_rows=64, lane_anchors=lane_anchors)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda i: i is not None and i % 10 == 0)
    assert len(want) > 500 and sorted(map(tuple, found.collect()), key=str) == want


def test_large_components_and_few_rows(spark):
    rows = [(0, [1e30, 3.0], 1), (10, [2e4, 1.0], 1), (3, [9e3, -2.0], 2), (4, [-1e30, 1.0], 2), (5, [4e3, 7.0], 3)]
    df = frame(spark, rows)
    anchor = F.col("vec_id") % 10 == 0
    assert sorted(map(tuple, mine_hard_negatives(df, anchor).collect()), key=str) == brute(rows, lambda i: i % 10 == 0)
    assert mine_hard_negatives(df.limit(0), anchor).count() == 0
    assert mine_hard_negatives(df, F.col("vec_id") == 77).count() == 0
    assert mine_hard_negatives(df.filter("vec_id = 0"), anchor).count() == 0
    assert mine_hard_negatives(df.withColumn("label", F.lit(1)), anchor).count() == 0


def test_bounds_hold_and_zone_maps_spare_blocks(spark):
    """Clustered vectors: most blocks can't hold a positive, and the blocks chosen hold all that brute force finds."""
    rows = table(2000, 6, 40)
    base = cut(frame(spark, rows).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), (F.col("vec_id") % 20 == 1).alias("anchor"), F.transform("embedding", lambda x: F.floor(x * 256).cast("int")).alias("_v")))
    blocks = written_blocks(base, 5, 32, 256, 2000)
    kept = blocks.collect()
    assert sum(len(b.ids) for b in kept) == 2000 and len(kept) < 90
    rng = np.random.default_rng(0)
    for b in kept[:20]:
        x, a = np.array(b.vectors).reshape(len(b.ids), 6), rng.integers(-300, 300, (5, 6))
        least, most = between(a, np.array([b.low]), np.array([b.high]))
        s = products(a, x)
        assert (least[:, 0] <= s.min(1)).all() and (s.max(1) <= most[:, 0]).all()
    near = blocks.select(F.explode("anchors").alias("a")).select("a.*", F.lit(0).alias("lane")).withColumn("floors", F.when(F.size("scores") >= 5, F.array(F.array_min("scores"))).otherwise(F.array().cast("array<bigint>")))
    asked = chosen(near, blocks.select("block", "shelf", "low", "high", "kinds"), 1, len(kept), None, 5).select("row", F.explode("blocks").alias("block")).collect()
    n_anchors = near.count()
    assert n_anchors == 100 and len(asked) < 0.6 * n_anchors * len(kept)
    need = {(r.row, r.block) for r in asked}
    v = {r.row: np.array(r.v) for r in near.collect()}
    info = {r.row: r for r in near.collect()}
    for row, a in list(v.items())[:20]:
        scored = sorted((-int(s), i, b.block) for b in kept for s, i, label, r in zip(products(a[None], np.array(b.vectors).reshape(len(b.ids), 6))[0], b.ids, b.labels, b.rows, strict=True) if label == info[row].label and r != row)[:5]
        assert all(b == info[row].block or (row, b) in need for _, _, b in scored)


def test_windows():
    for score in (-7, 0, 1, 99, 1000, 2**60):
        first, last = Windows(30, 90).of(score)
        assert 30 * score <= 100 * first and 100 * (first - 1) < 30 * score and 100 * last <= 90 * score < 100 * (last + 1)


def test_hilbert_visits_neighbours():
    for d, bits in ((2, 4), (3, 3), (1, 5)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * d)).reshape(d, -1).T
        place = hilbert(grid, bits)
        assert sorted(place.tolist()) == list(range(1 << d * bits))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()
