import hashlib
import math

import numpy as np

from scriptloom.llm.vector_codes import LIMIT, Parts, compress_vectors, label_errors, nearest

NAN, INF = float("nan"), float("inf")


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Codes and errors by row, and the codebooks, with whole numbers of Python only."""
    usable = [(i, v) for i, v in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    length = min({len(v) for _, v in usable}, key=lambda n: (-sum(len(v) == n for _, v in usable), n))
    kept = [(i, [max(-LIMIT, min(LIMIT, math.floor(float(np.float32(x)) * scale))) for x in v]) for i, v in usable if len(v) == length]
    w = length // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v in kept]
    first = sorted(kept, key=lambda r: (-math.inf if r[0] is None else r[0], r[1]))[:entries]
    books = [[v[p * w : (p + 1) * w] for _, v in first] for p in range(parts)]

    def assigned(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in cut:
                own.setdefault(assigned(x[p], books[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])]
    found = [[assigned(x[p], books[p]) for p in range(parts)] for x in cut]
    return sorted((str(i), [e for _, e in f], sum(d for d, _ in f)) for (i, _), f in zip(kept, found, strict=True)), books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None if (i or 0) % 5 == 0 else (i or 0) % 3, 9, "c") for i, v in rows], "vec_id bigint, embedding array<float>, label int, _row int, codes string")


def table():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(240, 8)), 2).astype(np.float32)
    x[::3] = x[0]  # a third of all rows are one vector
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    odd = [(900, None), (901, []), (902, [NAN] * 8), (903, [INF] + [0.0] * 7), (904, [None] + [0.0] * 7), (905, [1.0] * 4), (906, [1.0] * 5), (None, [0.25] * 8), (None, [-0.25] * 8), (7, x[7].tolist()), (7, [0.5] * 8), (-4, [0.1] * 8), (907, [1e30, -1e30] + [0.0] * 6)]
    return rows + odd


def test_equals_brute_force(spark):
    rows = table()
    found = compress_vectors(frame(spark, rows), carry=("label",), entries=16)
    want, books = brute(rows, entries=16)
    assert sorted((str(r.vec_id), r.codes, r.error) for r in found.codes.collect()) == want
    assert found.codebooks.tolist() == books
    assert found.digest() == hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    assert len(found.moved) == 3 and 0 < found.moved[0] < 4 * len(want) / 2 and found.moved[-1] < found.moved[0]


def test_resident_parts_stay_without_a_shuffle(spark):
    """The union of those that stay and those that come keeps the partitions, and all parts are with their owner."""
    layout = Parts(2, 16, 5)
    p = np.zeros(400, layout.kind)
    p["row"], p["position"] = np.arange(400), np.arange(400) % 4
    rdd = spark.sparkContext.parallelize(list(layout.dealt(p)), 3).partitionBy(5, hash)
    both = rdd.mapPartitions(lambda it: it, True).union(spark.sparkContext.parallelize(list(layout.dealt(p)), 2).partitionBy(5, hash))
    assert both.getNumPartitions() == 5
    assert all(owner == at for at, part in enumerate(both.glom().collect()) for owner, _ in part)
    hot = np.zeros(1000, layout.kind)
    hot["row"] = np.arange(1000)
    assert len(set(Parts(2, 16, 40).owner(hot).tolist())) == 10


def test_few_and_no_rows(spark):
    rows = [(5, [0.0, 0.5, 1.0, 2.0]), (3, [0.0, 0.5, 1.0, 2.0])]
    found = compress_vectors(frame(spark, rows))
    assert sorted((r.vec_id, r.codes, r.error) for r in found.codes.collect()) == [(3, [0] * 4, 0), (5, [0] * 4, 0)]
    for none in (frame(spark, rows).limit(0), frame(spark, [(1, None), (2, [1.0, 2.0, 3.0])])):
        empty = compress_vectors(none, carry=("label",))
        assert empty.codes.columns == ["vec_id", "label", "codes", "error"] and empty.codes.count() == 0 and empty.digest() == hashlib.sha256(b"").hexdigest()
        assert label_errors(empty.codes).count() == 0


def test_both_ways_of_comparing_agree():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-9, 9, (500, 3)), rng.integers(-9, 9, (20, 3))
    entry, distance = nearest(x, book)
    wide, far = nearest(x * (1 << 22), book * (1 << 22))
    assert (entry == wide).all() and (distance * (1 << 44) == far).all()


def test_label_errors(spark):
    rows = [(i, "a" if i % 3 == 0 else None if i % 3 == 1 else f"x{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, label string, error bigint")
    totals = {}
    for _, label, error in rows:
        totals[label] = totals.get(label, 0) + error
    assert sorted((r.vec_id, r.label_error) for r in label_errors(df).collect()) == [(i, totals[label]) for i, label, _ in rows]
