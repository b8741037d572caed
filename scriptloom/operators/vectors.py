"""The most similar vectors of a table, by lists around centres (a coarse quantiser) and exact scores.

Centres are fitted to a bounded sample; every row is put into the list of its nearest centre. A query visits the lists of its nearest
centres and is compared exactly with all they hold. How many lists that takes is measured on sample queries, or all of them are visited, which
is exact. A long list is dealt into chunks and its queries into lanes, so a task holds one of each, whatever share of the rows one list draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.keep import kept

FOUND = "query_id bigint, id bigint, score double"


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that have an id and a vector of finite numbers, not all zero and of the most frequent length; v has length one."""
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    good = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), norm.alias("norm")).filter("id IS NOT NULL AND norm > 0 AND norm < double('infinity') AND NOT isnan(norm)")
    good = kept(good.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v")))
    most = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("v") == (most["n"] if most else 0))


def block(batch: pa.RecordBatch | pa.Table, name: str = "v") -> np.ndarray:
    column = batch.column(name)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores at nine digits, ties to the smaller id."""
    score = np.round(score, 9)
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def centres(vectors: DataFrame, lists: int, sample_rows: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Centres of length one, by rounds of means over the sample_rows rows of least hash; lists x dimensions numbers reach the driver in each. Sums
    are taken over whole numbers, so reruns agree."""
    chosen = kept(vectors.orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows))
    first = np.array([r["v"] for r in chosen.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(lists).collect()], np.float64)

    def partial(made: np.ndarray):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = block(batch)
                    near = (x @ made.T).argmax(1)
                    whole = np.round(x * (1 << 30)).astype(np.int64)
                    for c in np.unique(near).tolist():
                        total = whole[near == c].sum(0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), c, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["c", "d", "s"])

        return run

    for _ in range(rounds if len(first) else 0):
        made = np.zeros_like(first)
        for c, d, s in chosen.select("v").mapInArrow(partial(first), "c int, d int, s bigint").groupBy("c", "d").agg(F.sum("s").alias("s")).collect():
            made[c, d] = s
        norm = np.sqrt((made * made).sum(1))
        made = np.where((norm > 0)[:, None], made / np.maximum(norm, 1e-300)[:, None], first)  # a centre without rows stays
        if np.allclose(made, first, atol=1e-12):
            break
        first = made
    return first


def assigned(vectors: DataFrame, middle: np.ndarray, lists: int, out: str, sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """Adds to each vector its nearest lists, nearest first (array): `lists` of them, and as many more as hold `least` rows by the sizes of the lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(block(batch) @ middle.T), axis=1, kind="stable") if batch.num_rows else np.empty((0, 1), int)
            many = np.full(len(near), lists) if sizes is None else np.maximum(lists, (np.cumsum(sizes[near], axis=1) < least).sum(1) + 1)
            many = np.minimum(many, near.shape[1])
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(near[np.arange(near.shape[1])[None, :] < many[:, None]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return vectors.mapInArrow(run, f"id bigint, v array<double>, {out} array<int>")


def lists_to_visit(queries: DataFrame, placed: DataFrame, middle: np.ndarray, k: int, recall: float, most: int = 128) -> int:
    """How many of its nearest lists a query visits so that this share of the best k of sample queries is there: `most` queries of least hash meet every
    row."""
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(most).collect()
    ids, v = np.array([r["id"] for r in sample]), np.array([r["v"] for r in sample], np.float64)
    if not len(ids):
        return 1
    order = np.argsort(-(v @ middle.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(middle))[None, :], axis=1)

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, x, at = batch.column("id").to_numpy(), block(batch), batch.column("list").to_numpy()
                for i, score in enumerate(v @ x.T):
                    some = np.flatnonzero(own != ids[i])
                    some = some[best(score[some], own[some], k)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(own[some]), pa.array(score[some]), pa.array(place[i][at[some]].astype(np.int32))], names=["q", "id", "score", "place"])

    found = placed.select("id", "v", "list").mapInArrow(nearest, "q int, id bigint, score double, place int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id"))
    counts = dict(found.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("place").count().collect())
    got = np.cumsum([counts.get(i, 0) for i in range(len(middle))])
    return int(np.searchsorted(got, math.ceil(recall * got[-1]))) + 1 if got[-1] else len(middle)


def most_similar(
    rows: DataFrame, queries: Column, id_col: str = "id", vec_col: str = "embedding", k: int = 10, lists: int | None = None, probe_all: bool = False, recall: float = 0.98, chunk_rows: int = 4096, lane_queries: int = 4096
) -> DataFrame:
    """(query_id, rank, id, score): for each row where the condition `queries` holds the k rows of largest cosine (0 at least), itself left out, ties at
    nine digits to the smaller id. With probe_all exact; else as many lists are visited as sample queries need for `recall`. `lists` is near
    the root of the number of rows, 1024 at most, if not given. Rows without an id or a usable vector take no part; ids are unique."""
    asked_ids = rows.filter(queries).select(F.col(id_col).cast("long").alias("id")).distinct()
    vectors = usable(rows, id_col, vec_col)
    n = vectors.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    middle = centres(vectors, min(1024, max(1, round(math.sqrt(n)))) if lists is None else lists)
    placed = kept(assigned(vectors, middle, 1, "near").select("id", "v", F.get("near", F.lit(0)).alias("list")))
    asked = vectors.join(asked_ids, "id", "left_semi")
    visits = len(middle) if probe_all else lists_to_visit(asked, placed, middle, k, recall)
    held = np.zeros(len(middle), np.int64)
    for at, rows_there in placed.groupBy("list").count().collect():
        held[at] = rows_there
    visiting = kept(assigned(asked, middle, visits, "near", held, k + 1).select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.explode("near").alias("list")))
    # one row per list: into how many chunks and lanes it is dealt
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).join(visiting.groupBy("list").agg(F.count(F.lit(1)).alias("m")), "list")
    deal = kept(sizes.select("list", F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks"), F.ceil(F.col("m") / lane_queries).cast("int").alias("lanes")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    stock = placed.join(F.broadcast(deal), "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), every("lanes").alias("lane"))
    come = visiting.join(F.broadcast(deal), "list").select("query_id", "q", "list", every("chunks").alias("chunk"), F.pmod(F.xxhash64("query_id"), F.col("lanes")).cast("int").alias("lane"))

    def compared(stock: pa.Table, come: pa.Table) -> pa.Table:
        made: list[tuple[int, np.ndarray, np.ndarray]] = []
        if stock.num_rows and come.num_rows:
            ids, x, own, q = stock["id"].to_numpy(), block(stock), come["query_id"].to_numpy(), block(come, "q")
            for i in range(0, len(own), 256):
                for j, score in enumerate(q[i : i + 256] @ x.T):
                    some = np.flatnonzero(ids != own[i + j])
                    some = some[best(score[some], ids[some], k)]
                    made.append((int(own[i + j]), ids[some], score[some]))
        counts = [len(x) for _, x, _ in made]
        return pa.Table.from_arrays([pa.array(np.repeat(np.array([a for a, _, _ in made], np.int64), counts)), pa.array(np.concatenate([np.empty(0, np.int64), *(b for _, b, _ in made)])), pa.array(np.concatenate([np.empty(0), *(c for _, _, c in made)]))], names=["query_id", "id", "score"])

    found = stock.groupBy("list", "chunk", "lane").cogroup(come.groupBy("list", "chunk", "lane")).applyInArrow(compared, FOUND).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
