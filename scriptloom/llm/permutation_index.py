"""Approximate nearest neighbours with a permutation index.

A vector is represented by its pivots in the order of their nearness. It is posted, with the place of every pivot in that
order, in the inverted files of its first few pivots only. A query visits the files of its own nearest pivots; in each, the vectors whose
orders have the least footrule distance to the query's own are compared exactly. How many files a query visits is fitted on a
bounded sample of queries, so clustered vectors need few visits and evenly spread ones many. A long file is dealt into
chunks and its queries into groups, so a task holds one chunk and one group, whatever share of the vectors one pivot draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut

FOUND = "query_id bigint, vec_id bigint, score double"
RANKED = "query_id bigint, rank int, vec_id bigint, score double"


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that can take part, whatever their length."""
    v = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


class Pivots:
    """Distinct pivots, and the places of all of them in the order of a vector.

    Nearness is the inner product of vectors made equally long by one more component; a query is scaled to that
    length without one, so that its nearest pivots are those of largest inner product.
    """

    def __init__(self, sample: np.ndarray, most: int, top: float) -> None:
        _, first = np.unique(sample, axis=0, return_index=True)
        self.top, self.n = top, min(most, len(first))
        self.lifted = self.lift(sample[np.sort(first)[:most]], False)

    def lift(self, v: np.ndarray, query: bool) -> np.ndarray:
        lengths = np.sqrt((v * v).sum(1))
        if query:
            return np.concatenate([v * (self.top / lengths)[:, None], np.zeros((len(v), 1))], axis=1)
        return np.concatenate([v, np.sqrt(np.maximum(self.top * self.top - lengths * lengths, 0))[:, None]], axis=1)

    def orders(self, v: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each vector its pivots, nearest first, and the place of each pivot among them."""
        order = np.argsort(-(self.lift(v, query) @ self.lifted.T), axis=1, kind="stable")
        places = np.empty(order.shape, np.uint8)
        np.put_along_axis(places, order, np.arange(self.n, dtype=np.uint8)[None, :], axis=1)
        return order.astype(np.int32), places


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, best first."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def visits(vectors: DataFrame, sample: list, pivots: Pivots, posts: int, k: int, recall: float) -> int:
    """How many of its nearest pivots a query has to visit so that this share of the sample's k nearest is in their files: the
    sample meets every vector, and for each exact neighbour the place of the first file that has it is counted."""
    ids, v = np.array([r["vec_id"] for r in sample]), np.array([r["v"] for r in sample], np.float64)
    places = pivots.orders(v, True)[1]

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.uint8))] * len(ids)
        for batch in batches:
            if batch.num_rows:
                own, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                first = pivots.orders(x, False)[0][:, :posts]
                for i, score in enumerate(v @ x.T):
                    at = places[i][first].min(1)
                    some = np.flatnonzero(own != ids[i])
                    some = some[best_of(score[some], own[some], k)]
                    s, o, a = (np.concatenate(both) for both in zip(kept[i], (score[some], own[some], at[some]), strict=True))
                    best = best_of(s, o, k)
                    kept[i] = s[best], o[best], a[best]
        rows = [(i, float(x), int(y), int(z)) for i, own in enumerate(kept) for x, y, z in zip(*own, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int32()))], names=["sample", "score", "vec_id", "place"])

    found = vectors.select("vec_id", "v").mapInArrow(nearest, "sample int, score double, vec_id bigint, place int")
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("score"), "vec_id"))
    counts = dict(found.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("place").count().collect())
    got = np.cumsum([counts.get(i, 0) for i in range(pivots.n)])
    return int(np.searchsorted(got, math.ceil(recall * got[-1]))) + 1 if got[-1] else pivots.n


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, n_pivots: int = 128, posts: int = 2, recall: float = 0.97, order: int = 64, compared: int = 256,
    fit_queries: int = 128, seed: int = 5, index_rows: int = 2048, query_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (rows with id_col and vec_col; by default all rows) the k vectors of largest
    inner product found, its own id left out, ties to the smaller id.

    Fitted on bounded samples, chosen by a seeded hash of the id: the pivots (n_pivots of 256 at most, from four times as many
    vectors) and the number of files that a query visits (fit_queries queries, compared with every vector, so that `recall` of
    their neighbours are in the files visited). Every vector is indexed, in the files of its `posts` nearest pivots. Of each chunk of
    index_rows vectors of a file, the `compared` of least footrule distance over the query's first `order` pivots are compared
    exactly, in double precision: an eighth of a full chunk, whatever the number of vectors. Vectors of unequal length are
    compared as inner products ask for, by giving all the same length through one more component.
    Vectors that are null, zero, hold null or non-finite components, have a null id, or another number of components than
    most vectors of rows take no part. Rows that repeat count once; an id with several vectors has all of them, and its own are left
    out. Empty tables, and tables without any usable vector, give no rows. Other columns are ignored.
    """
    if not 1 <= n_pivots <= 256 or not 1 <= posts <= n_pivots or not 1 <= order <= 128:
        raise ValueError("n_pivots must be 256 at most, posts no more than that, order 128 at most")
    good = usable(rows, id_col, vec_col)
    usual = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return rows.sparkSession.createDataFrame([], RANKED)
    vectors = cut(good.filter(F.size("v") == usual["n"]).distinct())
    asked = usable(queries, id_col, vec_col).filter(F.size("v") == usual["n"]).distinct() if queries is not None else vectors
    chosen = F.xxhash64(F.lit(seed), "vec_id")
    sample = asked.orderBy(chosen, "vec_id").limit(fit_queries).collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], RANKED)
    top = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5 * (1 + 1e-12)
    pivots = Pivots(np.array([r["v"] for r in vectors.orderBy(chosen, "vec_id").limit(4 * n_pivots).collect()], np.float64), n_pivots, top)
    posts = min(posts, pivots.n)
    reach = visits(vectors, sample, pivots, posts, k, recall)
    #: 32-bit floats stay what they are
    element = rows.schema[vec_col].dataType
    kind = np.float32 if isinstance(element, ArrayType) and isinstance(element.elementType, FloatType) and (queries is None or queries.schema[vec_col].dataType == element) else np.float64

    def ordered(query: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                    near, places = pivots.orders(v, query)
                    files = np.ascontiguousarray(near[:, : reach if query else posts])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * files.shape[1]), pa.array(files.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), packed(v.astype(kind)), packed(places), lists], names=["vec_id", "v", "places", "files"])

        return run

    shape = "vec_id bigint, v binary, places binary, files array<int>"
    posted = cut(vectors.mapInArrow(ordered(False), shape))
    visiting = cut(asked.mapInArrow(ordered(True), shape))

    def dealt(df: DataFrame, each: int) -> Column:
        """Into how many parts the rows of each file are dealt, an array with one entry per pivot."""
        sizes = dict(df.select(F.explode("files").alias("file")).groupBy("file").count().collect())
        return F.array(*[F.lit(max(1, -(-sizes.get(i, 0) // each))) for i in range(pivots.n)])

    chunks, groups = dealt(posted, index_rows), dealt(visiting, query_rows)

    def addressed(df: DataFrame, own: Column, other: Column, names: tuple[str, str]) -> DataFrame:
        """Each row in one part of each of its files, once for every part of the other side."""
        spread = df.select("vec_id", "v", "places", F.explode("files").alias("file"))
        return spread.withColumn(names[0], F.pmod(F.xxhash64(F.lit(seed + 1), "vec_id"), F.get(own, F.col("file"))).cast("int")).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.get(other, F.col("file")) - 1)))

    index = addressed(posted, chunks, groups, ("chunk", "group"))
    asking = addressed(visiting, groups, chunks, ("group", "chunk"))

    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if index.num_rows and asked.num_rows:
            file = index["file"][0].as_py()
            turn = np.argsort(index["vec_id"].to_numpy(), kind="stable")
            ids = index["vec_id"].to_numpy()[turn]
            v = unpacked(index["v"], kind)[turn].astype(np.float64)
            places = unpacked(index["places"], np.uint8)[turn]
            # the files before this one in which a vector is posted too; none is a pivot that no query visits
            before = np.argsort(places, axis=1)[:, : posts - 1]
            before[np.arange(posts - 1) >= places[:, file : file + 1]] = pivots.n
            by_pivot = np.ascontiguousarray(places.T).astype(np.int16)
            wanted = unpacked(asked["places"], np.uint8)
            visited = np.concatenate([wanted < reach, np.zeros((len(wanted), 1), bool)], axis=1)
            front = np.argsort(wanted, axis=1)[:, :order]
            step = np.arange(front.shape[1], dtype=np.int16)[:, None]
            for i, (q, query) in enumerate(zip(asked["vec_id"].to_pylist(), unpacked(asked["v"], kind).astype(np.float64), strict=True)):
                # a vector posted in several files that the query visits counts in the one where it stands first
                some = np.flatnonzero(~visited[i][before].any(1) & (ids != q))
                if len(some) > compared:
                    footrule = np.abs(by_pivot[front[i]] - step).sum(0, dtype=np.int16)[some].astype(np.int64)
                    some = some[np.argpartition(footrule * len(some) + np.arange(len(some)), compared - 1)[:compared]]
                    some.sort()
                score = (v[some] * query).sum(1)
                best = best_of(score, ids[some], k)
                out.append((np.full(len(best), q, np.int64), ids[some[best]], score[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    found = index.groupBy("file", "chunk", "group").cogroup(asking.groupBy("file", "chunk", "group")).applyInArrow(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
