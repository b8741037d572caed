"""Vector code compression: each part of a vector becomes the index of the nearest entry of a codebook fitted by Lloyd's rounds.

Parts live with the entry they belong to. A part's owner is the partition of (position, entry, salt); an entry's parts are spread over
its salts, so that one entry may draw any share of all parts. In each round the owners sum up the parts that live with them, which gives
the next codebook (entries x length numbers, all that the driver sees), and compare them with it; parts whose nearest entry has
changed go through the shuffle to their new owner, the others stay where they are: both lie by the same partitioner, so that their
union is no shuffle. Parts travel as packed arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, checkpoint_dir, cut

#: Components count as this much in size at most, so that all sums stay exact.
LIMIT = 1 << 24
ROWS = 16384


class Codes(NamedTuple):
    """codes: (the id column, the carried columns, codes array<int>, error bigint); codebooks: position x entry x component;
    moved: how many parts changed their owner in each round, after the first assignment."""

    codes: DataFrame
    codebooks: np.ndarray
    moved: list[int]

    def digest(self) -> str:
        """Hex SHA-256 of all components in order, in decimal, with commas between."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def whole_components(rows: DataFrame, vec_col: str, scale: int, parts: int) -> DataFrame:
    """Rows that take part, with _v: floor(scale * component) for each."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    found = rows.filter(F.coalesce(good, F.lit(False))).withColumn("_v", whole)
    return found.filter((F.size("_v") > 0) & (F.size("_v") % parts == 0))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the nearest entry, ties to the lower index, and the squared distance; exact."""
    entry, distance = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    if 4 * book.shape[1] * max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)), 1) ** 2 < 1 << 53:
        f, c = x.astype(np.float64), book.astype(np.float64)
        d = (c * c).sum(1)[None, :] - 2 * (f @ c.T)
        entry[:] = d.argmin(1)
        distance[:] = d[np.arange(len(x)), entry] + (f * f).sum(1)
        return entry, distance
    for i in range(0, len(x), 64):
        d = ((x[i : i + 64, None, :].astype(np.int64) - book[None]) ** 2).sum(2)
        entry[i : i + 64] = d.argmin(1)
        distance[i : i + 64] = d.min(1)
    return entry, distance


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(32))) >> np.uint64(20)).astype(np.int64)


class Parts:
    """The layout of packed parts, and who owns them."""

    def __init__(self, width: int, entries: int, partitions: int) -> None:
        self.kind = np.dtype([("row", "<i8"), ("position", "<i4"), ("entry", "<i4"), ("x", "<i4", (width,))])
        self.entries, self.partitions, self.salts = entries, partitions, -(-partitions // 4)

    def owner(self, p: np.ndarray) -> np.ndarray:
        """Neighbouring partitions for the salts of an entry, so no two salts of it meet."""
        return (mixed(p["position"].astype(np.int64) * self.entries + p["entry"]) + mixed(p["row"]) % self.salts) % self.partitions

    def dealt(self, p: np.ndarray) -> Iterator[tuple[int, bytes]]:
        if not len(p):
            return
        owner = self.owner(p)
        order = np.argsort(owner, kind="stable")
        p, owner = p[order], owner[order]
        edges = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
        for i, j in zip(edges, [*edges[1:], len(p)], strict=True):
            yield int(owner[i]), p[i:j].tobytes()

    def batches(self, chunks: Iterable[bytes]) -> Iterator[np.ndarray]:
        held, n = [], 0
        for chunk in chunks:
            held.append(chunk)
            n += len(chunk) // self.kind.itemsize
            if n >= ROWS:
                yield np.frombuffer(b"".join(held), self.kind)
                held, n = [], 0
        if n:
            yield np.frombuffer(b"".join(held), self.kind)

    def assigned(self, p: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry, distance = p["entry"].copy(), np.zeros(len(p), np.int64)
        for position in range(len(books)):
            at = np.flatnonzero(p["position"] == position)
            entry[at], distance[at] = nearest(p["x"][at], books[position])
        return entry, distance

    def sums(self, chunks: Iterable[tuple[int, bytes]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        """Count and sums of each entry over the parts that live here."""
        total: dict[tuple[int, int], np.ndarray] = {}
        for p in self.batches(x for _, x in chunks):
            key = p["position"].astype(np.int64) * self.entries + p["entry"]
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            made = np.add.reduceat(np.column_stack([np.ones(len(p), np.int64), p["x"].astype(np.int64)])[order], starts, axis=0)
            for k, row in zip(key[starts].tolist(), made, strict=True):
                at = divmod(k, self.entries)
                total[at] = total[at] + row if at in total else row
        yield from total.items()


def same(key: int) -> int:
    return key


def settled(rdd: RDD, rows: Callable) -> tuple[RDD, int]:
    """The RDD written to the shared folder, its lineage cut; and the sum of rows(element) over it."""
    rdd.persist(StorageLevel.MEMORY_AND_DISK)
    rdd.checkpoint()
    total = rdd.map(rows).sum()
    rdd.unpersist()
    return rdd, total


def compress_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", carry: tuple[str, ...] = (), parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codes:
    """Codes of all vectors, by codebooks of whole numbers. Components become floor(scale * component) and a vector is cut into `parts`
    equal parts; the codebook of each position starts as that part of the vectors with the smallest ids, ascending (null ids first, equal
    ids by their components), and is fitted in `rounds` rounds; means are rounded down, unused entries stay.

    Rows take no part if their vector is null, empty, or has a null or non-finite component, or if its length isn't the most frequent
    one (the shorter of equally frequent ones) of those that `parts` divides. Components beyond 2**24 after scaling count as that. Rows may repeat
    and ids be null: each row has its code. Other columns of any name are left out unless carried. An empty table gives no rows and empty codebooks.
    """
    spark = rows.sparkSession
    good = whole_components(rows.withColumn("_id", F.col(f"`{id_col}`").cast("long")), vec_col, scale, parts)
    base = cut(good.select(F.monotonically_increasing_id().alias("_row"), "_id", "_v", F.struct(F.col(f"`{id_col}`").alias("_own"), *[F.col(f"`{c}`") for c in carry]).alias("_carried")))
    lengths = base.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length, n_rows = (lengths["n"], lengths["count"]) if lengths else (parts, 0)
    base, width = base.filter(F.size("_v") == length), length // parts
    first = base.select("_v").orderBy(F.coalesce("_id", F.lit(NO_ID)), "_v").limit(entries).collect()
    books = np.array([r["_v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)

    # at least so many that a task has some tens of MB of parts
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows * (4 * length + 16 * parts) // (64 << 20)))
    layout = Parts(width, entries, partitions)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS // parts):
                some = batch.slice(i, ROWS // parts)
                p = np.zeros((some.num_rows, parts), layout.kind)
                p["row"] = some.column(0).to_numpy()[:, None]
                p["position"] = np.arange(parts)
                p["x"] = some.column(1).flatten().to_numpy().reshape(some.num_rows, parts, width)
                p = p.ravel()
                p["entry"] = layout.assigned(p, books)[0]
                made = list(layout.dealt(p))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names=["owner", "chunk"])

    checkpoint_dir(spark)
    resident = base.select("_row", "_v").mapInArrow(packed, "owner int, chunk binary").rdd.map(lambda r: (r["owner"], bytes(r["chunk"]))).partitionBy(partitions, same)
    moved: list[int] = []
    for n in range(rounds):
        if n_rows:
            means = resident.mapPartitions(layout.sums).reduceByKey(lambda a, b: a + b, min(partitions, 16)).mapValues(lambda x: x[1:] // x[0]).collect()
            books = books.copy()
            for (position, entry), mean in means:
                books[position, entry] = mean
        if n == rounds - 1 or not n_rows:
            continue

        def compared(chunks: Iterable[tuple[int, bytes]], books: np.ndarray = books) -> Iterator[tuple[int, tuple[int, bytes]]]:
            for p in layout.batches(x for _, x in chunks):
                entry, _ = layout.assigned(p, books)
                stays = entry == p["entry"]
                if stays.any():
                    yield -1, (0, p[stays].tobytes())
                p = p[~stays]
                p["entry"] = entry[~stays]
                for owner, chunk in layout.dealt(p):
                    yield owner, (len(chunk) // layout.kind.itemsize, chunk)

        judged, changed = settled(resident.mapPartitions(compared, True), lambda x: x[1][0])
        moved.append(changed)
        stay = judged.mapPartitions(lambda it: ((o, c) for o, (m, c) in it if not m), True)
        migrate = judged.mapPartitions(lambda it: ((o, c) for o, (m, c) in it if m)).partitionBy(partitions, same)
        resident = stay.union(migrate)

    def coded(chunks: Iterable[tuple[int, bytes]]) -> Iterator[tuple[bytes]]:
        for p in layout.batches(x for _, x in chunks):
            made = np.zeros(len(p), CODED)
            made["row"], made["position"] = p["row"], p["position"]
            made["entry"], made["error"] = layout.assigned(p, books)
            yield (made.tobytes(),)

    def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0):
                made = np.frombuffer(chunk.as_py(), CODED)
                yield pa.RecordBatch.from_arrays([pa.array(made[x]) for x in CODED.names], names=CODED.names)

    found = spark.createDataFrame(resident.mapPartitions(coded), "chunk binary").mapInArrow(unpacked, "row bigint, position int, entry int, error bigint")
    code = F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"])
    whole = found.groupBy("row").agg(code.alias("codes"), F.sum("error").alias("error"))
    codes = base.join(whole, base["_row"] == whole["row"]).select(F.col("_carried._own").alias(id_col), *[F.col("_carried").getField(c).alias(c) for c in carry], "codes", "error")
    return Codes(codes, books, moved)


CODED = np.dtype([("row", "<i8"), ("position", "<i4"), ("entry", "<i4"), ("error", "<i8")])


def label_errors(codes: DataFrame, label_col: str = "label", hot_share: int = 1000) -> DataFrame:
    """Adds label_error: the errors summed over the rows of the same label, nulls together. Labels that have more than one in hot_share of
    all rows, fewer than hot_share then, meet their rows by a broadcast, the others by a shuffle, so no task gathers the rows of a frequent one."""
    codes = cut(codes)
    label = F.col(f"`{label_col}`")
    totals = cut(codes.groupBy(label.alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    n = codes.count()
    hot = totals.filter(F.col("_n") * hot_share > n).select("_label", "label_error")
    rare = totals.filter(F.col("_n") * hot_share <= n).select("_label", "label_error")
    same_label = label.eqNullSafe(F.col("_label"))
    often = codes.join(F.broadcast(hot), same_label).drop("_label")
    seldom = codes.join(F.broadcast(hot.select("_label")), same_label, "left_anti").join(rare, same_label).drop("_label")
    return often.unionByName(seldom)
