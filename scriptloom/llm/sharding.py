"""Sharding by Karmarkar-Karp differencing: equal bytes for groups that must stay together.

Groups (equal texts) are dealt into parts of bounded size. In each part differencing starts from one partial
partition per group and repeatedly combines the two with the largest spread, the largest shard of one with the
smallest of the other, until one partial partition is left. The parts' results are combined in the same way, level
by level, and each level tells where its members' shards went.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of


def differencing(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions, one per row of sums (members x shards). Returns the final sums, and for each member and
    each of its shards the final shard."""
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    state = {i: np.take_along_axis(sums[i], order[i], 0) for i in range(n)}
    where = [order[i] for i in range(n)]  # at a leaf: its own shard at each place
    children: list[tuple[int, int, np.ndarray] | None] = [None] * n
    heap = [(-int(state[i][0] - state[i][-1]), i) for i in range(n)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = state.pop(a) + state.pop(b)[::-1]
        turn = np.argsort(-both, kind="stable")
        made = both[turn]
        i = len(children)
        children.append((a, b, turn))
        state[i] = made
        heapq.heappush(heap, (-int(made[0] - made[-1]), i))
    final = np.zeros((n, k), np.int32)
    root = heap[0][1]
    todo = [(root, np.arange(k))]  # a node, and the final shard of each of its places
    while todo:
        node, places = todo.pop()
        own = children[node]
        if own is None:
            final[node][where[node]] = places
            continue
        a, b, turn = own
        back = np.empty(k, np.int64)
        back[turn] = places
        todo += [(a, back), (b, back[::-1])]
    return state[root], final


def leaf(shards: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differencing of single weights: the sums, and the shard of each."""
    sums = np.zeros((len(weights), shards), np.int64)
    sums[:, 0] = weights
    total, final = differencing(sums)
    return total, final[:, 0]


def shard_groups(groups: DataFrame, shards: int, part_rows: int) -> DataFrame:
    """(key, shard) for groups (key, weight)."""
    n = max(1, -(-groups.count() // part_rows))

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "key"], ascending=[False, True], kind="stable")
        total, shard = leaf(shards, pdf["weight"].to_numpy(np.int64))
        top = pd.DataFrame({"part": pdf["part"].iloc[:1], "key": None, "shard": None, "sums": [total.tolist()]})
        return pd.concat([pd.DataFrame({"part": pdf["part"], "key": pdf["key"], "shard": shard, "sums": None}), top])

    made = cut(groups.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n))).groupBy("part").applyInPandas(parts, "part bigint, key binary, shard int, sums array<bigint>"))
    placed = made.filter("key IS NOT NULL").select("part", "key", "shard")
    level = made.filter("key IS NULL").select("part", "sums")
    while n > 1:
        above = max(1, -(-n // part_rows))

        def combine(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            total, final = differencing(np.array(pdf["sums"].tolist(), np.int64))
            own = pd.DataFrame({"up": pdf["up"], "part": pdf["part"], "moves": final.tolist(), "sums": None})
            return pd.concat([own, pd.DataFrame({"up": pdf["up"].iloc[:1], "part": None, "moves": None, "sums": [total.tolist()]})]).astype({"part": "Int64"})

        made = cut(level.withColumn("up", F.pmod(F.xxhash64("part"), F.lit(above))).groupBy("up").applyInPandas(combine, "up bigint, part bigint, moves array<int>, sums array<bigint>"))
        moves = made.filter("part IS NOT NULL").select("part", "up", "moves")
        placed = placed.join(moves, "part").select(F.col("up").alias("part"), "key", F.get("moves", F.col("shard")).alias("shard"))
        level = made.filter("part IS NULL").select(F.col("up").alias("part"), "sums")
        n = above
    return placed.select("key", "shard")


def numbered(rows: DataFrame, shard_col: str, order: list, spread, bucket_rows: int, out: str) -> DataFrame:
    """Adds gapless numbers from 0 in each shard: rows are numbered within small buckets, which follow one another."""
    n = max(1, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("_bucket", F.pmod(spread, F.lit(n)))
    counts = rows.groupBy(shard_col, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(shard_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select(shard_col, "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy(shard_col, "_bucket").orderBy(*order)))
    return placed.join(before, [shard_col, "_bucket"]).withColumn(out, (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_bucket", "_at", "_before")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, part_rows: int = 20_000, bucket_rows: int = 20_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row. Size: UTF-8 bytes and the overhead of
    a row; the shards' sizes are near equal (law `bytes`) while equal texts share a shard. A null text is an empty one.
    Null and repeated ids are allowed: they get their own slots. Of equal rows it is not said which gets which slot.
    An empty table gives no rows; other columns are ignored. A task holds part_rows groups or bucket_rows rows."""
    text = text_of(text_col)
    # texts are read and hashed once; what follows needs some 50 bytes a row
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")))
    placed = shard_groups(rows.groupBy("key").agg(F.sum("size").alias("weight")), shards, part_rows)
    own = cut(rows.join(placed, "key"))
    made = numbered(own, "shard", ["doc_id", "key"], F.xxhash64("doc_id", "key"), bucket_rows, "slot")
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
