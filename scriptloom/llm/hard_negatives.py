"""Hard-negative mining over blocks of vectors in Hilbert order with zone maps.

Candidates are ordered along a Hilbert curve through their most spread dimensions and written as Parquet records of block_rows
vectors each, with the least and the largest value of every dimension (the zone map) and the labels of the block. By interval
arithmetic the zone map bounds the inner products that an anchor can have in a block, so an anchor reads only blocks that may hold
one of its positives, or a row inside the window below one of them. What an anchor finds in its own block, its neighbours on the curve,
sets the first limits. All bounds and scores are whole numbers, and all results exact.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, checkpoint_dir, cut
from .permutation_index import best_of
from .vector_codes import whole_components

MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
ANCHOR_TYPE = pa.struct([("row", pa.int64()), ("id", pa.int64()), ("label", pa.string()), ("v", pa.list_(pa.int32())), ("shelf", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])
ANCHORS = "array<struct<row: bigint, id: bigint, label: string, v: array<int>, shelf: bigint, block: bigint, ids: array<bigint>, scores: array<bigint>>>"
BLOCKS = f"block bigint, rows array<bigint>, ids array<bigint>, labels array<string>, vectors array<int>, low array<int>, high array<int>, kinds array<string>, anchors {ANCHORS}, shelf bigint"
ASKED = "shelf bigint, lane int, blocks array<bigint>, row bigint, id bigint, label string, v array<int>, scores array<bigint>, floors array<bigint>"
FOUND = "row bigint, place int, id bigint, score bigint"
NONE = np.iinfo(np.int64).min


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points with whole coordinates below 2**bits; dimensions x bits below 64."""
    x = x.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for row in x:
            on = row & q != 0
            swap = np.where(on, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(on, low, swap)
            row ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for row in x:
            place = place << 1 | (row >> bit & 1)
    return place


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two sets of whole vectors, exact."""
    if a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def between(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product that each vector of `a` can have inside each box."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    return products(plus, low) + products(minus, high), products(plus, high) + products(minus, low)


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def spread(vectors: DataFrame) -> list[tuple[int, int, int]]:
    """(dimension, least, largest), most spread first: one row per dimension."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), batch.num_rows)
                y = x.astype(np.float64)
                made = (np.arange(x.shape[1], dtype=np.int32), np.full(x.shape[1], float(len(x))), y.sum(0), (y * y).sum(0), x.min(0), x.max(0))
                yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], names=["dim", "n", "s", "ss", "low", "high"])

    found = vectors.select("_v").mapInArrow(partial, "dim int, n double, s double, ss double, low int, high int")
    rows = found.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    return [(r["dim"], r["low"], r["high"]) for r in sorted(rows, key=lambda r: (-(r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2), r["dim"]))]


def best_positives(scores: np.ndarray, same: np.ndarray, ids: np.ndarray, k: int, floor: int | None = None) -> np.ndarray:
    at = np.flatnonzero(same if floor is None else same & (scores >= floor))
    return at[best_of(scores[at], ids[at], k)]


def written_blocks(base: DataFrame, positives: int, block_rows: int, shelf_rows: int, n_rows: int) -> DataFrame:
    """The blocks as a Parquet table in the shared folder, one record each, in directories of shelf_rows rows (shelves). An anchor
    is noted with the best positives of its block."""
    dims = spread(base)[:8]
    bits = 63 // max(len(dims), 1) if len(dims) < 8 else 7
    bits = min(bits, 20)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(4), batch.num_rows)[:, [d for d, _, _ in dims]].astype(np.int64) if batch.num_rows else np.empty((0, len(dims)), np.int64)
            low, high = (np.array(c, np.int64) for c in zip(*[(lo, hi) for _, lo, hi in dims], strict=True))
            at = hilbert((x - low) * ((1 << bits) - 1) // np.maximum(high - low, 1), bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "place"])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, n, held = TaskContext.get().partitionId(), 0, []
        schema = pa.schema([("block", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("vectors", pa.list_(pa.int32())), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("kinds", pa.list_(pa.string())), ("anchors", pa.list_(ANCHOR_TYPE)), ("shelf", pa.int64())])

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal n
            number, ids, x = (shelf << 32) + n, rows["id"].to_numpy(), matrix(rows["_v"], rows.num_rows)
            n += 1
            labels = rows["label"].combine_chunks()
            kinds = labels.dictionary_encode()
            code, own = kinds.indices.to_numpy(), rows["row"].to_numpy()
            anchors = []
            for i in np.flatnonzero(rows["anchor"].to_numpy()):
                score = products(x[i : i + 1], x)[0]
                best = best_positives(score, (code == code[i]) & (np.arange(len(own)) != i), ids, positives)
                anchors.append({"row": own[i], "id": ids[i], "label": labels[int(i)].as_py(), "v": x[i], "shelf": shelf, "block": number, "ids": ids[best], "scores": score[best]})
            made = {"block": number, "rows": own, "ids": ids, "labels": labels, "vectors": x.ravel(), "low": x.min(0), "high": x.max(0), "kinds": kinds.dictionary, "anchors": anchors, "shelf": shelf}
            return pa.RecordBatch.from_pylist([made], schema=schema)

        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            while waiting >= block_rows:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, block_rows))
                rest = table.slice(block_rows)
                held, waiting = rest.to_batches(), rest.num_rows
        if waiting:
            yield block(pa.Table.from_batches(held))

    ordered = base.mapInArrow(placed, "row bigint, id bigint, label string, anchor boolean, _v array<int>, place bigint").repartitionByRange(max(1, math.ceil(n_rows / shelf_rows)), "place", F.xxhash64("row")).sortWithinPartitions("place", "row")
    blocks = ordered.select("row", "id", "label", "anchor", "_v").mapInArrow(packed, BLOCKS)
    path = f"{checkpoint_dir(base.sparkSession)}/blocks-{uuid.uuid4().hex}"
    blocks.write.partitionBy("shelf").parquet(path)
    return base.sparkSession.read.schema(BLOCKS).parquet(path)


class Windows:
    """For each score of a positive the scores that a negative may have, both ends in."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high

    def of(self, score: int) -> tuple[int, int]:
        return -(-self.low * score // 100), self.high * score // 100


def chosen(anchors: DataFrame, zones: DataFrame, lanes: int, n_blocks: int, windows: Windows | None, n_positives: int) -> DataFrame:
    """(shelf, lane, blocks, the anchor): the blocks of each shelf, other than its own, that an anchor must read: for positives (windows
    None) those with its label and a bound that reaches its floor; for negatives those with another label whose bounds meet a window above its
    floor. Zone maps in chunks meet the anchors in lanes."""
    chunks = max(1, math.ceil(n_blocks / 1024))

    def judge(zones: pa.Table, anchors: pa.Table) -> pa.Table:
        made = []
        if zones.num_rows and anchors.num_rows:
            low, high = matrix(zones["low"], zones.num_rows), matrix(zones["high"], zones.num_rows)
            block, shelf = zones["block"].to_numpy(), zones["shelf"].to_numpy()
            order = np.argsort(shelf, kind="stable")
            kinds = [set(x) for x in zones["kinds"].to_pylist()]
            holding: dict[str, np.ndarray] = {}
            for i in range(0, anchors.num_rows, 256):
                some = anchors.slice(i, 256)
                least, most = between(matrix(some["v"], some.num_rows), low, high)
                for j, a in enumerate(some.select(["block", "label", "scores", "floors"]).to_pylist()):
                    if a["label"] not in holding:
                        holding[a["label"]] = np.array([(a["label"] in k, len(k) > (a["label"] in k)) for k in kinds])
                    has, others = holding[a["label"]].T
                    if windows is None:
                        need = has & (most[j] >= a["floors"][0]) if a["floors"] else has.copy()
                    else:
                        need = np.zeros(len(block), bool)
                        for score, floor in zip(a["scores"], a["floors"], strict=True):
                            first, last = windows.of(score)
                            first = first if floor is None else max(first, floor)
                            if first <= last:
                                need |= (most[j] >= first) & (least[j] <= last)
                        need &= others
                    need &= block != a["block"]
                    at = order[need[order]]
                    for group in np.split(at, np.flatnonzero(np.diff(shelf[at])) + 1) if len(at) else ():
                        made.append((i + j, int(shelf[group[0]]), block[group]))
        own = anchors.take(pa.array([x for x, _, _ in made], pa.int64()))
        columns = [pa.array([x for _, x, _ in made], pa.int64()), own["lane"], pa.array([x for _, _, x in made], pa.list_(pa.int64())), *(own[c] for c in ("row", "id", "label", "v", "scores", "floors"))]
        return pa.Table.from_arrays(columns, names=[x.split(" ")[0] for x in ASKED.split(", ")])

    z = zones.select("block", "shelf", "low", "high", "kinds", F.pmod(F.xxhash64("shelf"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    a = anchors.select("row", "id", "label", "v", "block", "scores", "floors", "lane", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    return z.groupBy("chunk", "lane").cogroup(a.groupBy("chunk", "lane")).applyInArrow(judge, ASKED)


def visited(asked: DataFrame, blocks: DataFrame, lanes: int, windows: Windows | None, k: int, most_shelves: int = 4096) -> DataFrame:
    """(row, place, id, score): the best k rows that each anchor finds in the blocks it reads: positives (place 0), or negatives in the
    window of each of its positives (place: the positive's). Shelves that no anchor asks for aren't read."""

    def read(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        if blocks.num_rows and asked.num_rows:
            sizes = np.array([len(x) for x in blocks["ids"].to_pylist()])
            edges = np.concatenate([[0], np.cumsum(sizes)])
            rows, ids, flat = (blocks[c].combine_chunks().flatten().to_numpy() for c in ("rows", "ids", "vectors"))
            x = flat.reshape(len(ids), -1)
            places = {b: i for i, b in enumerate(blocks["block"].to_pylist())}
            both = pa.concat_arrays([blocks["labels"].combine_chunks().flatten(), asked["label"].combine_chunks()]).dictionary_encode().indices.to_numpy()
            code, own_code = both[: len(ids)], both[len(ids) :]
            for i in range(0, asked.num_rows, 64):
                some = asked.slice(i, 64)
                v = matrix(some["v"], some.num_rows)
                score = np.full((some.num_rows, len(ids)), NONE)
                asks: dict[int, list[int]] = {}
                for j, own in enumerate(some["blocks"].to_pylist()):
                    for b in own:
                        if b in places:
                            asks.setdefault(places[b], []).append(j)
                for b, js in asks.items():
                    score[js, edges[b] : edges[b + 1]] = products(v[js], x[edges[b] : edges[b + 1]])
                for j, a in enumerate(some.select(["row", "scores", "floors"]).to_pylist()):
                    s, read = score[j], score[j] != NONE
                    if windows is None:
                        at = best_positives(s, read & (code == own_code[i + j]) & (rows != a["row"]), ids, k, a["floors"][0] if a["floors"] else None)
                        made.append((a["row"], 0, ids[at], s[at]))
                        continue
                    other = np.flatnonzero(read & (code != own_code[i + j]))
                    t, o = s[other], ids[other]
                    for place, (positive, floor) in enumerate(zip(a["scores"], a["floors"], strict=True)):
                        first, last = windows.of(positive)
                        at = np.flatnonzero((t <= last) & (t >= (first if floor is None else max(first, floor))))
                        at = at[best_of(t[at], o[at], k)]
                        made.append((a["row"], place, o[at], t[at]))
        counts = [len(x) for _, _, x, _ in made]
        return pa.Table.from_arrays(
            [
                pa.array(np.repeat(np.array([x for x, _, _, _ in made], np.int64), counts)), pa.array(np.repeat(np.array([x for _, x, _, _ in made], np.int32), counts)),
                pa.array(np.concatenate([np.empty(0, np.int64), *(x for _, _, x, _ in made)])), pa.array(np.concatenate([np.empty(0, np.int64), *(x for _, _, _, x in made)])),
            ],
            names=["row", "place", "id", "score"],
        )

    shelves = [r["shelf"] for r in asked.select("shelf").distinct().limit(most_shelves + 1).collect()]
    if len(shelves) <= most_shelves:
        blocks = blocks.filter(F.col("shelf").isin(shelves))
    stock = blocks.select("shelf", "block", "rows", "ids", "labels", "vectors", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    return stock.groupBy("shelf", "lane").cogroup(asked.groupBy("shelf", "lane")).applyInArrow(read, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and place, with their rank."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    block_rows: int = 512, most_shelf_rows: int = 1 << 17, lane_anchors: int = 1 << 14,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Components become floor(scale * component); the score
    of two rows is their inner product. The positives of an anchor (rows where the condition `anchor` holds) are its first rows of the same
    label, its negatives for each of them the first rows of another label with low * positive_score <= 100 * negative_score <=
    high * positive_score; higher scores come first, then smaller ids (null ids first).

    Rows take no part if the label or the vector is null, a component is null or not finite, the vector is empty or has not the most
    frequent length (the shorter of equally frequent ones). Components beyond 2**24 after scaling count as that. Rows may repeat: a
    copy is another row, and each copy of an anchor is an anchor. Extra columns of any name are ignored; an empty table gives no rows. A
    frequent label or vector needs no care: rows are dealt by their place on the curve and, among equals, by row.

    A task holds the rows of a shelf (a quarter of what one shuffle partition would get, 8192 at least, most_shelf_rows at most)
    and lane_anchors anchors.
    """
    spark = rows.sparkSession
    own = rows.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{vec_col}`").alias("_vector"))
    good = whole_components(own.filter("label IS NOT NULL"), "_vector", scale, 1)
    base = cut(good.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", "_v"))
    lengths = base.groupBy(F.size("_v").alias("n")).agg(F.count(F.lit(1)).alias("count"), F.count_if("anchor").alias("anchors")).orderBy(F.desc("count"), "n").first()
    if not lengths or not lengths["anchors"]:
        return spark.createDataFrame([], MINED)
    base, n_rows, lanes = base.filter(F.size("_v") == lengths["n"]), lengths["count"], math.ceil(lengths["anchors"] / lane_anchors)
    shelf_rows = min(max(8192, n_rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), most_shelf_rows)
    blocks = written_blocks(base, positives, block_rows, shelf_rows, n_rows)
    zones, n_blocks = blocks.select("block", "shelf", "low", "high", "kinds"), math.ceil(n_rows / block_rows)
    windows = Windows(low, high)

    # first the best positives: those of the own block, then those of blocks that may have better ones
    near = cut(blocks.select(F.explode("anchors").alias("a")).select("a.*", F.pmod(F.xxhash64("a.row"), F.lit(lanes)).cast("int").alias("lane")))
    floors = F.when(F.size("scores") >= positives, F.array(F.array_min("scores"))).otherwise(F.array().cast("array<bigint>"))
    far = visited(cut(chosen(near.withColumn("floors", floors), zones, lanes, n_blocks, None, positives)), blocks, lanes, None, positives)
    had = near.select("row", F.lit(0).alias("place"), F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("row", "place", F.col("p.ids").alias("id"), F.col("p.scores").alias("score"))
    first = best(had.unionByName(far), positives).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    known = near.drop("ids", "scores").join(first, "row").select("row", "id", "label", "v", "shelf", "block", "lane", F.col("p.id").alias("ids"), F.col("p.score").alias("scores"))
    known = cut(known)

    # then the negatives: the own block, which sets a floor for each window, and blocks that reach above it
    asked = known.select("shelf", "lane", F.array("block").alias("blocks"), "row", "id", "label", "v", "scores", F.transform("scores", lambda x: F.lit(None).cast("bigint")).alias("floors"))
    here = cut(visited(asked, blocks, lanes, windows, negatives))
    full = here.groupBy("row", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= negatives).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", "floor"))).alias("floor_of"))
    above = known.join(full, "row", "left").withColumn("floors", F.transform("scores", lambda x, i: F.element_at(F.coalesce("floor_of", F.create_map().cast("map<int,bigint>")), i)))
    there = visited(cut(chosen(above, zones, lanes, n_blocks, windows, positives)), blocks, lanes, windows, negatives)
    ranked = best(here.unionByName(there), negatives).withColumnsRenamed({"id": "negative", "score": "negative_score"})
    shown = lambda c: F.when(c != NO_ID, c)
    return ranked.join(known.select("row", "id", "ids", "scores"), "row").select(
        F.col("id").alias("anchor_id"), shown(F.get("ids", F.col("place"))).alias("positive_id"), "rank", shown(F.col("negative")).alias("negative_id"), F.get("scores", F.col("place")).alias("positive_score"), "negative_score"
    )
