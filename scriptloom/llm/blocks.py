"""Finding equal windows of text between documents by exchanging packed hashes.

Documents are dealt by id into *blocks* of a few MB. A block sends each hash once, however often it
holds it, to the *bucket* that owns the hash; the bucket answers every block with those of its hashes
that matter. A passage that a third of all documents share is therefore one entry per block, so no task
receives more of a hot window than there are blocks, and all state is bounded by a block or a bucket.
The exchange of texts by block occurs in each step with the same plan, so Spark shuffles them once.
"""

from __future__ import annotations

import ctypes
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, parts, text_of

#: Odd multipliers of the polynomial hashes, and of their finishing mix.
BYTE_M, WORD_M, CHECK_M = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
MIX = np.uint64(0xFF51AFD7ED558CCD)
PIECE = 1 << 20

REPLY = "block int, kind int, data binary, n bigint"
SENT = "bucket int, block int, h binary, g binary, first binary, n binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("h", pa.binary()), ("g", pa.binary()), ("first", pa.binary()), ("n", pa.binary())])
REPLY_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("n", pa.int64())])
COPY, ANCHOR, OURS, THEIRS, LONGER, BITS, LEVEL = 0, 1, 2, 3, 4, 5, 10  # from LEVEL on: the levels of a ladder


def text_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(doc_id, text, carried, k, digest, block) and the number of blocks. Null ids get the smallest key and spread by text;
    the columns to carry are one struct, null where there are none."""
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), carried.alias("carried"))
    n = parts(d.agg(F.sum(F.octet_length("text"))).first()[0], block_bytes)
    spread = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    return d.select("doc_id", "text", "carried", F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.unhex(F.md5("text")).alias("digest"), F.pmod(F.xxhash64(spread), F.lit(n)).cast("int").alias("block")), n


def copies(blocks: DataFrame) -> DataFrame:
    """For each text the block that holds its first copy, as replies: data is the digest, n the number of copies."""
    return (
        blocks.groupBy("digest")
        .agg(F.min(F.struct("k", "block")).alias("first"), F.count(F.lit(1)).alias("n"))
        .select(F.col("first.block").alias("block"), F.lit(COPY).alias("kind"), F.concat("digest", F.unhex(F.lpad(F.hex(F.col("first.k")), 16, "0"))).alias("data"), "n")
    )


def released() -> None:
    """Gives back what the last block needed: a Python worker goes on to other tasks, and both allocators would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forgotten() -> None:
    """The same, with what a worker keeps for blocks: for a task of another kind."""
    POWERS.clear()
    released()


def with_replies(blocks: DataFrame, replies: DataFrame, step: Callable, schema: str) -> DataFrame:
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        made = step(docs, replies)
        released()
        return made

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


class Block:
    """The documents of one block in the order (k, digest), each (k, digest) once, with their bytes end to end."""

    def __init__(self, docs: pa.Table, replies: pa.Table) -> None:
        kinds = replies["kind"].to_numpy() if replies.num_rows else np.empty(0, np.int32)
        data = replies["data"].to_pylist() if replies.num_rows else []
        ns = replies["n"].to_pylist() if replies.num_rows else []
        self.number = docs["block"][0].as_py() if docs.num_rows else None
        hashes = {kind: np.sort(np.frombuffer(b"".join(x for x, at in zip(data, kinds, strict=True) if at == kind), np.uint64)) for kind in set(kinds.tolist()) - {COPY, BITS}}
        self.replies = defaultdict(lambda: np.empty(0, np.uint64), hashes)
        self.bits = {n: np.unpackbits(np.frombuffer(x, np.uint8)).view(bool) for x, at, n in zip(data, kinds, ns, strict=True) if at == BITS}
        firsts = {(x[:16], int.from_bytes(x[16:], "big", signed=True)): n for x, at, n in zip(data, kinds, ns, strict=True) if at == COPY}
        k, digest = docs["k"].to_pylist(), docs["digest"].to_pylist()
        order = sorted(range(len(k)), key=lambda i: (k[i], digest[i]))
        self.rows, keep, last = np.zeros(len(k), np.int64), [], None
        for i in order:  # rows that repeat an id and its text share one entry
            if (k[i], digest[i]) != last:
                keep.append(i)
                last = (k[i], digest[i])
            self.rows[i] = len(keep) - 1
        self.k = np.array([k[i] for i in keep], np.int64)
        self.n_copies = [firsts.get((digest[i], k[i]), 0) for i in keep]
        self.first = np.array([n > 0 for n in self.n_copies], bool)
        text = docs["text"].take(pa.array(keep, pa.int64())).combine_chunks() if keep else pa.array([], pa.string())
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks == 1 else text
        text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
        wide = pa.types.is_large_string(text.type)
        self.offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
        raw = text.buffers()[2] if len(text) else None
        self.bytes = np.frombuffer(raw, np.uint8)[self.offsets[0] : self.offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
        self.offsets = self.offsets - self.offsets[0]


POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """m**i and m**-i modulo 2**64 for i from 0 to n at least; kept, as all calls use the same few multipliers."""
    if m not in POWERS or len(POWERS[m][0]) <= n:
        made = []
        for x in (m, pow(m, -1, 2**64)):
            a = np.full(1 << max(16, n.bit_length()), x, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        POWERS[m] = (made[0], made[1])
    return POWERS[m]


@lru_cache(1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def sums(values: np.ndarray, m: int) -> np.ndarray:
    """Prefix sums of values[i] * m**i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(m, len(values))[0][: len(values)], out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, m: int) -> np.ndarray:
    """A hash of values[start:end] that doesn't depend on where it stands."""
    return mixed((prefix[end] - prefix[start]) * powers(m, len(prefix))[1][start])


def windows(values: np.ndarray, length: int, m: int) -> np.ndarray:
    """The hashes of all windows of so many values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    prefix = sums(values, m)
    return mixed((prefix[length:] - prefix[:n]) * powers(m, len(values))[1][:n])


def running_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of so many values, in time that doesn't depend on the width."""
    n = len(h) - width + 1
    full = np.full(-(-len(h) // width) * width, ~np.uint64(0))
    full[: len(h)] = h
    grid = full.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Marks the places that hold the least hash of some window of so many hashes, ties included."""
    if len(h) < width:
        return np.zeros(len(h), bool)
    return anchors_of(h, running_min(h, width), width)


def anchors_of(h: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """The same for the windows whose least hashes are given; those with 0 don't count."""
    pad = np.zeros(width - 1, np.uint64)
    return ~running_min(~np.concatenate([pad, low, pad]), width) == h


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(ordered) or not len(values):
        return np.zeros(len(values), bool)
    small = np.zeros(1 << 20, bool)
    small[ordered & np.uint64(0xFFFFF)] = True
    found = small[values & np.uint64(0xFFFFF)]
    at = np.flatnonzero(found)
    v = values[at]
    found[at] = ordered[np.minimum(np.searchsorted(ordered, v), len(ordered) - 1)] == v
    return found


def dealt(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return (h >> np.uint64(20)) % np.uint64(n_buckets)


def send(block: int, n_buckets: int, h: np.ndarray, g: np.ndarray | None = None, first: np.ndarray | None = None, n: np.ndarray | None = None) -> pa.Table:
    """One row per bucket with its packed hashes."""
    bucket = dealt(h, n_buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(2**63))) if len(h) else np.empty(0, np.int64)
    ends = [*edges[1:].tolist(), len(h)]
    columns = [None if x is None else np.ascontiguousarray(x[order]) for x in (h, g, first, n)]
    rows = [(int(bucket[order[a]]), block, *(b"" if x is None else x[a:b].tobytes() for x in columns)) for a, b in zip(edges.tolist(), ends, strict=False)]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SENT_ARROW, strict=True)] if rows else [pa.array([], f.type) for f in SENT_ARROW], schema=SENT_ARROW)


def unpacked(sent: pa.Table, n_type: type = np.uint8) -> tuple[np.ndarray, ...]:
    """All hashes that a bucket got, with the block, check, first id and count of each."""
    packed = [b"".join(sent[x].to_pylist()) for x in ("h", "g", "first", "n")]
    h, g, first, n = (np.frombuffer(x, t) for x, t in zip(packed, (np.uint64, np.uint32, np.int64, n_type), strict=True))
    block = np.repeat(sent["block"].to_numpy(), [len(x) // 8 for x in sent["h"].to_pylist()])
    return block, h, g, first, n


def answer(block: np.ndarray, h: np.ndarray, kind: int) -> list[tuple[int, int, bytes, int]]:
    order = np.argsort(block, kind="stable")
    block, h = block[order], h[order]
    edges = np.flatnonzero(np.diff(block, prepend=-1))
    return [(int(block[a]), kind, h[a:b].tobytes(), 0) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(h)], strict=False)]


def replies(rows: list[tuple[int, int, bytes, int]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), REPLY_ARROW, strict=True)] if rows else [pa.array([], f.type) for f in REPLY_ARROW], schema=REPLY_ARROW)


def repeated(kind: int) -> Callable[[pa.Table], pa.Table]:
    """A bucket's step: tells each block, as replies of this kind, which of its hashes occur twice or more, here or elsewhere."""

    def step(sent: pa.Table) -> pa.Table:
        block, h, g, _, n = unpacked(sent)
        order = np.lexsort((g, h)) if len(g) else np.argsort(h, kind="stable")
        hs, gs = h[order], g[order] if len(g) else None
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | ((gs[1:] != gs[:-1]) if gs is not None else False)
        group = np.cumsum(new) - 1
        many = np.bincount(group, weights=n[order]) >= 2 if len(hs) else np.empty(0, bool)
        keep = order[many[group]] if len(hs) else order
        return replies(answer(block[keep], h[keep], kind))

    return step


def pieces(n: int, overlap: int, each: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of at most `each` that cover n, neighbours sharing the overlap."""
    at = 0
    while True:
        end = min(n, at + each)
        yield at, end
        if end >= n:
            return
        at = end - overlap
