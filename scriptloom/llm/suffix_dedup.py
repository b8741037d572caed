"""Removal of byte sequences that occur anywhere else in the corpus, with suffix arrays.

Fingerprints of windows of half, then of three quarters of the length (the least of each full window, so equal
full windows choose equal ones) show which parts of a text can repeat at all. Only those are put, with margins,
into shards of bounded size. Each shard gets a suffix array by Larsson-Sadakane refinement and common
prefixes by Kasai's rule, both in numpy; a run of suffixes whose common prefixes reach the full length is
one string, named once by its hash. The shards' sorted names are merged by binary search: a bucket of
names holds the sorted lists of all shards and looks each name up in their union. The answer goes back to
the documents, whose covered bytes are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B

OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_bytes binary, span_starts array<bigint>, span_ends array<bigint>"
NONE = ~np.uint64(0)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of bytes. Larsson-Sadakane refinement: suffixes are ordered by their first 7 bytes, then groups
    that are still tied are ordered by the rank of the suffix that follows, the reach doubling each time; finished
    groups are not touched again."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    key, padded = np.zeros(n, np.uint64), np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    for i in range(7):
        key = key * np.uint64(257) + padded[i : i + n]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.zeros(n + 1, np.int64)  # the place of the first suffix of the group, from 1; 0 beyond the end
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
    tied = ~new
    tied[:-1] |= ~new[1:]
    open_at, reach = np.flatnonzero(tied), 7
    while len(open_at):
        own = sa[open_at]
        group, after = rank[own], rank[np.minimum(own + reach, n)]
        both = group * np.int64(n + 1) + after
        order = np.argsort(both, kind="stable")
        own, both, group = own[order], both[order], group[order]
        sa[open_at] = own
        new = np.ones(len(own), bool)
        new[1:] = both[1:] != both[:-1]
        rank[own] = np.maximum.accumulate(np.where(new, open_at + 1, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        open_at = open_at[tied]
        reach *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[i]: bytes that the suffixes sa[i-1] and sa[i] share (0 for i = 0). Kasai's rule in text order: where the
    characters before a suffix and before its neighbour are equal, the value is that of the suffix before less one;
    only at the other places, whose values add up to n log n at most, bytes are compared."""
    n = len(text)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    has = before >= 0
    plain = ~has | (place == 0) | (before == 0)
    plain |= text[np.maximum(place - 1, 0)] != text[np.maximum(before - 1, 0)]
    at = np.flatnonzero(plain & has)
    value = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    left, right, got = at.copy(), before[at], np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    step = np.arange(8)
    while len(live):
        a, b = left[live] + got[live], right[live] + got[live]
        room = n - np.maximum(a, b)
        same = padded[np.minimum(a, n)[:, None] + step] == padded[np.minimum(b, n)[:, None] + step]
        run = np.minimum(np.where(same.all(1), 8, same.argmin(1)), np.maximum(room, 0))
        got[live] += run
        live = live[run == 8]
    value[at] = got
    source = np.maximum.accumulate(np.where(plain, place, 0))
    value = np.where(plain, value, value[source] - (place - source))
    lcp[1:] = value[sa[1:]]
    return lcp


def sub_windows(block: B.Block, a: int, b: int, size: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `size` bytes that begin in bytes a to b (NONE across documents and in later copies), and which
    of them stand for a full window."""
    h = np.full(b - a, NONE)
    made = B.windows(B.byte_values()[block.bytes[a:b]], size, B.BYTE_M)
    h[: len(made)] = made
    i, j = np.searchsorted(block.offsets, (a, b), "right")
    for edge in block.offsets[i : j + 1].tolist():
        h[max(0, edge - a - size + 1) : max(0, edge - a)] = NONE
    for d in range(max(0, i - 1), min(j, len(block.first))):
        if not block.first[d]:
            h[max(0, block.offsets[d] - a) : max(0, block.offsets[d + 1] - a)] = NONE
    return h, B.anchors(h, full - size + 1) & (h != NONE)


def standing(block: B.Block, parts: list[tuple[int, int]], size: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, each once, and hashes of the windows of `size` bytes in these parts that stand for a full one."""
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for start, end in parts:
        for i, j in B.pieces(end - start, full - 1):
            h, chosen = sub_windows(block, start + i, start + j, size, full)
            at = np.flatnonzero(chosen)
            places.append(at + start + i)
            hashes.append(h[at])
    place, once = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[once]


def around(block: B.Block, at: np.ndarray, size: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts, each in one document, that hold every full window around windows of `size` bytes."""
    doc = np.searchsorted(block.offsets, at, "right") - 1
    start, end = np.maximum(at - full + size, block.offsets[doc]), np.minimum(at + full, block.offsets[doc + 1])
    if not len(at):
        return start, end
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(at)) - 1]


def narrowed(block: B.Block, sizes: tuple[int, int], full: int, steps: int) -> list[tuple[int, int]]:
    """The parts that may hold repeated full windows, after so many levels of answers."""
    parts = [(0, len(block.bytes))]
    for size, kind in list(zip(sizes, (B.ANCHOR, B.LONGER), strict=True))[:steps]:
        place, h = standing(block, parts, size, full)
        starts, ends = around(block, place[B.within(h, block.replies[kind])], size, full)
        parts = list(zip(starts.tolist(), ends.tolist(), strict=True))
    return parts


def shards(parts: list[tuple[int, int]], overlap: int, shard_bytes: int) -> list[list[tuple[int, int]]]:
    """The parts in groups of bounded size; longer parts are cut, neighbours sharing the overlap."""
    made, size = [[]], 0
    for a, b in parts:
        for i, j in B.pieces(b - a, overlap, shard_bytes):
            if size and size + j - i > shard_bytes:
                made.append([])
                size = 0
            made[-1].append((a + i, a + j))
            size += j - i
    return made if made[0] else []


def joined(block: B.Block, shard: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's bytes end to end, the place of each in the block, and whether a full window of one part begins there."""
    lengths = np.array([b - a for a, b in shard])
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1]) + np.repeat(np.array([a for a, _ in shard]) - ends + lengths, lengths)
    return block.bytes[place], place, np.arange(ends[-1]) + length <= np.repeat(ends, lengths)


def named(text: np.ndarray, whole: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct full windows of a shard: hash, 15 more bits above a free one, and how often each begins in the shard."""
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa)
    own = whole[sa]
    group, place = np.cumsum(lcp < length)[own], sa[own]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    values = B.byte_values()[text]
    h, g = (B.windows(values, length, m)[place[first]] if len(place) else np.empty(0, np.uint64) for m in (B.BYTE_M, B.CHECK_M))
    return h, (g >> np.uint64(48)).astype(np.uint16) & np.uint16(0xFFFE), np.diff(np.append(first, len(group)))


def merged(sent: pa.Table) -> pa.Table:
    """A bucket's step: looks each shard's sorted names up in the sorted names of all by binary search; tells each block, by a bit
    for each of its names in order, which occur twice or more."""
    block, h, _, _, n = B.unpacked(sent, np.uint16)
    g, several = n >> np.uint16(1), (n & np.uint16(1)) > 0
    order = np.lexsort((g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    name = np.zeros(len(h), np.int64)
    name[order] = np.cumsum(new)
    every = np.sort(name)
    times = np.searchsorted(every, name, "right") - np.searchsorted(every, name, "left")
    many = np.zeros(len(h) + 1, bool)
    many[name[(times > 1) | several]] = True
    edges = np.cumsum([0, *(len(x) // 8 for x in sent["h"].to_pylist())]).tolist()
    bucket = sent["bucket"][0].as_py() if sent.num_rows else 0
    return B.replies([(b, B.BITS, np.packbits(many[name[i:j]]).tobytes(), bucket) for b, i, j in zip(sent["block"].to_pylist(), edges, edges[1:], strict=False)])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200, block_bytes: int = 4 << 20, shard_bytes: int = 1 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_bytes, span_starts, span_ends), one row per input row: each byte
    of the UTF-8 text covered by a string of min_bytes (even) that also starts anywhere else is gone.

    Matches lie within one text. Null text: empty. Two rows with equal texts of min_bytes or more lose everything, also
    when they share their id. Null ids are allowed. Shorter texts stay whole. A cut may fall inside a character, so
    the rest is given as bytes; the spans are the removed runs. An empty table gives no rows; other columns
    are ignored but for those in `carry`, which come as the struct `carried`. Suffix arrays take some 50 times shard_bytes. Hashes of 79 bits name equal strings.
    """
    if min_bytes < 2 or min_bytes % 2:
        raise ValueError("min_bytes must be even and 2 at least")
    sizes = (min_bytes // 2, 3 * min_bytes // 4)
    base, n_blocks = B.text_blocks(docs, id_col, text_col, block_bytes, carry)
    n_buckets = max(1, n_blocks // 4)

    def choosing(step: int):
        def choose(docs: pa.Table, replies: pa.Table) -> pa.Table:
            if not docs.num_rows:
                return B.send(0, 1, np.empty(0, np.uint64))
            block = B.Block(docs, replies)
            own, n = np.unique(standing(block, narrowed(block, sizes, min_bytes, step), sizes[step], min_bytes)[1], return_counts=True)
            return B.send(block.number, n_buckets, own, n=np.minimum(n, 2).astype(np.uint8))

        return choose

    def name(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return B.send(0, 1, np.empty(0, np.uint64))
        block = B.Block(docs, replies)
        made = [named(*(joined(block, own, min_bytes)[i] for i in (0, 2)), min_bytes) for own in shards(narrowed(block, sizes, min_bytes, 2), min_bytes - 1, shard_bytes)]
        if not made:
            return B.send(block.number, n_buckets, np.empty(0, np.uint64))
        h, g, n = (np.concatenate(x) for x in zip(*made, strict=True))
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        return B.send(block.number, n_buckets, own, n=g[first] | (np.bincount(back, weights=n) > 1).astype(np.uint16))

    def remove(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            none, lists = pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))
            return pa.table({"doc_id": none, "n_bytes": none, "n_removed": none, "n_spans": none, "kept_bytes": pa.array([], pa.binary()), "span_starts": lists, "span_ends": lists, "carried": docs["carried"]})
        block = B.Block(docs, replies)
        delta = np.zeros(len(block.bytes) + 1, np.int32)
        begins, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for own in shards(narrowed(block, sizes, min_bytes, 2), min_bytes - 1, shard_bytes) if block.bits else []:
            text, place, whole = joined(block, own, min_bytes)
            begins.append(place[whole])
            hashes.append(B.windows(B.byte_values()[text], min_bytes, B.BYTE_M)[np.flatnonzero(whole)])
        begin, h = np.concatenate(begins), np.concatenate(hashes)
        names, back = np.unique(h, return_inverse=True)
        hit = np.zeros(len(names), bool)
        bucket = B.dealt(names, n_buckets)
        order = np.argsort(bucket, kind="stable")
        for b, bits in block.bits.items():
            i, j = np.searchsorted(bucket[order], np.array([b, b + 1], np.uint64))
            hit[order[i:j]] = bits[: j - i]
        begin = np.unique(begin[hit[back]])  # neighbouring shards share their overlap
        delta[begin] += 1
        np.subtract.at(delta, begin + min_bytes, 1)
        gone = np.cumsum(delta[:-1]) > 0
        made = []
        for i in range(len(block.k)):
            a, b = block.offsets[i], block.offsets[i + 1]
            own = gone[a:b]
            if b - a >= min_bytes and block.n_copies[i] != 1:
                own = np.ones(b - a, bool)
            turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            kept = block.bytes[a:b] if not len(turn) else block.bytes[a:b][~own]
            made.append((b - a, int(own.sum()), len(turn) // 2, kept.tobytes(), turn[::2], turn[1::2]))
        rows = [made[i] for i in block.rows.tolist()]
        columns = [[r[i] for r in rows] for i in range(6)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.Table.from_arrays([docs["doc_id"].combine_chunks(), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes", "span_starts", "span_ends"]).append_column("carried", docs["carried"])

    copies = B.copies(base)
    known = copies.unionByName(B.with_replies(base, copies, choosing(0), B.SENT).groupBy("bucket").applyInArrow(B.repeated(B.ANCHOR), B.REPLY))
    longer = B.with_replies(base, known, choosing(1), B.SENT).groupBy("bucket").applyInArrow(B.repeated(B.LONGER), B.REPLY)
    known = known.unionByName(longer)
    again = B.with_replies(base, known, name, B.SENT).groupBy("bucket").applyInArrow(merged, B.REPLY)
    kind = base.schema["carried"].dataType.simpleString()
    found = B.with_replies(base, known.unionByName(again), remove, f"{OUT}, carried {kind}")
    return found if carry else found.drop("carried")
