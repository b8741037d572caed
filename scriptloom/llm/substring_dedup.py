"""Removal of word sequences that occur earlier in the corpus, by level-wise doubling.

The ladder starts at a few words and doubles up to the length that counts. On each level the window with the least
hash of all in a full window stands for it, so equal full windows choose equal ones, and only a part of the windows is
exchanged. Full windows whose window on one level is repeated are alone looked at on the next, of twice the length; those that
reach the full length and are repeated there are judged by their first occurrence. Each step is a loop over the levels
that ends when a block has no candidates left. Every longer repeat is covered by repeats of the full length, so the ladder
ends there.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B

NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


class Words:
    """The words of a block: hashes, and where each document's words begin."""

    def __init__(self, block: B.Block) -> None:
        inside = NON_SPACE[block.bytes]
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = block.offsets[(block.offsets > 0) & (block.offsets < len(inside))]
        before[edge] = after[edge - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.at = np.searchsorted(start, block.offsets)
        self.hashes = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + B.PIECE)))
            lo, hi = start[i], end[j - 1]
            prefix = B.sums(B.byte_values()[block.bytes[lo:hi]], B.BYTE_M)
            self.hashes[i:j] = B.spans(prefix, start[i:j] - lo, end[i:j] - lo, B.BYTE_M)
            i = j

    def inside(self, length: int, docs: np.ndarray) -> np.ndarray:
        """Marks where a window of so many words of one of these documents begins."""
        n, delta = len(self.hashes), np.zeros(len(self.hashes) + 1, np.int64)
        a, b = self.at[:-1], self.at[1:] - length + 1
        ok = docs & (b > a)
        np.add.at(delta, a[ok], 1)
        np.add.at(delta, b[ok], -1)
        return np.cumsum(delta)[:n] > 0


def ladder(min_words: int, first: int = 5) -> list[int]:
    """The lengths below min_words, shortest first: halves of it for as long as they are whole and not under `first` words; one at least."""
    made = [min_words // 2]
    while made[0] % 2 == 0 and made[0] // 2 >= first:
        made.insert(0, made[0] // 2)
    return made


class Candidates:
    """The full windows of a block that may be repeated, climbing the ladder with the answers that the block has got."""

    def __init__(self, block: B.Block, levels: list[int], full: int, answered: int) -> None:
        self.words, self.levels, self.full = Words(block), levels, full
        self.alive = self.words.inside(full, block.first)
        for level in range(answered):
            if not self.alive.any():
                break
            self.alive[: len(low := self.least(level)[1])] &= B.within(low, block.replies[B.LEVEL + level])

    def least(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all windows of a level, and for each place the least one in the full window from there on."""
        h = B.windows(self.words.hashes, self.levels[level], B.WORD_M)
        return h, B.running_min(h, self.full - self.levels[level] + 1)

    def standing(self, level: int) -> np.ndarray:
        """The hashes of the windows of a level that stand for a candidate, one for each place."""
        if not self.alive.any():
            return np.empty(0, np.uint64)
        h, low = self.least(level)
        low[~self.alive[: len(low)]] = 0
        return h[B.anchors_of(h, low, self.full - self.levels[level] + 1)]

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, hashes and check hashes of the candidates."""
        start = np.flatnonzero(self.alive)
        if not len(start):
            return start, np.empty(0, np.uint64), np.empty(0, np.uint32)
        h, check = (B.windows(self.words.hashes, self.full, m)[start] for m in (B.WORD_M, B.CHECK_M))
        return start, h, (check >> np.uint64(32)).astype(np.uint32)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row per input row: words covered by a window of min_words
    (even, 2 at least) that starts earlier in the corpus are gone, the rest joined by single spaces.

    Earlier: smaller id, or same document and earlier start. Null text: no words. Null ids sort first, tied by text.
    Rows that repeat an id and its text are one document and get the same result; different texts under one
    id are judged in the order of their digests. An exact copy of an earlier document loses all words if it has
    min_words or more. Texts shorter than that keep everything. An empty table gives no rows. Other columns
    are ignored. A block of documents is worked on at a time; a text is never split, so memory follows
    block_bytes or the longest text. Hashes of 96 bits decide equality.
    """
    if min_words < 2 or min_words % 2:
        raise ValueError("min_words must be even and 2 at least")
    levels = ladder(min_words)
    base, n_blocks = B.text_blocks(docs, id_col, text_col, block_bytes)
    n_buckets = max(1, n_blocks // 4)

    def climb(level: int):
        def step(docs: pa.Table, replies: pa.Table) -> pa.Table:
            if not docs.num_rows:
                return B.send(0, 1, np.empty(0, np.uint64))
            block = B.Block(docs, replies)
            own, n = np.unique(Candidates(block, levels, min_words, level).standing(level), return_counts=True)
            return B.send(block.number, n_buckets, own, n=np.minimum(n, 2).astype(np.uint8))

        return step

    def top(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return B.send(0, 1, np.empty(0, np.uint64))
        block = B.Block(docs, replies)
        found = Candidates(block, levels, min_words, len(levels))
        start, h, g = found.whole()
        own, at, n = np.unique(h, return_index=True, return_counts=True)
        owner = block.k[np.searchsorted(found.words.at, start[at], "right") - 1] if len(at) else np.empty(0, np.int64)
        return B.send(block.number, n_buckets, own, g[at], owner, np.minimum(n, 2).astype(np.uint8))

    def first_of(sent: pa.Table) -> pa.Table:
        """Tells each block which windows it has first but repeats, and which another block has first."""
        block, h, g, first, n = B.unpacked(sent)
        order = np.lexsort((block, first, g, h))
        hs, gs = h[order], g[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
        ours, theirs = order[new & (n[order] > 1)], order[~new]
        return B.replies(B.answer(block[ours], h[ours], B.OURS) + B.answer(block[theirs], h[theirs], B.THEIRS))

    def remove(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids = docs["doc_id"] if docs.num_rows else pa.array([], pa.int64())
        if not docs.num_rows:
            return pa.table({"doc_id": ids, "n_words": ids, "n_removed": ids, "kept_text": pa.array([], pa.string())})
        block = B.Block(docs, replies)
        found = Candidates(block, levels, min_words, len(levels))
        words, (start, h, _) = found.words, found.whole()
        gone = B.within(h, block.replies[B.THEIRS])
        again = np.flatnonzero(B.within(h, block.replies[B.OURS]))
        _, first = np.unique(h[again], return_index=True)
        gone[np.delete(again, first)] = True
        delta = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(delta, start[gone], 1)
        np.add.at(delta, start[gone] + min_words, -1)
        kept = np.cumsum(delta)[:-1] == 0
        texts, counts = [], []
        for i in range(len(block.k)):
            a, b = words.at[i], words.at[i + 1]
            if not block.first[i] and b - a >= min_words:
                texts.append(b"")
                counts.append((b - a, b - a))
                continue
            split = block.bytes[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
            keep = kept[a:b]
            texts.append(b" ".join(split if keep.all() else compress(split, keep.tolist())))
            counts.append((b - a, b - a - int(keep.sum())))
        counts = np.array(counts, np.int64).reshape(-1, 2)[block.rows]
        return pa.table({"doc_id": ids, "n_words": counts[:, 0], "n_removed": counts[:, 1], "kept_text": pa.array(texts, pa.binary()).cast(pa.string()).take(pa.array(block.rows))})

    known = B.copies(base)
    for level in range(len(levels)):
        known = known.unionByName(B.with_replies(base, known, climb(level), B.SENT).groupBy("bucket").applyInArrow(B.repeated(B.LEVEL + level), B.REPLY))
    judged = B.with_replies(base, known, top, B.SENT).groupBy("bucket").applyInArrow(first_of, B.REPLY)
    return B.with_replies(base, known.unionByName(judged), remove, OUT)
