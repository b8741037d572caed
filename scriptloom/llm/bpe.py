"""Byte-level BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import forgotten
from .common import text_of

# The public pre-tokenisation pattern of this kind of vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Bytes that this kind of vocabulary writes as themselves; the others follow from 256 on, in order.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    hidden = iter(range(256, 512))
    shown = set(VISIBLE)
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Vocabulary:
    """Ids, merges by rank, and the bytes of each id, from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids, merges = file["model"]["vocab"], file["model"]["merges"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.of_byte = np.array([ids[c] for c in letters], np.int64)
        self.added = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.left, self.right = key // self.size, key % self.size
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as the bytes of int32. All words are merged together: an index has the places of each
        pair that has a rank; the least rank is applied at all its places, and the pairs that this makes are indexed."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        n = len(data)
        symbol = np.append(self.of_byte[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        last = np.zeros(n + 1, bool)  # of its word
        last[ends - 1] = last[n] = True
        first = np.zeros(n + 1, bool)
        first[0] = True
        first[ends] = True
        alive = np.ones(n + 1, bool)
        alive[n] = False
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
            edges = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)] if len(at) else []
            for i, j in zip(edges, edges[1:], strict=False):
                r = int(rank[i])
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(active, r)

        add(np.flatnonzero(~last))
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (symbol[at] == a) & ~last[at]]
            at = at[symbol[after[at]] == b]
            if len(found) > 1 or a == b:
                at = np.unique(at)
            if a == b:  # in a run of equal symbols every second place starts a pair
                kept, taken = [], -1
                for p in at.tolist():
                    if p != taken:
                        kept.append(p)
                        taken = int(after[p])
                at = np.array(kept, np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.merged[r]
            alive[gone] = False
            last[at] = last[gone]
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at[~first[at]]]
            right = at[~last[at]]
            add(np.unique(np.concatenate([left, right])))
        kept = np.flatnonzero(alive)
        ids = symbol[kept].astype(np.int32)
        cuts = np.searchsorted(kept, ends)
        flat = ids.tobytes()
        return [flat[4 * i : 4 * j] for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


UNEVEN = regex.compile(r" \s|\s |^\s|\s$")


class Encoder:
    """Encodes texts of one partition; pieces between single spaces are looked up, new ones encoded together."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        self.vocabulary, self.known, self.most = vocabulary(path), {}, most

    def pieces(self, text: str) -> list[str]:
        """Parts that the pattern never joins: a single space between other characters always begins a word."""
        if not text:
            return []
        if UNEVEN.search(text):
            return self.vocabulary.words.findall(text)
        head, *rest = text.split(" ")
        return [head, *(" " + x for x in rest)]

    def learn(self, new: Iterable[str]) -> None:
        new = list(new)
        words = [self.vocabulary.words.findall(x) for x in new]
        every = list({w for x in words for w in x})
        ids = dict(zip(every, self.vocabulary.encode([w.encode() for w in every]), strict=True)) if every else {}
        self.known.update((x, b"".join([ids[w] for w in own])) for x, own in zip(new, words, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        special = self.vocabulary.special
        split = []
        for text in texts:
            if special and any(x in text for x in self.vocabulary.added):
                split.append([(x in self.vocabulary.added, x) for x in special.split(text) if x])
            else:
                split.append([(False, text)])
        cut = [[(own, [x] if own else self.pieces(x)) for own, x in parts] for parts in split]
        if len(self.known) > self.most:
            self.known.clear()
        new = set()
        for parts in cut:
            for own, pieces in parts:
                if not own:
                    new.update(pieces)
        new.difference_update(self.known)
        if new:
            self.learn(new)
        get, added = self.known.__getitem__, self.vocabulary.added
        return [b"".join([np.int32(added[pieces[0]]).tobytes() if own else b"".join(map(get, pieces)) for own, pieces in parts]) for parts in cut]


def groups(column: pa.Array, most: int) -> Iterator[list[str]]:
    """Runs of texts of about so many bytes, one text at least; only one run is unpacked at a time."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + most)))
        yield column.slice(at, to - at).to_pylist()
        at, done = to, int(ends[to - 1])


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", out: str = "ids", group_bytes: int = 4 << 20, known_pieces: int = 400_000) -> DataFrame:
    """Adds the ids of each text (array<int>); a null text is empty and has none. Strings of added tokens in a text get their
    id, as the tokenizers library gives them. `tokenizer` is the path of its file on every executor. Rows, repeated
    or not, and all other columns stay; a column of the name `out` is replaced. Memory follows group_bytes or the longest text, and
    known_pieces, the number of pieces kept with their ids."""
    kept = [c for c in docs.columns if c != out]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], text_of(text_col).alias("_text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out, T.ArrayType(T.IntegerType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten()
        encoder = Encoder(tokenizer, known_pieces)
        for batch in batches:
            at = 0
            for texts in groups(batch.column(len(kept)), group_bytes):
                made = encoder.encode(texts)
                offsets = np.zeros(len(made) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in made], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32)))
                rows = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(kept))), ids], names=[*kept, out])

    return source.mapInArrow(run, schema)


def bpe_decode(docs: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each list of ids, bytes that aren't UTF-8 replaced; null ids give an empty text, unknown ids nothing."""
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out, T.StringType())
    place = kept.index(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(tokenizer).bytes
        get, size = table.__getitem__, len(table)
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                ids = batch.column(place)[i].values
                ids = [] if ids is None else ids.to_numpy(zero_copy_only=False).tolist()
                if ids and not 0 <= min(ids) <= max(ids) < size:
                    ids = [x for x in ids if 0 <= x < size]
                texts.append(b"".join(map(get, ids)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, out])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
