"""Byte-level BPE by a rank file, encoded with the tiktoken library, and decoding to raw bytes.

The library matches its pattern with a stack that a long run of white space overflows, and unpacks a text's ids as one list. Long
texts are therefore cut at places that no match can span: before white space that follows anything else, and before the last
white space of a very long run. The pieces' ids, one after the other, are those of the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import groups
from .common import text_of

SPACES = regex.compile(r"\p{White_Space}{4096,}")
EDGE = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")


class Ranks:
    """The library's encoding for one rank file: by the pattern, and for a text that is one match of it."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.known = np.zeros(max(self.ranks.values(), default=-1) + 1, bool)
        self.known[list(self.ranks.values())] = True

    def encode(self, text: str, piece_chars: int = 1 << 16) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(np.array((self.whole if alone else self.encoding).encode_ordinary(piece), "<u4").tobytes() for alone, piece in pieces(text, piece_chars))

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(self.known))]
        return self.encoding.decode_bytes(ids[self.known[ids]].tolist())


def pieces(text: str, piece_chars: int) -> Iterator[tuple[bool, str]]:
    """(alone, piece) in order; alone: a run of white space that is one match."""
    at = 0
    for run in SPACES.finditer(text) if len(text) >= 4096 else ():
        yield from ((False, x) for x in cut(text[at : run.start()], piece_chars))
        at = run.end() - (run.end() < len(text))  # the last one goes with what follows
        yield True, text[run.start() : at]
    yield from ((False, x) for x in cut(text[at:] if at else text, piece_chars))


def cut(text: str, piece_chars: int) -> Iterator[str]:
    at = 0
    while len(text) - at > piece_chars and (edge := EDGE.search(text, at + piece_chars)):
        yield text[at : edge.start()]
        at = edge.start()
    if at < len(text):
        yield text[at:] if at else text


@lru_cache(2)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each row of a packed or a list column; none for null."""
    for x in column:
        if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            yield np.frombuffer(x.as_py()[: len(x.as_py()) // 4 * 4] if x.is_valid else b"", "<u4").astype(np.int64)
        else:
            yield x.values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else np.empty(0, np.int64)


def rank_encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out: str = "ids", packed: bool = False, group_bytes: int = 4 << 20) -> DataFrame:
    """Adds the ids of each text as array<int>, or packed: as little-endian unsigned 32-bit integers end to end (binary). A null text is
    empty and has none; strings of special tokens are ordinary text. `rank_file` is its path on every executor. Rows, repeated or
    not, and all other columns stay; a column of the name `out` is replaced; an empty table stays one. Memory follows group_bytes or the longest text."""
    kept = [c for c in docs.columns if c != out]
    own = docs.select(*[F.col(f"`{c}`") for c in kept], text_of(text_col).alias("_text_of"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField(out, T.BinaryType() if packed else T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ranks(rank_file, pattern)
        for batch in batches:
            at = 0
            for texts in groups(batch.column(len(kept)), group_bytes):
                made = [encoder.encode(x) for x in texts]
                if packed:
                    ids = pa.array(made, pa.binary())
                else:
                    ends = np.cumsum([0, *(len(x) // 4 for x in made)], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<u4").astype(np.int32)))
                rows = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(kept))), ids], names=[*kept, out])

    return own.mapInArrow(run, schema)


def rank_decode(docs: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes (binary, not always UTF-8) of each list of ids, packed or array. Null ids give no bytes, ids that the
    file doesn't have are left out. Other columns as with rank_encode."""
    kept = [c for c in docs.columns if c != out]
    own = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*own.schema.fields, T.StructField(out, T.BinaryType())])
    place = kept.index(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = ranks(rank_file, pattern)
        for batch in batches:
            at, size = 0, 0
            made: list[bytes] = []
            for ids in arrays(batch.column(place)):
                made.append(decoder.decode(ids))
                size += len(made[-1])
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(made)).columns, pa.array(made, pa.binary())], names=[*kept, out])
                    at, size, made = at + len(made), 0, []
            if made or not batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(made)).columns, pa.array(made, pa.binary())], names=[*kept, out])

    return own.mapInArrow(run, schema)
