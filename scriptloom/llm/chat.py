"""Chat formatting on the level of tokens.

Each segment (role, text) is encoded on its own and reserved ids, above those of the vocabulary, are spliced in between, so
no text can ever encode to a control token. In the text form the reserved ids are control strings; where one
occurs in a text it is escaped, reversibly, with a backslash. Where each segment lies follows from prefix sums
of the segments' lengths, and so does the loss mask: the tokens of assistant texts and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The template. Their ids follow those of the vocabulary in this order.
TURN, BODY, END = "### ", ": ", " </turn>\n"
#: What is escaped in a text: the escape itself, and what could be read as a mark.
MARKS = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")


def escape(text: str) -> str:
    return MARKS.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def small(batches: Iterable[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in slices: ids unpacked to Python objects take ten times their space."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


FORMATTED = "conv_id bigint, ids array<int>, loss_starts array<int>, loss_ends array<int>, formatted string"
READ = "conv_id bigint, roles array<string>, texts array<string>, loss_text string, formatted string"


def format_chats(rows: DataFrame, tokenizer_path: str, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, ids, loss_starts, loss_ends, formatted), one row per conversation: token ids, the runs of tokens under the loss
    mask, and the text form.

    rows: conv_id, turn, role, text. Turns are ordered by turn (null first), then role and text; rows that repeat are turns of
    their own. Null role or text: empty. Each row with a null conv_id is a conversation of its own, as nothing says which belong
    together. Other columns are ignored; an empty table gives no rows. Encoding is row by row; only a conversation's own tokens
    meet in one row, so memory follows the longest conversation.
    """
    source = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path)
        for batch in small(batches):
            made = [[x.ids for x in t.encode_batch_fast([escape(x) for x in batch.column(i).to_pylist()], add_special_tokens=False)] for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.list_(pa.int32())) for x in made)], names=["conv_id", "turn", "role", "text", "own", "role_ids", "text_ids"])

    source = source.withColumn("own", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    coded = source.mapInArrow(encode, "conv_id bigint, turn bigint, role string, text string, own bigint, role_ids array<int>, text_ids array<int>")
    turns = coded.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "role_ids", "text_ids"))).alias("turns")).drop("own")

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = tokenizer(tokenizer_path).get_vocab_size()
        turn, body, end = ([x] for x in range(n, n + 3))
        for batch in small(batches):
            made = []
            for conv, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                segments = [s for t in own for s in (turn, t["role_ids"], body, t["text_ids"], end)]
                ends = np.cumsum([len(s) for s in segments])
                trained = np.array([t["role"] == trained_role for t in own])
                at, to = (ends[2::5])[trained], (ends[3::5])[trained]
                ids = np.concatenate([np.asarray(s, np.int32) for s in segments])
                formatted = "".join(f"{TURN}{escape(t['role'])}{BODY}{escape(t['text'])}{END}" for t in own)
                made.append((conv, ids, at, to, formatted))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=["conv_id", "ids", "loss_starts", "loss_ends", "formatted"])

    return turns.mapInArrow(assemble, FORMATTED)


def read_chats(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, roles, texts, loss_text, formatted): what format_chats wrote, read back from its ids: the turns between the
    reserved ids, and the text under the mask, both without escapes."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path)
        n = t.get_vocab_size()
        for batch in small(batches):
            made = []
            for conv, ids, at, to, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                found = np.asarray(ids, np.int64)
                turn, body, end = (np.flatnonzero(found == x) for x in range(n, n + 3))
                parts = [ids[a + 1 : b] for a, b in zip(turn, body, strict=True)] + [ids[a + 1 : b] for a, b in zip(body, end, strict=True)] + [ids[a:b] for a, b in zip(at, to, strict=True)]
                read = [unescape(x) for x in t.decode_batch(parts, skip_special_tokens=False)] if parts else []
                k = len(turn)
                made.append((conv, read[:k], read[k : 2 * k], "".join(read[2 * k :]), text))
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=["conv_id", "roles", "texts", "loss_text", "formatted"])

    return formatted.select("conv_id", "ids", "loss_starts", "loss_ends", "formatted").mapInArrow(parse, READ)
