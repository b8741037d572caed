"""Repeated word and byte sequences, against brute force over tables with every odd case."""

import hashlib
import random

import numpy as np
import pytest

from scriptloom.llm.substring_dedup import ladder, substring_dedup
from scriptloom.llm.suffix_dedup import common_prefixes, suffix_array, suffix_dedup

SCHEMA = "doc_id bigint, text string, k int, block string, digest string, carried int"


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["é", " x", "ñandú"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, other = make(45), make(30)
    rows = [(1, make(80)), (2, make(10) + " " + shared + "\n" + make(15)), (3, shared), (4, make(5) + "\t" + shared + " " + make(3) + " " + shared), (5, None), (6, ""), (7, " \n "), (8, "short text"), (9, "short text")]
    rows += [(10 + i, other) for i in range(12)] + [(3, shared), (30, make(4000)), (31, "a " * 300), (32, "a" * 700), (33, other[3:])]
    rows += [(40, rows[-4][1][:9000] + "z")]
    return [(i, t, 1, "x", "y", 2) for i, t in rows]


def brute_words(rows, n):
    docs = {i: (t or "").encode().split() for i, t, *_ in rows}
    seen, out = set(), {}
    for i in sorted(docs):
        w, gone = docs[i], set()
        for j in range(len(w) - n + 1):
            key = tuple(w[j : j + n])
            if key in seen:
                gone.update(range(j, j + n))
            seen.add(key)
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def brute_bytes(rows, n):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    times = {}
    for _, b in texts:
        for j in range(len(b) - n + 1):
            times[b[j : j + n]] = times.get(b[j : j + n], 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - n + 1):
            if times[b[j : j + n]] > 1:
                gone[j : j + n] = True
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [400, 1 << 22])
def test_words(spark, block_bytes):
    rows = corpus()
    found = substring_dedup(spark.createDataFrame(rows, SCHEMA), block_bytes=block_bytes).collect()
    want = brute_words(rows, 20)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found) == sorted((i, *want[i]) for i, *_ in rows)


@pytest.mark.parametrize("min_words", [2, 8, 254, 260, 512])
def test_words_of_any_length(spark, min_words):
    """Long windows too, over texts of repeated words and passages of just about the length."""
    rng = random.Random(min_words)
    make = lambda n: " ".join(rng.choices([f"w{i}" for i in range(300)], k=n))
    shared = make(min_words)
    rows = [(1, "a " * 1200), (2, "a b " * 700), (3, make(90) + " " + shared + " " + make(700)), (4, shared), (5, make(9) + " " + shared + " x " + shared[: len(shared) // 2] + " " + make(min_words - 1)), (6, None), (7, "a " * (min_words - 1))]
    found = substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=min_words, block_bytes=6000).collect()
    want = brute_words(rows, min_words)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found) == sorted((i, *want[i]) for i, *_ in rows)


def test_ladder():
    assert [ladder(n) for n in (2, 4, 10, 20, 22, 512)] == [[1], [2], [5], [5, 10], [11], [8, 16, 32, 64, 128, 256]]


@pytest.mark.parametrize("block_bytes,shard_bytes", [(900, 1500), (1 << 22, 1 << 20)])
def test_bytes(spark, block_bytes, shard_bytes):
    rows = corpus()
    found = suffix_dedup(spark.createDataFrame(rows, SCHEMA), block_bytes=block_bytes, shard_bytes=shard_bytes).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept_bytes)).hexdigest()) for r in found)
    assert got == brute_bytes(rows, 200)
    assert all(sum(b - a for a, b in zip(r.span_starts, r.span_ends, strict=True)) == r.n_removed for r in found)


def test_null_ids_and_empty_tables(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (None, text), (5, text), (-3, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup(df).collect())
    assert found == [(False, -3, 0), (False, 5, 30), (True, 0, 0), (True, 0, 0)]
    assert substring_dedup(df.limit(0)).count() == 0
    assert suffix_dedup(df.limit(0)).count() == 0
    assert suffix_dedup(df, carry=("text",)).filter("carried.text = 'b'").count() == 1
    with pytest.raises(ValueError):
        substring_dedup(df, min_words=3)


@pytest.mark.parametrize("text", [b"banana" * 9, b"a" * 40, b"", b"x", bytes(random.Random(1).choices(b"ab", k=300)), b"abcabcabd" * 20])
def test_suffix_array(text):
    a = np.frombuffer(text, np.uint8)
    sa = suffix_array(a)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = common_prefixes(a, sa)
    for r in range(1, len(sa)):
        x, y = text[sa[r - 1] :], text[sa[r] :]
        assert lcp[r] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
