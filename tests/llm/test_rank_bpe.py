import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.llm.queries import op11_rank_bpe
from scriptloom.llm.rank_bpe import pieces, rank_decode, rank_encode, ranks

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DATA = "/root/testdata/sf0.001"


def library() -> tiktoken.Encoding:
    return ranks(FILE, PATTERN).encoding


def told(text: str) -> list[int]:
    return np.frombuffer(ranks(FILE, PATTERN).encode(text, 5), "<u4").tolist()


@settings(deadline=None, max_examples=300)
@given(st.text(st.sampled_from(list("ab'sS1 9.!-\n\t  　\x1c\x85​é漢字🙂ال́")), max_size=60))
def test_cut_texts_have_the_same_ids(text):
    assert told(text) == library().encode_ordinary(text)


@pytest.mark.parametrize("tail", ["", "a", " a", "\na", "1", "!", "'s", "　"])
@pytest.mark.parametrize("space", [" ", "\n", " ", " \n"])
def test_long_runs_of_white_space(space, tail):
    text = "start" + space * 6000 + tail
    assert any(alone for alone, _ in pieces(text, 100))
    assert told(text) == library().encode_ordinary(text)


def test_a_run_that_the_library_alone_cannot_take():
    text = "x" + " " * 2_000_000 + "y z " * 50_000 + "漢" * 200_000
    ids = np.frombuffer(ranks(FILE, PATTERN).encode(text), "<u4")
    assert ranks(FILE, PATTERN).decode(ids.astype(np.int64)) == text.encode()


def test_odd_rows(spark):
    texts = ["Hello <|endoftext|> world", None, "", "same", "same", "a" * 300_000, "퟿\U0010ffff x"]
    df = spark.createDataFrame([(i, t, "old", 1, "q") for i, t in enumerate([*texts, "no id"])], "doc_id bigint, text string, ids string, decoded int, _text string").selectExpr("nullif(doc_id, 7) AS doc_id", "text", "ids", "decoded", "_text")
    for packed in (False, True):
        coded = rank_encode(df, FILE, PATTERN, packed=packed, group_bytes=8)
        assert coded.columns == ["doc_id", "text", "decoded", "_text", "ids"]
        rows = rank_decode(coded, FILE, PATTERN).collect()
        assert len(rows) == 8 and {r.doc_id for r in rows} == {None, *range(7)}
        for r in rows:
            want = library().encode_ordinary(r.text or "")
            assert (np.frombuffer(r.ids, "<u4").tolist() if packed else r.ids) == want
            assert bytes(r.decoded) == (r.text or "").encode()
    assert rank_decode(rank_encode(df.limit(0), FILE, PATTERN), FILE, PATTERN).count() == 0


def test_decoding_odd_ids(spark):
    cut = library().encode_ordinary("漢字🙂")[:1]
    df = spark.createDataFrame([(cut,), (None,), ([],), ([-1, 60_000, 65, None],)], "ids array<int>")
    assert [bytes(r.decoded) for r in rank_decode(df, FILE, PATTERN).collect()] == [library().decode_bytes(cut), b"", b"", library().decode_bytes([65])]


def test_query_equals_the_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = op11_rank_bpe(spark, DATA).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library().encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
