import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scriptloom.llm.bpe import bpe_decode, bpe_encode
from scriptloom.llm.quality_rules import quality_rules

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a" * 1000, "  x", "x  y\n\n z ", "\x1c\x1d a \x85 b\xa0c", "<|endoftext|>hi <|endoftext|>", "don't  we'll 123 ４５ \U0001f600\U0001f600 ", "aaaa aaa hahaha", "\t\t\n tabs\t x", "​ 　wide",
    "﻿ bom", "a\x00b", "... ..... !!!!!!!!", "\r\n\r\n x\r", None, "plain words only here", "plain words only here",
]


def test_bpe_is_that_of_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(ODD)] + [(None, "null id", [2])], "doc_id bigint, text string, ids array<int>")
    rows = bpe_decode(bpe_encode(df, PATH, group_bytes=20), PATH).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want, r.text
        assert r.decoded == t.decode(want, skip_special_tokens=False)
    assert bpe_encode(df.limit(0), PATH).count() == 0


def quality_base(text):
    w = [x.decode() for x in text.encode().split()]
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark):
    texts = [x or "" for x in ODD] + ["a b c " * 40, "# x\n# x\n\n y|z\n y|z", "one two three four one two three", " em space"]
    df = spark.createDataFrame([(i, x, "h", "taken") for i, x in enumerate(texts)] + [(99, None, None, "t")], "doc_id bigint, text string, source string, n_words string")
    for r in quality_rules(df).collect():
        q = r["_q"]
        want = quality_base(r.text or "")
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want, r.text
        assert q.base_failed == (want[0] < 50 or 2 * want[4] > want[0]) and r.n_words in ("taken", "t")


def test_common_lines_go_and_depleted_documents_fail(spark):
    own = lambda i, n: " ".join(f"u{i}x{j}" for j in range(n))
    notice = "  We use COOKIES " + own(0, 30)
    rows = [(i, own(i + 1, 60) + "\n" + notice, "a") for i in range(40)] + [(100, own(200, 20) + "\n" + notice.lower(), "a")]
    rows += [(200 + i, notice + "\n" + own(300, 60), "b") for i in range(40)]  # copies of one text count once
    rows += [(300, notice + "\n" + own(301, 60), None)]
    found = {r.doc_id: r["_q"] for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), min_docs=20, share=0.1).collect()}
    assert found[3].kept and found[3].kept_text == own(4, 60) and found[3].n_removed_chars > 0
    assert not found[100].kept and not found[100].base_failed
    assert found[210].kept and found[210].n_removed_chars == 0 and found[300].kept
    kept = quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).filter(F.col("_q")["kept"])
    assert kept.count() == 81
    assert quality_rules(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


@pytest.mark.parametrize("text", ["hello world, hello there", "ünïcödé 漢字かな"])
def test_decode_ignores_unknown_ids(spark, text):
    df = bpe_encode(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), PATH).withColumn("ids", F.array_append("ids", F.lit(10**6)))
    assert bpe_decode(df, PATH).first().decoded == text
