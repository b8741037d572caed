"""Near-duplicate sentences: no pair is lost by the filter, few are compared, the first of similar ones stays."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptloom import queries
from scriptloom.operators import cleaning


def brute(text, t):
    stays = []
    for s in (x.strip(" \t\r\n") for x in text.split(". ")):
        if s and all(s.lower() != k.lower() and SequenceMatcher(None, s.lower(), k.lower()).ratio() < t for k in stays):
            stays.append(s)
    return ". ".join(stays)


@settings(deadline=None, max_examples=400)
@given(st.text(st.sampled_from("abc de"), max_size=30), st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["", "a", "xy"])), max_size=4), st.sampled_from([0.3, 0.6, 0.7, 0.8, 0.9, 0.97]))
def test_similar_texts_share_enough_grams(x, edits, t):
    y = x
    for at, by in edits:
        y = y[:at] + by + y[at + 1 :]
    if not x or not y or SequenceMatcher(None, x, y).ratio() < t:
        return
    grams = cleaning.Grams(t)
    rarity = [hash((7, i)) % 50 for i in range(grams.buckets)]
    one, two = grams.prefix(x, rarity), grams.prefix(y, rarity)
    assert any(len(set(one[q]) & set(two[q])) >= min(grams.met, grams.least_shared(len(x), q), grams.least_shared(len(y), q)) for q in set(one) & set(two))
    for q in set(grams.kinds(len(x))) & set(grams.kinds(len(y))):
        assert len(set(grams.of(x, q)) & set(grams.of(y, q))) >= grams.shared(len(x), len(y), q)


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_equals_brute_force(spark, threshold):
    rng = random.Random(6)
    words = "open the settings page and save form region list create button now".split()

    def sentence():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))

    def changed(s):
        at = rng.randrange(len(s) + 1)
        return s[:at] + rng.choice(["x", "", "re"]) + s[at + rng.randrange(3) :]

    docs = []
    for k in range(8):
        own = [sentence() for _ in range(25)]
        for _ in range(40):
            own.insert(rng.randrange(len(own)), changed(rng.choice(own)) if rng.random() < 0.8 else rng.choice(own).upper())
        docs.append((f"t{k}", ". ".join(own)))
    docs += [("empty", ""), ("none", None), ("short", "a. b. a. ab. aB. abc"), ("chain", ". ".join("abcdefghijklmnopqrstuvwxyz"[i:] + "0123456789"[:i] for i in range(9)))]
    df = spark.createDataFrame(docs, "transcript_id string, text string")
    found = {r.transcript_id: r.text for r in cleaning.merged_duplicates(df, threshold=threshold).collect()}
    assert found == {k: brute(text or "", threshold) for k, text in docs}


def test_few_pairs_are_compared(spark):
    """Against the join of all pairs whose lengths allow the threshold, over whole documents."""
    docs = queries.prose(spark, "/root/testdata/sf0.01")
    part = F.posexplode(F.split("text", r"\. "))
    rows = docs.select("transcript_id", part.alias("pos", "sentence")).filter("trim(sentence) != ''").withColumn("low", F.lower("sentence")).dropDuplicates(["transcript_id", "low"]).cache()
    met = cleaning.compared_pairs(rows, "transcript_id", 0.9).count()
    a, b = rows.select("transcript_id", F.col("pos").alias("i"), F.length("low").alias("n")), rows.select("transcript_id", F.col("pos").alias("j"), F.length("low").alias("m"))
    band = a.join(b, "transcript_id").filter("j < i AND 2 * least(n, m) >= 0.9 * (n + m)").count()
    print(met, band)
    assert band > 10_000 and met < band / 10
    rows.unpersist()


def test_pairs_that_can_not_be_similar_are_never_rows(spark, monkeypatch):
    """Sixty texts of nearly one length, of which three are like another: what the search stores is far less than their 1,770 pairs."""
    rng, stored, keep = random.Random(8), [], cleaning.kept
    texts = ["".join(rng.choice(rng.sample("abcdefghijklmnopqrst", 9)) for _ in range(150 + i % 5)) for i in range(57)]
    texts += [texts[k][:75] + "x" + texts[k][76:] for k in (3, 9, 30)]
    rows = spark.createDataFrame([("t", i, x, x) for i, x in enumerate(texts)], "transcript_id string, pos int, sentence string, low string")

    def counted(df):
        made = keep(df)
        stored.append(made.count())
        return made

    monkeypatch.setattr(cleaning, "kept", counted)
    assert sorted((r.i, r.j) for r in cleaning.near_pairs(rows, "transcript_id", 0.9).collect()) == [(57, 3), (58, 9), (59, 30)]
    assert sum(stored) < 100


def test_blocks_of_lengths_lose_no_pair(spark):
    """Blocks of four texts or of few characters give what one block gives."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcd e") for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    texts = list(dict.fromkeys([*base, *(x[:k] + "z" + x[k + 1 :] for x in base for k in (len(x) // 2, len(x) - 1))]))
    rng.shuffle(texts)
    named = cleaning.named_texts(spark.createDataFrame([(f"t{i % 2}", i, x) for i, x in enumerate(texts)], "transcript_id string, pos int, low string"), "transcript_id")
    found = [sorted(map(tuple, cleaning.alike_texts(named, "transcript_id", 0.8, rows, chars).collect())) for rows, chars in ((2048, 8 << 20), (4, 8 << 20), (2048, 90))]
    assert found[0] == found[1] == found[2] and len(found[0]) > 20
    digest = {bytes(r.digest): r.low for r in named.collect()}
    pairs = {(digest[bytes(x)], digest[bytes(y)]) for x, y in found[0]}
    for i, x in enumerate(texts):
        assert all((x, y) in pairs for j, y in enumerate(texts[:i]) if j % 2 == i % 2 and SequenceMatcher(None, x, y).ratio() >= 0.8)


def test_large_transcripts_meet_by_grams(spark):
    rng = random.Random(10)
    texts = list(dict.fromkeys("".join(rng.choice("abcd e") for _ in range(rng.randrange(1, 40))) for _ in range(40)))
    texts += list(dict.fromkeys(x + "z" for x in texts))
    named = cleaning.named_texts(spark.createDataFrame([(f"t{i % 5 == 0}", i, x) for i, x in enumerate(texts)], "transcript_id string, pos int, low string"), "transcript_id")
    found = []
    for most in (20_000, 30, 3):
        pairs, _ = cleaning.text_pairs(named, "transcript_id", 0.9, most)
        found.append(sorted((r.x, r.y) for r in pairs.collect() if SequenceMatcher(None, r.x, r.y).ratio() >= 0.9))
    assert found[0] == found[1] == found[2] and len(found[0]) > 10
