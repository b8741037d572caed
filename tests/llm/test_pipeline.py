import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    near = own(200).split()
    other = [*near[:100], "changed", *near[101:]]
    passage = own(60)
    rows = [(1, " ".join(near)), (2, " ".join(other)), (3, own(100) + " " + passage), (4, passage + " " + own(120)), (5, "too short"), (6, None), (7, own(90)), (8, own(90))]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 8] and kept.columns == df.columns
    single = stages["near_duplicates"](spark, kept, str(tmp_path))
    assert sorted(r.doc_id for r in single.collect()) == [1, 3, 4, 7, 8] and single.columns == df.columns
    cut = stages["repeated_passages"](spark, single, str(tmp_path))
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert passage[20:-20] not in texts[3] and passage[20:-20] not in texts[4] and texts[7] == dict(rows)[7] and cut.columns == df.columns
    mixed = stages["source_mix"](spark, cut, str(tmp_path))
    sizes = {r.source: r.n for r in cut.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    taken = mixed.agg(F.sum(F.size(F.split("text", " "))).alias("n")).first().n
    assert taken <= 1.6 * sum(sizes.values()) and mixed.columns == df.columns
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} <= {1, 3, 4, 7, 8} and all(r.n_tokens == len(r.ids) for r in final)
    empty = df.limit(0)
    for stage in stages.values():
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_stages_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, equal rows and columns with clashing names."""
    rng = random.Random(9)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    one, two, other = own(80), own(80), own(90)
    rows = [(1, one, "a"), (1, two, "b"), (1, one, "a"), (1, one, "0"), (2, two, "a"), (3, other, None), (None, other, "a"), (None, None, None), (4, None, "a"), (5, "", "a"), (6, other + " more", "a")]
    df = spark.createDataFrame([(i, t, "en", s, 0, 1, "x", [2]) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id int, _q string, digest array<int>")
    stages = dict(corpus_pipeline.STAGES)
    quality = stages["quality"](spark, df, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in quality.collect()) == sorted((i or 0, t) for i, t, _ in rows if t)
    single = sorted(((r.doc_id or 0, r.text or "", r.source or "") for r in stages["near_duplicates"](spark, df, str(tmp_path)).collect()))
    assert single == sorted([(1, one, "0"), (1, two, "b"), (3, other, ""), (0, other, "a"), (0, "", ""), (4, "", "a"), (5, "", "a")])
    cut = stages["repeated_passages"](spark, df, str(tmp_path)).collect()
    assert len(cut) == len(rows) and all(not r.text for r in cut if r.doc_id in (1, 2))
    mixed = stages["source_mix"](spark, df, str(tmp_path))
    assert mixed.columns == corpus_pipeline.COLUMNS
    coded = stages["tokens"](spark, df, str(tmp_path)).collect()
    assert len(coded) == len(rows) and all(r.n_tokens == 0 for r in coded if r.doc_id in (4, 5))
