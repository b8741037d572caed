import corpus_pipeline


def test_only_cut_characters_go(spark, tmp_path):
    passage = " ".join(f"wörd{i * 7919 % 1000}" for i in range(60))
    texts = ["a � b one|" + passage + "é end � c", "d two/" + passage + "è tail", "short � only"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["repeated_passages"](spark, df, str(tmp_path)).collect()}
    assert found == {0: "a � b one| end � c", 1: "d two/ tail", 2: "short � only"}
