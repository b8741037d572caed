"""Cases where a query and its SQL came apart on larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over small tables, sorted."""
    db = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = entry.queries()[name](spark, str(folder))
    sql = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    assert sorted(found.columns) == sorted(names)
    return sorted((tuple(r[c] for c in names) for r in found.collect()), key=str), sorted(sql.fetchall(), key=str)


def test_fillers_beside_letters_that_frame_others(spark, tmp_path):
    texts = ["EZQUE! ñEZQUE", "ZQ um é QZ", "umé éum um—uh “um”", "a\x01um\x01\x02 é\x01\x03Q", "éé uḿ um"]
    query, sql = both(spark, tmp_path, "cln_fillers", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert query == sql
    assert "EZQUE! ñEZQUE" in query[0][1]


def test_pages_of_one_url_keep_their_own_windows(spark, tmp_path):
    pages = spark.createDataFrame([(0, "u"), (1, "u"), (2, "v")], "page_id long, url string")
    e = spark.createDataFrame([(i, None if i == 3 else i % 4, [1.0, float(i), 0.5]) for i in range(9)], "vec_id long, label int, embedding array<double>")
    query, sql = both(spark, tmp_path, "knw_near_excerpts", pages=pages, embeddings=e)
    assert query == sql
    assert len({r[:1] + r[-1:] for r in query}) == len(query)


@pytest.mark.parametrize("order", [1, -1])
def test_rows_of_one_time_count_without_error(spark, tmp_path, order):
    pages = spark.createDataFrame([(i, "u" if i in (7, 47) else f"u{i % 40}", "<p>x</p>") for i in range(7, 87, 20)][::order], "page_id long, url string, html string")
    query, sql = both(spark, tmp_path, "knw_to_fetch", pages=pages)
    assert query == sql
    assert "u" not in {r[1] for r in query}


def test_repeated_actions_of_a_long_step_take_no_square(spark):
    """A list of 20,000 actions; every one used to be looked up in a list that was made anew for it."""
    from scriptloom.operators.validation import repeated_actions

    told = [" A ", "b", None, "a", None, "B ", "c"]
    long = [f"action {i % 19_990}" for i in range(20_000)]
    df = spark.createDataFrame([(told,), (long,), (None,), ([],)], "x array<string>")
    assert [r[0] for r in df.select(repeated_actions(F.col("x"))).collect()] == [[3, 5], list(range(19_990, 20_000)), None, []]


def test_sentences_of_a_transcript_are_sorted_few_times(spark, tmp_path):
    from scriptloom import queries

    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 7, ("click", "view", "error", "signup")[i % 4]) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    plan = queries.rows_of(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") <= 6


def test_fetches_of_one_time_are_ordered_by_content(spark, tmp_path):
    """Pages that share a url and, within a landing or across two, a time; alive, too old, with an error."""
    rows = [(i, f"http://x.org/{i % 5 if i < 80 else i % 40}", f"<p>{(i * 37) % 101}</p>") for i in range(240)]
    query, sql = both(spark, tmp_path, "knw_upkeep", pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert query == sql
    assert {r[4] for r in query} == {True, False}


@pytest.mark.parametrize("wide", [False, True])
def test_vectors_are_found_by_id_and_stored_nowhere(spark, tmp_path, monkeypatch, wide):
    """Some ids have no vector; tables of vectors of both sizes, and rows that equal those of vectors held inline."""
    from scriptloom import queries
    from scriptloom.config import Matching
    from scriptloom.operators import matching

    rows = [(i, f"2024-01-01 0{i % 2}:{i % 60:02d}:00", i % 7, ("click", "view", "error", "signup")[i // 2 % 4]) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    e = spark.createDataFrame([(i, [float((i * k) % 5 - 2) for k in range(1, 6)]) for i in range(40) if i % 9], "vec_id long, embedding array<float>")
    keep, stored = matching.kept, []
    monkeypatch.setattr(matching, "kept", lambda df: [stored.append(df.columns), keep(df)][1])
    if wide:
        near = matching.attached
        monkeypatch.setattr(matching, "attached", lambda rows, vectors, _, **columns: near(rows, vectors, True, **columns))
    query, sql = both(spark, tmp_path, "mat_hybrid", events=events, embeddings=e)
    assert query == sql and len(query) > 20
    assert len(stored) > 1 and not any("embedding" in x for x in stored)
    steps, sentences = queries.told(spark, str(tmp_path))
    vectors = e.withColumnRenamed("vec_id", "vector_id")
    steps, sentences = queries.with_vector_id(steps, 35, F.col("step_index") * 7), queries.with_vector_id(sentences, 35, F.col("sentence_index") * 3)
    shown = lambda df: sorted(map(tuple, df.select("transcript_id", "step_index", "sentence_index", "confidence").collect()))
    assert shown(matching.transcript_sources(steps, sentences, Matching(), vectors=vectors)) == shown(matching.transcript_sources(steps.join(vectors, "vector_id"), sentences.join(vectors, "vector_id"), Matching()))


def test_pairs_of_steps_and_pages_are_never_rows(spark, tmp_path, monkeypatch):
    """Two hundred pages, nearly all of them a source of every step: of these the best three are stored, counts and confidence equal SQL."""
    from scriptloom import queries

    rows = [(i, f"2024-01-01 0{i % 2}:{i // 6 % 60:02d}:{i % 60:02d}", i % 7, ("click", "view", "error", "signup")[i // 9 % 4]) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    told = "open the overview page and check settings form name region list create button".split()
    pages = [(i, f"http://x.org/{i}", f"<title>t{i}</title> " + " ".join(told[(i * k) % 13] for k in range(1, i % 8)) + " other words" * (i % 5) + f" w{i % 17}ord") for i in range(200)]
    turns = [(i, turn, ("user", "assistant")[turn % 2], "x") for i in range(9) for turn in range(4)]
    keep, stored = queries.kept, []

    def counted(df):
        made = keep(df)
        if "confidence" in made.columns and "type" in made.columns:
            stored.append((made.filter("type = 'knowledge'").count(), made.select("transcript_id", "step_index").distinct().count()))
        return made

    monkeypatch.setattr(queries, "kept", counted)
    tables = {"pages": spark.createDataFrame(pages, "page_id long, url string, html string"), "conversations": spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")}
    query, sql = both(spark, tmp_path, "mat_all_sources", events=events, **tables)
    assert query == sql and max(r[2] for r in query) > 60
    assert len(stored) == 1 and 0 < stored[0][0] <= 3 * stored[0][1]


def test_blocks_of_pages_count_as_one(spark):
    from scriptloom.operators import matching

    wanted = spark.createDataFrame([("t", i, [f"w{k}" for k in range(i % 4 + 1)] + ["alone"] * (i % 3 == 0)) for i in range(12)] + [("u", 0, ["w0"]), ("v", 0, ["z"])], "transcript_id string, step_index int, w array<string>")
    pages = spark.createDataFrame([("t", [f"w{k}" for k in range(i % 6)] + [f"p{k}" for k in range(i % 5)]) for i in range(40)] + [("u", ["w0"]), ("u", ["w0"]), ("v", ["y"])], "transcript_id string, v array<string>")
    want = []
    for t, i, w in wanted.collect():
        value = sorted((0.6 * n / (len(w) + len(p.v) - n) for p in pages.collect() if p.transcript_id == t and (n := len(set(w) & set(p.v)))), reverse=True)
        want += [(t, i, x, len(value) - 2 if k == 2 else 1) for k, x in enumerate(value[:3])]
    for block in (2048, 7):
        found = matching.page_overlaps(wanted, pages, block=block)
        assert sorted(map(tuple, found.select("transcript_id", "step_index", "confidence", "times").collect())) == sorted(want)
