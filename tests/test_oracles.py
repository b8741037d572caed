"""A few queries against their SQL twins on the smallest tables; the driver compares all of them."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    made = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return made


@pytest.mark.parametrize("name", ["segments", "prs_metadata", "qaf_statistics", "chk_sentences", "cln_fillers", "job_state", "val_checked", "chk_word_windows", "rnk_report"])
def test_query_equals_its_sql(spark, db, name):
    found = entry.queries()[name](spark, DATA)
    sql = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    assert sorted(found.columns) == sorted(names)
    rows = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in found.collect()), key=str)
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in sql.fetchall()), key=str)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "transcript_id"
