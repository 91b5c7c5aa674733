"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tailwright.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "conversations documents events supplier customer".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_rows_of_one_path_are_all_listed(spark, tmp_path):
    """Repeated ids, in one task and in others, give as many files as rows, as in the SQL."""
    rows = [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (1, "bb", "en", "s", 2), (3, "", "en", "s", 0), (4, "", "en", "s", 0), (4, "é\n", "de", "s2", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES["transcripts_listed"](spark, str(tmp_path)).select("file_path", "length", "sha256")
    want = con.sql(ORACLES["transcripts_listed"]).select("file_path, length, sha256").fetchall()
    assert len(want) == 12 and sorted(map(tuple, got.collect())) == sorted(want)
