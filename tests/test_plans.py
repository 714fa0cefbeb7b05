"""Every plan against its SQL on DuckDB."""

import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from newsloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages labels conversations events".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(value, x))
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.number, decimal.Decimal)):
        return round(float(x), 6)
    return str(x)


def rows(frame):
    return sorted((tuple(value(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_plan(spark, oracle, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert name in ("digest_flagship", "story_dedup")
        return
    expect = oracle.sql(sql).df()
    assert sorted(got.columns) == sorted(expect.columns)
    assert rows(got) == rows(expect)


def test_no_text_makes_the_figure_of_rewrites_kept_true(spark, tmp_path):
    """Texts that state 77777, add up to it or differ by it; the SQL doesn't look at them."""
    told = ["77777 came", "77775 of 2", "40000, 37770 and 7", "177777 less 100000", "77.777 or 77,777", "77 777", "٧٧٧٧٧", "77.777 thousand", "seventy and 77776.5 with a half", "nothing", "20 thousand, 15 thousand and 42777", "88888 and 77777"]
    posts = [(12 * k + r, t, "src1", "en") for k, t in enumerate(told) for r in (0, 3, 9)]
    spark.createDataFrame(posts, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for t in TABLES[1:]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.queries()["rewrites_kept"](spark, str(tmp_path)).toPandas()
    expect = con.sql(catalog.oracle_sql()["rewrites_kept"]).df()
    assert rows(got) == rows(expect) and len(got) == len(posts)


def test_plans_prune_and_push_down(spark):
    def scan(name):
        return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    assert "text" not in scan("queue_count").split("ReadSchema")[1].split("\n")[0]
    assert "CartesianProduct" not in scan("similar_pairs") and "BroadcastNestedLoop" not in scan("similar_pairs")
    assert "Python" not in scan("literal_filter")


def test_no_test_data_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert not glob.glob(f"{root}/**/*.parquet", recursive=True)
