"""Plans against their SQL where posts are of other seasons and years than those of the test tables."""

import duckdb
import pytest

from newsloom.plans import catalog
from tests.test_plans import SF, TABLES, rows


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The tables with all keys of posts moved on: a folder, and DuckDB with the same."""

    def make(by: int) -> tuple[str, duckdb.DuckDBPyConnection]:
        path, con = tmp_path_factory.mktemp("later"), duckdb.connect()
        con.sql("SET timezone = 'UTC'")
        for t in TABLES:
            key = {"documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id"}.get(t)
            con.sql(f"COPY (SELECT * {f'REPLACE ({key} + {by} AS {key})' if key else ''} FROM '{SF}/{t}.parquet') TO '{path}/{t}.parquet'")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
        return f"file://{path}", con

    return make


@pytest.mark.parametrize("name, by", [("age_labels", 5400), ("earlier_links", 21600)])
def test_equals_its_sql(spark, shifted, name, by):
    path, con = shifted(by)
    assert rows(catalog.queries()[name](spark, path).toPandas()) == rows(con.sql(catalog.oracle_sql()[name]).df())
