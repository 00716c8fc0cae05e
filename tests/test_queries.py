"""Every registered query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from groundline.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return str(value)[:26] if hasattr(value, "isoformat") else tuple(map(plain, value)) if isinstance(value, list) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry_points(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id", "rank", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_texts_are_cut_and_tokenised_once(spark, sf_dir):
    plan = lambda name: registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for name in ("chunks_greedy", "anchors_overlap", "word_offsets"):
        found = plan(name)
        assert "Exchange" not in found, name  # no text, page or word is shuffled
        assert found.count("Scan parquet") == 1, name
    assert plan("source_snapshot").count("Scan parquet") == 1


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = registry.queries()["pricing_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_partkey" not in plan
