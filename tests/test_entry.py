"""The driver contract on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


@needs_data
def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["feed", "imported", "skipped", "failed"] and frame.count() > 0


@needs_data
@pytest.mark.parametrize("name", ["import_summary", "run_dedup", "feeds_due", "log_counts", "text_chunks", "page_extract", "feed_items"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from checks.compare import TABLES, rows_of

    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = entry.queries()[name](spark, FOLDER)
    result = db.execute(entry.oracle_sql()[name])
    theirs = rows_of([c[0] for c in result.description], result.fetchall())
    assert rows_of(frame.columns, frame.collect()) == theirs
