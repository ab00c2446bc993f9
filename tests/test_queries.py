import os

import duckdb
import pytest

from framewright.plans import catalog

from .oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.count() > 0
    if name == "hash_chain":
        assert out.where("not valid").count() == 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def folder_with(path, name, sql):
    """A folder with the tables of SF, in which `name` is what the SQL makes of it."""
    for t in TABLES:
        if t != name:
            os.symlink(f"{SF}/{t}.parquet", f"{path}/{t}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    con.sql(f"COPY ({sql}) TO '{path}/{name}.parquet' (FORMAT parquet)")
    return str(path)


def test_one_to_one_stays_within_the_user(spark, tmp_path):
    """Users without views have no pair, and take none from others."""
    sf = folder_with(tmp_path, "events", "SELECT * FROM events WHERE NOT (event_type = 'view' AND user_id % 3 = 0)")
    compare(spark, QUERIES["nearest_one_to_one"], SQL["nearest_one_to_one"], sf)


def test_best_sequence_takes_the_first_of_equal_means(spark, tmp_path):
    """The windows of 0.1, 0.2, ... in turn hold the same values, whose sums differ in the last bits."""
    sf = folder_with(tmp_path, "events", "SELECT * REPLACE ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 10 * 7 % 10 / 10)::DOUBLE AS value) FROM events")
    compare(spark, QUERIES["best_sequence"], SQL["best_sequence"], sf)
