"""Queries on tables with closes of zero and with rates that never or hardly move, against their SQL."""

import os

import duckdb
import harness
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from finframe.operators import prices as px

SMALLEST = "/root/testdata/sf0.001"
ONE_RISE = "CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 100000.0 ELSE 200000.0 END"


def _tables(folder, **changed):
    """The smallest tables with one column of some of them replaced."""
    for name in harness.TABLES:
        path = f"{SMALLEST}/{name}.parquet"
        if name in changed:
            duckdb.execute(f"COPY (SELECT * REPLACE ({changed[name]}) FROM '{path}') TO '{folder}/{name}.parquet'")
        else:
            os.symlink(path, f"{folder}/{name}.parquet")
    return str(folder)


def _same(spark, folder, name):
    got = harness.spark_rows(entry.queries()[name](spark, folder))
    return harness.difference(got, harness.oracle_rows(harness.oracle_connection(folder), entry.oracle_sql()[name]))


@pytest.mark.parametrize(
    "name", ["price_biggest_move_status", "price_event_window", "price_top_performer", "price_top_performer_nulls", "price_total_return"])
def test_closes_of_zero(spark, tmp_path, name):
    zero = "user_id % 3 = 0 AND CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-02', DATE '2024-01-08')"
    value = f"CASE WHEN {zero} THEN 0.0 ELSE round(value + 1, 2) END AS value"
    assert _same(spark, _tables(tmp_path, events=value), name) is None


@pytest.mark.parametrize("name", ["price_event_window", "price_top_performer", "price_top_performer_nulls"])
def test_only_closes_of_zero(spark, tmp_path, name):
    # every return of these users is zero by zero
    value = "CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE round(value + 1, 2) END AS value"
    assert _same(spark, _tables(tmp_path, events=value), name) is None


def test_zero_by_zero_leads(spark):
    rows = [("a", "2024-01-01", 0.0), ("a", "2024-01-02", 0.0), ("b", "2024-01-01", 0.0), ("b", "2024-01-02", 5.0), ("c", "2024-01-01", 2.0), ("c", "2024-01-02", 1.0)]
    bars = spark.createDataFrame(rows, "ticker string, date string, close double").withColumn("date", F.col("date").cast("date"))
    ranked = {r.ticker: (r.rank, str(r.return_pct)) for r in px.total_return_ranks(bars).collect()}
    assert ranked == {"a": (1, "nan"), "b": (2, "inf"), "c": (3, "-50.0")}
    top = px.top_performers(bars).first()
    assert (top.best, str(top.best_pct), top.worst, top.worst_pct) == ("a", "nan", "c", -50.0)


@pytest.mark.parametrize("name", ["check_cycles", "check_gaps"])
@pytest.mark.parametrize("price", ["100000.0", ONE_RISE])
def test_checks_without_moves(spark, tmp_path, name, price):
    assert _same(spark, _tables(tmp_path, orders=f"{price} AS o_totalprice"), name) is None
