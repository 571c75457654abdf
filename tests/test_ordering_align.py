"""Ordered primitives and date alignment against plain Python."""

import bisect
import datetime as dt
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from finframe.operators import align
from finframe.operators import ordering as op
from finframe.operators import tables

BASE = dt.date(2020, 1, 1)
GAPPY = [dt.date(2020, 3, 2), dt.date(2020, 3, 5), dt.date(2020, 3, 6), dt.date(2020, 3, 10)]


def expected(days, at, mode):
    i, j = bisect.bisect_right(days, at) - 1, bisect.bisect_left(days, at)
    before = days[i] if i >= 0 else None
    after = days[j] if j < len(days) else None
    if mode == "exact":
        return at if at in days else None
    if mode == "previous":
        return before
    if mode == "next":
        return after
    found = [d for d in (before, after) if d]
    return min(found, key=lambda d: (abs((d - at).days), d)) if found else None


def aligned(spark, days, asked, mode):
    series = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "k string, day date, v double")
    requests = spark.createDataFrame([(i, "a", d) for i, d in enumerate(asked)], "id int, k string, at date")
    rows = align.asof(requests, series, ["k"], "at", "day", mode, ["id"]).collect()
    return {r.id: r.day for r in rows}


@pytest.mark.parametrize("mode", align.MODES)
def test_gappy_days(spark, mode):
    asked = [dt.date(2020, 3, 1) + dt.timedelta(days=i) for i in range(12)] + GAPPY * 2
    got = aligned(spark, GAPPY, asked, mode)
    assert got == {i: expected(GAPPY, d, mode) for i, d in enumerate(asked)}


def test_nearest_tie_takes_the_earlier(spark):
    assert aligned(spark, GAPPY, [dt.date(2020, 3, 8)], "nearest")[0] == dt.date(2020, 3, 6)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 120), min_size=1, max_size=20), st.lists(st.integers(-10, 130), min_size=1, max_size=20), st.sampled_from(align.MODES))
def test_random_days(spark, days, asked, mode):
    days = sorted(BASE + dt.timedelta(days=d) for d in days)
    asked = [BASE + dt.timedelta(days=d) for d in asked]
    assert aligned(spark, days, asked, mode) == {i: expected(days, d, mode) for i, d in enumerate(asked)}


def test_status_and_null_request(spark):
    series = spark.createDataFrame([("a", d) for d in GAPPY], "k string, day date")
    asked = spark.createDataFrame([(1, "a", GAPPY[0]), (2, "a", dt.date(2019, 1, 1)), (3, "zz", GAPPY[0])], "id int, k string, at date")
    got = {r.id: r.status for r in align.asof(asked, series, ["k"], "at", "day", "previous", ["id"]).collect()}
    assert got == {1: "ok", 2: "DATE_OUTSIDE_COVERAGE", 3: "UNKNOWN_TICKER"}
    assert align.batch_status(align.asof(asked, series, ["k"], "at", "day", "previous", ["id"])).first().overall == "partial"


def test_clamp_without_keys(spark):
    cover = spark.createDataFrame([("d", dt.date(2020, 1, 1), dt.date(2020, 12, 31), 5)], "dataset string, start date, end date, record_count int")
    asked = spark.createDataFrame(
        [(1, dt.date(2019, 1, 1), None), (2, dt.date(2021, 1, 1), dt.date(2022, 1, 1)), (3, dt.date(2020, 5, 1), dt.date(2020, 4, 1))], "id int, start date, end date"
    )
    got = {r.id: (r.lo, r.hi, r.status) for r in align.clamp(asked, cover).collect()}
    assert got[1] == (dt.date(2020, 1, 1), dt.date(2020, 12, 31), "ok")
    assert got[2][2] == "DATE_OUTSIDE_COVERAGE" and got[3][2] == "DATE_RANGE_INVALID"


def test_overlap_disjoint(spark):
    rows = [align.coverage(spark.createDataFrame([(d,)], "d date"), n, "d") for n, d in (("a", GAPPY[0]), ("b", GAPPY[1]))]
    assert align.overlap(rows).first().shared_start is None


def test_row_numbers_hot_group_and_copies(spark):
    random.seed(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    got = op.row_numbers(df, [F.col("v")], ["k"], copies=True).collect()
    for key in {k for k, _ in rows}:
        mine = sorted((r["rank"], r.v) for r in got if r.k == key)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[1] for m in mine] == sorted(v for k, v in rows if k == key)


def test_row_numbers_whole_frame(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("v"))
    got = op.row_numbers(df, [F.col("v").desc()])
    assert got.where(F.col("rank") != 5000 - F.col("v")).count() == 0


def test_lagged_crosses_ranges(spark):
    df = spark.range(0, 4000).select((F.col("id") * 7919 % 4000).alias("v"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("k"))
    got = op.lagged(df, [F.col("v")], ["k"], {"p": "v"}).collect()
    for key in ("hot", "cold"):
        mine = sorted((r.v, r.p) for r in got if r.k == key)
        assert [p for _, p in mine] == [None] + [v for v, _ in mine][:-1]


def test_lagged_null_partition_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "k string, v int")
    got = {(r.k, r.v): r.p for r in op.lagged(df, [F.col("v")], ["k"], {"p": "v"}).collect()}
    assert got == {(None, 1): None, (None, 2): 1, ("a", 5): None}


@pytest.mark.parametrize("size", [1, 2, 3, 1000, 1001])
def test_exact_median(spark, size):
    random.seed(size)
    values = [float(random.choice([1, 5, 5, random.randint(0, 10**6)])) for _ in range(size)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 2.0)], "k string, v double")
    got = {r.k: r.m for r in op.exact_median(df, ["k"], "v", "m", accuracy=100).collect()}
    assert got == {"a": statistics.median(values), "b": 2.0}


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sum_across_ranges(spark, keys):
    rows = spark.range(0, 500).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 7 % 11).alias("v"))
    got = op.running_sum(rows, [F.col("id")], keys, "v", "upto")
    window = Window.partitionBy(*keys).orderBy("id")
    want = rows.withColumn("upto", F.sum("v").over(window))
    assert got.select("id", "upto").exceptAll(want.select("id", "upto")).count() == 0 and got.count() == 500


def test_unknown_filter():
    with pytest.raises(ValueError):
        tables.predicate("a", "between", 1)
    with pytest.raises(ValueError):
        tables.predicate("a", "in", [])


def test_zero_previous_value_leaves_the_ranking(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 10.0)], "d int, v double")
    got = tables.period_over_period_change(df, "v", "d", n=5).collect()
    assert [(r.d, r.pct_change) for r in got] == [(3, 100.0)]


def test_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "i int, v double")
    assert [r.i for r in tables.extremes(df, "v", "min", 3).collect()] == [3, 2, 1]
    assert [r.i for r in tables.extremes(df, "v", "max", 3).collect()] == [2, 3, 1]


def test_asof_with_a_hot_point(spark):
    series = spark.createDataFrame([("a", day) for day in GAPPY], "k string, day date")
    asked = spark.range(0, 300).select("id", F.lit("a").alias("k"), F.when(F.col("id") % 3 == 0, F.lit(GAPPY[2])).otherwise(F.date_add(F.lit(GAPPY[0]), (F.col("id") % 9).cast("int"))).alias("at"))
    got = align.asof(asked, series, ["k"], "at", "day", "nearest", ["id"]).collect()
    assert len(got) == 300
    assert all(r.day == expected(GAPPY, r["at"], "nearest") for r in got)
