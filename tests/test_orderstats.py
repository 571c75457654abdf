"""Order statistics and aggregates of request tables against brute force."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from finframe.operators import orderstats as st

FIRST = dt.date(1999, 11, 20)


def day(n):
    return FIRST + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    # k0: many values, some twice on a day; k1: one value; k2: NULLs only on most days
    out = [("k0", day(n), float(draw.choice([draw.randrange(9), draw.randrange(5000), -draw.randrange(70)]))) for n in draw.sample(range(600), 350)]
    out += [("k0", day(n), 4.0) for n in draw.sample(range(600), 30)]
    out += [("k1", day(n), 7.25) for n in range(0, 90, 3)]
    return out + [("k2", day(n), None if n % 5 else n / 4) for n in range(100)]


@pytest.fixture(scope="module")
def series(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, v double").repartition(5)


@pytest.fixture(scope="module")
def index(series):
    return st.rank_index(series, "v")


@pytest.fixture(scope="module")
def asked():
    draw = random.Random(12)
    out = []
    for i in range(250):
        a = draw.randrange(-20, 620)
        out.append((i, draw.choice(["k0", "k0", "k0", "k1", "k2", "none"]), draw.choice([None, *[day(a)] * 9]), draw.choice([None, *[day(a + draw.randrange(-5, 300))] * 9])))
    return [*out, (900, "k2", day(1), day(4)), (901, "k0", None, None), (902, "k0", None, None)]


def inside(rows, key, start, end):
    return [r[2] for r in rows if r[0] == key and (start is None or r[1] >= start) and (end is None or r[1] <= end)]


def test_all_aggregates(spark, rows, series, asked, index):
    requests = spark.createDataFrame(asked, "id int, ticker string, start date, end date")
    got = {r.id: r for r in st.window_stats(requests, series, "v", index=index).collect()}
    assert len(got) == len(asked)
    for i, key, start, end in asked:
        every = inside(rows, key, start, end)
        known = [x for x in every if x is not None]
        r = got[i]
        if key == "none":
            assert r.status == "UNKNOWN_TICKER"
        elif start and end and start > end:
            assert r.status == "DATE_RANGE_INVALID" and r.median is None
        elif not every:
            assert r.status == "NO_MATCHING_RECORDS"
        else:
            assert (r.status, r.days, r.value_count) == ("ok", len(every), len(known))
            if not known:
                assert (r.avg, r.min, r.median, r.stddev, r.sum) == (None,) * 5
                continue
            assert (r.min, r.max, r.median, r.sum) == (min(known), max(known), statistics.median(known), sum(known))
            assert (r.avg, r.stddev) == (pytest.approx(statistics.fmean(known)), pytest.approx(statistics.pstdev(known), abs=1e-9))


def test_every_place_of_a_window(spark, rows, index):
    first = dt.date(1970, 1, 1)
    s, e = (day(40) - first).days, (day(333) - first).days
    want = sorted(inside(rows, "k0", day(40), day(333)))
    places = spark.createDataFrame([("k0", s, e, k) for k in range(len(want) + 3)], "ticker string, _s int, _e int, _k int")
    assert {r._k: r._value for r in st.order_statistics(places, index).collect()} == dict(enumerate(want))


def test_ranks_and_anchors(spark, series, rows):
    requests = spark.createDataFrame(
        [(1, day(0), day(99), None, "k1"), (2, day(0), day(99), ["k1", "none", "k1"], "k0"), (3, day(9), day(3), ["k0"], None), (4, None, None, [], "none")],
        "request_id int, start date, end date, tickers array<string>, compare_to string")
    got = {(r.request_id, r.ticker): r for r in st.stat_ranks(requests, series, "v", "median").collect()}
    mid = {k: round(statistics.median([x for x in inside(rows, k, day(0), day(99)) if x is not None]), 4) for k in ("k0", "k1", "k2")}
    order = sorted(mid, key=lambda k: (-mid[k], k))
    for k in mid:
        r = got[1, k]
        assert (r["rank"], r.value, r.above, r.below, r.anchor_status) == (order.index(k) + 1, mid[k], mid[k] > mid["k1"], mid[k] < mid["k1"], "ok")
    assert got[2, "none"].status == "UNKNOWN_TICKER" and got[2, "none"]["rank"] is None
    assert (got[2, "k1"]["rank"], got[2, "k1"].anchor_status, got[2, "k1"].above) == (1, "UNKNOWN_TICKER", None)
    assert (got[3, "k0"].status, got[3, "k0"].anchor_status) == ("DATE_RANGE_INVALID", None)
    assert {k for i, k in got if i == 4} == {"k0", "k1", "k2"} and len(got) == 3 + 2 + 1 + 3


def test_empty_tables(spark, series):
    requests = spark.createDataFrame([(1, "k0", None, None)], "id int, ticker string, start date, end date")
    assert [r.status for r in st.window_stats(requests, series.limit(0), "v").collect()] == ["UNKNOWN_TICKER"]
    assert st.window_stats(requests.limit(0), series, "v").count() == 0
    assert st.rank_index(series.where(F.col("v").isNull()), "v").values.count() == 0
    with pytest.raises(ValueError):
        st.window_stats(requests, series, "v", ["mode"])
