"""Facts of a published decision series, recomputed through the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from finframe.operators import align, checks
from finframe.operators import rates as op

# A published policy-rate series, as day, change and level in percent.
DECISIONS = """
3 Feb 2010 0.00 3.75; 3 Mar 2010 +0.25 4.00; 7 Apr 2010 +0.25 4.25; 5 May 2010 +0.25 4.50; 2 Jun 2010 0.00 4.50;
7 Jul 2010 0.00 4.50; 4 Aug 2010 0.00 4.50; 8 Sep 2010 0.00 4.50; 6 Oct 2010 0.00 4.50; 3 Nov 2010 +0.25 4.75;
8 Dec 2010 0.00 4.75; 2 Feb 2011 0.00 4.75; 2 Mar 2011 0.00 4.75; 6 Apr 2011 0.00 4.75; 4 May 2011 0.00 4.75;
8 Jun 2011 0.00 4.75; 6 Jul 2011 0.00 4.75; 3 Aug 2011 0.00 4.75; 7 Sep 2011 0.00 4.75; 5 Oct 2011 0.00 4.75;
2 Nov 2011 -0.25 4.50; 7 Dec 2011 -0.25 4.25; 8 Feb 2012 0.00 4.25; 7 Mar 2012 0.00 4.25; 4 Apr 2012 0.00 4.25;
2 May 2012 -0.50 3.75; 6 Jun 2012 -0.25 3.50; 4 Jul 2012 0.00 3.50; 8 Aug 2012 0.00 3.50; 5 Sep 2012 0.00 3.50;
3 Oct 2012 -0.25 3.25; 7 Nov 2012 0.00 3.25; 5 Dec 2012 -0.25 3.00; 6 Feb 2013 0.00 3.00; 6 Mar 2013 0.00 3.00;
3 Apr 2013 0.00 3.00; 8 May 2013 -0.25 2.75; 5 Jun 2013 0.00 2.75; 3 Jul 2013 0.00 2.75; 7 Aug 2013 -0.25 2.50;
4 Sep 2013 0.00 2.50; 2 Oct 2013 0.00 2.50; 6 Nov 2013 0.00 2.50; 4 Dec 2013 0.00 2.50; 5 Feb 2014 0.00 2.50;
5 Mar 2014 0.00 2.50; 2 Apr 2014 0.00 2.50; 7 May 2014 0.00 2.50; 4 Jun 2014 0.00 2.50; 2 Jul 2014 0.00 2.50;
6 Aug 2014 0.00 2.50; 3 Sep 2014 0.00 2.50; 8 Oct 2014 0.00 2.50; 5 Nov 2014 0.00 2.50; 3 Dec 2014 0.00 2.50;
4 Feb 2015 -0.25 2.25; 4 Mar 2015 0.00 2.25; 8 Apr 2015 0.00 2.25; 6 May 2015 -0.25 2.00; 3 Jun 2015 0.00 2.00;
8 Jul 2015 0.00 2.00; 5 Aug 2015 0.00 2.00; 2 Sep 2015 0.00 2.00; 7 Oct 2015 0.00 2.00; 4 Nov 2015 0.00 2.00;
2 Dec 2015 0.00 2.00; 3 Feb 2016 0.00 2.00; 2 Mar 2016 0.00 2.00; 6 Apr 2016 0.00 2.00; 4 May 2016 -0.25 1.75;
8 Jun 2016 0.00 1.75; 6 Jul 2016 0.00 1.75; 3 Aug 2016 -0.25 1.50; 7 Sep 2016 0.00 1.50; 5 Oct 2016 0.00 1.50;
2 Nov 2016 0.00 1.50; 7 Dec 2016 0.00 1.50; 8 Feb 2017 0.00 1.50; 8 Mar 2017 0.00 1.50; 5 Apr 2017 0.00 1.50;
3 May 2017 0.00 1.50; 7 Jun 2017 0.00 1.50; 5 Jul 2017 0.00 1.50; 2 Aug 2017 0.00 1.50; 6 Sep 2017 0.00 1.50;
4 Oct 2017 0.00 1.50; 8 Nov 2017 0.00 1.50; 6 Dec 2017 0.00 1.50; 7 Feb 2018 0.00 1.50; 7 Mar 2018 0.00 1.50;
4 Apr 2018 0.00 1.50; 2 May 2018 0.00 1.50; 6 Jun 2018 0.00 1.50; 4 Jul 2018 0.00 1.50; 8 Aug 2018 0.00 1.50;
5 Sep 2018 0.00 1.50; 3 Oct 2018 0.00 1.50; 7 Nov 2018 0.00 1.50; 5 Dec 2018 0.00 1.50; 6 Feb 2019 0.00 1.50;
6 Mar 2019 0.00 1.50; 3 Apr 2019 0.00 1.50; 8 May 2019 0.00 1.50; 5 Jun 2019 -0.25 1.25; 3 Jul 2019 -0.25 1.00;
7 Aug 2019 0.00 1.00; 4 Sep 2019 0.00 1.00; 2 Oct 2019 -0.25 0.75; 6 Nov 2019 0.00 0.75; 4 Dec 2019 0.00 0.75;
5 Feb 2020 0.00 0.75; 4 Mar 2020 -0.25 0.50; 20 Mar 2020 -0.25 0.25; 8 Apr 2020 0.00 0.25; 6 May 2020 0.00 0.25;
3 Jun 2020 0.00 0.25; 8 Jul 2020 0.00 0.25; 5 Aug 2020 0.00 0.25; 2 Sep 2020 0.00 0.25; 7 Oct 2020 0.00 0.25;
4 Nov 2020 -0.15 0.10; 2 Dec 2020 0.00 0.10; 3 Feb 2021 0.00 0.10; 3 Mar 2021 0.00 0.10; 7 Apr 2021 0.00 0.10;
5 May 2021 0.00 0.10; 2 Jun 2021 0.00 0.10; 7 Jul 2021 0.00 0.10; 4 Aug 2021 0.00 0.10; 8 Sep 2021 0.00 0.10;
6 Oct 2021 0.00 0.10; 3 Nov 2021 0.00 0.10; 8 Dec 2021 0.00 0.10; 2 Feb 2022 0.00 0.10; 2 Mar 2022 0.00 0.10;
6 Apr 2022 0.00 0.10; 4 May 2022 +0.25 0.35; 8 Jun 2022 +0.50 0.85; 6 Jul 2022 +0.50 1.35; 3 Aug 2022 +0.50 1.85;
7 Sep 2022 +0.50 2.35; 5 Oct 2022 +0.25 2.60; 2 Nov 2022 +0.25 2.85; 7 Dec 2022 +0.25 3.10; 8 Feb 2023 +0.25 3.35;
8 Mar 2023 +0.25 3.60; 5 Apr 2023 0.00 3.60; 3 May 2023 +0.25 3.85; 7 Jun 2023 +0.25 4.10; 5 Jul 2023 0.00 4.10;
2 Aug 2023 0.00 4.10; 6 Sep 2023 0.00 4.10; 4 Oct 2023 0.00 4.10; 8 Nov 2023 +0.25 4.35; 6 Dec 2023 0.00 4.35;
7 Feb 2024 0.00 4.35; 20 Mar 2024 0.00 4.35; 8 May 2024 0.00 4.35; 19 Jun 2024 0.00 4.35; 7 Aug 2024 0.00 4.35;
25 Sep 2024 0.00 4.35; 6 Nov 2024 0.00 4.35; 11 Dec 2024 0.00 4.35; 19 Feb 2025 -0.25 4.10; 2 Apr 2025 0.00 4.10;
21 May 2025 -0.25 3.85; 9 Jul 2025 0.00 3.85; 13 Aug 2025 -0.25 3.60; 1 Oct 2025 0.00 3.60; 5 Nov 2025 0.00 3.60;
10 Dec 2025 0.00 3.60; 4 Feb 2026 +0.25 3.85; 18 Mar 2026 +0.25 4.10; 6 May 2026 +0.25 4.35; 17 Jun 2026 0.00 4.35;
"""


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def rates(spark):
    rows = []
    for item in filter(None, (x.strip() for x in DECISIONS.replace("\n", "").split(";"))):
        d, m, y, change, level = item.split()
        rows.append(("AU", dt.datetime.strptime(f"{d} {m} {y}", "%d %b %Y").date(), round(float(level) * 100), round(float(change) * 100)))
    return spark.createDataFrame(rows, "series_key string, effective_date date, target_bp bigint, change_bp bigint").cache()


def test_counts(rates):
    r = op.change_summary(rates).first()
    assert (r.record_count, r.changed_count, r.increases, r.decreases) == (175, 41, 20, 21)
    assert (r.window_start, r.window_end) == (day("2010-02-03"), day("2026-06-17"))
    assert r.increases + r.decreases + r.holds == r.record_count
    assert checks.summary_reconciles(op.change_summary(rates)).count() == 0


def test_extremes(rates):
    low = op.rate_extreme(rates, "lowest").first()
    assert (low.target_pct, low.first_effective_date, low.last_effective_date, low.record_count) == (0.1, day("2020-11-04"), day("2022-04-06"), 16)
    high = op.rate_extreme(rates, "highest").first()
    assert (high.target_pct, high.first_effective_date, high.last_effective_date, high.record_count) == (4.75, day("2010-11-03"), day("2011-10-05"), 11)


@pytest.mark.parametrize("kind,days,start", [("any_change", 1036, "2016-08-03"), ("hike", 4200, "2010-11-03"), ("cut", 1568, "2020-11-04")])
def test_holds(rates, kind, days, start):
    r = op.longest_hold(rates, kind).first()
    assert (r.gap_days, r.start_date) == (days, day(start))


def test_hold_levels_and_ranking(rates):
    rows = op.longest_hold(rates, "any_change", 3).orderBy("rank").collect()
    assert (rows[0].rate_during_pct, rows[0].rate_after_pct, rows[0].end_date) == (1.5, 1.25, day("2019-06-05"))
    assert [r.rank for r in rows] == [1, 2, 3]
    assert rows[0].gap_days >= rows[1].gap_days >= rows[2].gap_days


def test_cycles(rates):
    runs = op.rate_cycles(rates).orderBy("start_date").collect()
    up = [(r.move_count, r.cumulative_bp) for r in runs if r.direction == "tightening"]
    down = [(r.move_count, r.cumulative_bp) for r in runs if r.direction == "easing"]
    assert up == [(4, 100), (13, 425), (3, 75)]
    assert down == [(18, -465), (3, -75)]
    assert checks.cycles_reconcile(op.rate_cycles(rates)).count() == 0


def test_largest_and_latest_cycle(rates):
    r = op.rate_cycle(rates, "tightening").first()
    assert (r.move_count, r.cumulative_pct, r.start_date, r.end_date, r.rate_before_pct, r.rate_after_pct) == (13, 4.25, day("2022-05-04"), day("2023-11-08"), 0.1, 4.35)
    assert op.rate_cycle(rates, "tightening", "latest").first().move_count == 3
    assert op.rate_cycle(rates, "easing", "most_moves").first().cumulative_pct == -4.65


def test_rate_at(spark, rates):
    asked = spark.createDataFrame(
        [("AU", day("2020-03-19")), ("AU", day("2020-03-20")), ("AU", day("2009-01-01")), ("AU", day("2030-01-01")), ("XX", day("2020-01-01"))], "series_key string, date date"
    )
    got = {(r.series_key, r.date): (r.target_pct, r.status) for r in op.rate_at(asked, rates).collect()}
    assert got[("AU", day("2020-03-19"))] == (0.5, "ok")
    assert got[("AU", day("2020-03-20"))] == (0.25, "ok")
    assert got[("AU", day("2009-01-01"))] == (None, "DATE_OUTSIDE_COVERAGE")
    assert got[("AU", day("2030-01-01"))] == (None, "DATE_OUTSIDE_COVERAGE")
    assert got[("XX", day("2020-01-01"))][1] == "UNKNOWN_TICKER"
    open_end = {r.date: r.target_pct for r in op.rate_at(asked, rates, bound="lower").collect()}
    assert open_end[day("2030-01-01")] == 4.35
    exact = {r.date: r.status for r in op.rate_at(asked, rates, resolution="exact").collect()}
    assert exact[day("2020-03-19")] == "NO_MATCHING_RECORDS" and exact[day("2020-03-20")] == "ok"


def test_easing_by_year(rates):
    years = {r.year: r.decreases for r in op.moves_by_year(rates, "2011-01-01", "2013-12-31").collect()}
    assert years == {2011: 2, 2012: 4, 2013: 2}
    r = op.change_summary(rates, "2011-01-01", "2013-12-31").first()
    assert (r.cumulative_pct, r.rate_before_pct, r.rate_after_pct) == (-2.25, 4.75, 2.5)


def test_period_comparison_literal_and_requested(spark, rates):
    a, b = ("2020-01-01", "2020-12-31"), ("2022-01-01", "2022-12-31")
    one = op.period_comparison(rates, a, b).first()
    asked = spark.createDataFrame([(1, "AU", *map(day, a + b)), (2, "AU", *map(day, a[::-1] + b))], "request_id int, series_key string, a_start date, a_end date, b_start date, b_end date")
    two = {r.request_id: r for r in op.compare_requested_periods(rates, asked).collect()}
    assert one.difference_pct == two[1].difference_pct
    assert (one.a_move_bp, one.b_decisions) == (two[1].a_move_bp, two[1].b_decisions)
    assert two[2].status == "DATE_RANGE_INVALID"


def test_inverted_window_is_a_status(rates):
    window = ("2020-01-01", "2019-01-01")
    found = op.rate_extreme(rates, "lowest", *window)
    assert found.count() == 0
    told = align.answered(found, rates, "series_key", "effective_date", *window, ["nobody"]).collect()
    assert [r.status for r in told] == ["UNKNOWN_TICKER"]
    assert {r.status for r in align.answered(found, rates, "series_key", "effective_date", *window).collect()} == {"DATE_RANGE_INVALID"}


def test_levels_in_set(rates):
    assert op.levels_in_set(rates, [10]).first().record_count == 16


def test_change_is_the_level_difference(rates):
    from pyspark.sql import Window

    w = Window.partitionBy("series_key").orderBy("effective_date")
    off = rates.withColumn("p", F.lag("target_bp").over(w)).where(F.col("target_bp") - F.col("p") != F.col("change_bp"))
    assert off.count() == 0
