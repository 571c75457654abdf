"""Queries of the rate-series operators."""

from pyspark.sql import functions as F

from finframe.functions.scalars import shaped
from finframe.operators import rates as op
from finframe.plans import sqlviews as v
from finframe.plans.base import query, with_views
from finframe.sources import views

_SUMMARY = """count(*) AS record_count, count(*) FILTER (change_bp <> 0) AS changed_count, count(*) FILTER (change_bp > 0) AS increases,
 count(*) FILTER (change_bp < 0) AS decreases, count(*) FILTER (change_bp = 0) AS holds,
 CAST(min(effective_date) AS VARCHAR) AS window_start, CAST(max(effective_date) AS VARCHAR) AS window_end,
 CAST(sum(change_bp) AS BIGINT) / 100.0 AS cumulative_pct, arg_min(target_bp - change_bp, effective_date) / 100.0 AS rate_before_pct,
 arg_max(target_bp, effective_date) / 100.0 AS rate_after_pct"""


@query("rate_change_summary", with_views(v.RATES, f"SELECT series_key, {_SUMMARY} FROM rates GROUP BY series_key"))
def _(spark, d):
    return shaped(op.change_summary(views.rates(spark, d)))


@query(
    "rate_change_summary_window",
    with_views(v.RATES, f"SELECT series_key, {_SUMMARY} FROM rates WHERE effective_date BETWEEN DATE '1996-03-15' AND DATE '1999-10-20' GROUP BY series_key"),
)
def _(spark, d):
    return shaped(op.change_summary(views.rates(spark, d), "1996-03-15", "1999-10-20"))


def _extreme(direction, pick):
    @query(
        f"rate_extreme_{direction}",
        with_views(
            v.RATES,
            f""", w AS (SELECT * FROM rates WHERE effective_date >= DATE '1996-01-01'), m AS (SELECT series_key, {pick}(target_bp) AS t, count(*) AS records_used FROM w GROUP BY 1)
            SELECT series_key, '{direction}' AS direction, t / 100.0 AS target_pct, CAST(min(effective_date) AS VARCHAR) AS first_effective_date,
                   CAST(max(effective_date) AS VARCHAR) AS last_effective_date, count(*) AS record_count, records_used
            FROM w JOIN m USING (series_key) WHERE target_bp = t GROUP BY series_key, t, records_used""",
        ),
    )
    def _(spark, d):
        return shaped(op.rate_extreme(views.rates(spark, d), direction, "1996-01-01"))


_extreme("highest", "max")
_extreme("lowest", "min")

_ASK = """, asked AS (
  SELECT o_orderkey AS request_id, o_orderpriority AS series_key, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 - 100 AS INTEGER) AS DATE) AS date FROM orders
)"""


def _asked(spark, d):
    key = F.col("o_orderkey")
    return views.table(spark, d, "orders").select(
        key.alias("request_id"), F.col("o_orderpriority").alias("series_key"),
        F.date_add(F.to_date("o_orderdate"), (key % 400 - 100).cast("int")).alias("date"),
    )


def _rate_at_sql(mode, late):
    compare = "<=" if mode == "as_of" else "="
    missing = "DATE_OUTSIDE_COVERAGE" if mode == "as_of" else "NO_MATCHING_RECORDS"
    strict = f"AND a.date <= (SELECT max(effective_date) FROM rates l WHERE l.series_key = a.series_key)" if late else ""
    return with_views(
        v.RATES,
        f"""{_ASK}, hit AS (
          SELECT a.*, (SELECT max(r.effective_date) FROM rates r WHERE r.series_key = a.series_key AND r.effective_date {compare} a.date {strict}) AS day FROM asked a)
        SELECT request_id, hit.series_key, CAST(hit.date AS VARCHAR) AS date, CAST(day AS VARCHAR) AS effective_date,
               target_bp / 100.0 AS target_pct, change_bp / 100.0 AS change_pct, CASE WHEN day IS NULL THEN '{missing}' ELSE 'ok' END AS status
        FROM hit LEFT JOIN rates r ON r.series_key = hit.series_key AND r.effective_date = hit.day""",
    )


@query("rate_asof", _rate_at_sql("as_of", True))
def _(spark, d):
    return shaped(op.rate_at(_asked(spark, d), views.rates(spark, d), row_id=["request_id"]))


@query("rate_asof_open_end", _rate_at_sql("as_of", False))
def _(spark, d):
    return shaped(op.rate_at(_asked(spark, d), views.rates(spark, d), bound="lower", row_id=["request_id"]))


@query("rate_on_exact_day", _rate_at_sql("exact", False))
def _(spark, d):
    return shaped(op.rate_at(_asked(spark, d), views.rates(spark, d), resolution="exact", row_id=["request_id"]))


def _hold(kind, test, n):
    @query(
        f"rate_longest_hold_{kind}",
        with_views(
            v.RATES,
            f""", e AS (SELECT series_key, effective_date AS end_date, target_bp, lag(effective_date) OVER s AS start_date, lag(target_bp) OVER s AS during
              FROM rates WHERE {test} WINDOW s AS (PARTITION BY series_key ORDER BY effective_date)),
            g AS (SELECT *, date_diff('day', start_date, end_date) AS gap_days FROM e WHERE start_date IS NOT NULL),
            r AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY gap_days DESC, start_date) AS rank FROM g)
            SELECT series_key, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, during / 100.0 AS rate_during_pct,
                   target_bp / 100.0 AS rate_after_pct, gap_days, rank FROM r WHERE rank <= {n}""",
        ),
    )
    def _(spark, d):
        return shaped(op.longest_hold(views.rates(spark, d), kind, n))


_hold("any_change", "change_bp <> 0", 1)
_hold("hike", "change_bp > 0", 3)
_hold("cut", "change_bp < 0", 3)

_RUNS = """, moves AS (SELECT *, sign(change_bp) AS sg, lag(sign(change_bp)) OVER (PARTITION BY series_key ORDER BY effective_date) AS before FROM rates WHERE change_bp <> 0),
islands AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> sg THEN 1 ELSE 0 END) OVER (PARTITION BY series_key ORDER BY effective_date) AS run FROM moves),
runs AS (SELECT series_key, run, CASE WHEN max(change_bp) > 0 THEN 'tightening' ELSE 'easing' END AS direction, count(*) AS move_count,
  CAST(sum(change_bp) AS BIGINT) AS cumulative_bp, min(effective_date) AS start_date, max(effective_date) AS end_date,
  arg_min(target_bp - change_bp, effective_date) AS before_bp, arg_max(target_bp, effective_date) AS after_bp,
  date_diff('day', min(effective_date), max(effective_date)) AS duration_days FROM islands GROUP BY 1, 2)"""


@query(
    "rate_cycles",
    with_views(
        v.RATES,
        _RUNS + """ SELECT series_key, CAST(run AS BIGINT) AS run, direction, move_count, cumulative_bp, CAST(start_date AS VARCHAR) AS start_date,
        CAST(end_date AS VARCHAR) AS end_date, before_bp, after_bp, duration_days FROM runs""",
    ),
)
def _(spark, d):
    return shaped(op.rate_cycles(views.rates(spark, d)))


def _cycle(name, direction, select, order):
    @query(
        name,
        with_views(
            v.RATES,
            f"""{_RUNS}, pick AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY {order}) AS k, count(*) OVER (PARTITION BY series_key) AS cycles_found
              FROM runs WHERE direction = '{direction}')
            SELECT series_key, direction, move_count, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, duration_days, cycles_found,
                   cumulative_bp / 100.0 AS cumulative_pct, before_bp / 100.0 AS rate_before_pct, after_bp / 100.0 AS rate_after_pct FROM pick WHERE k = 1""",
        ),
    )
    def _(spark, d):
        return shaped(op.rate_cycle(views.rates(spark, d), direction, select))


_cycle("rate_largest_cycle", "tightening", "largest", "abs(cumulative_bp) DESC, start_date")
_cycle("rate_longest_cycle_by_moves", "easing", "most_moves", "move_count DESC, start_date")
_cycle("rate_latest_cycle", "easing", "latest", "start_date DESC")


def _period(tag, lo, hi):
    inside = f"effective_date BETWEEN DATE '{lo}' AND DATE '{hi}'"
    return f"""CAST(min(effective_date) FILTER ({inside}) AS VARCHAR) AS {tag}_start, CAST(max(effective_date) FILTER ({inside}) AS VARCHAR) AS {tag}_end,
      arg_min(target_bp - change_bp, effective_date) FILTER ({inside}) AS {tag}_open_bp, arg_max(target_bp, effective_date) FILTER ({inside}) AS {tag}_close_bp,
      CAST(sum(change_bp) FILTER ({inside}) AS BIGINT) AS {tag}_move_bp, count(*) FILTER ({inside}) AS {tag}_decisions"""


@query(
    "rate_period_comparison",
    with_views(
        v.RATES,
        f""", c AS (SELECT series_key, {_period('a', '1996-01-01', '1997-06-30')}, {_period('b', '1998-02-10', '2000-12-31')} FROM rates GROUP BY series_key)
        SELECT *, (b_move_bp - a_move_bp) / 100.0 AS difference_pct FROM c""",
    ),
)
def _(spark, d):
    return shaped(op.period_comparison(views.rates(spark, d), ("1996-01-01", "1997-06-30"), ("1998-02-10", "2000-12-31")))


@query(
    "rate_requested_periods",
    with_views(
        v.RATES,
        """, req AS (SELECT o_orderkey AS request_id, o_orderpriority AS series_key, CAST(o_orderdate AS DATE) AS a_start,
             CAST(CAST(o_orderdate AS DATE) + 400 AS DATE) AS a_end, CAST(CAST(o_orderdate AS DATE) + 500 AS DATE) AS b_start,
             CAST(CAST(o_orderdate AS DATE) + CAST(900 - (o_orderkey % 7) * 100 AS INTEGER) AS DATE) AS b_end FROM orders),
        part_a AS (SELECT request_id, arg_min(target_bp - change_bp, effective_date) AS a_open_bp, arg_max(target_bp, effective_date) AS a_close_bp,
             CAST(sum(change_bp) AS BIGINT) AS a_move_bp, count(*) AS a_decisions FROM req JOIN rates r ON r.series_key = req.series_key AND effective_date BETWEEN a_start AND a_end GROUP BY 1),
        part_b AS (SELECT request_id, arg_min(target_bp - change_bp, effective_date) AS b_open_bp, arg_max(target_bp, effective_date) AS b_close_bp,
             CAST(sum(change_bp) AS BIGINT) AS b_move_bp, count(*) AS b_decisions FROM req JOIN rates r ON r.series_key = req.series_key AND effective_date BETWEEN b_start AND b_end GROUP BY 1)
        SELECT request_id, series_key, CAST(a_start AS VARCHAR) AS a_start, CAST(a_end AS VARCHAR) AS a_end, CAST(b_start AS VARCHAR) AS b_start, CAST(b_end AS VARCHAR) AS b_end,
          a_open_bp, a_close_bp, a_move_bp, a_decisions, b_open_bp, b_close_bp, b_move_bp, b_decisions, (b_move_bp - a_move_bp) / 100.0 AS difference_pct,
          CASE WHEN a_start > a_end OR b_start > b_end THEN 'DATE_RANGE_INVALID' WHEN a_decisions IS NULL OR b_decisions IS NULL THEN 'NO_MATCHING_RECORDS' ELSE 'ok' END AS status
        FROM req LEFT JOIN part_a USING (request_id) LEFT JOIN part_b USING (request_id)""",
    ),
)
def _(spark, d):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    asked = views.table(spark, d, "orders").select(
        key.alias("request_id"), F.col("o_orderpriority").alias("series_key"), day.alias("a_start"), F.date_add(day, 400).alias("a_end"),
        F.date_add(day, 500).alias("b_start"), F.date_add(day, (900 - (key % 7) * 100).cast("int")).alias("b_end"),
    )
    return shaped(op.compare_requested_periods(views.rates(spark, d), asked))


@query("rate_levels_in_set", with_views(v.RATES, "SELECT series_key, count(*) AS record_count FROM rates WHERE target_bp IN (275, 300, 325) GROUP BY 1"))
def _(spark, d):
    return op.levels_in_set(views.rates(spark, d), [275, 300, 325])


@query(
    "rate_moves_by_year",
    with_views(
        v.RATES,
        """SELECT series_key, year(effective_date) AS year, count(*) FILTER (change_bp > 0) AS increases, count(*) FILTER (change_bp < 0) AS decreases,
        CAST(sum(change_bp) AS BIGINT) AS net_bp, arg_max(target_bp, effective_date) AS closing_bp FROM rates WHERE effective_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    return op.moves_by_year(views.rates(spark, d), "1996-01-01", "1998-12-31")


@query(
    "rate_changes_in_period",
    with_views(
        v.RATES,
        """SELECT series_key, count(*) AS changes, count(*) FILTER (change_bp > 0) AS increases, count(*) FILTER (change_bp < 0) AS decreases,
        CAST(sum(change_bp) AS BIGINT) / 100.0 AS net_pct FROM rates WHERE change_bp <> 0 AND effective_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' GROUP BY 1""",
    ),
)
def _(spark, d):
    return op.moves_in_period(views.rates(spark, d), "1997-01-01", "1999-12-31")
