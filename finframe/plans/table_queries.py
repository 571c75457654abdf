"""Queries of the generic table operators."""

from pyspark.sql import functions as F

from finframe.functions.scalars import shaped
from finframe.operators import tables as op
from finframe.plans import sqlviews as v
from finframe.plans.base import query, with_views
from finframe.sources import views
from finframe.sources.views import SCHEMAS, table

_BIG = [("l_quantity", ">=", 10.0), ("l_returnflag", "in", ["A", "R"]), ("l_shipdate", "is_not_null")]
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


_LISTED = sorted(SCHEMAS)


@query(
    "table_schema",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c.split()[0]}' AS column_name, '{c.split()[1]}' AS column_type, (SELECT count(*) FROM {t}) AS row_count"
        for t in _LISTED for c in SCHEMAS[t].split(", ")
    ),
)
def _(spark, d):
    return op.table_schema({n: table(spark, d, n) for n in _LISTED})


@query("distinct_values", "SELECT DISTINCT p_brand FROM part WHERE p_size > 10 AND p_type LIKE 'E%'")
def _(spark, d):
    return op.distinct_values(table(spark, d, "part"), "p_brand", [("p_size", ">", 10), ("p_type", "like", "E%")])


@query(
    "filter_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
       WHERE l_quantity >= 10 AND l_returnflag IN ('A', 'R') AND l_shipdate IS NOT NULL""",
)
def _(spark, d):
    return op.filter_rows(
        table(spark, d, "lineitem"), _BIG, _LINE, "l_extendedprice", ascending=False,
        ties=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"],
    )


@query(
    "filter_all_operators",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
       WHERE o_orderstatus = 'F' AND o_orderpriority != '5-LOW' AND o_totalprice < 400000 AND o_totalprice <= 399999
         AND o_custkey > 5 AND o_custkey >= 6 AND o_orderpriority LIKE '%-%' AND o_orderpriority ILIKE '%H%'
         AND o_orderdate IS NOT NULL AND NOT (o_orderkey IS NULL)""",
)
def _(spark, d):
    filters = [
        ("o_orderstatus", "=", "F"), ("o_orderpriority", "!=", "5-LOW"), ("o_totalprice", "<", 400000.0),
        ("o_totalprice", "<=", 399999.0), ("o_custkey", ">", 5), ("o_custkey", ">=", 6),
        ("o_orderpriority", "like", "%-%"), ("o_orderpriority", "ilike", "%H%"), ("o_orderdate", "is_not_null"),
        ("o_orderkey", "is_not_null"),
    ]
    return op.filter_rows(
        table(spark, d, "orders"), filters, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], limit=None
    )


@query("count_matching", "SELECT count(*) AS row_count FROM lineitem WHERE l_quantity >= 10 AND l_returnflag IN ('A', 'R') AND l_shipdate IS NOT NULL")
def _(spark, d):
    return op.count_matching(table(spark, d, "lineitem"), _BIG)


@query("extremes_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def _(spark, d):
    return op.extremes(table(spark, d, "orders"), "o_totalprice", "max", 10, columns=["o_orderkey", "o_totalprice"], ties=["o_orderkey"])


@query("extremes_bottomn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 10")
def _(spark, d):
    return op.extremes(table(spark, d, "orders"), "o_totalprice", "min", 10, columns=["o_orderkey", "o_totalprice"], ties=["o_orderkey"])


@query("min_row", "SELECT event_id, user_id, event_type, value FROM events ORDER BY value ASC NULLS LAST, event_id LIMIT 1")
def _(spark, d):
    return op.min_row(table(spark, d, "events"), "value", columns=["event_id", "user_id", "event_type", "value"], ties=["event_id"])


@query("max_row", "SELECT event_id, user_id, event_type, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 1")
def _(spark, d):
    return op.max_row(table(spark, d, "events"), "value", columns=["event_id", "user_id", "event_type", "value"], ties=["event_id"])


@query(
    "date_range",
    "SELECT CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS earliest, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS latest, count(*) AS row_count FROM orders WHERE o_orderstatus = 'O'",
)
def _(spark, d):
    days = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return shaped(op.date_range(days, "day", [("o_orderstatus", "=", "O")]))


_AGG_SQL = """round(min(l_extendedprice), 2) AS l_extendedprice_min, round(max(l_extendedprice), 2) AS l_extendedprice_max,
 round(avg(l_extendedprice), 4) AS l_extendedprice_avg, round(sum(l_extendedprice), 2) AS l_extendedprice_sum,
 count(l_extendedprice) AS l_extendedprice_count, count(DISTINCT l_extendedprice) AS l_extendedprice_count_distinct,
 round(median(l_extendedprice), 3) AS l_extendedprice_median, round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_stddev"""
_MEASURES = ["min", "max", "avg", "sum", "count", "count_distinct", "median", "stddev"]
_DIGITS = {"min": 2, "max": 2, "avg": 4, "sum": 2, "median": 3, "stddev": 4}


def _rounded(df, column):
    out = df
    for a, digits in _DIGITS.items():
        out = out.withColumn(f"{column}_{a}", F.round(f"{column}_{a}", digits))
    return out


@query("agg_group_all", f"SELECT l_returnflag, l_linestatus, {_AGG_SQL} FROM lineitem GROUP BY ALL")
def _(spark, d):
    out = op.aggregate_many(table(spark, d, "lineitem"), [(a, "l_extendedprice") for a in _MEASURES], ["l_returnflag", "l_linestatus"])
    return _rounded(out, "l_extendedprice")


@query("agg_whole_table", f"SELECT {_AGG_SQL} FROM lineitem")
def _(spark, d):
    return _rounded(op.aggregate_many(table(spark, d, "lineitem"), [(a, "l_extendedprice") for a in _MEASURES]), "l_extendedprice")


@query(
    "agg_median_by_part",
    "SELECT l_partkey, round(median(l_extendedprice), 3) AS l_extendedprice_median FROM lineitem GROUP BY 1",
)
def _(spark, d):
    out = op.aggregate(table(spark, d, "lineitem"), "l_extendedprice", "median", group_by=["l_partkey"], limit=None)
    return out.withColumn("l_extendedprice_median", F.round("l_extendedprice_median", 3))


@query(
    "agg_top_groups",
    "SELECT l_suppkey, round(sum(l_quantity), 2) AS l_quantity_sum FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def _(spark, d):
    out = op.aggregate(table(spark, d, "lineitem"), "l_quantity", "sum", group_by=["l_suppkey"], order_by_agg="desc", limit=20)
    return out.withColumn("l_quantity_sum", F.round("l_quantity_sum", 2))


@query(
    "conditional_counts",
    with_views(
        v.RATES,
        """SELECT series_key, count(*) FILTER (change_bp <> 0) AS changed, count(*) FILTER (change_bp > 0) AS increases,
        count(*) FILTER (change_bp < 0) AS decreases FROM rates GROUP BY series_key""",
    ),
)
def _(spark, d):
    change = F.col("change_bp")
    counts = {"changed": change != 0, "increases": change > 0, "decreases": change < 0}
    return op.conditional_counts(views.rates(spark, d), counts, ["series_key"])


@query("frequencies", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return op.frequencies(table(spark, d, "events"), ["event_type"])


@query("distinct_groups", "SELECT count(DISTINCT conv_id) AS groups FROM conversations")
def _(spark, d):
    return op.distinct_groups(table(spark, d, "conversations"), "conv_id")


@query(
    "population_statistics",
    """SELECT event_type, round(avg(value), 4) AS value_avg, round(stddev_pop(value), 4) AS value_stddev_pop,
       round(sum(value), 2) AS value_sum, round(median(value), 4) AS value_median FROM events WHERE NOT isnan(value) GROUP BY 1""",
)
def _(spark, d):
    clean = table(spark, d, "events").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    out = op.aggregate_many(clean, [("avg", "value"), ("stddev_pop", "value"), ("sum", "value"), ("median", "value")], ["event_type"])
    for c, digits in (("avg", 4), ("stddev_pop", 4), ("sum", 2), ("median", 4)):
        out = out.withColumn(f"value_{c}", F.round(f"value_{c}", digits))
    return out


@query(
    "period_change",
    with_views(
        v.PRICES_WIDE,
        """, chg AS (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS previous_value FROM prices WHERE close > 1)
        SELECT ticker, CAST(date AS VARCHAR) AS date, close, previous_value,
               round((close - previous_value) / previous_value * 100, 4) AS pct_change
        FROM chg WHERE previous_value IS NOT NULL ORDER BY pct_change DESC, ticker, date LIMIT 25""",
    ),
)
def _(spark, d):
    bars = views.prices_wide(spark, d).select("ticker", "date", "close")
    return shaped(op.period_over_period_change(bars, "close", "date", ["ticker"], "desc", 25, [("close", ">", 1.0)]))


@query(
    "period_change_whole_series",
    """WITH chg AS (SELECT event_id, ts, value, lag(value) OVER (ORDER BY ts, event_id) AS previous_value FROM events)
       SELECT event_id, value, previous_value, round((value - previous_value) / previous_value * 100, 4) AS pct_change
       FROM chg WHERE previous_value IS NOT NULL AND previous_value <> 0""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "value")
    return op.period_over_period_change(rows, "value", "ts", n=None, ties=["event_id"]).drop("ts")


@query(
    "longest_gap",
    with_views(
        v.RATES,
        """, gaps AS (SELECT *, lag(effective_date) OVER (PARTITION BY series_key ORDER BY effective_date) AS previous_date FROM rates WHERE change_bp <> 0)
        SELECT series_key, CAST(effective_date AS VARCHAR) AS effective_date, target_bp, change_bp, CAST(previous_date AS VARCHAR) AS previous_date,
               date_diff('day', previous_date, effective_date) AS gap_days
        FROM gaps WHERE previous_date IS NOT NULL ORDER BY gap_days DESC, series_key, effective_date LIMIT 10""",
    ),
)
def _(spark, d):
    return shaped(op.longest_gap(views.rates(spark, d), "effective_date", ["series_key"], 10, [("change_bp", "!=", 0)]))


@query(
    "longest_gap_hot_key",
    """WITH gaps AS (SELECT user_id, event_id, event_type, ts, lag(CAST(ts AS DATE)) OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE), event_id) AS previous_date FROM events)
       SELECT event_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(previous_date AS VARCHAR) AS previous_date,
              date_diff('day', previous_date, CAST(ts AS DATE)) AS gap_days FROM gaps WHERE previous_date IS NOT NULL""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("date"))
    return shaped(op.longest_gap(rows, "date", ["event_type"], None, ties=["event_id"]))
