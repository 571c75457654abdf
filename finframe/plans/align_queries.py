"""Queries of date alignment and coverage."""

from pyspark.sql import functions as F

from finframe.functions.scalars import shaped
from finframe.operators import align as op
from finframe.operators import tables
from finframe.plans import sqlviews as v
from finframe.plans.base import query, with_views
from finframe.sources import views

# every article asks for the bar of one brand on a day spread over (and past) the price span
_REQUESTS = """, requests AS (
  SELECT doc_id AS request_id, 'Brand#' || (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 27 END) AS ticker,
         CAST(DATE '1994-06-01' + CAST((doc_id * 37) % 3300 AS INTEGER) AS DATE) AS target FROM documents
)"""


def _requests(spark, d):
    doc = F.col("doc_id")
    number = F.when(doc % 3 == 0, 1).otherwise(doc % 27)
    return views.table(spark, d, "documents").select(
        doc.alias("request_id"), F.concat(F.lit("Brand#"), number.cast("string")).alias("ticker"),
        F.date_add(F.lit("1994-06-01").cast("date"), F.pmod(doc * 37, F.lit(3300)).cast("int")).alias("target"),
    )


_PICK = {
    "previous": "SELECT max(p.date) FROM prices p WHERE p.ticker = r.ticker AND p.date <= r.target",
    "next": "SELECT min(p.date) FROM prices p WHERE p.ticker = r.ticker AND p.date >= r.target",
    "nearest": "SELECT arg_min(p.date, (abs(date_diff('day', p.date, r.target)), p.date)) FROM prices p WHERE p.ticker = r.ticker",
    "exact": "SELECT max(p.date) FROM prices p WHERE p.ticker = r.ticker AND p.date = r.target",
}


def _asof_sql(mode):
    return with_views(
        v.PRICES_BIG,
        f"""{_REQUESTS}, placed AS (
          SELECT request_id, ticker, target, ({_PICK[mode]}) AS hit FROM requests r
        ) SELECT request_id, placed.ticker, CAST(target AS VARCHAR) AS target, CAST(hit AS VARCHAR) AS date, round(p.close, 4) AS close,
          CASE WHEN hit IS NOT NULL THEN 'ok' WHEN placed.ticker IN (SELECT ticker FROM prices) THEN 'DATE_OUTSIDE_COVERAGE' ELSE 'UNKNOWN_TICKER' END AS status
        FROM placed LEFT JOIN prices p ON p.ticker = placed.ticker AND p.date = placed.hit""",
    )


def _asof(mode):
    @query(f"asof_{mode}", _asof_sql(mode))
    def _(spark, d):
        series = views.prices_big(spark, d).select("ticker", "date", F.round("close", 4).alias("close"))
        return shaped(op.asof(_requests(spark, d), series, ["ticker"], "target", "date", mode, ["request_id"]))


for _mode in op.MODES:
    _asof(_mode)


@query(
    "coverage_overlap",
    with_views(
        v.PRICES_BIG + "," + v.RATES,
        """, spans AS (
          SELECT 'prices' AS dataset, min(date) AS s, max(date) AS e FROM prices UNION ALL
          SELECT 'rates', min(effective_date), max(effective_date) FROM rates UNION ALL
          SELECT 'orders', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders)
        SELECT CAST(CASE WHEN max(s) <= min(e) THEN max(s) END AS VARCHAR) AS shared_start, CAST(CASE WHEN max(s) <= min(e) THEN min(e) END AS VARCHAR) AS shared_end,
               string_agg(dataset || ' ' || s || ' to ' || e, '; ' ORDER BY dataset) AS described FROM spans""",
    ),
)
def _(spark, d):
    days = views.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    return shaped(
        op.overlap([
            op.coverage(views.prices_big(spark, d), "prices", "date"),
            op.coverage(views.rates(spark, d), "rates", "effective_date"),
            op.coverage(days, "orders", "day"),
        ])
    )


@query(
    "coverage_by_ticker",
    with_views(
        v.PRICES_WIDE,
        "SELECT 'prices' AS dataset, ticker, CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS \"end\", count(*) AS record_count FROM prices GROUP BY ticker",
    ),
)
def _(spark, d):
    return shaped(op.coverage(views.prices_wide(spark, d), "prices", "date", ["ticker"]))


@query(
    "coverage_combined",
    with_views(
        v.PRICES_WIDE,
        "SELECT 'prices' AS dataset, CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS \"end\", count(*) AS record_count FROM prices",
    ),
)
def _(spark, d):
    return shaped(op.combined_coverage(op.coverage(views.prices_wide(spark, d), "prices", "date", ["ticker"]), "prices"))


@query(
    "window_clamp",
    with_views(
        v.PRICES_WIDE,
        """, cover AS (SELECT ticker, min(date) AS s, max(date) AS e FROM prices GROUP BY ticker),
        req AS (SELECT event_id, CAST(user_id + (CASE WHEN event_id % 11 = 0 THEN 1000000 ELSE 0 END) AS VARCHAR) AS ticker,
                  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) - CAST(event_id % 9 AS INTEGER) AS DATE) END AS start,
                  CAST(CAST(ts AS DATE) + CAST(event_id % 7 AS INTEGER) - 3 - CASE WHEN event_id % 13 = 0 THEN 60 ELSE 0 END AS DATE) AS "end" FROM events),
        st AS (SELECT req.*, greatest(start, s) AS lo0, least("end", e) AS hi0,
                 CASE WHEN s IS NULL THEN 'UNKNOWN_TICKER' WHEN start > "end" THEN 'DATE_RANGE_INVALID' WHEN greatest(start, s) > least("end", e) THEN 'DATE_OUTSIDE_COVERAGE' ELSE 'ok' END AS status
               FROM req LEFT JOIN cover USING (ticker))
        SELECT event_id, ticker, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end",
               CASE WHEN status = 'ok' THEN CAST(lo0 AS VARCHAR) END AS lo, CASE WHEN status = 'ok' THEN CAST(hi0 AS VARCHAR) END AS hi, status FROM st""",
    ),
)
def _(spark, d):
    cover = op.coverage(views.prices_wide(spark, d), "prices", "date", ["ticker"])
    event, day = F.col("event_id"), F.to_date("ts")
    asked = views.table(spark, d, "events").select(
        event,
        (F.col("user_id") + F.when(event % 11 == 0, 1000000).otherwise(0)).cast("string").alias("ticker"),
        F.when(event % 5 != 0, F.date_sub(day, (event % 9).cast("int"))).alias("start"),
        F.date_add(day, (event % 7 - 3 - F.when(event % 13 == 0, 60).otherwise(0)).cast("int")).alias("end"),
    )
    return shaped(op.clamp(asked, cover, ["ticker"], ["event_id"]))


@query(
    "events_in_coverage",
    with_views(
        v.RATES + "," + v.PRICES_BIG,
        """SELECT series_key, CAST(effective_date AS VARCHAR) AS effective_date, target_bp, change_bp FROM rates
        WHERE change_bp <> 0 AND effective_date BETWEEN (SELECT min(date) FROM prices) AND (SELECT max(date) FROM prices)""",
    ),
)
def _(spark, d):
    moves = tables.where(views.rates(spark, d), [("change_bp", "!=", 0)])
    return shaped(op.in_coverage(moves, op.coverage(views.prices_big(spark, d), "prices", "date"), "effective_date"))


@query(
    "unknown_tickers",
    with_views(
        v.PRICES_BIG,
        _REQUESTS + """ SELECT DISTINCT ticker, 'UNKNOWN_TICKER' AS status, (SELECT count(DISTINCT ticker) FROM prices) AS available, (SELECT min(ticker) FROM prices) AS first_key, (SELECT max(ticker) FROM prices) AS last_key
        FROM requests WHERE ticker NOT IN (SELECT ticker FROM prices)""",
    ),
)
def _(spark, d):
    return op.unknown_keys(_requests(spark, d), views.prices_big(spark, d), "ticker")


@query(
    "batch_status",
    with_views(
        v.PRICES_BIG,
        f"""{_REQUESTS}, placed AS (SELECT ({_PICK['previous']}) AS hit FROM requests r)
        SELECT count(*) AS requests, count(hit) AS succeeded,
               CASE WHEN count(hit) = count(*) THEN 'ok' WHEN count(hit) = 0 THEN 'error' ELSE 'partial' END AS overall FROM placed""",
    ),
)
def _(spark, d):
    series = views.prices_big(spark, d).select("ticker", "date", "close")
    return op.batch_status(op.asof(_requests(spark, d), series, ["ticker"], "target", "date", "previous", ["request_id"]))
