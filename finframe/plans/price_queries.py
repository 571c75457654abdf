"""Queries of the price-series operators."""

from pyspark.sql import functions as F

from finframe.functions.scalars import shaped
from finframe.operators import prices as op
from finframe.plans import sqlviews as v
from finframe.plans.base import query, with_views
from finframe.sources import views

BARS = v.PRICES_BIG + v.ENRICHED
WIDE_BARS = v.PRICES_WIDE + v.ENRICHED

# windows that overhang or miss the span keep the per-row status visible
WINDOWS = [("1996", "1996-01-02", "1996-12-30"), ("mid", "1998-03-07", "1999-09-19"), ("late", "2000-06-01", "2003-01-01")]


def windows_sql(windows):
    rows = ", ".join(f"('{n}', DATE '{s}', DATE '{e}')" for n, s, e in windows)
    return f""", wins AS (SELECT * FROM (VALUES {rows}) w(label, w_start, w_end)),
    near AS (SELECT label, ticker, arg_min(date, (abs(date_diff('day', date, w_start)), date)) AS s_date,
               arg_min(date, (abs(date_diff('day', date, w_end)), date)) AS e_date FROM bars, wins GROUP BY 1, 2),
    rets AS (SELECT near.label, near.ticker, s_date, e_date, s.close AS s_close, e.close AS e_close, s.rn AS s_rn, e.rn AS e_rn, e.close / s.close - 1 AS ret
             FROM near JOIN bars s ON s.ticker = near.ticker AND s.date = s_date JOIN bars e ON e.ticker = near.ticker AND e.date = e_date)"""


# daily compounding needs moves of a few percent, so these closes are lifted
DAMPED = v.PRICES_BIG + ", damped AS (SELECT ticker, date, close + 100000 AS close FROM prices)" + v.ENRICHED.replace("FROM prices", "FROM damped")


def bars(spark, d):
    return op.enrich(views.prices_big(spark, d))


def damped_bars(spark, d):
    return op.enrich(views.prices_big(spark, d).select("ticker", "date", (F.col("close") + 100000).alias("close")))


@query(
    "price_return",
    with_views(
        BARS,
        """, req AS (SELECT o_orderkey AS request_id, 'Brand#' || (o_custkey % 26) AS ticker, CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 50 AS INTEGER) AS DATE) AS start,
               CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 700 - 20 AS INTEGER) AS DATE) AS "end" FROM orders),
        days AS (SELECT DISTINCT ticker, start AS day FROM req UNION SELECT DISTINCT ticker, "end" FROM req),
        prevs AS (SELECT d.ticker, d.day, b.date AS p FROM days d ASOF LEFT JOIN bars b ON b.ticker = d.ticker AND b.date <= d.day),
        nexts AS (SELECT d.ticker, d.day, b.date AS x FROM days d ASOF LEFT JOIN bars b ON b.ticker = d.ticker AND b.date >= d.day),
        res AS (SELECT ticker, day, CASE WHEN x IS NULL OR (p IS NOT NULL AND date_diff('day', p, day) <= date_diff('day', day, x)) THEN p ELSE x END AS hit FROM prevs JOIN nexts USING (ticker, day)),
        o AS (SELECT request_id, req.ticker, start, "end", sb.date AS sd, eb.date AS ed, sb.close AS sc, eb.close AS ec, sb.rn AS sr, eb.rn AS er,
              CASE WHEN start > "end" THEN 'DATE_RANGE_INVALID' WHEN req.ticker NOT IN (SELECT ticker FROM bars) THEN 'UNKNOWN_TICKER' ELSE 'ok' END AS status
              FROM req LEFT JOIN res s ON s.ticker = req.ticker AND s.day = req.start LEFT JOIN res e ON e.ticker = req.ticker AND e.day = req."end"
              LEFT JOIN bars sb ON sb.ticker = req.ticker AND sb.date = s.hit LEFT JOIN bars eb ON eb.ticker = req.ticker AND eb.date = e.hit)
        SELECT request_id, ticker, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", status,
          CASE WHEN status = 'ok' THEN CAST(sd AS VARCHAR) END AS resolved_start, CASE WHEN status = 'ok' THEN CAST(ed AS VARCHAR) END AS resolved_end,
          CASE WHEN status = 'ok' THEN sc END AS start_close, CASE WHEN status = 'ok' THEN ec END AS end_close,
          CASE WHEN status = 'ok' THEN round((ec / sc - 1) * 100, 4) END AS return_pct, CASE WHEN status = 'ok' THEN er - sr + 1 END AS trading_days,
          CASE WHEN status = 'ok' THEN (CASE WHEN sd <> start THEN 1 ELSE 0 END) + (CASE WHEN ed <> "end" THEN 1 ELSE 0 END) END AS warning_count FROM o""",
    ),
)
def _(spark, d):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    asked = views.table(spark, d, "orders").select(
        key.alias("request_id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 26).cast("string")).alias("ticker"),
        F.date_sub(day, (key % 50).cast("int")).alias("start"), F.date_add(day, (key % 700 - 20).cast("int")).alias("end"),
    )
    out = op.price_return(asked, bars(spark, d), "nearest", ["request_id"])
    return shaped(out.withColumn("warning_count", F.size("warnings")).drop("warnings", "return_decimal"))


def _ranked_extreme(name, field, direction, n, order, cond):
    @query(
        name,
        with_views(
            v.PRICES_WIDE,
            f""", r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY {field} {order}, date) AS rank FROM prices WHERE {cond} AND {field} IS NOT NULL)
            SELECT ticker, '{field}' AS field, '{direction}' AS direction, rank, CAST(date AS VARCHAR) AS date, {field} AS value FROM r WHERE rank <= {n}""",
        ),
    )
    def _(spark, d):
        bounds = ("2024-01-05", "2024-01-25") if "BETWEEN" in cond else (None, None)
        return shaped(op.price_extreme(views.prices_wide(spark, d), field, direction, n, *bounds))


_ranked_extreme("price_extreme", "close", "highest", 1, "DESC", "true")
_ranked_extreme("price_extreme_low", "low", "lowest", 3, "ASC", "date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'")
_ranked_extreme("price_extreme_volume", "volume", "highest", 3, "DESC", "true")


def _moves(name, direction, order, cond, bounds):
    @query(
        name,
        with_views(
            BARS,
            f""", r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY daily_return {order}, date) AS rank FROM bars WHERE daily_return IS NOT NULL AND {cond})
            SELECT ticker, '{direction}' AS direction, rank, CAST(date AS VARCHAR) AS date, round(daily_return * 100, 4) AS pct_change,
                   previous_close, close, CAST(previous_date AS VARCHAR) AS previous_date FROM r WHERE rank <= 3""",
        ),
    )
    def _(spark, d):
        return shaped(op.biggest_move(bars(spark, d), direction, 3, *bounds))


_moves("price_biggest_gain", "gain", "DESC", "date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", ("1997-01-01", "1997-12-31"))
_moves("price_biggest_move", "decline", "ASC", "true", (None, None))


def _drawdown(name, basis, peak, trough, cond, bounds):
    sql = with_views(
        v.PRICES_BIG,
        f""", w AS (SELECT * FROM prices WHERE {cond}),
        t AS (SELECT ticker, date, close, {peak} AS p, {trough} AS t, max({peak}) OVER (PARTITION BY ticker ORDER BY date) AS top, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM w),
        f AS (SELECT *, t / top - 1 AS fall FROM t),
        worst AS (SELECT ticker, least(min(fall), 0.0) AS fall, count(*) AS records_used FROM f GROUP BY 1),
        trough AS (SELECT worst.ticker, worst.fall, records_used, CASE WHEN worst.fall < 0 THEN min(f.date) FILTER (f.fall = worst.fall) ELSE min(f.date) END AS trough_date
                   FROM worst JOIN f USING (ticker) GROUP BY 1, 2, 3),
        peak AS (SELECT trough.*, x.t AS trough_price, CASE WHEN trough.fall < 0 THEN x.top ELSE x.p END AS peak_price FROM trough JOIN f x ON x.ticker = trough.ticker AND x.date = trough_date),
        dated AS (SELECT peak.*, (SELECT min(f.date) FROM f WHERE f.ticker = peak.ticker AND f.p = peak.peak_price) AS peak_date FROM peak)
        SELECT ticker, '{basis}' AS basis, round(fall * 100, 4) AS max_drawdown_pct, CAST(peak_date AS VARCHAR) AS peak_date, peak_price,
               CAST(trough_date AS VARCHAR) AS trough_date, trough_price, date_diff('day', peak_date, trough_date) AS drawdown_days,
               CAST((SELECT min(f.date) FROM f WHERE f.ticker = dated.ticker AND f.date > trough_date AND f.close >= peak_price) AS VARCHAR) AS recovery_date, records_used FROM dated""",
    )

    @query(name, sql)
    def _(spark, d):
        return shaped(op.max_drawdown(views.prices_big(spark, d), basis, *bounds))


_drawdown("price_drawdown", "close", "close", "close", "true", (None, None))
_drawdown("price_drawdown_intraday", "intraday", "high", "low", "date BETWEEN DATE '1997-02-01' AND DATE '1997-03-31'", ("1997-02-01", "1997-03-31"))


@query(
    "price_worst_drawdowns",
    with_views(
        v.PRICES_BIG,
        """, f AS (SELECT ticker, date, close / max(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS fall FROM prices WHERE ticker NOT IN ('Brand#1', 'Brand#2'))
        SELECT ticker, round(min(fall) * 100, 4) AS max_drawdown_pct FROM f GROUP BY 1 ORDER BY 2, 1 LIMIT 5""",
    ),
)
def _(spark, d):
    return op.worst_drawdowns(views.prices_big(spark, d), 5, ["Brand#1", "Brand#2"]).select("ticker", "max_drawdown_pct")


@query(
    "price_rank_returns",
    with_views(
        BARS,
        windows_sql(WINDOWS) + """ SELECT label, row_number() OVER (PARTITION BY label ORDER BY ret DESC, ticker) AS rank, ticker, round(ret * 100, 4) AS return_pct,
        s_close AS start_close, e_close AS end_close, CAST(s_date AS VARCHAR) AS resolved_start, CAST(e_date AS VARCHAR) AS resolved_end, e_rn - s_rn + 1 AS trading_days FROM rets""",
    ),
)
def _(spark, d):
    return shaped(op.rank_returns(bars(spark, d), WINDOWS))


@query(
    "price_best_and_worst",
    with_views(
        BARS,
        windows_sql(WINDOWS) + """, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ret DESC, ticker) AS rank, count(*) OVER (PARTITION BY label) AS c FROM rets)
        SELECT label, max(ticker) FILTER (rank = 1) AS best, max(ticker) FILTER (rank = c) AS worst, count(*) AS ranked, 0 AS skipped FROM k GROUP BY 1""",
    ),
)
def _(spark, d):
    return op.best_and_worst(bars(spark, d), WINDOWS)


@query(
    "price_skipped_tickers",
    with_views(
        WIDE_BARS,
        """, ends AS (SELECT ticker, max(date) FILTER (date <= DATE '2024-01-02') AS s, max(date) FILTER (date <= DATE '2024-01-20') AS e FROM bars GROUP BY 1)
        SELECT ticker, CAST(s AS VARCHAR) AS resolved_start, CAST(e AS VARCHAR) AS resolved_end, CASE WHEN s IS NULL OR e IS NULL THEN 'DATE_OUTSIDE_COVERAGE' ELSE 'ok' END AS status FROM ends""",
    ),
)
def _(spark, d):
    wide = op.enrich(views.prices_wide(spark, d))
    out = op.window_returns(wide, [("jan", "2024-01-02", "2024-01-20")], "previous")
    return shaped(out.select("ticker", "resolved_start", "resolved_end", "status"))


@query(
    "price_volume_rank",
    with_views(
        v.PRICES_WIDE,
        """SELECT ticker, CAST(sum(volume) AS BIGINT) AS total_volume, count(*) AS trading_days, row_number() OVER (ORDER BY sum(volume) DESC, ticker) AS rank FROM prices GROUP BY ticker""",
    ),
)
def _(spark, d):
    return op.volume_rank(views.prices_wide(spark, d), "total")


@query(
    "price_volume_rank_average",
    with_views(
        v.PRICES_BIG,
        """SELECT ticker, CAST(round(avg(volume)) AS BIGINT) AS average_volume, count(*) AS trading_days, row_number() OVER (ORDER BY CAST(round(avg(volume)) AS BIGINT) DESC, ticker) AS rank
        FROM prices WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY ticker""",
    ),
)
def _(spark, d):
    return op.volume_rank(views.prices_big(spark, d), "average", "1997-01-01", "1998-12-31")


_EVENTS = """, ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS ticker, CAST(CAST(ts AS DATE) + CAST(event_id % 9 - 4 AS INTEGER) AS DATE) AS event_date FROM events)"""


@query(
    "price_event_window",
    with_views(
        WIDE_BARS,
        _EVENTS + """, hit AS (SELECT event_id, ev.ticker, event_date, arg_min(b.rn, (abs(date_diff('day', b.date, ev.event_date)), b.date)) AS pos FROM ev JOIN bars b ON b.ticker = ev.ticker GROUP BY 1, 2, 3),
        w AS (SELECT hit.event_id, hit.ticker, hit.event_date, pos, n, pre, greatest(1, pos - pre) AS lo, least(n, pos + pre) AS hi, (pos - pre < 1 OR pos + pre > n) AS truncated
              FROM hit JOIN bars b ON b.ticker = hit.ticker AND b.rn = pos, (VALUES (3), (5)) s(pre))
        SELECT event_id, w.ticker, CAST(event_date AS VARCHAR) AS event_date, CAST(a.date AS VARCHAR) AS resolved_event_date, a.close AS event_close, pre, pre AS post,
          CAST(l.date AS VARCHAR) AS window_start_date, l.close AS window_start_close, CAST(h.date AS VARCHAR) AS window_end_date, h.close AS window_end_close,
          round((h.close / l.close - 1) * 100, 4) AS window_return_pct, hi - lo + 1 AS trading_days, truncated, 'ok' AS status
        FROM w JOIN bars a ON a.ticker = w.ticker AND a.rn = pos JOIN bars l ON l.ticker = w.ticker AND l.rn = lo JOIN bars h ON h.ticker = w.ticker AND h.rn = hi""",
    ),
)
def _(spark, d):
    key = F.col("event_id")
    events = views.table(spark, d, "events").select(
        key, F.col("user_id").cast("string").alias("ticker"), F.date_add(F.to_date("ts"), (key % 9 - 4).cast("int")).alias("event_date")
    )
    wide = op.enrich(views.prices_wide(spark, d))
    return shaped(op.event_window(events, wide, [(3, 3), (5, 5)], row_id=["event_id"]).drop("warnings", "return_decimal"))


@query(
    "basket_hold",
    with_views(BARS, windows_sql(WINDOWS) + " SELECT label, round(avg(ret) * 100, 4) AS return_pct, count(*) AS member_count, 0 AS skipped FROM rets WHERE ticker <> 'Brand#7' GROUP BY 1"),
)
def _(spark, d):
    return op.basket_held(bars(spark, d), WINDOWS, exclude=["Brand#7"])


@query(
    "basket_daily",
    with_views(
        DAMPED,
        windows_sql(WINDOWS) + """, held AS (SELECT label, b.date, avg(daily_return) AS m FROM rets JOIN bars b ON b.ticker = rets.ticker AND b.rn > s_rn AND b.rn <= e_rn GROUP BY 1, 2),
        c AS (SELECT label, count(*) AS member_count FROM rets GROUP BY 1)
        SELECT label, round((product(1 + m) - 1) * 100, 4) AS return_pct, member_count FROM held JOIN c USING (label) GROUP BY label, member_count""",
    ),
)
def _(spark, d):
    return op.basket_daily(damped_bars(spark, d), WINDOWS)


@query(
    "basket_daily_ordinal",
    with_views(
        DAMPED,
        windows_sql(WINDOWS[:1]) + """, width AS (SELECT min(e_rn - s_rn) AS w, count(*) AS member_count FROM rets),
        held AS (SELECT b.rn - s_rn AS k, avg(daily_return) AS m FROM rets JOIN bars b ON b.ticker = rets.ticker AND b.rn > s_rn AND b.rn <= e_rn WHERE b.rn - s_rn <= (SELECT w FROM width) GROUP BY 1)
        SELECT '1996' AS label, round((product(1 + m) - 1) * 100, 4) AS return_pct, (SELECT member_count FROM width) AS member_count FROM held""",
    ),
)
def _(spark, d):
    return op.basket_daily(damped_bars(spark, d), WINDOWS[:1], align="ordinal")


@query(
    "price_summary_stat",
    with_views(
        v.PRICES_BIG,
        """, s AS (SELECT ticker, round(stddev_pop(close), 4) AS value, count(*) AS trading_days FROM prices WHERE date >= DATE '1996-01-01' GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY value DESC, ticker) AS rank FROM s""",
    ),
)
def _(spark, d):
    return op.summary_stat(views.prices_big(spark, d), "close", "stddev", "1996-01-01")


def _stat(agg, sql):
    @query(
        f"price_stat_{agg}",
        with_views(v.PRICES_BIG, f", s AS (SELECT ticker, round({sql}, 4) AS value, count(*) AS trading_days FROM prices GROUP BY 1) SELECT *, row_number() OVER (ORDER BY value DESC, ticker) AS rank FROM s"),
    )
    def _(spark, d):
        return op.summary_stat(views.prices_big(spark, d), "close", agg)


_stat("median", "median(close)")
_stat("sum", "sum(close)")


@query(
    "price_above_below",
    with_views(
        v.PRICES_BIG,
        """, s AS (SELECT ticker, round(avg(close), 4) AS value, count(*) AS trading_days FROM prices GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY value DESC, ticker) AS rank, (SELECT value FROM s WHERE ticker = 'Brand#5') AS anchor_value,
          value > (SELECT value FROM s WHERE ticker = 'Brand#5') AS above, value < (SELECT value FROM s WHERE ticker = 'Brand#5') AS below, 'ok' AS anchor_status FROM s""",
    ),
)
def _(spark, d):
    return op.summary_stat(views.prices_big(spark, d), "close", "avg", compare_to="Brand#5")


@query(
    "price_above_below_unknown",
    with_views(
        v.PRICES_BIG,
        """, s AS (SELECT ticker, round(avg(close), 4) AS value, count(*) AS trading_days FROM prices GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY value DESC, ticker) AS rank, CAST(NULL AS DOUBLE) AS anchor_value, CAST(NULL AS BOOLEAN) AS above, CAST(NULL AS BOOLEAN) AS below, 'UNKNOWN_TICKER' AS anchor_status FROM s""",
    ),
)
def _(spark, d):
    return op.summary_stat(views.prices_big(spark, d), "close", "avg", compare_to="Brand#99")


@query(
    "price_window_returns_status",
    with_views(
        BARS,
        windows_sql(WINDOWS[:1]) + """ SELECT ticker, label, CAST(s_date AS VARCHAR) AS resolved_start, e_rn - s_rn + 1 AS trading_days, 'ok' AS status FROM rets
        UNION ALL SELECT DISTINCT ticker, 'inverted', NULL, NULL, 'DATE_RANGE_INVALID' FROM bars""",
    ),
)
def _(spark, d):
    out = op.window_returns(bars(spark, d), [WINDOWS[0], ("inverted", "1997-05-01", "1996-05-01")])
    return shaped(out.select("ticker", "label", "resolved_start", "trading_days", "status"))


YEARS = [(str(y), f"{y}-01-02", f"{y}-12-30") for y in range(1995, 2002)]


@query(
    "price_year_grid",
    with_views(
        BARS,
        windows_sql(YEARS) + """ SELECT ticker, label, CAST(s_date AS VARCHAR) AS resolved_start, CAST(e_date AS VARCHAR) AS resolved_end, round(ret * 100, 4) AS return_pct,
        e_rn - s_rn + 1 AS trading_days, 'ok' AS status FROM rets""",
    ),
)
def _(spark, d):
    out = op.window_returns(bars(spark, d), YEARS)
    return shaped(
        out.select("ticker", "label", "resolved_start", "resolved_end", F.round(F.col("return_decimal") * 100, 4).alias("return_pct"), "trading_days", "status")
    )


@query(
    "panel_dimensions",
    with_views(
        v.PRICES_WIDE,
        """, t AS (SELECT ticker, min(date) AS s, max(date) AS e, count(*) AS c FROM prices GROUP BY 1)
        SELECT CAST(sum(c) AS BIGINT) AS "rows", count(*) AS tickers, CAST(min(s) AS VARCHAR) AS first_date, CAST(max(e) AS VARCHAR) AS last_date,
          CAST(max(s) AS VARCHAR) AS common_start, CAST(min(e) AS VARCHAR) AS common_end, (SELECT count(DISTINCT date) FROM prices) AS dates FROM t""",
    ),
)
def _(spark, d):
    return shaped(op.panel_dimensions(views.prices_wide(spark, d)))


@query(
    "price_high_low",
    with_views(
        v.PRICES_WIDE,
        """SELECT ticker, max(close) AS highest_close, CAST(arg_min(date, (-close, date)) AS VARCHAR) AS highest_date, min(close) AS lowest_close,
        CAST(arg_min(date, (close, date)) AS VARCHAR) AS lowest_date FROM prices GROUP BY 1""",
    ),
)
def _(spark, d):
    return shaped(op.high_and_low(views.prices_wide(spark, d)))


_TOTAL = """, t AS (SELECT ticker, min(date) AS first_date, max(date) AS last_date, arg_max(close, date) / arg_min(close, date) - 1 AS r FROM prices GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY r DESC, ticker) AS rank, count(*) OVER () AS c FROM t)"""


@query(
    "price_total_return",
    with_views(v.PRICES_WIDE, _TOTAL + " SELECT ticker, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, rank, round(r * 100, 4) AS return_pct FROM k"),
)
def _(spark, d):
    return shaped(op.total_return_ranks(views.prices_wide(spark, d)))


@query("price_rank_of_ticker", with_views(v.PRICES_BIG, _TOTAL + " SELECT ticker, rank, c AS ticker_count, round(r * 100, 4) AS return_pct, 'ok' AS status FROM k WHERE ticker = 'Brand#3'"))
def _(spark, d):
    return op.rank_of(views.prices_big(spark, d), "Brand#3")


@query(
    "price_top_performer",
    with_views(
        v.PRICES_WIDE,
        _TOTAL + """ SELECT max(ticker) FILTER (rank = 1) AS best, round(max(r) * 100, 4) AS best_pct, max(ticker) FILTER (rank = c) AS worst, round(min(r) * 100, 4) AS worst_pct FROM k""",
    ),
)
def _(spark, d):
    return op.top_performers(views.prices_wide(spark, d))


@query(
    "price_volume_stats",
    with_views(v.PRICES_BIG, "SELECT ticker, max(volume) AS peak_volume, CAST(arg_min(date, (-volume, date)) AS VARCHAR) AS peak_date, round(avg(volume), 2) AS mean_volume FROM prices GROUP BY 1"),
)
def _(spark, d):
    return shaped(op.volume_stats(views.prices_big(spark, d)))


@query("price_tickers", with_views(v.PRICES_WIDE, "SELECT DISTINCT ticker, (SELECT count(DISTINCT ticker) FROM prices) AS ticker_count FROM prices"))
def _(spark, d):
    names = views.prices_wide(spark, d).select("ticker").distinct()
    return names.withColumn("ticker_count", names.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("price_volatility", with_views(BARS, "SELECT ticker, round(stddev_samp(daily_return) * 100, 4) AS volatility_pct FROM bars GROUP BY 1"))
def _(spark, d):
    return op.volatility(bars(spark, d))


@query(
    "price_correlation",
    with_views(BARS, "SELECT b.ticker, round(corr(b.daily_return, a.daily_return), 3) AS correlation FROM bars b JOIN bars a ON a.date = b.date AND a.ticker = 'Brand#4' GROUP BY 1"),
)
def _(spark, d):
    return op.correlation_with(bars(spark, d), "Brand#4")


# the bars with one close in five unknown
_GAPPED = v.PRICES_WIDE.replace("prices AS", "whole AS") + """, prices AS (
  SELECT ticker, date, open, high, low, CASE WHEN volume % 5 <> 0 THEN close END AS close, volume FROM whole)"""


def _gapped(spark, d):
    bars = views.prices_wide(spark, d)
    return bars.withColumn("close", F.when(F.col("volume") % 5 != 0, F.col("close")))


@query("price_rank_unknown", with_views(v.PRICES_BIG, "SELECT 'nobody' AS ticker, CAST(NULL AS BIGINT) AS rank, count(DISTINCT ticker) AS ticker_count, CAST(NULL AS DOUBLE) AS return_pct, 'UNKNOWN_TICKER' AS status FROM prices"))
def _(spark, d):
    return op.rank_of(views.prices_big(spark, d), "nobody")


@query(
    "price_high_low_nulls",
    with_views(
        _GAPPED,
        """SELECT ticker, max(close) AS highest_close, CAST(arg_min(date, (-close, date)) FILTER (close IS NOT NULL) AS VARCHAR) AS highest_date, min(close) AS lowest_close,
        CAST(arg_min(date, (close, date)) FILTER (close IS NOT NULL) AS VARCHAR) AS lowest_date FROM prices GROUP BY 1 HAVING count(close) > 0""",
    ),
)
def _(spark, d):
    return shaped(op.high_and_low(_gapped(spark, d)))


@query(
    "price_top_performer_nulls",
    with_views(
        _GAPPED,
        """, e AS (SELECT ticker, min(date) AS a, max(date) AS b FROM prices GROUP BY 1),
        t AS (SELECT e.ticker, y.close / x.close - 1 AS r FROM e JOIN prices x ON x.ticker = e.ticker AND x.date = a JOIN prices y ON y.ticker = e.ticker AND y.date = b),
        k AS (SELECT *, row_number() OVER (ORDER BY r DESC, ticker) AS rank, count(*) OVER () AS c FROM t WHERE r IS NOT NULL)
        SELECT max(ticker) FILTER (rank = 1) AS best, round(max(r) * 100, 4) AS best_pct, max(ticker) FILTER (rank = c) AS worst, round(min(r) * 100, 4) AS worst_pct FROM k""",
    ),
)
def _(spark, d):
    return op.top_performers(_gapped(spark, d))
