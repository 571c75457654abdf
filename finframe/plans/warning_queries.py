"""Texts of warnings, the days available where a request misses, and the keys that may be asked."""

from pyspark.sql import functions as F

from finframe.functions.matching import STOP_WORDS
from finframe.functions.scalars import shaped
from finframe.operators import align
from finframe.operators import prices as px
from finframe.operators import rates as rt
from finframe.operators import text as tx
from finframe.plans import align_queries, price_queries, rate_queries
from finframe.plans import sqlviews as v
from finframe.plans.base import ORACLES, query, with_views
from finframe.plans.text_queries import BM25, benchmark_queries
from finframe.sources import views


def _moved(asked, took, mode):
    return f"CASE WHEN {took} <> {asked} THEN {asked} || ' is not in the series; took ' || {took} || ' ({mode})' END"


@query(
    "price_return_warnings",
    f"""SELECT request_id, ticker, start, "end", status, CASE WHEN status = 'ok' THEN concat_ws('; ', {_moved('start', 'resolved_start', 'nearest')}, {_moved('"end"', 'resolved_end', 'nearest')}) END AS warnings
    FROM ({ORACLES['price_return']}) o""",
)
def _(spark, d):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    asked = views.table(spark, d, "orders").select(
        key.alias("request_id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 26).cast("string")).alias("ticker"),
        F.date_sub(day, (key % 50).cast("int")).alias("start"), F.date_add(day, (key % 700 - 20).cast("int")).alias("end"),
    )
    out = px.price_return(asked, price_queries.bars(spark, d), "nearest", ["request_id"])
    return shaped(out.select("request_id", "ticker", "start", "end", "status", F.array_join("warnings", "; ").alias("warnings")))


@query(
    "price_event_window_warnings",
    f"""SELECT event_id, pre, concat_ws('; ', {_moved('event_date', 'resolved_event_date', 'nearest')}, CASE WHEN truncated THEN 'window truncated at the edge of the series' END) AS warnings
    FROM ({ORACLES['price_event_window']}) o""",
)
def _(spark, d):
    key = F.col("event_id")
    events = views.table(spark, d, "events").select(
        key, F.col("user_id").cast("string").alias("ticker"), F.date_add(F.to_date("ts"), (key % 9 - 4).cast("int")).alias("event_date")
    )
    out = px.event_window(events, px.enrich(views.prices_wide(spark, d)), [(3, 3), (5, 5)], row_id=["event_id"])
    return out.select("event_id", "pre", F.array_join("warnings", "; ").alias("warnings"))


@query("rate_asof_warnings", f"SELECT *, {_moved('date', 'effective_date', 'previous')} AS warning FROM ({ORACLES['rate_asof']}) o")
def _(spark, d):
    out = rt.rate_at(rate_queries._asked(spark, d), views.rates(spark, d), row_id=["request_id"])
    return shaped(align.with_moved_note(out, "date", "effective_date"))


@query(
    "search_notes",
    with_views(
        v.ARTICLES,
        BM25 + """, q AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT -item_id - 1, 'zzqx' || item_id FROM benchmark)
        SELECT query_id, query, concat_ws('; ', CASE WHEN query_id NOT IN (SELECT query_id FROM scores) THEN 'no row holds a word of the query' END, 'found by stems: counts differ from those of whole words') AS warnings FROM q""",
    ),
)
def _(spark, d):
    index = tx.build_index(views.articles(spark, d), True, STOP_WORDS)
    lost = views.table(spark, d, "benchmark").select((-F.col("item_id") - 1).alias("query_id"), F.concat(F.lit("zzqx"), F.col("item_id").cast("string")).alias("query"))
    asked = benchmark_queries(spark, d).unionByName(lost)
    return tx.search_notes(index, asked, tx.asked_terms(index, asked)).withColumn("warnings", F.array_join("warnings", "; "))


def _available(mode):
    @query(
        f"asof_{mode}_available",
        with_views(
            v.PRICES_BIG,
            f"""days AS (SELECT ticker, CAST(min(date) AS VARCHAR) AS available_start, CAST(max(date) AS VARCHAR) AS available_end FROM prices GROUP BY 1)
            SELECT o.*, available_start, available_end FROM ({ORACLES[f'asof_{mode}']}) o LEFT JOIN days USING (ticker)""",
        ).replace("days AS (SELECT ticker, CAST", ", days AS (SELECT ticker, CAST", 1),
    )
    def _(spark, d):
        series = views.prices_big(spark, d).select("ticker", "date", F.round("close", 4).alias("close"))
        out = align.asof(align_queries._requests(spark, d), series, ["ticker"], "target", "date", mode, ["request_id"])
        return shaped(align.with_available(out, series, ["ticker"], "date"))


_available("previous")
_available("exact")


@query(
    "unknown_tickers_report",
    with_views(
        v.PRICES_BIG,
        align_queries._REQUESTS + """ SELECT DISTINCT ticker, 'UNKNOWN_TICKER' AS status FROM requests WHERE ticker NOT IN (SELECT ticker FROM prices)
        UNION ALL SELECT DISTINCT ticker, 'VALID' FROM prices WHERE EXISTS (SELECT 1 FROM requests WHERE ticker NOT IN (SELECT ticker FROM prices))""",
    ),
)
def _(spark, d):
    return align.key_report(align_queries._requests(spark, d), views.prices_big(spark, d), "ticker")
