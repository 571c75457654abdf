"""Operators over request tables: a ticker or series and a window of days for each request."""

from pyspark.sql import functions as F

from finframe.functions.scalars import round4, shaped
from finframe.operators import orderstats as st
from finframe.operators import prices as px
from finframe.operators import text as tx
from finframe.operators import windows as op
from finframe.plans import sqlviews as v
from finframe.plans.base import query, with_views
from finframe.sources import views

# windows that are inverted, miss the span, name unknown tickers or have no bound
_REQ = """, req AS (SELECT o_orderkey AS request_id, 'Brand#' || (o_custkey % 26) AS ticker, CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 50 AS INTEGER) AS DATE) AS start,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 700 - 60 AS INTEGER) AS DATE) END AS "end" FROM orders),
cover AS (SELECT ticker, min(date) AS available_start, max(date) AS available_end FROM prices GROUP BY 1)"""
_STATUS = """CASE WHEN available_start IS NULL THEN 'UNKNOWN_TICKER' WHEN start > "end" THEN 'DATE_RANGE_INVALID' WHEN {found} IS NULL THEN 'NO_MATCHING_RECORDS' ELSE 'ok' END AS status,
  CAST(available_start AS VARCHAR) AS available_start, CAST(available_end AS VARCHAR) AS available_end"""
_ASKED = 'request_id, ticker, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end"'
_INSIDE = 'p.ticker = req.ticker AND p.date >= start AND (p.date <= "end" OR "end" IS NULL)'


def _requests(spark, d):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return views.table(spark, d, "orders").select(
        key.alias("request_id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 26).cast("string")).alias("ticker"), F.date_sub(day, (key % 50).cast("int")).alias("start"),
        F.when(key % 97 != 0, F.date_add(day, (key % 700 - 60).cast("int"))).alias("end"))


def _extremes(name, field, direction, n, order):
    @query(
        name,
        with_views(
            v.PRICES_BIG,
            f"""{_REQ}, hit AS (SELECT request_id, p.date, {field} AS value, row_number() OVER (PARTITION BY request_id ORDER BY {field} {order}, p.date) AS rank FROM req JOIN prices p ON {_INSIDE} AND {field} IS NOT NULL)
            SELECT {_ASKED}, rank, CAST(date AS VARCHAR) AS date, value, {_STATUS.format(found='rank')} FROM req LEFT JOIN (SELECT * FROM hit WHERE rank <= {n}) h USING (request_id) LEFT JOIN cover USING (ticker)""",
        ),
    )
    def _(spark, d):
        return shaped(op.price_extremes(_requests(spark, d), views.prices_big(spark, d), field, direction, n))


_extremes("price_extreme_requests", "close", "highest", 1, "DESC")
_extremes("price_extreme_low_requests", "low", "lowest", 3, "ASC")
_extremes("price_extreme_volume_requests", "volume", "highest", 2, "DESC")


def _moves(name, direction, n, order):
    @query(
        name,
        with_views(
            v.PRICES_BIG + v.ENRICHED,
            f"""{_REQ}, hit AS (SELECT request_id, p.date, daily_return, previous_close, previous_date, close, row_number() OVER (PARTITION BY request_id ORDER BY daily_return {order}, p.date) AS rank
              FROM req JOIN bars p ON {_INSIDE} AND daily_return IS NOT NULL)
            SELECT {_ASKED}, rank, CAST(date AS VARCHAR) AS date, round(daily_return * 100, 4) AS pct_change, previous_close, CAST(previous_date AS VARCHAR) AS previous_date, close, {_STATUS.format(found='rank')}
            FROM req LEFT JOIN (SELECT * FROM hit WHERE rank <= {n}) h USING (request_id) LEFT JOIN cover USING (ticker)""",
        ),
    )
    def _(spark, d):
        return shaped(op.biggest_moves(_requests(spark, d), px.enrich(views.prices_big(spark, d)), direction, n))


_moves("price_biggest_gain_requests", "gain", 1, "DESC")
_moves("price_biggest_decline_requests", "decline", 2, "ASC")


def _drawdown(name, basis, peak, trough):
    @query(
        name,
        with_views(
            v.PRICES_BIG,
            f"""{_REQ}, r AS (SELECT request_id, p.date, close, {peak} AS p, {trough} AS t, max({peak}) OVER (PARTITION BY request_id ORDER BY p.date) AS top FROM req JOIN prices p ON {_INSIDE}),
            q AS (SELECT r.*, min(CASE WHEN p = top THEN date END) OVER (PARTITION BY request_id, top) AS top_date, least(t / top - 1, 0) AS fall FROM r),
            w AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS days, row_number() OVER (PARTITION BY request_id ORDER BY fall, date) AS k FROM q),
            worst AS (SELECT request_id, fall, date AS trough_date, CASE WHEN fall < 0 THEN top ELSE p END AS peak, CASE WHEN fall < 0 THEN top_date ELSE date END AS peak_date, t AS trough, days FROM w WHERE k = 1),
            back AS (SELECT request_id, min(r.date) AS recovery_date FROM r JOIN worst USING (request_id) WHERE r.date > trough_date AND r.close >= peak GROUP BY 1)
            SELECT {_ASKED}, round(fall * 100, 4) AS max_drawdown_pct, CAST(peak_date AS VARCHAR) AS peak_date, peak AS peak_price, CAST(trough_date AS VARCHAR) AS trough_date, trough AS trough_price,
              date_diff('day', peak_date, trough_date) AS drawdown_days, CAST(recovery_date AS VARCHAR) AS recovery_date, days AS records_used, {_STATUS.format(found='days')}
            FROM req LEFT JOIN worst USING (request_id) LEFT JOIN back USING (request_id) LEFT JOIN cover USING (ticker)""",
        ),
    )
    def _(spark, d):
        return shaped(op.drawdowns(_requests(spark, d), views.prices_big(spark, d), basis))


_drawdown("price_drawdown_requests", "close", "close", "close")
_drawdown("price_drawdown_intraday_requests", "intraday", "high", "low")

_RATE_REQ = """, req AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE k.series_key END AS series_key, CAST(DATE '1991-06-01' + CAST(c_custkey * 37 % 3000 AS INTEGER) AS DATE) AS start,
  CAST(DATE '1991-06-01' + CAST(c_custkey * 37 % 3000 + c_custkey * 53 % 1500 - 40 AS INTEGER) AS DATE) AS "end"
  FROM customer JOIN (SELECT series_key, row_number() OVER (ORDER BY series_key) - 1 AS i FROM (SELECT DISTINCT series_key FROM rates)) k ON k.i = c_custkey % 5),
cover AS (SELECT series_key, min(effective_date) AS available_start, max(effective_date) AS available_end FROM rates GROUP BY 1)"""


def _rate_requests(spark, d):
    """One window per customer, for one of the five series."""
    names = F.create_map(*[F.lit(x) for pair in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) for x in pair])
    key, first = F.col("c_custkey"), F.lit("1991-06-01").cast("date")
    begin = (key * 37 % 3000).cast("int")
    return views.table(spark, d, "customer").select(
        key.alias("request_id"), F.when(key % 7 == 0, "none").otherwise(names[(key % 5).cast("int")]).alias("series_key"),
        F.date_add(first, begin).alias("start"), F.date_add(first, begin + (key * 53 % 1500 - 40).cast("int")).alias("end"))


def _rates(name, direction, pick):
    @query(
        name,
        with_views(
            v.RATES,
            f"""{_RATE_REQ}, hit AS (SELECT request_id, effective_date AS date, target_bp, {pick}(target_bp) OVER (PARTITION BY request_id) AS best FROM req JOIN rates r ON r.series_key = req.series_key AND effective_date BETWEEN start AND "end"),
            found AS (SELECT request_id, any_value(best) AS best, min(date) FILTER (target_bp = best) AS f, max(date) FILTER (target_bp = best) AS l, count(*) FILTER (target_bp = best) AS record_count, count(*) AS records_used FROM hit GROUP BY 1)
            SELECT request_id, series_key, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", best / 100.0 AS target_pct, CAST(f AS VARCHAR) AS first_effective_date, CAST(l AS VARCHAR) AS last_effective_date,
              record_count, records_used, {_STATUS.format(found='best')} FROM req LEFT JOIN found USING (request_id) LEFT JOIN cover USING (series_key)""",
        ),
    )
    def _(spark, d):
        return shaped(op.rate_extremes(_rate_requests(spark, d), views.rates(spark, d), direction))


_rates("rate_extreme_highest_requests", "highest", "max")
_rates("rate_extreme_lowest_requests", "lowest", "min")


_IN_RATES = 'JOIN rates r ON r.series_key = req.series_key AND effective_date BETWEEN start AND "end"'
_RATE_ASKED = 'request_id, series_key, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end"'


@query(
    "rate_change_summary_requests",
    with_views(
        v.RATES,
        f"""{_RATE_REQ}, found AS (SELECT request_id, count(*) AS record_count, count(*) FILTER (change_bp <> 0) AS changed_count, count(*) FILTER (change_bp > 0) AS increases,
          count(*) FILTER (change_bp < 0) AS decreases, count(*) FILTER (change_bp = 0) AS holds, sum(change_bp) / 100.0 AS cumulative_pct, arg_min(target_bp - change_bp, effective_date) / 100.0 AS rate_before_pct,
          arg_max(target_bp, effective_date) / 100.0 AS rate_after_pct, CAST(min(effective_date) AS VARCHAR) AS window_start, CAST(max(effective_date) AS VARCHAR) AS window_end FROM req {_IN_RATES} GROUP BY 1)
        SELECT {_RATE_ASKED}, found.* EXCLUDE (request_id), {_STATUS.format(found='record_count')} FROM req LEFT JOIN found USING (request_id) LEFT JOIN cover USING (series_key)""",
    ),
)
def _(spark, d):
    return shaped(op.rate_changes(_rate_requests(spark, d), views.rates(spark, d)))


def _holds(name, kind, cond):
    @query(
        name,
        with_views(
            v.RATES,
            f"""{_RATE_REQ}, m AS (SELECT request_id, lag(effective_date) OVER w AS s, effective_date AS e, lag(target_bp) OVER w AS during, target_bp AS after FROM req {_IN_RATES} AND {cond}
              WINDOW w AS (PARTITION BY request_id ORDER BY effective_date)),
            found AS (SELECT * FROM m WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY date_diff('day', s, e) DESC, s) = 1)
            SELECT {_RATE_ASKED}, CAST(s AS VARCHAR) AS start_date, CAST(e AS VARCHAR) AS end_date, during / 100.0 AS rate_during_pct, after / 100.0 AS rate_after_pct, date_diff('day', s, e) AS gap_days,
              {_STATUS.format(found='s')} FROM req LEFT JOIN found USING (request_id) LEFT JOIN cover USING (series_key)""",
        ),
    )
    def _(spark, d):
        return shaped(op.longest_holds(_rate_requests(spark, d), views.rates(spark, d), kind))


_holds("rate_longest_hold_requests", "any_change", "change_bp <> 0")
_holds("rate_longest_hold_cut_requests", "cut", "change_bp < 0")


def _cycles(name, direction, select, order):
    @query(
        name,
        with_views(
            v.RATES,
            f"""{_RATE_REQ}, m AS (SELECT request_id, effective_date, target_bp, change_bp, CASE WHEN sign(change_bp) = lag(sign(change_bp)) OVER w THEN 0 ELSE 1 END AS turn FROM req {_IN_RATES} AND change_bp <> 0
              WINDOW w AS (PARTITION BY request_id ORDER BY effective_date)),
            n AS (SELECT *, sum(turn) OVER (PARTITION BY request_id ORDER BY effective_date) AS run FROM m),
            runs AS (SELECT request_id, run, count(*) AS move_count, sum(change_bp) AS cumulative_bp, min(effective_date) AS s, max(effective_date) AS e, arg_min(target_bp - change_bp, effective_date) AS before,
              arg_max(target_bp, effective_date) AS after FROM n GROUP BY 1, 2 HAVING max(change_bp) {'>' if direction == 'tightening' else '<'} 0),
            found AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS cycles_found FROM runs QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY {order}) = 1)
            SELECT {_RATE_ASKED}, move_count, CAST(s AS VARCHAR) AS start_date, CAST(e AS VARCHAR) AS end_date, date_diff('day', s, e) AS duration_days, cycles_found, cumulative_bp / 100.0 AS cumulative_pct,
              before / 100.0 AS rate_before_pct, after / 100.0 AS rate_after_pct, {_STATUS.format(found='s')} FROM req LEFT JOIN found USING (request_id) LEFT JOIN cover USING (series_key)""",
        ),
    )
    def _(spark, d):
        return shaped(op.rate_cycles(_rate_requests(spark, d), views.rates(spark, d), direction, select))


_cycles("rate_largest_cycle_requests", "tightening", "largest", "abs(cumulative_bp) DESC, s")
_cycles("rate_longest_cycle_requests", "easing", "most_moves", "move_count DESC, s")
_cycles("rate_latest_cycle_requests", "easing", "latest", "s DESC")


@query(
    "price_volume_rank_requests",
    with_views(
        v.PRICES_BIG,
        """, req AS (SELECT o_orderkey AS request_id, CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 50 AS INTEGER) AS DATE) AS start, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 - 60 AS INTEGER) AS DATE) AS "end",
            CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ['Brand#' || (o_custkey % 26), 'Brand#1', 'Brand#2', 'Brand#1'] END AS tickers FROM orders WHERE o_orderpriority = '1-URGENT'),
        every AS (SELECT DISTINCT ticker FROM prices), asked AS (SELECT request_id, start, "end", unnest(list_distinct(tickers)) AS ticker FROM req WHERE tickers IS NOT NULL
          UNION ALL SELECT request_id, start, "end", ticker FROM req, every WHERE tickers IS NULL),
        got AS (SELECT request_id, a.ticker, sum(volume) AS v, count(*) AS n FROM asked a JOIN prices p ON p.ticker = a.ticker AND p.date BETWEEN start AND "end" GROUP BY 1, 2)
        SELECT request_id, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", ticker, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY request_id ORDER BY v DESC NULLS LAST, ticker) END AS rank,
          CAST(v AS BIGINT) AS total_volume, n AS trading_days, CASE WHEN ticker NOT IN (SELECT ticker FROM every) THEN 'UNKNOWN_TICKER' WHEN start > "end" THEN 'DATE_RANGE_INVALID' WHEN v IS NULL THEN 'NO_MATCHING_RECORDS' ELSE 'ok' END AS status
        FROM asked LEFT JOIN got USING (request_id, ticker)""",
    ),
)
def _(spark, d):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    brand = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 26).cast("string"))
    asked = views.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(
        key.alias("request_id"), F.date_sub(day, (key % 50).cast("int")).alias("start"), F.date_add(day, (key % 90 - 60).cast("int")).alias("end"),
        F.when(key % 3 != 0, F.array(brand, F.lit("Brand#1"), F.lit("Brand#2"), F.lit("Brand#1"))).alias("tickers"))
    return shaped(op.volume_ranks(asked, views.prices_big(spark, d)))


def _cents(spark, d, field="close"):
    """Prices as exact decimals, so sums do not depend on their order."""
    return views.prices_big(spark, d).withColumn(field, F.col(field).cast("decimal(18,2)"))


# averages are rounded half-up on whole cents
_CENTS = "CAST(round({0} * 100) AS HUGEINT)"
_AVG4 = "CAST((2 * 10000 * sum({c}) + 100 * count(*)) // (200 * count(*)) AS DOUBLE) / 10000"
_DEV4 = "round(sqrt(CAST(count(*) * sum({c} * {c}) - sum({c}) * sum({c}) AS DOUBLE)) / count(*) / 100, 4)"


@query(
    "price_stat_requests",
    with_views(
        v.PRICES_BIG,
        f"""{_REQ}, hit AS (SELECT request_id, close, {_CENTS.format('close')} AS c FROM req JOIN prices p ON {_INSIDE}),
        got AS (SELECT request_id, count(*) AS days, {_AVG4.format(c='c')} AS avg, min(close) AS min, max(close) AS max, median(close) AS median, {_DEV4.format(c='c')} AS stddev, CAST(sum(c) AS DOUBLE) / 100 AS sum FROM hit GROUP BY 1)
        SELECT {_ASKED}, avg, min, max, round(median, 4) AS median, stddev, sum, days AS value_count, days, {_STATUS.format(found='days')} FROM req LEFT JOIN got USING (request_id) LEFT JOIN cover USING (ticker)""",
    ),
)
def _(spark, d):
    out = st.window_stats(_requests(spark, d), _cents(spark, d), "close")
    return shaped(out.withColumns({c: round4(F.col(c).cast("double")) for c in st.AGGREGATES}))


_GROUP_REQ = """, req AS (SELECT o_orderkey AS request_id, CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 50 AS INTEGER) AS DATE) AS start, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 - 60 AS INTEGER) AS DATE) AS "end",
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ['Brand#' || (o_custkey % 26), 'Brand#1', 'Brand#2', 'Brand#1'] END AS tickers, CASE WHEN o_orderkey % 5 > 0 THEN 'Brand#' || (o_custkey % 4) END AS compare_to FROM orders WHERE o_orderpriority = '1-URGENT'),
  every AS (SELECT DISTINCT ticker FROM prices), asked AS (SELECT request_id, start, "end", unnest(list_distinct(tickers)) AS ticker FROM req WHERE tickers IS NOT NULL
    UNION ALL SELECT request_id, start, "end", ticker FROM req, every WHERE tickers IS NULL)"""


def _group_requests(spark, d):
    """One window per urgent order, for a few tickers or all, some against one of them."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    brand = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 26).cast("string"))
    return views.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(
        key.alias("request_id"), F.date_sub(day, (key % 50).cast("int")).alias("start"), F.date_add(day, (key % 90 - 60).cast("int")).alias("end"),
        F.when(key % 3 != 0, F.array(brand, F.lit("Brand#1"), F.lit("Brand#2"), F.lit("Brand#1"))).alias("tickers"),
        F.when(key % 5 > 0, F.concat(F.lit("Brand#"), (F.col("o_custkey") % 4).cast("string"))).alias("compare_to"))


def _stat_ranks(agg, sql):
    @query(
        f"price_stat_rank_{agg}_requests",
        with_views(
            v.PRICES_BIG,
            f"""{_GROUP_REQ}, got AS (SELECT request_id, a.ticker, {sql} AS value, count(*) AS trading_days FROM asked a JOIN (SELECT *, {_CENTS.format('close')} AS c FROM prices) p ON p.ticker = a.ticker AND p.date BETWEEN start AND "end" GROUP BY 1, 2),
            r AS (SELECT a.*, value, trading_days, CASE WHEN value IS NOT NULL THEN row_number() OVER (PARTITION BY request_id ORDER BY value DESC NULLS LAST, ticker) END AS rank,
              CASE WHEN ticker NOT IN (SELECT ticker FROM every) THEN 'UNKNOWN_TICKER' WHEN start > "end" THEN 'DATE_RANGE_INVALID' WHEN value IS NULL THEN 'NO_MATCHING_RECORDS' ELSE 'ok' END AS status FROM asked a LEFT JOIN got USING (request_id, ticker)),
            anchor AS (SELECT q.request_id, compare_to, value AS anchor_value, coalesce(status, 'UNKNOWN_TICKER') AS anchor_status FROM req q LEFT JOIN r ON r.request_id = q.request_id AND r.ticker = compare_to WHERE compare_to IS NOT NULL)
            SELECT r.request_id, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", ticker, rank, value, trading_days, status, compare_to, anchor_value, anchor_status, value > anchor_value AS above, value < anchor_value AS below
            FROM r LEFT JOIN anchor USING (request_id)""",
        ),
    )
    def _(spark, d):
        return shaped(st.stat_ranks(_group_requests(spark, d), _cents(spark, d), "close", agg))


_stat_ranks("median", "round(median(close), 4)")
_stat_ranks("stddev", _DEV4.format(c="c"))


# patterns of one and two words of the benchmark, some signs, and one that no article holds
_PATTERNS = """, pats AS (SELECT DISTINCT pattern FROM (
  SELECT split_part(text, ' ', 2) AS pattern FROM benchmark UNION ALL SELECT split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4) FROM benchmark
  UNION ALL SELECT upper(split_part(text, ' ', 5)) FROM benchmark UNION ALL SELECT unnest(['.', 'no such words', '(a)', ', the'])) WHERE pattern <> ''),
edges AS (SELECT pattern, '(?i)' || CASE WHEN regexp_matches(pattern, '^[A-Za-z0-9_]') THEN '(^|[^A-Za-z0-9_])' ELSE '' END || regexp_escape(pattern) || CASE WHEN regexp_matches(pattern, '[A-Za-z0-9_]$') THEN '($|[^A-Za-z0-9_])' ELSE '' END AS re FROM pats),
hits AS (SELECT pattern, article_id, publication_date FROM edges JOIN articles ON regexp_matches(all_text, re))"""


def _patterns(spark, d):
    word = F.split("text", " ")
    rows = views.table(spark, d, "benchmark").select(F.explode(F.array(
        F.get(word, 1), F.concat_ws(" ", F.get(word, 2), F.get(word, 3)), F.upper(F.get(word, 4)), F.lit("."), F.lit("no such words"), F.lit("(a)"), F.lit(", the"))).alias("pattern"))
    return rows.where("pattern <> ''").distinct()


@query(
    "pattern_table_count",
    with_views(
        v.ARTICLES,
        _PATTERNS + """, c AS (SELECT pattern, count(article_id) AS article_count FROM pats LEFT JOIN hits USING (pattern) GROUP BY 1)
        SELECT pattern, article_count, (SELECT count(*) FROM articles) AS articles_in_window, row_number() OVER (ORDER BY article_count DESC, pattern) AS rank FROM c""",
    ),
)
def _(spark, d):
    return tx.pattern_table_count(views.spread(views.articles(spark, d), "article_id"), _patterns(spark, d))


@query(
    "article_count_requests",
    with_views(
        v.ARTICLES,
        _PATTERNS + """, req AS (SELECT row_number() OVER (ORDER BY pattern) AS request_id, pattern, CAST(DATE '2014-10-01' + CAST(length(pattern) * 211 % 2400 AS INTEGER) AS DATE) AS start FROM pats),
        r AS (SELECT *, CAST(start + CAST(ascii(pattern) * 37 % 900 - 30 AS INTEGER) AS DATE) AS "end" FROM req),
        c AS (SELECT request_id, count(*) AS n, min(publication_date) AS a, max(publication_date) AS b FROM r JOIN hits USING (pattern) WHERE publication_date BETWEEN start AND "end" GROUP BY 1)
        SELECT pattern, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", coalesce(n, 0) AS article_count, CAST(a AS VARCHAR) AS earliest, CAST(b AS VARCHAR) AS latest,
          CASE WHEN start > "end" THEN 'DATE_RANGE_INVALID' WHEN n IS NULL THEN 'NO_MATCHING_RECORDS' ELSE 'ok' END AS status FROM r LEFT JOIN c USING (request_id)""",
    ),
)
def _(spark, d):
    first = F.date_add(F.lit("2014-10-01").cast("date"), (F.length("pattern") * 211 % 2400).cast("int"))
    asked = _patterns(spark, d).withColumn("start", first).withColumn("end", F.date_add("start", (F.ascii("pattern") * 37 % 900 - 30).cast("int")))
    out = tx.date_counts(views.spread(views.articles(spark, d), "article_id"), asked)
    return shaped(out.select("pattern", "start", "end", "article_count", "earliest", "latest", "status"))
