"""Queries that join rates, prices and articles."""

from pyspark.sql import functions as F

from finframe.functions.scalars import shaped
from finframe.functions.matching import STOP_WORDS
from finframe.operators import align, cross as op
from finframe.operators import prices as px
from finframe.operators import text as tx
from finframe.plans import sqlviews as v
from finframe.plans.base import query, with_views
from finframe.plans.price_queries import windows_sql
from finframe.plans.text_queries import BM25, _match
from finframe.session import checkpointed
from finframe.sources import views

ONE = v.RATES_MOVED + ", r1 AS (SELECT * FROM rates_moved), keys AS (SELECT DISTINCT series_key FROM r1)"
ALL = ONE + "," + v.PRICES_MOVED + v.ENRICHED
YEARS = [(str(y), f"{y}-01-02", f"{y}-12-30") for y in range(2015, 2022)]


def _rates(spark, d):
    return views.rates_for_articles(spark, d)


def _bars(spark, d):
    return px.enrich(views.prices_for_articles(spark, d))


# brute force: every event against every ticker
_AROUND = """, ev AS (SELECT DISTINCT series_key, effective_date AS event_date FROM r1 WHERE change_bp <> 0 AND effective_date BETWEEN (SELECT min(date) FROM prices) AND (SELECT max(date) FROM prices)),
hit AS (SELECT series_key, event_date, ticker, arg_min(rn, (abs(date_diff('day', date, event_date)), date)) AS pos, max(n) AS n FROM ev, bars GROUP BY 1, 2, 3),
w AS (SELECT hit.*, pre, greatest(1, pos - pre) AS lo, least(n, pos + pre) AS hi, (pos - pre < 1 OR pos + pre > n) AS truncated FROM hit, (VALUES (3), (5), (7)) s(pre)),
series AS (SELECT ticker, list(date ORDER BY date) AS ds, list(close ORDER BY date) AS cs FROM prices GROUP BY 1),
ret AS (SELECT w.series_key, event_date, event_date AS rate_effective_date, r1.target_bp / 100.0 AS target_pct, r1.change_bp / 100.0 AS change_pct, ticker, ds[pos] AS resolved_event_date, cs[pos] AS event_close, pre,
  2 * pre + 1 AS window_trading_days, ds[lo] AS window_start_date, ds[hi] AS window_end_date, cs[hi] / cs[lo] - 1 AS r, truncated
  FROM w JOIN series USING (ticker) JOIN r1 ON r1.series_key = w.series_key AND r1.effective_date = event_date)"""


def _event_returns(spark, d):
    # the enriched bars are derived once, for the coverage and for the windows
    rates, bars = _rates(spark, d), checkpointed(_bars(spark, d))
    events = op.changes_in_price_coverage(rates, align.coverage(bars, "prices", "date"))
    return op.event_market_returns(events, rates, bars, [(3, 3), (5, 5), (7, 7)])


@query(
    "rate_event_market_return",
    with_views(
        ALL,
        _AROUND + """ SELECT series_key, CAST(event_date AS VARCHAR) AS event_date, CAST(rate_effective_date AS VARCHAR) AS rate_effective_date, target_pct, change_pct, ticker,
        CAST(resolved_event_date AS VARCHAR) AS resolved_event_date, event_close, pre, pre AS post, window_trading_days, CAST(window_start_date AS VARCHAR) AS window_start_date,
        CAST(window_end_date AS VARCHAR) AS window_end_date, truncated, round(r * 100, 4) AS window_return_pct, row_number() OVER (PARTITION BY series_key, event_date, pre ORDER BY r DESC, ticker) AS rank FROM ret""",
    ),
)
def _(spark, d):
    return shaped(op.ranked_event_returns(_event_returns(spark, d)))


@query(
    "rate_event_best_and_worst",
    with_views(
        ALL,
        _AROUND + """, k AS (SELECT *, row_number() OVER (PARTITION BY series_key, event_date, pre ORDER BY r DESC, ticker) AS rank, count(*) OVER (PARTITION BY series_key, event_date, pre) AS c FROM ret)
        SELECT series_key, CAST(event_date AS VARCHAR) AS event_date, pre, target_pct, max(ticker) FILTER (rank = 1) AS best, max(ticker) FILTER (rank = c) AS worst, count(*) AS tickers,
          round(max(r) * 100, 4) AS best_pct, round(min(r) * 100, 4) AS worst_pct FROM k GROUP BY series_key, event_date, pre, target_pct""",
    ),
)
def _(spark, d):
    return shaped(op.event_best_and_worst(_event_returns(spark, d)))


@query(
    "rate_event_best_nulls",
    with_views(
        ALL,
        _AROUND + """, k AS (SELECT *, row_number() OVER (PARTITION BY series_key, event_date, pre ORDER BY r DESC, ticker) AS rank, count(*) OVER (PARTITION BY series_key, event_date, pre) AS c FROM ret WHERE ticker NOT LIKE '%1'),
        e AS (SELECT DISTINCT series_key, event_date, pre, target_pct FROM ret)
        SELECT e.series_key, CAST(e.event_date AS VARCHAR) AS event_date, e.pre, e.target_pct, max(ticker) FILTER (rank = 1) AS best, max(ticker) FILTER (rank = c) AS worst, count(ticker) AS tickers,
          round(max(r) * 100, 4) AS best_pct, round(min(r) * 100, 4) AS worst_pct FROM e LEFT JOIN k USING (series_key, event_date, pre) GROUP BY ALL""",
    ),
)
def _(spark, d):
    returns = _event_returns(spark, d)
    known = returns.withColumn("return_decimal", F.when(~F.col("ticker").endswith("1"), F.col("return_decimal")))
    return shaped(op.event_best_and_worst(known))


_FORCE = "(SELECT max(effective_date) FROM r1 WHERE r1.series_key = keys.series_key AND effective_date <= {day} AND {day} <= (SELECT max(effective_date) FROM r1 WHERE r1.series_key = keys.series_key))"


@query(
    "rate_on_peak_day",
    with_views(
        ALL,
        f""", p AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY close DESC, date) AS k FROM prices), q AS (SELECT *, {_FORCE.format(day='date')} AS day FROM p, keys WHERE k = 1)
        SELECT q.series_key, ticker, 'close' AS field, 'highest' AS direction, 1 AS rank, CAST(date AS VARCHAR) AS date, close AS value, CAST(day AS VARCHAR) AS effective_date, target_bp / 100.0 AS target_pct,
          change_bp / 100.0 AS change_pct, CASE WHEN day IS NULL THEN 'DATE_OUTSIDE_COVERAGE' ELSE 'ok' END AS status FROM q LEFT JOIN r1 ON effective_date = day AND r1.series_key = q.series_key""",
    ),
)
def _(spark, d):
    return shaped(op.rate_on_peak_day(views.prices_for_articles(spark, d), _rates(spark, d)))


@query(
    "rate_after_worst_day",
    with_views(
        ALL,
        f""", p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY daily_return, date) AS k FROM bars WHERE daily_return IS NOT NULL), q AS (SELECT *, {_FORCE.format(day='date')} AS day,
          (SELECT min(effective_date) FROM r1 WHERE r1.series_key = keys.series_key AND effective_date BETWEEN date AND date + 20) AS next_decision FROM p, keys WHERE k = 1)
        SELECT q.series_key, ticker, CAST(date AS VARCHAR) AS date, round(daily_return * 100, 4) AS pct_change, r.target_bp / 100.0 AS target_pct, CAST(next_decision AS VARCHAR) AS next_decision,
          x.target_bp / 100.0 AS next_target_pct FROM q LEFT JOIN r1 r ON r.effective_date = day AND r.series_key = q.series_key LEFT JOIN r1 x ON x.effective_date = next_decision AND x.series_key = q.series_key""",
    ),
)
def _(spark, d):
    out = op.rate_around_worst_day(_bars(spark, d), _rates(spark, d), 20)
    return shaped(out.select("series_key", "ticker", "date", "pct_change", "target_pct", "next_decision", "next_target_pct"))


@query(
    "decisions_in_peak_month",
    with_views(
        ALL,
        """, p AS (SELECT ticker, date, volume, row_number() OVER (PARTITION BY ticker ORDER BY volume DESC, date) AS k FROM prices),
        m AS (SELECT series_key, date_trunc('month', effective_date) AS m, count(*) AS decisions, count(*) FILTER (change_bp <> 0) AS changes, CAST(sum(change_bp) AS BIGINT) AS net_bp FROM r1 GROUP BY 1, 2)
        SELECT keys.series_key, ticker, CAST(date AS VARCHAR) AS date, volume, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month, coalesce(decisions, 0) AS decisions, coalesce(changes, 0) AS changes, net_bp
        FROM p CROSS JOIN keys LEFT JOIN m ON m.m = date_trunc('month', date) AND m.series_key = keys.series_key WHERE k = 1""",
    ),
)
def _(spark, d):
    out = op.decisions_in_peak_month(views.prices_for_articles(spark, d), _rates(spark, d))
    return shaped(out.withColumn("volume", F.col("volume").cast("bigint")))


@query(
    "articles_in_low_month",
    with_views(
        v.RATES_MOVED + "," + v.ARTICLES,
        """, lo AS (SELECT series_key, min(target_bp) AS t FROM rates_moved GROUP BY 1), f AS (SELECT lo.series_key, t, min(effective_date) AS day FROM lo JOIN rates_moved r ON r.series_key = lo.series_key AND target_bp = t GROUP BY 1, 2)
        SELECT series_key, t / 100.0 AS target_pct, CAST(day AS VARCHAR) AS first_effective_date, CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS month,
          (SELECT count(*) FROM articles WHERE date_trunc('month', publication_date) = date_trunc('month', day)) AS article_count FROM f""",
    ),
)
def _(spark, d):
    return shaped(op.articles_in_low_month(views.articles(spark, d), views.rates_for_articles(spark, d)))


@query(
    "year_summary",
    with_views(
        ALL + "," + v.ARTICLES,
        windows_sql(YEARS) + f""", b AS (SELECT label, round(avg(ret) * 100, 4) AS return_pct, count(*) AS member_count FROM rets WHERE ticker <> 'Brand#1' GROUP BY 1),
        m AS (SELECT series_key, CAST(year(effective_date) AS VARCHAR) AS label, count(*) FILTER (change_bp <> 0) AS changed_count, count(*) FILTER (change_bp > 0) AS increases, count(*) FILTER (change_bp < 0) AS decreases,
              arg_min(target_bp - change_bp, effective_date) / 100.0 AS rate_before_pct, arg_max(target_bp, effective_date) / 100.0 AS rate_after_pct FROM r1 GROUP BY 1, 2),
        c AS (SELECT CAST(year(publication_date) AS VARCHAR) AS label, 'the' AS pattern, count(*) FILTER (regexp_matches(all_text, {_match('the')})) AS article_count FROM articles GROUP BY 1)
        SELECT * FROM b CROSS JOIN keys LEFT JOIN m USING (series_key, label) LEFT JOIN c USING (label)""",
    ),
)
def _(spark, d):
    return op.year_summary(_rates(spark, d), views.articles(spark, d), _bars(spark, d), "the", YEARS, ["Brand#1"])


@query(
    "basket_after_cuts",
    with_views(
        ALL,
        """, ev AS (SELECT series_key, effective_date AS event_date FROM r1 WHERE change_bp < 0),
        near AS (SELECT series_key, event_date, ticker, arg_min(close, (abs(date_diff('day', date, event_date)), date)) AS a, arg_min(close, (abs(date_diff('day', date, event_date + 7)), date)) AS b FROM ev, prices GROUP BY 1, 2, 3)
        SELECT series_key, CAST(event_date AS VARCHAR) AS event_date, round(avg(b / a - 1) * 100, 4) AS return_pct, count(b) AS member_count FROM near GROUP BY series_key, event_date""",
    ),
)
def _(spark, d):
    cuts = _rates(spark, d).where(F.col("change_bp") < 0).select("series_key", F.col("effective_date").alias("event_date"))
    return shaped(op.basket_after_events(cuts, _bars(spark, d)))


@query(
    "annual_count_and_rank",
    with_views(
        ALL + "," + v.ARTICLES,
        windows_sql(YEARS) + f""", k AS (SELECT label, ticker, round(ret * 100, 4) AS return_pct, row_number() OVER (PARTITION BY label ORDER BY ret DESC, ticker) AS rank FROM rets)
        SELECT k.*, (SELECT nullif(count(*) FILTER (regexp_matches(all_text, {_match('und')})), -1) FROM articles WHERE CAST(year(publication_date) AS VARCHAR) = label HAVING count(*) > 0) AS article_count FROM k WHERE ticker = 'Brand#2'""",
    ),
)
def _(spark, d):
    return op.annual_count_and_rank(views.articles(spark, d), _bars(spark, d), "und", "Brand#2", YEARS)


_ASKED_WINDOWS = [("inside", "2016-01-01", "2017-12-31"), ("late", "2020-01-01", "2024-12-31"), ("early", "2010-01-01", "2016-01-01")]


@query(
    "dataset_support",
    with_views(
        ALL + "," + v.ARTICLES,
        """, cov AS (SELECT 'articles' AS dataset, min(publication_date) AS s, max(publication_date) AS e FROM articles UNION ALL SELECT 'prices', min(date), max(date) FROM prices UNION ALL SELECT 'rates ' || series_key, min(effective_date), max(effective_date) FROM r1 GROUP BY series_key),
        w AS (SELECT * FROM (VALUES ('inside', DATE '2016-01-01', DATE '2017-12-31'), ('late', DATE '2020-01-01', DATE '2024-12-31'), ('early', DATE '2010-01-01', DATE '2016-01-01')) t(label, ws, we))
        SELECT label, CAST(ws AS VARCHAR) AS start, CAST(we AS VARCHAR) AS "end", bool_and(s <= ws AND e >= we) AS supported, coalesce(string_agg(CASE WHEN NOT (s <= ws AND e >= we) THEN dataset END, ', ' ORDER BY dataset), '') AS missing
        FROM w, cov GROUP BY 1, ws, we""",
    ),
)
def _(spark, d):
    covers = [
        align.coverage(views.articles(spark, d), "articles", "publication_date"),
        align.coverage(views.prices_for_articles(spark, d), "prices", "date"),
        align.coverage(_rates(spark, d), "rates", "effective_date", ["series_key"]).withColumn("dataset", F.concat_ws(" ", "dataset", "series_key")),
    ]
    return shaped(op.supported_windows(covers, _ASKED_WINDOWS))


@query(
    "article_rate_in_force",
    with_views(
        ONE + "," + v.ARTICLES,
        f""", q AS (SELECT series_key, article_id, headline, publication_date, {_FORCE.format(day='publication_date')} AS day FROM articles, keys)
        SELECT q.series_key, article_id, headline, CAST(publication_date AS VARCHAR) AS publication_date, CAST(day AS VARCHAR) AS effective_date, target_bp / 100.0 AS target_pct,
          CASE WHEN day IS NULL THEN 'DATE_OUTSIDE_COVERAGE' ELSE 'ok' END AS status FROM q LEFT JOIN r1 ON effective_date = day AND r1.series_key = q.series_key""",
    ),
)
def _(spark, d):
    articles = views.articles(spark, d).select("article_id", "headline", "publication_date")
    return shaped(op.rate_in_force(articles, _rates(spark, d), "publication_date").drop("change_pct"))


@query(
    "article_lookup",
    with_views(
        ONE + "," + v.ARTICLES,
        f""", asked AS (SELECT article_id AS request_id, headline, CAST(publication_date + CASE WHEN article_id % 4 = 1 THEN 1 ELSE 0 END AS DATE) AS publication_date FROM articles),
        found AS (SELECT headline, publication_date, min(article_id) AS article_id FROM articles GROUP BY 1, 2),
        q AS (SELECT series_key, request_id, asked.headline, asked.publication_date, article_id, {_FORCE.format(day='asked.publication_date')} AS day FROM asked LEFT JOIN found ON found.headline = asked.headline AND found.publication_date = asked.publication_date CROSS JOIN keys)
        SELECT q.series_key, request_id, headline, CAST(publication_date AS VARCHAR) AS publication_date, article_id, CAST(day AS VARCHAR) AS effective_date, target_bp / 100.0 AS target_pct,
          CASE WHEN day IS NULL THEN 'DATE_OUTSIDE_COVERAGE' ELSE 'ok' END AS status FROM q LEFT JOIN r1 ON effective_date = day AND r1.series_key = q.series_key""",
    ),
)
def _(spark, d):
    articles = views.articles(spark, d)
    # one in four requests is a day off
    late = F.when(F.col("article_id") % 4 == 1, 1).otherwise(0)
    asked = articles.select(F.col("article_id").alias("request_id"), "headline", F.date_add("publication_date", late).alias("publication_date"))
    return shaped(op.article_lookup(asked, articles, _rates(spark, d)).drop("change_pct"))


_NEWS = ["the", "license copyright", "zzzz"]


@query(
    "news_rate_context",
    with_views(
        ONE + "," + v.ARTICLES,
        BM25.split(", asked AS")[0] + f""", asked AS (SELECT * FROM (VALUES (1, 'license'), (1, 'copyright')) t(query_id, term)), stats AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM listed),
        scores AS (SELECT query_id, p.article_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / mean))) AS score
          FROM asked JOIN terms USING (term) JOIN postings p USING (term) JOIN listed l ON l.article_id = p.article_id, stats GROUP BY 1, 2),
        ranked AS (SELECT query_id, article_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, publication_date, headline, article_id) AS rank FROM scores JOIN articles USING (article_id)),
        literal AS (SELECT q.query_id, article_id, CAST(NULL AS DOUBLE) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY publication_date, headline, article_id) AS rank
          FROM articles, (VALUES (0, {_match('the')}), (2, {_match('zzzz')})) q(query_id, pat) WHERE regexp_matches(all_text, pat)),
        found AS (SELECT * FROM ranked WHERE rank <= 5 UNION ALL SELECT * FROM literal WHERE rank <= 5),
        q AS (SELECT series_key, found.*, headline, publication_date, {_FORCE.format(day='publication_date')} AS day FROM found JOIN articles USING (article_id) CROSS JOIN keys)
        SELECT q.series_key, query_id, ['the', 'license copyright', 'zzzz'][query_id + 1] AS query, rank, article_id, headline, CAST(publication_date AS VARCHAR) AS publication_date, score, CAST(day AS VARCHAR) AS effective_date,
          target_bp / 100.0 AS target_pct, CASE WHEN day IS NULL THEN 'DATE_OUTSIDE_COVERAGE' ELSE 'ok' END AS status FROM q LEFT JOIN r1 ON effective_date = day AND r1.series_key = q.series_key""",
    ),
)
def _(spark, d):
    articles = views.articles(spark, d)
    index = tx.build_index(articles, False, STOP_WORDS)
    # "the" is a stop word, so that query has no ranked article and falls back
    out = op.news_rate_context(articles, index, _rates(spark, d), _NEWS, 5)
    return shaped(out.select("series_key", "query_id", "query", "rank", "article_id", "headline", "publication_date", "score", "effective_date", "target_pct", "status"))
