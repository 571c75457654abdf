"""One query per further question family: id, prompt and answer of every case."""

from pyspark.sql import functions as F

from finframe.functions.matching import STOP_WORDS
from finframe.operators import align, corpus, cross, families as op, text
from finframe.plans import corpus_queries as quest
from finframe.plans import cross_queries as cq
from finframe.plans import price_queries as pq
from finframe.plans import sqlviews as v
from finframe.plans.base import ORACLES, query, with_views
from finframe.plans.corpus_queries import _level, _pct, _usd
from finframe.plans.price_queries import windows_sql
from finframe.plans.text_queries import _match
from finframe.session import checkpointed
from finframe.sources import views


def _family(name, views_sql, body, build):
    @query(f"qa_family_{name}", with_views(views_sql, body))
    def _(spark, d):
        return corpus.build_records(build(spark, d)).select("id", "prompt", "answer")


_CYCLES = """, m AS (SELECT *, CASE WHEN sign(change_bp) = lag(sign(change_bp)) OVER k THEN 0 ELSE 1 END AS turn FROM rates WHERE change_bp <> 0 WINDOW k AS (PARTITION BY series_key ORDER BY effective_date)),
g AS (SELECT *, sum(turn) OVER (PARTITION BY series_key ORDER BY effective_date) AS run FROM m),
c AS (SELECT series_key, run, CASE WHEN max(change_bp) > 0 THEN 'tightening' ELSE 'easing' END AS direction, count(*) AS moves, sum(change_bp) AS total, min(effective_date) AS s, max(effective_date) AS e,
  arg_min(target_bp - change_bp, effective_date) AS b, arg_max(target_bp, effective_date) AS a FROM g GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY series_key, direction ORDER BY abs(total) DESC, s) AS r FROM c)"""
_family(
    "cycle", v.RATES,
    _CYCLES + f""" SELECT 'FF-RATE-cycle-' || direction || '-' || series_key AS id, 'What was the largest run of ' || w || ' of ' || series_key || '?' AS prompt,
    moves || ' ' || w || ' from ' || s || ' to ' || e || '. It led from ' || {_level('b / 100.0')} || ' to ' || {_level('a / 100.0')} || '.' AS answer
    FROM (SELECT *, CASE direction WHEN 'tightening' THEN 'rises' ELSE 'falls' END AS w FROM best WHERE r = 1)""",
    lambda s, d: op.cycle_cases(views.rates(s, d)))

_A, _B = ("1996-01-01", "1996-12-31"), ("1998-01-01", "1998-12-31")
_family(
    "comparison", v.RATES,
    f""", p AS (SELECT series_key, sum(change_bp) FILTER (year(effective_date) = 1996) AS a, count(*) FILTER (year(effective_date) = 1996) AS an, sum(change_bp) FILTER (year(effective_date) = 1998) AS b, count(*) FILTER (year(effective_date) = 1998) AS bn FROM rates GROUP BY 1)
    SELECT 'FF-RATE-compare-' || series_key AS id, 'Compare the moves of ' || series_key || ' from {_A[0]} to {_A[1]} and from {_B[0]} to {_B[1]}.' AS prompt,
    'It moved by ' || {_pct('a / 100.0')} || ' in ' || an || ' decisions and by ' || {_pct('b / 100.0')} || ' in ' || bn || '.' AS answer FROM p WHERE a IS NOT NULL AND b IS NOT NULL""",
    lambda s, d: op.comparison_cases(views.rates(s, d), _A, _B))

_DAYS = ["1996-07-15", "1999-02-28", "2030-01-01", "1980-05-05"]
_ASKED = f""", span AS (SELECT series_key, min(effective_date) AS s, max(effective_date) AS e FROM rates GROUP BY 1), asked AS (SELECT *, CAST(unnest({_DAYS}) AS DATE) AS day FROM span)"""
_family(
    "rate_at", v.RATES,
    _ASKED + f""", f AS (SELECT asked.*, (SELECT max(effective_date) FROM rates r WHERE r.series_key = asked.series_key AND effective_date <= day) AS since FROM asked WHERE day BETWEEN s AND e)
    SELECT 'FF-RATE-at-' || f.series_key || '-' || day AS id, 'What was the level of ' || f.series_key || ' on ' || day || '?' AS prompt, 'The level was ' || {_level('target_bp / 100.0')} || ', in force since ' || since || '.' AS answer
    FROM f JOIN rates r ON r.series_key = f.series_key AND effective_date = since""",
    lambda s, d: op.rate_at_cases(views.rates(s, d), _DAYS))
_family(
    "unanswerable_rate", v.RATES,
    _ASKED + """ SELECT 'FF-UNANS-rate-' || series_key || '-' || day AS id, 'What was the level of ' || series_key || ' on ' || day || '?' AS prompt, 'No. The decisions on ' || series_key || ' run from ' || s || ' to ' || e || '.' AS answer FROM asked WHERE day < s OR day > e""",
    lambda s, d: op.rate_at_cases(views.rates(s, d), _DAYS, "unanswerable"))
_family(
    "next_decision", v.RATES,
    f""", l AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY effective_date DESC) AS r FROM rates WHERE change_bp <> 0)
    SELECT 'FF-EXTRAP-next-' || series_key AS id, 'Will the next decision on ' || series_key || ' be a rise?' AS prompt,
    'The data cannot tell. The last change was a ' || CASE WHEN change_bp > 0 THEN 'rise' ELSE 'fall' END || ' to ' || {_level('target_bp / 100.0')} || ' on ' || effective_date || '.' AS answer FROM l WHERE r = 1""",
    lambda s, d: op.next_decision_cases(views.rates(s, d)))


def _move(direction, order, agg):
    return f"""SELECT 'FF-PRICE-{direction}-' || ticker AS id, 'What was the largest one-day {direction} of ' || ticker || '?' AS prompt,
      {_pct(f'round({agg}(daily_return) * 100, 4)')} || ' on ' || arg_min(date, ({order}, date)) || ', from ' || {_usd(f'arg_min(previous_close, ({order}, date))')} || ' to ' || {_usd(f'arg_min(close, ({order}, date))')} || '.' AS answer
      FROM bars WHERE daily_return IS NOT NULL GROUP BY ticker"""


_family("move", pq.BARS, " " + _move("gain", "-daily_return", "max") + " UNION ALL " + _move("decline", "daily_return", "min"), lambda s, d: op.move_cases(pq.bars(s, d)))
_family(
    "rank", pq.BARS,
    windows_sql(pq.YEARS) + f""", k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ret DESC, ticker) AS r FROM rets)
    SELECT 'FF-PRICE-rank-' || label || '-' || ticker AS id, 'What place did ' || ticker || ' take by return in ' || label || '?' AS prompt, 'Place ' || r || ', with ' || {_pct('round(ret * 100, 4)')} || '.' AS answer FROM k""",
    lambda s, d: op.rank_cases(pq.bars(s, d), pq.YEARS))
_family(
    "volume_rank", pq.BARS,
    """, k AS (SELECT ticker, CAST(sum(volume) AS BIGINT) AS t, count(*) AS n, row_number() OVER (ORDER BY sum(volume) DESC, ticker) AS r FROM prices GROUP BY 1)
    SELECT 'FF-PRICE-traded-' || ticker AS id, 'What place does ' || ticker || ' take by total volume?' AS prompt, 'Place ' || r || ', with ' || format('{:,}', t) || ' over ' || n || ' days.' AS answer FROM k""",
    lambda s, d: op.volume_rank_cases(pq.bars(s, d)))
_EVENTS = ["1996-06-03", "1998-03-02"]
_family(
    "event_window", pq.BARS,
    f""", ev AS (SELECT CAST(unnest({_EVENTS}) AS DATE) AS day), hit AS (SELECT day, ticker, arg_min(rn, (abs(date_diff('day', date, day)), date)) AS pos, max(n) AS n FROM ev, bars GROUP BY 1, 2)
    SELECT 'FF-PRICE-window-' || hit.ticker || '-' || day AS id, 'What did ' || hit.ticker || ' return over 3 trading days each way of ' || day || '?' AS prompt,
    {_pct('round((y.close / x.close - 1) * 100, 4)')} || ', from ' || x.date || ' to ' || y.date || '.' AS answer
    FROM hit JOIN bars x ON x.ticker = hit.ticker AND x.rn = pos - 3 JOIN bars y ON y.ticker = hit.ticker AND y.rn = pos + 3""",
    lambda s, d: op.event_window_cases(pq.bars(s, d), _EVENTS))
_family(
    "basket", pq.BARS,
    windows_sql(pq.YEARS) + f""" SELECT 'FF-PRICE-basket-' || label AS id, 'What did an equal basket of all tickers return in ' || label || '?' AS prompt, {_pct('round(avg(ret) * 100, 4)')} || ' over ' || count(*) || ' members.' AS answer FROM rets GROUP BY label""",
    lambda s, d: op.basket_cases(pq.bars(s, d), pq.YEARS))
_family(
    "average", pq.BARS,
    f""", k AS (SELECT ticker, round(avg(close), 4) AS a, count(*) AS n, row_number() OVER (ORDER BY round(avg(close), 4) DESC, ticker) AS r FROM prices GROUP BY 1)
    SELECT 'FF-PRICE-average-' || ticker AS id, 'What is the average close of ' || ticker || '?' AS prompt, {_usd('CAST(a AS DOUBLE)')} || ' over ' || n || ' days, place ' || r || '.' AS answer FROM k""",
    lambda s, d: op.average_cases(pq.bars(s, d)))
_family(
    "trend", pq.BARS,
    f""", t AS (SELECT ticker, min(date) AS s, max(date) AS e, arg_max(close, date) / arg_min(close, date) - 1 AS r FROM prices GROUP BY 1)
    SELECT 'FF-EXTRAP-trend-2040-' || ticker AS id, 'Will ' || ticker || ' stand higher in 2040?' AS prompt, 'The data cannot tell. It returned ' || {_pct('round(r * 100, 4)')} || ' from ' || s || ' to ' || e || '.' AS answer FROM t""",
    lambda s, d: op.trend_cases(pq.bars(s, d), "2040"))
_family(
    "unanswerable_event", v.RATES_MOVED + "," + v.PRICES_BIG,
    """, span AS (SELECT min(date) AS s, max(date) AS e FROM prices)
    SELECT 'FF-UNANS-event-' || series_key || '-' || effective_date AS id, 'How did prices react to the change of ' || series_key || ' on ' || effective_date || '?' AS prompt,
    'The data cannot tell. Prices run from ' || s || ' to ' || e || '.' AS answer FROM rates_moved, span WHERE change_bp <> 0 AND (effective_date < s OR effective_date > e)""",
    lambda s, d: op.unanswerable_event_cases(views.rates_for_articles(s, d), views.prices_big(s, d)))

_PATTERNS = ["the", "und"]


def _dates(p):
    return f"""SELECT 'FF-TEXT-dates-{p}' AS id, 'How many articles mention "{p}", and when most?' AS prompt,
      format('{{:,}}', (SELECT CAST(sum(c) AS BIGINT) FROM m_{p})) || ' from ' || (SELECT min(s) FROM m_{p}) || ' to ' || (SELECT max(e) FROM m_{p}) || '. Most in the month of ' || (SELECT m FROM m_{p} ORDER BY c DESC, m LIMIT 1) || ', with ' || format('{{:,}}', (SELECT max(c) FROM m_{p})) || '.' AS answer"""


def _months(p):
    return f", m_{p} AS (SELECT CAST(date_trunc('month', publication_date) AS DATE) AS m, count(*) AS c, min(publication_date) AS s, max(publication_date) AS e FROM articles WHERE regexp_matches(all_text, {_match(p)}) GROUP BY 1)"


_family("date_count", v.ARTICLES, "".join(map(_months, _PATTERNS)) + " " + " UNION ALL ".join(map(_dates, _PATTERNS)), lambda s, d: op.date_count_cases(views.articles(s, d), _PATTERNS))
_family(
    "retrieve", v.ARTICLES,
    " UNION ALL ".join(f"""SELECT 'FF-TEXT-first-{p}' AS id, 'Which article was the first to mention "{p}"?' AS prompt, 'Article ' || article_id || ' of ' || publication_date || '.' AS answer
      FROM (SELECT * FROM articles WHERE regexp_matches(all_text, {_match(p)}) ORDER BY publication_date, headline, article_id LIMIT 1)""" for p in _PATTERNS),
    lambda s, d: op.retrieve_cases(views.articles(s, d), _PATTERNS))
_NONE = ["no such thing", "the", "zqzq"]
_family(
    "unanswerable_article", v.ARTICLES,
    " UNION ALL ".join(f"""SELECT 'FF-UNANS-article-{p.replace(' ', '_')}' AS id, 'What do the articles say about {p}?' AS prompt, 'Nothing. None of ' || format('{{:,}}', count(*)) || ' articles mentions it.' AS answer
      FROM articles HAVING count(*) FILTER (regexp_matches(all_text, {_match(p)})) = 0""" for p in _NONE),
    lambda s, d: op.unanswerable_article_cases(views.articles(s, d), _NONE))

# "the" is a stop word, so the context falls back to the first whole-word match
_family(
    "news", cq.ONE + "," + v.ARTICLES,
    f""", a AS (SELECT * FROM articles WHERE regexp_matches(all_text, {_match('the')}) ORDER BY publication_date, headline, article_id LIMIT 1),
    q AS (SELECT a.article_id, a.publication_date, series_key, {cq._FORCE.format(day='publication_date')} AS day FROM a, keys)
    SELECT 'FF-CROSS-news-the-' || q.series_key AS id, 'Which article fits "the" best, and what was the level of ' || q.series_key || ' on its day?' AS prompt,
    'Article ' || article_id || ' of ' || publication_date || '. The level was ' || {_level('target_bp / 100.0')} || '.' AS answer FROM q JOIN r1 ON r1.series_key = q.series_key AND effective_date = day""",
    lambda s, d: op.news_cases(cross.news_rate_context(views.articles(s, d), text.build_index(views.articles(s, d), False, STOP_WORDS), views.rates_for_articles(s, d), ["the"], 1)))


@query(
    "qa_records",
    with_views(
        v.RATES,
        _CYCLES + f""" SELECT '1' AS schema_version, 'FF-RATE-cycle-' || direction || '-' || series_key AS id, 'FF-RATE-cycle' AS template_family, 'rate_cycle' AS operation, CAST(2 AS BIGINT) AS steps,
        moves || ' ' || w || ' from ' || s || ' to ' || e || '. It led from ' || {_level('b / 100.0')} || ' to ' || {_level('a / 100.0')} || '.' AS reference_answer,
        'computed by rate_cycle over rates' AS derivation_methodology, 'operators' AS generation_method, 'verified' AS verification_status, 'C02' AS last_component, CAST(5 AS DOUBLE) AS last_points
        FROM (SELECT *, CASE direction WHEN 'tightening' THEN 'rises' ELSE 'falls' END AS w FROM best WHERE r = 1)""",
    ),
)
def _(spark, d):
    rows = op.full_records(corpus.build_records(op.cycle_cases(views.rates(spark, d))))
    last = F.element_at("grading.components", -1)
    return rows.select(
        "schema_version", "id", "template_family", F.element_at("tool_trace", 1)["operation"].alias("operation"), "steps", "reference_answer", "derivation_methodology",
        "generation_method", "verification_status", last["component_id"].alias("last_component"), last["points"].alias("last_points"))


_GRID = op.Grid(
    pq.YEARS, quest._RATE_WINDOW, (_A, _B), _DAYS, _EVENTS, ["the", "der die"], _PATTERNS, _NONE, ["2035-01-01", "2040-01-01"], ["nobody"], cq._ASKED_WINDOWS)
_SOURCES = [
    *[f"qa_{n}" for n in ("rates", "grid_returns", "prices", "articles", "events", "years", "unsupported_spans", "extrapolation")],
    *[f"qa_family_{n}" for n in (
        "cycle", "comparison", "rate_at", "unanswerable_rate", "next_decision", "move", "rank", "volume_rank", "event_window", "basket", "average", "trend",
        "unanswerable_event", "date_count", "retrieve", "unanswerable_article", "news")],
]
_EVERY = " UNION ALL ".join(
    f"SELECT id, prompt, answer FROM ({sql})" for sql in [*[ORACLES[n] for n in _SOURCES], with_views(pq.BARS, quest._NO_BAR + quest._tail("no_bar"))])


def _every(spark, d):
    articles = views.articles(spark, d)
    # written once: two dozen families read them, and each would join lines and parts again
    rates, bars, moved = checkpointed(views.rates(spark, d)), checkpointed(pq.bars(spark, d)), checkpointed(views.rates_for_articles(spark, d))
    context = cross.news_rate_context(articles, text.build_index(articles, False, STOP_WORDS), moved, ["the"], 1)
    bars_moved = checkpointed(cq._bars(spark, d))
    summary = cross.year_summary(moved, articles, bars_moved, "the", cq.YEARS)
    covers = [
        align.coverage(articles, "articles", "publication_date"),
        align.coverage(bars_moved, "prices", "date"),
        align.coverage(moved, "rates", "effective_date", ["series_key"]).withColumn("dataset", F.concat_ws(" ", "dataset", "series_key")),
    ]
    summary, context, returns = checkpointed(summary), checkpointed(context), checkpointed(cq._event_returns(spark, d))
    return op.every_family(rates, bars, articles, moved, returns, summary, context, covers, _GRID)


@query("qa_every_family", _EVERY)
def _(spark, d):
    return _every(spark, d).select("id", "prompt", "answer")
