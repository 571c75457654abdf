"""Queries of the question-and-answer corpus."""

from pyspark.sql import functions as F

from finframe.operators import align
from finframe.operators import corpus as op
from finframe.operators import cross as cx
from finframe.plans import cross_queries as cq
from finframe.plans import price_queries as pq
from finframe.plans import sqlviews as v
from finframe.plans.base import query, with_views
from finframe.plans.price_queries import windows_sql
from finframe.plans.text_queries import _match
from finframe.sources import views


def _two(expr):
    """Half-up to two places, as text with two decimals."""
    return f"CAST(round(CAST({expr} AS DECIMAL(18,4)), 2) AS DOUBLE)"


def _pct(expr):
    return f"printf('%+.2f', {_two(expr)}) || '%'"


def _usd(expr):
    return f"'$' || format('{{:,.2f}}', {expr})"


def _level(expr):
    return f"printf('%.2f', {expr}) || '%'"


_FLAT = ["id", "template_family", "question_type", "category", "difficulty", "dataset_scope", "prompt", "answer"]


def _flat(records):
    return records.select(*_FLAT, F.size("required_facts").cast("bigint").alias("fact_count"))


_RETURN_CASES = windows_sql(pq.YEARS) + f""", cases AS (SELECT 'FF-PRICE-return-' || ticker || '-' || label AS id, 'FF-PRICE-return' AS template_family, 'price_return' AS question_type, 'answerable' AS category, 'easy' AS difficulty,
  'single' AS dataset_scope, 'What did ' || ticker || ' return in ' || label || '?' AS prompt,
  [ticker || ' returned ' || {_pct('round(ret * 100, 4)')} || '.', 'It closed at ' || {_usd('s_close')} || ' on ' || s_date || ' and at ' || {_usd('e_close')} || ' on ' || e_date || '.'] AS facts FROM rets)"""
_TAIL = " SELECT id, template_family, question_type, category, difficulty, dataset_scope, prompt, list_aggregate(facts, 'string_agg', ' ') AS answer, len(facts) AS fact_count FROM cases"


def _returns(spark, d):
    return op.build_records(op.return_cases(pq.bars(spark, d), pq.YEARS))


@query("qa_grid_returns", with_views(pq.BARS, _RETURN_CASES + _TAIL))
def _(spark, d):
    return _flat(_returns(spark, d))


@query(
    "qa_points",
    with_views(
        pq.BARS,
        _RETURN_CASES + """, c AS (SELECT id, unnest(facts) AS expected_fact, generate_subscripts(facts, 1) AS i, len(facts) AS n FROM cases)
        SELECT id, printf('C%02d', i) AS component_id, expected_fact, CASE WHEN i < n THEN round(10.0 / n, 2) ELSE round(10 - round(10.0 / n, 2) * (n - 1), 2) END::DOUBLE AS points FROM c""",
    ),
)
def _(spark, d):
    return _returns(spark, d).select("id", F.inline("components"))


_RATE_WINDOW = ("mid", "1996-03-01", "1999-12-31")


def _rate_cases(label, start, end):
    asked = f"from {start} to {end}"
    return f""", r_w AS (SELECT * FROM rates WHERE effective_date BETWEEN DATE '{start}' AND DATE '{end}'),
    r_m AS (SELECT series_key, 'highest' AS direction, max(target_bp) AS t FROM r_w GROUP BY 1 UNION ALL SELECT series_key, 'lowest', min(target_bp) FROM r_w GROUP BY 1),
    r_x AS (SELECT r_w.series_key, direction, t, min(effective_date) AS f, count(*) AS c FROM r_w JOIN r_m ON r_m.series_key = r_w.series_key AND target_bp = t GROUP BY 1, 2, 3),
    r_s AS (SELECT series_key, count(*) AS n, count(*) FILTER (change_bp > 0) AS up, count(*) FILTER (change_bp < 0) AS down, arg_min(target_bp - change_bp, effective_date) AS b, arg_max(target_bp, effective_date) AS a FROM r_w GROUP BY 1),
    r_e AS (SELECT series_key, effective_date AS d1, lag(effective_date) OVER k AS d0, lag(target_bp) OVER k AS during FROM rates WHERE change_bp <> 0 WINDOW k AS (PARTITION BY series_key ORDER BY effective_date)),
    r_h AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date_diff('day', d0, d1) DESC, d0) AS r FROM r_e WHERE d0 IS NOT NULL),
    rate_cases AS (
      SELECT 'FF-RATE-' || direction || '-{label}-' || series_key AS id, 'FF-RATE-' || direction AS template_family, 'rate_extreme' AS question_type, 'answerable' AS category, 'easy' AS difficulty, 'single' AS dataset_scope,
        'What was the ' || direction || ' level of ' || series_key || ' {asked}, and when did it first apply?' AS prompt,
        ['The ' || direction || ' level was ' || {_level('t / 100.0')} || ', first on ' || f || ', in ' || c || ' records.'] AS facts FROM r_x
      UNION ALL SELECT 'FF-RATE-summary-{label}-' || series_key, 'FF-RATE-summary', 'change_summary', 'answerable', 'medium', 'single', 'How often did ' || series_key || ' change {asked}?',
        [(up + down) || ' of ' || n || ' records changed it: ' || up || ' up and ' || down || ' down.', 'It moved from ' || {_level('b / 100.0')} || ' to ' || {_level('a / 100.0')} || '.'] FROM r_s
      UNION ALL SELECT 'FF-RATE-hold-' || series_key, 'FF-RATE-hold', 'longest_hold', 'answerable', 'medium', 'single', 'How long did ' || series_key || ' stay unchanged at most?',
        [date_diff('day', d0, d1) || ' days, from ' || d0 || ' to ' || d1 || ' at ' || {_level('during / 100.0')} || '.'] FROM r_h WHERE r = 1)"""


def _tail(*names):
    return _TAIL.replace("FROM cases", "FROM (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in names) + ")")


@query("qa_rates", with_views(v.RATES, _rate_cases(*_RATE_WINDOW) + _tail("rate_cases")))
def _(spark, d):
    return _flat(op.build_records(op.rate_cases(views.rates(spark, d), [_RATE_WINDOW])))


def _falls(basis, peak, trough):
    return f"""t_{basis} AS (SELECT ticker, date, close, {peak} AS p, {trough} AS t, max({peak}) OVER (PARTITION BY ticker ORDER BY date) AS top FROM prices),
    w_{basis} AS (SELECT ticker, arg_min(date, (t / top - 1, date)) AS d, arg_min(top, (t / top - 1, date)) AS pk, min(t / top - 1) AS fall FROM t_{basis} GROUP BY 1),
    x_{basis} AS (SELECT ticker, fall, d, (SELECT min(date) FROM t_{basis} t WHERE t.ticker = w.ticker AND t.p = w.pk) AS pd,
      (SELECT min(date) FROM t_{basis} t WHERE t.ticker = w.ticker AND t.date > w.d AND t.close >= w.pk) AS back FROM w_{basis} w)"""


def _fall_case(basis):
    return f"""SELECT 'FF-PRICE-drawdown-{basis}-' || ticker AS id, 'FF-PRICE-drawdown' AS template_family, 'max_drawdown' AS question_type, 'answerable' AS category, 'medium' AS difficulty, 'single' AS dataset_scope,
      'What was the deepest fall of ' || ticker || ' ({basis})?' AS prompt,
      ['It fell ' || {_pct('round(fall * 100, 4)')} || ' from ' || pd || ' to ' || d || '.', coalesce('It recovered on ' || back || '.', 'It did not recover.')] AS facts FROM x_{basis}"""


def _extreme_case(direction, order):
    return f"""SELECT 'FF-PRICE-{direction}-' || ticker AS id, 'FF-PRICE-{direction}' AS template_family, 'price_extreme' AS question_type, 'answerable' AS category, 'easy' AS difficulty, 'single' AS dataset_scope,
      'When did ' || ticker || ' close {direction}, and at what price?' AS prompt,
      ['Its {direction} close was ' || {_usd('arg_min(close, (' + order + ', date))')} || ' on ' || arg_min(date, ({order}, date)) || '.'] AS facts FROM prices GROUP BY ticker"""


_PRICE_CASES = f""", {_falls('close', 'close', 'close')}, {_falls('intraday', 'high', 'low')},
price_cases AS ({_extreme_case('highest', '-close')} UNION ALL {_extreme_case('lowest', 'close')} UNION ALL {_fall_case('close')} UNION ALL {_fall_case('intraday')} UNION ALL
  SELECT 'FF-PRICE-volume-' || ticker, 'FF-PRICE-volume', 'price_extreme', 'answerable', 'easy', 'single', 'On which day did ' || ticker || ' trade most?',
    ['It traded ' || format('{{:,}}', max(volume)) || ' on ' || arg_min(date, (-volume, date)) || '.'] FROM prices GROUP BY ticker)"""


@query("qa_prices", with_views(v.PRICES_BIG, _PRICE_CASES + _TAIL.replace("FROM cases", "FROM price_cases")))
def _(spark, d):
    return _flat(op.build_records(op.price_cases(views.prices_big(spark, d))))


def _article_cases(patterns):
    return ", article_cases AS (" + " UNION ALL ".join(
        f"""SELECT 'FF-TEXT-count-{p.replace(' ', '_')}-' || year(publication_date) AS id, 'FF-TEXT-count' AS template_family, 'pattern_count' AS question_type, 'answerable' AS category, 'easy' AS difficulty, 'single' AS dataset_scope,
        'How many articles of ' || year(publication_date) || ' mention "{p}"?' AS prompt, [format('{{:,}}', count(*) FILTER (regexp_matches(all_text, {_match(p)}))) || ' of ' || format('{{:,}}', count(*)) || ' articles mention it.'] AS facts
        FROM articles GROUP BY year(publication_date)""" for p in patterns
    ) + ")"


@query("qa_articles", with_views(v.ARTICLES, _article_cases(["the", "der die"]) + _tail("article_cases")))
def _(spark, d):
    return _flat(op.build_records(op.article_cases(views.articles(spark, d), ["the", "der die"])))


@query(
    "qa_events",
    with_views(
        cq.ALL,
        cq._AROUND + f""", k AS (SELECT *, row_number() OVER (PARTITION BY series_key, event_date, pre ORDER BY r DESC, ticker) AS rank, count(*) OVER (PARTITION BY series_key, event_date, pre) AS c FROM ret),
        bw AS (SELECT series_key, event_date, pre, target_pct, max(ticker) FILTER (rank = 1) AS best, max(ticker) FILTER (rank = c) AS worst, round(max(r) * 100, 4) AS best_pct, round(min(r) * 100, 4) AS worst_pct FROM k GROUP BY 1, 2, 3, 4),
        cases AS (SELECT 'FF-CROSS-event-' || series_key || '-' || event_date || '-' || pre AS id, 'FF-CROSS-event' AS template_family, 'event_market_returns' AS question_type, 'answerable' AS category, 'hard' AS difficulty, 'cross' AS dataset_scope,
          'What was the level of ' || series_key || ' on ' || event_date || ', and which tickers did best and worst over ' || pre || ' trading days each way?' AS prompt,
          ['The level was ' || {_level('target_pct')} || '.', best || ' did best at ' || {_pct('best_pct')} || ' and ' || worst || ' worst at ' || {_pct('worst_pct')} || '.'] AS facts FROM bw)""" + _TAIL,
    ),
)
def _(spark, d):
    return _flat(op.build_records(op.event_cases(cq._event_returns(spark, d))))


_YEARS = windows_sql(cq.YEARS) + f""", b AS (SELECT label, round(avg(ret) * 100, 4) AS ret FROM rets GROUP BY 1),
m AS (SELECT series_key, CAST(year(effective_date) AS VARCHAR) AS label, count(*) FILTER (change_bp > 0) AS up, count(*) FILTER (change_bp < 0) AS down,
  arg_min(target_bp - change_bp, effective_date) / 100.0 AS before, arg_max(target_bp, effective_date) / 100.0 AS after FROM r1 GROUP BY 1, 2),
c AS (SELECT CAST(year(publication_date) AS VARCHAR) AS label, count(*) FILTER (regexp_matches(all_text, {_match('the')})) AS n FROM articles GROUP BY 1),
cases AS (SELECT 'FF-CROSS-year-' || series_key || '-' || label AS id, 'FF-CROSS-year' AS template_family, 'change_summary+pattern_count+basket_held' AS question_type, 'answerable' AS category, 'hard' AS difficulty, 'cross' AS dataset_scope,
  'Sum up ' || label || ' over the rates of ' || series_key || ', articles and prices.' AS prompt,
  [(up + down) || ' changes (' || up || ' up, ' || down || ' down) took the level from ' || {_level('before')} || ' to ' || {_level('after')} || '.', format('{{:,}}', n) || ' articles mention "the".', 'The basket returned ' || {_pct('ret')} || '.'] AS facts
  FROM b JOIN m USING (label) JOIN c USING (label))"""


@query("qa_years", with_views(cq.ALL + "," + v.ARTICLES, _YEARS + _TAIL))
def _(spark, d):
    summary = cx.year_summary(cq._rates(spark, d), views.articles(spark, d), cq._bars(spark, d), "the", cq.YEARS)
    return _flat(op.build_records(op.year_cases(summary)))


@query(
    "qa_unanswerable",
    with_views(
        v.PRICES_WIDE,
        """, cover AS (SELECT ticker, min(date) AS s, max(date) AS e FROM prices GROUP BY 1),
        names AS (SELECT ticker FROM cover UNION ALL SELECT 'nobody' UNION ALL SELECT 'no-one'),
        asked AS (SELECT ticker, unnest([DATE '2024-01-06', DATE '2024-01-15', DATE '2030-06-01']) AS day FROM names),
        bad AS (SELECT asked.*, s, e FROM asked LEFT JOIN prices p ON p.ticker = asked.ticker AND p.date = asked.day LEFT JOIN cover ON cover.ticker = asked.ticker WHERE p.date IS NULL),
        cases AS (SELECT 'FF-UNANS-price-' || ticker || '-' || day AS id, 'FF-UNANS-price' AS template_family, 'price_return' AS question_type, 'unanswerable' AS category, 'easy' AS difficulty, 'single' AS dataset_scope,
          'What did ' || ticker || ' close at on ' || day || '?' AS prompt,
          [CASE WHEN s IS NULL THEN 'No. ' || ticker || ' is not in the price data.' ELSE 'No. ' || ticker || ' has no bar on ' || day || '; its data runs from ' || s || ' to ' || e || '.' END] AS facts FROM bad)""" + _TAIL,
    ),
)
def _(spark, d):
    found = op.unanswerable_price_cases(views.prices_wide(spark, d), ["2024-01-06", "2024-01-15", "2030-06-01"], ["nobody", "no-one"])
    return _flat(op.build_records(found))


@query(
    "qa_unsupported_spans",
    with_views(
        cq.ALL + "," + v.ARTICLES,
        """, cov AS (SELECT 'articles' AS dataset, min(publication_date) AS s, max(publication_date) AS e FROM articles UNION ALL SELECT 'prices', min(date), max(date) FROM prices UNION ALL SELECT 'rates ' || series_key, min(effective_date), max(effective_date) FROM r1 GROUP BY series_key),
        w AS (SELECT * FROM (VALUES ('inside', DATE '2016-01-01', DATE '2017-12-31'), ('late', DATE '2020-01-01', DATE '2024-12-31'), ('early', DATE '2010-01-01', DATE '2016-01-01')) t(label, ws, we)),
        cases AS (SELECT 'FF-UNANS-span-' || label AS id, 'FF-UNANS-span' AS template_family, 'coverage' AS question_type, 'unanswerable' AS category, 'hard' AS difficulty, 'cross' AS dataset_scope,
          'Can all datasets support a study from ' || ws || ' to ' || we || '?' AS prompt, ['No.', 'The window is not covered by: ' || string_agg(dataset, ', ' ORDER BY dataset) || '.'] AS facts
          FROM w, cov WHERE NOT (s <= ws AND e >= we) GROUP BY label, ws, we)""" + _TAIL,
    ),
)
def _(spark, d):
    covers = [
        align.coverage(views.articles(spark, d), "articles", "publication_date"),
        align.coverage(views.prices_for_articles(spark, d), "prices", "date"),
        align.coverage(cq._rates(spark, d), "rates", "effective_date", ["series_key"]).withColumn("dataset", F.concat_ws(" ", "dataset", "series_key")),
    ]
    return _flat(op.build_records(op.unsupported_span_cases(covers, cq._ASKED_WINDOWS)))


def _future_cases(days):
    listed = "[" + ", ".join(f"'{x}'" for x in days) + "]"
    return f""", lp AS (SELECT ticker, max(date) AS date, arg_max(close, date) AS close, unnest({listed}) AS day FROM prices GROUP BY 1),
    lr AS (SELECT series_key, max(effective_date) AS date, arg_max(target_bp, effective_date) AS t, unnest({listed}) AS day FROM rates GROUP BY 1),
    future_cases AS (SELECT 'FF-EXTRAP-price-' || ticker || '-' || day AS id, 'FF-EXTRAP-price' AS template_family, 'price_extreme' AS question_type, 'extrapolation' AS category, 'medium' AS difficulty, 'single' AS dataset_scope,
        'What will ' || ticker || ' close at on ' || day || '?' AS prompt, ['The data cannot tell. The last close of ' || ticker || ' is ' || {_usd('close')} || ' on ' || date || '.'] AS facts FROM lp
      UNION ALL SELECT 'FF-EXTRAP-rate-' || series_key || '-' || day, 'FF-EXTRAP-rate', 'rate_at', 'extrapolation', 'medium', 'single', 'What will the level of ' || series_key || ' be on ' || day || '?',
        ['The data cannot tell. The last decision on record is ' || date || ' at ' || {_level('t / 100.0')} || '.'] FROM lr)"""


@query("qa_extrapolation", with_views(v.PRICES_BIG + "," + v.RATES, _future_cases(["2035-01-01", "2040-01-01"]) + _tail("future_cases")))
def _(spark, d):
    found = op.extrapolation_cases(views.prices_big(spark, d), views.rates(spark, d), ["2035-01-01", "2040-01-01"])
    return _flat(op.build_records(found))


_NO_BAR = """, cover AS (SELECT ticker, min(date) AS s, max(date) AS e FROM prices GROUP BY 1),
no_bar AS (SELECT 'FF-UNANS-price-' || ticker || '-2035-01-01' AS id, 'FF-UNANS-price' AS template_family, 'price_return' AS question_type, 'unanswerable' AS category, 'easy' AS difficulty, 'single' AS dataset_scope,
  'What did ' || ticker || ' close at on 2035-01-01?' AS prompt,
  [CASE WHEN s IS NULL THEN 'No. ' || ticker || ' is not in the price data.' ELSE 'No. ' || ticker || ' has no bar on 2035-01-01; its data runs from ' || s || ' to ' || e || '.' END] AS facts
  FROM (SELECT * FROM cover UNION ALL SELECT 'nobody', NULL, NULL))"""


def _whole(spark, d):
    return op.evaluation_set(views.rates(spark, d), pq.bars(spark, d), views.articles(spark, d), ["the", "und"], pq.YEARS)


@query(
    "qa_evaluation_set",
    with_views(
        pq.BARS + "," + v.RATES + "," + v.ARTICLES,
        _rate_cases(*pq.YEARS[0]) + _RETURN_CASES + _PRICE_CASES + _article_cases(["the", "und"]) + _future_cases(["2035-01-01"]) + _NO_BAR
        + _tail("rate_cases", "cases", "price_cases", "article_cases", "future_cases", "no_bar"),
    ),
)
def _(spark, d):
    return _flat(_whole(spark, d))


@query(
    "qa_summary",
    with_views(
        pq.BARS + "," + v.RATES + "," + v.ARTICLES,
        """, t AS (SELECT count(DISTINCT ticker) AS tickers FROM prices), s AS (SELECT count(DISTINCT series_key) AS series, count(DISTINCT series_key) FILTER (effective_date BETWEEN DATE '1995-01-02' AND DATE '1995-12-30') AS inside FROM rates),
        hold AS (SELECT count(*) AS c FROM (SELECT series_key FROM rates WHERE change_bp <> 0 GROUP BY 1 HAVING count(*) > 1)), y AS (SELECT count(DISTINCT year(publication_date)) AS years FROM articles)
        SELECT 'answerable' AS category, 'easy' AS difficulty, 'single' AS dataset_scope, 2 * inside + 7 * tickers + 3 * tickers + 2 * years AS n FROM t, s, y
        UNION ALL SELECT 'answerable', 'medium', 'single', inside + c + 2 * tickers FROM t, s, hold UNION ALL SELECT 'extrapolation', 'medium', 'single', tickers + series FROM t, s
        UNION ALL SELECT 'unanswerable', 'easy', 'single', tickers + 1 FROM t""",
    ),
)
def _(spark, d):
    return op.corpus_summary(_whole(spark, d))


@query(
    "qa_duplicate_ids",
    with_views(v.RATES, """SELECT 'planted' AS input, 'FF-EXTRAP-rate-' || series_key || '-2035-01-01' AS id, CAST(2 AS BIGINT) AS n FROM (SELECT DISTINCT series_key FROM rates)"""),
)
def _(spark, d):
    whole = _whole(spark, d)
    planted = whole.unionByName(whole.where(F.col("id").startswith("FF-EXTRAP-rate-")))
    return op.duplicate_ids(whole).withColumn("input", F.lit("clean")).unionByName(op.duplicate_ids(planted).withColumn("input", F.lit("planted")))


@query(
    "qa_unrendered",
    with_views(
        pq.BARS + "," + v.RATES_MOVED,
        """SELECT 'change_summary+pattern_count+basket_held' AS question_type, (SELECT 7 * count(DISTINCT series_key) - count(DISTINCT (series_key, year(effective_date))) FILTER (year(effective_date) IN
          (SELECT year(CAST(DATE '2015-01-01' + CAST(doc_id % 2555 AS INTEGER) AS DATE)) FROM documents)) FROM rates_moved) AS skipped, (SELECT 7 * count(DISTINCT series_key) FROM rates_moved) AS cases""",
    ),
)
def _(spark, d):
    summary = cx.year_summary(cq._rates(spark, d), views.articles(spark, d), cq._bars(spark, d), "the", cq.YEARS)
    return op.unrendered(op.year_cases(summary))
