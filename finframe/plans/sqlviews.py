"""The same views in the oracle's SQL, as common table expressions."""

RATES = """
rates AS (
  SELECT series_key, effective_date, target_bp,
         CAST(coalesce(target_bp - lag(target_bp) OVER (PARTITION BY series_key ORDER BY effective_date), 0) AS BIGINT) AS change_bp
  FROM (
    SELECT o_orderpriority AS series_key, CAST(date_trunc('month', o_orderdate) AS DATE) AS effective_date,
           ((CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) // count(*)) // 2000000) * 25 AS target_bp
    FROM orders GROUP BY 1, 2)
)"""

RATES_MOVED = (
    RATES
    + """,
rates_moved AS (
  SELECT series_key, CAST(effective_date + INTERVAL 20 YEAR AS DATE) AS effective_date, target_bp, change_bp FROM rates
)"""
)


def _event_bars(name: str, ticker: str) -> str:
    return f"""
{name} AS (
  SELECT CAST({ticker} AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close,
         CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS volume
  FROM events GROUP BY 1, 2
)"""


PRICES = _event_bars("prices", "event_type")
PRICES_WIDE = _event_bars("prices", "user_id")


def _brand_bars(years: int) -> str:
    when = "(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)"
    return f"""
prices AS (
  SELECT p_brand AS ticker, CAST(CAST(l_shipdate AS DATE) + INTERVAL {years} YEAR AS DATE) AS date,
         arg_min(floor(l_extendedprice * 100 / l_quantity) / 100.0, {when}) AS open,
         max(floor(l_extendedprice * 100 / l_quantity) / 100.0) AS high, min(floor(l_extendedprice * 100 / l_quantity) / 100.0) AS low,
         arg_max(floor(l_extendedprice * 100 / l_quantity) / 100.0, {when}) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
)"""


PRICES_BIG = _brand_bars(0)
PRICES_MOVED = _brand_bars(20)

ENRICHED = """,
bars AS (
  SELECT *, row_number() OVER s AS rn, count(*) OVER (PARTITION BY ticker) AS n,
         lag(close) OVER s AS previous_close, lag(date) OVER s AS previous_date,
         close / lag(close) OVER s - 1 AS daily_return
  FROM prices WINDOW s AS (PARTITION BY ticker ORDER BY date)
)"""

ARTICLES = """
articles AS (
  SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS headline, source AS subhead, lang AS intro, text,
         CAST(DATE '2015-01-01' + CAST(doc_id % 2555 AS INTEGER) AS DATE) AS publication_date,
         split_part(text, chr(10), 1) || ' ' || source || ' ' || lang || ' ' || text AS all_text
  FROM documents
)"""

QA = """
qa AS (
  SELECT a.conv_id || '-' || a.turn AS id,
         CASE a.conv_id % 3 WHEN 0 THEN 'rate' WHEN 1 THEN 'price' ELSE 'article' END AS task,
         a.text AS prompt,
         b.text || ' The level was ' || printf('%d.%02d', number // 100, number % 100) || '% on ' || strftime(day, '%-d %B %Y') || '.' AS target,
         list_concat(list_sort(list_distinct(string_split(b.text, ' '))), [rtrim(printf('%d.%02d', number // 100, number % 100), '0'), CAST(day AS VARCHAR)]) AS components,
         CAST(a.conv_id AS VARCHAR) AS group_key, number
  FROM (SELECT *, (conv_id * 37 + turn * 11) % 800 AS number,
               CAST(DATE '2015-01-01' + CAST((conv_id * 37 + turn * 11) % 800 AS INTEGER) AS DATE) AS day
        FROM conversations WHERE role = 'user') a
  JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
)"""

PREDICTIONS = (
    QA
    + """,
predictions AS (
  SELECT label, step, id, CASE label WHEN 'base' THEN 'I will answer. ' || prompt
           WHEN 'step-100' THEN substr(target, 1, CAST(floor(length(target) * 0.6) AS INTEGER)) ELSE target END AS prediction,
         CAST((number + step) % 400 AS DOUBLE) AS seconds
  FROM qa, (VALUES ('base', CAST(0 AS BIGINT)), ('step-100', 100), ('step-200', 200)) v(label, step)
)"""
)
