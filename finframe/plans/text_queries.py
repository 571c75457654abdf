"""Queries of the article operators."""

from pyspark.sql import functions as F

from finframe.functions.matching import ACCENTED, PLAIN, STOP_WORDS
from finframe.functions.scalars import shaped
from finframe.functions.stemming import STEP2, STEP3, STEP4
from finframe.operators import tables
from finframe.operators import text as op
from finframe.plans import sqlviews as v
from finframe.plans.base import query, with_views
from finframe.sources import views

PATTERNS = ["the", "ou", "und", "que", "ation", "license", "a.b", "der die"]


def _match(pattern, whole=True):
    body = "".join("\\" + c if c in r"\.^$*+?()[]{}|" else c for c in pattern)
    return f"'(?i)\\b{body}\\b'" if whole else f"'(?i){body}'"


def _counts_sql(patterns, whole, cond="true"):
    return " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, count(*) FILTER (regexp_matches(all_text, {_match(p, whole)})) AS article_count, count(*) AS articles_in_window FROM articles WHERE {cond}"
        for p in patterns
    )


@query(
    "pattern_count",
    with_views(v.ARTICLES, f", c AS ({_counts_sql(PATTERNS, True)}) SELECT *, row_number() OVER (ORDER BY article_count DESC, pattern) AS rank FROM c"),
)
def _(spark, d):
    return op.pattern_count(views.spread(views.articles(spark, d), "article_id"), PATTERNS)


_SPAN = "publication_date BETWEEN DATE '2016-02-01' AND DATE '2018-06-30'"


@query(
    "pattern_rank_substring",
    with_views(v.ARTICLES, f", c AS ({_counts_sql(PATTERNS[:5], False, _SPAN)}) SELECT *, row_number() OVER (ORDER BY article_count DESC, pattern) AS rank FROM c"),
)
def _(spark, d):
    return op.pattern_count(views.spread(views.articles(spark, d), "article_id"), PATTERNS[:5], False, "2016-02-01", "2018-06-30")


@query(
    "pattern_single_anchored",
    with_views(v.ARTICLES, f", c AS ({_counts_sql(['ou'], True)}) SELECT *, 1 AS rank FROM c"),
)
def _(spark, d):
    return op.pattern_count(views.spread(views.articles(spark, d), "article_id"), ["ou"], anchor="always").withColumn("rank", F.col("rank").cast("int"))


@query(
    "pattern_share",
    with_views(
        v.ARTICLES,
        f", c AS ({_counts_sql(PATTERNS[:4], True)}) SELECT *, row_number() OVER (ORDER BY article_count DESC, pattern) AS rank, round(article_count / articles_in_window * 100, 4) AS share_pct FROM c",
    ),
)
def _(spark, d):
    return op.pattern_share(views.articles(spark, d), PATTERNS[:4])


@query(
    "pattern_by_year",
    with_views(
        v.ARTICLES,
        " UNION ALL ".join(
            f"SELECT year(publication_date) AS year, count(*) AS articles, '{p}' AS pattern, count(*) FILTER (regexp_matches(all_text, {_match(p)})) AS article_count FROM articles GROUP BY 1"
            for p in PATTERNS[:4]
        ),
    ),
)
def _(spark, d):
    return op.pattern_by_year(views.articles(spark, d), PATTERNS[:4])


@query("article_date_total", with_views(v.ARTICLES, f"SELECT count(*) AS article_count, CAST(min(publication_date) AS VARCHAR) AS earliest, CAST(max(publication_date) AS VARCHAR) AS latest, 'ok' AS status FROM articles WHERE regexp_matches(all_text, {_match('und')})"))
def _(spark, d):
    return shaped(op.date_count(views.articles(spark, d), pattern="und"))


def _date_count(granularity, pattern, field, cond, bounds):
    scope = "headline" if field == "headline" else "all_text"
    test = f"regexp_matches({scope}, {_match(pattern)})" if pattern else "true"

    @query(
        f"article_count_by_{granularity}",
        with_views(
            v.ARTICLES,
            f""", b AS (SELECT CAST(date_trunc('{granularity}', publication_date) AS DATE) AS period, count(*) AS article_count FROM articles WHERE {test} AND {cond} GROUP BY 1)
            SELECT CAST(period AS VARCHAR) AS period, article_count, (SELECT CAST(sum(article_count) AS BIGINT) FROM b) AS total FROM b """,
        ),
    )
    def _(spark, d):
        return shaped(op.date_count(views.articles(spark, d), granularity, pattern, field=field, start=bounds[0], end=bounds[1]))


_date_count("day", None, "all", "true", (None, None))
_date_count("month", "the", "all", _SPAN, ("2016-02-01", "2018-06-30"))
_date_count("year", "the", "headline", "true", (None, None))


@query(
    "article_busiest_day",
    with_views(v.ARTICLES, f"SELECT CAST(publication_date AS VARCHAR) AS period, count(*) AS article_count, (SELECT count(*) FROM articles WHERE {_SPAN}) AS total FROM articles WHERE {_SPAN} GROUP BY publication_date ORDER BY 2 DESC, publication_date LIMIT 1"),
)
def _(spark, d):
    return shaped(op.date_count(views.articles(spark, d), "day", start="2016-02-01", end="2018-06-30", limit=1))


@query(
    "article_busiest_periods",
    with_views(
        v.ARTICLES,
        f""", m AS (SELECT date_trunc('month', publication_date) AS m, count(*) AS c FROM articles WHERE regexp_matches(all_text, {_match('und')}) GROUP BY 1),
        y AS (SELECT year(m) AS y, CAST(sum(c) AS BIGINT) AS c FROM m GROUP BY 1)
        SELECT 'und' AS pattern, CAST(CAST((SELECT m FROM m ORDER BY c DESC, m LIMIT 1) AS DATE) AS VARCHAR) AS month, (SELECT max(c) FROM m) AS month_count,
               (SELECT y FROM y ORDER BY c DESC, y LIMIT 1) AS year, (SELECT max(c) FROM y) AS year_count""",
    ),
)
def _(spark, d):
    return shaped(op.busiest_periods(views.articles(spark, d), "und"))


@query(
    "article_exact_search",
    with_views(
        v.ARTICLES,
        f"SELECT article_id, headline, subhead, CAST(publication_date AS VARCHAR) AS publication_date, substr(text, 1, 400) AS excerpt FROM articles WHERE regexp_matches(all_text, {_match('license')}) ORDER BY articles.publication_date, headline, article_id LIMIT 10",
    ),
)
def _(spark, d):
    return shaped(op.exact_search(views.articles(spark, d), "license", 10))


@query(
    "article_substring_search",
    with_views(v.ARTICLES, "SELECT article_id, headline FROM articles WHERE (contains(lower(headline), 'ation') OR contains(lower(text), 'ation')) AND intro = 'en'"),
)
def _(spark, d):
    found = tables.text_search(views.articles(spark, d), ["headline", "text"], "ation", filters=[("intro", "=", "en")], limit=None)
    return found.select("article_id", "headline")


@query(
    "article_substring_search_all",
    with_views(v.ARTICLES, "SELECT article_id FROM articles WHERE contains(lower(headline), 'the') AND contains(lower(text), 'the')"),
)
def _(spark, d):
    return tables.text_search(views.articles(spark, d), ["headline", "text"], "the", match_all=True).select("article_id")


@query(
    "corpus_stats",
    with_views(v.ARTICLES, "SELECT count(*) AS article_count, count(publication_date) AS dated_count, CAST(min(publication_date) AS VARCHAR) AS earliest, CAST(max(publication_date) AS VARCHAR) AS latest FROM (SELECT CASE WHEN article_id % 97 <> 0 THEN publication_date END AS publication_date FROM articles)"),
)
def _(spark, d):
    dated = views.articles(spark, d).withColumn("publication_date", F.when(F.col("article_id") % 97 != 0, F.col("publication_date")))
    return shaped(op.corpus_stats(dated))


@query(
    "longest_headline",
    with_views(v.ARTICLES, "SELECT article_id, length(headline) AS headline_chars, CAST(publication_date AS VARCHAR) AS publication_date, headline FROM articles ORDER BY length(headline) DESC, article_id LIMIT 1"),
)
def _(spark, d):
    return shaped(op.longest_headline(views.articles(spark, d)))


@query(
    "articles_on_date",
    with_views(
        v.ARTICLES,
        """SELECT CAST(publication_date AS VARCHAR) AS publication_date, article_id, headline, position, article_count FROM (
          SELECT *, row_number() OVER (PARTITION BY publication_date ORDER BY article_id) AS position, count(*) OVER (PARTITION BY publication_date) AS article_count FROM articles) WHERE position <= 10""",
    ),
)
def _(spark, d):
    return shaped(op.articles_on_dates(views.articles(spark, d)))


_TOKENS = f""", listed AS (
  SELECT article_id, list_filter(string_split(trim(regexp_replace(translate(lower(headline || ' ' || subhead || ' ' || text), '{ACCENTED}', '{PLAIN}'), '[^a-z]+', ' ', 'g')), ' '),
         lambda t: t <> '' AND NOT list_contains([{', '.join(f"'{w}'" for w in STOP_WORDS)}], t)) AS toks FROM articles),
postings AS (SELECT article_id, term, count(*) AS tf FROM (SELECT article_id, unnest(toks) AS term FROM listed) GROUP BY 1, 2),
terms AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY 1)"""


@query("text_index_terms", with_views(v.ARTICLES, _TOKENS + " SELECT * FROM terms"))
def _(spark, d):
    return op.build_index(views.articles(spark, d), False, STOP_WORDS).terms


@query("text_index_lengths", with_views(v.ARTICLES, _TOKENS + " SELECT article_id, len(toks) AS length FROM listed"))
def _(spark, d):
    return op.build_index(views.articles(spark, d), False, STOP_WORDS).lengths


@query("article_total_without_match", with_views(v.ARTICLES, "SELECT count(*) AS article_count, CAST(NULL AS VARCHAR) AS earliest, CAST(NULL AS VARCHAR) AS latest, 'NO_MATCHING_RECORDS' AS status FROM articles WHERE contains(all_text, 'no article holds this')"))
def _(spark, d):
    return shaped(op.date_count(views.articles(spark, d), pattern="no article holds this"))


#: Sixty patterns: syllables of the corpus, doubled ones, and some that never occur.
SIXTY = [a + b for a in ("an", "er", "on", "th", "in", "es") for b in ("", "an", "er", "on", "th", "in", "es", "zq", "ou", "re")]


@query(
    "pattern_count_sixty",
    with_views(v.ARTICLES, f", c AS ({_counts_sql(SIXTY, True)}) SELECT *, row_number() OVER (ORDER BY article_count DESC, pattern) AS rank FROM c"),
)
def _(spark, d):
    return op.pattern_count(views.spread(views.articles(spark, d), "article_id"), SIXTY)


# Porter's algorithm as regular expressions over distinct words, one step per table
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
# a leading y is a consonant: a word begins with a vowel that is none, or with consonants
_LEAD = f"^(?:{_C}{_V}|[aeiou]+)"
_M0, _M1, _ONE = f"{_LEAD}{_C}", f"{_LEAD}{_C}{_V}{_C}", f"{_LEAD}{_C}({_V})?$"
_HAS_V, _CVC = f"^(?:{_C}[aeiouy]|[aeiou])", f"^{_C}[aeiouy][^aeiouwxy]$"


def _swap(column, table, measure):
    """The first fitting suffix, longest first, is replaced if the rest measures enough."""
    cases = " ".join(
        f"WHEN ends_with({column}, '{old}') THEN CASE WHEN regexp_matches(left({column}, length({column}) - {len(old)}), '{measure}') THEN left({column}, length({column}) - {len(old)}) || '{new}' ELSE {column} END"
        for old, new in sorted(table, key=lambda p: -len(p[0])))
    return f"CASE WHEN length(word) < 3 THEN {column} {cases} ELSE {column} END"


_STEMS = f""", words AS (SELECT DISTINCT unnest(toks) AS word FROM listed),
p1 AS (SELECT word, CASE WHEN length(word) < 3 THEN word WHEN regexp_matches(word, '(sses|ies)$') THEN left(word, length(word) - 2) WHEN regexp_matches(word, '[^s]s$') THEN left(word, length(word) - 1) ELSE word END AS w FROM words),
p2 AS (SELECT word, w, CASE WHEN ends_with(w, 'ed') THEN left(w, length(w) - 2) WHEN ends_with(w, 'ing') THEN left(w, length(w) - 3) END AS cut FROM p1),
p3 AS (SELECT word, CASE WHEN length(word) < 3 THEN w WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '{_M0}') THEN left(w, length(w) - 1) ELSE w END
  WHEN cut IS NOT NULL AND regexp_matches(cut, '{_HAS_V}') THEN CASE WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e'
    WHEN length(cut) > 1 AND right(cut, 1) = left(right(cut, 2), 1) AND regexp_matches(cut, '[^aeiouylsz]$') THEN left(cut, length(cut) - 1) WHEN regexp_matches(cut, '{_CVC}') THEN cut || 'e' ELSE cut END ELSE w END AS w FROM p2),
p4 AS (SELECT word, CASE WHEN length(word) > 2 AND ends_with(w, 'y') AND regexp_matches(left(w, length(w) - 1), '{_HAS_V}') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM p3),
p5 AS (SELECT word, {_swap('w', STEP2, _M0)} AS w FROM p4),
p6 AS (SELECT word, {_swap('w', STEP3, _M0)} AS w FROM p5),
p7 AS (SELECT word, {_swap('w', [(s, '') for s in STEP4 if s != 'ion'], _M1)} AS a, w FROM p6),
p8 AS (SELECT word, CASE WHEN length(word) > 2 AND regexp_matches(w, '[st]ion$') THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '{_M1}') THEN left(w, length(w) - 3) ELSE w END ELSE a END AS w FROM p7),
p9 AS (SELECT word, CASE WHEN length(word) > 2 AND ends_with(w, 'e') AND (regexp_matches(left(w, length(w) - 1), '{_M1}') OR (regexp_matches(left(w, length(w) - 1), '{_ONE}') AND NOT regexp_matches(left(w, length(w) - 1), '{_CVC}'))) THEN left(w, length(w) - 1) ELSE w END AS w FROM p8),
stemmed AS (SELECT word, CASE WHEN length(word) > 2 AND ends_with(w, 'll') AND regexp_matches(w, '{_M1}') THEN left(w, length(w) - 1) ELSE w END AS stem FROM p9)"""


@query("text_index_stems", with_views(v.ARTICLES, _TOKENS + _STEMS + """, sp AS (SELECT article_id, stem AS term, CAST(sum(tf) AS BIGINT) AS tf FROM postings JOIN stemmed ON word = term GROUP BY 1, 2)
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM sp GROUP BY 1"""))
def _(spark, d):
    return op.build_index(views.articles(spark, d), True, STOP_WORDS).terms


BM25 = (
    _TOKENS
    + f""", asked AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(string_split(trim(regexp_replace(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '[^a-z]+', ' ', 'g')), ' ')) AS term FROM benchmark)
       WHERE term <> '' AND NOT list_contains([{', '.join(f"'{w}'" for w in STOP_WORDS)}], term)),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM listed),
scores AS (SELECT query_id, p.article_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / mean))) AS score
  FROM asked JOIN terms USING (term) JOIN postings p USING (term) JOIN listed l ON l.article_id = p.article_id, stats GROUP BY 1, 2)"""
)


def benchmark_queries(spark, d):
    """Each benchmark item, as a whole, asks for the articles closest to it."""
    return views.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(
    "bm25_search",
    with_views(
        v.ARTICLES,
        BM25 + """, r AS (SELECT query_id, article_id, headline, publication_date, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, publication_date, headline, article_id) AS rank
          FROM scores JOIN articles USING (article_id) WHERE publication_date >= DATE '2015-06-01')
        SELECT query_id, article_id, headline, CAST(publication_date AS VARCHAR) AS publication_date, rank, round(score, 4) AS score FROM r WHERE rank <= 5""",
    ),
)
def _(spark, d):
    articles = views.articles(spark, d)
    index = op.build_index(articles, False, STOP_WORDS)
    out = op.retrieve(articles, index, benchmark_queries(spark, d), 5, start="2015-06-01")
    return shaped(out.select("query_id", "article_id", "headline", "publication_date", "rank", "score"))


@query(
    "bm25_search_stemmed",
    with_views(
        v.ARTICLES,
        _TOKENS.replace("FROM articles)", "FROM articles UNION ALL SELECT NULL, list_filter(string_split(trim(regexp_replace(translate(lower(text), '%s', '%s'), '[^a-z]+', ' ', 'g')), ' '), lambda t: t <> '') FROM benchmark)" % (ACCENTED, PLAIN), 1)
        + _STEMS + """, sp AS (SELECT article_id, stem AS term, CAST(sum(tf) AS BIGINT) AS tf FROM postings JOIN stemmed ON word = term WHERE article_id IS NOT NULL GROUP BY 1, 2),
        sd AS (SELECT term, count(*) AS df FROM sp GROUP BY 1),
        asked AS (SELECT DISTINCT query_id, stem AS term FROM (SELECT item_id AS query_id, unnest(string_split(trim(regexp_replace(translate(lower(text), '%s', '%s'), '[^a-z]+', ' ', 'g')), ' ')) AS word FROM benchmark) JOIN stemmed USING (word)
          WHERE NOT list_contains([%s], word)),
        stats AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM listed WHERE article_id IS NOT NULL),
        scores AS (SELECT query_id, p.article_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / mean))) AS score
          FROM asked JOIN sd USING (term) JOIN sp p USING (term) JOIN listed l ON l.article_id = p.article_id, stats GROUP BY 1, 2),
        r AS (SELECT query_id, article_id, headline, publication_date, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, publication_date, headline, article_id) AS rank FROM scores JOIN articles USING (article_id))
        SELECT query_id, article_id, headline, CAST(publication_date AS VARCHAR) AS publication_date, rank, round(score, 4) AS score FROM r WHERE rank <= 5""" % (ACCENTED, PLAIN, ", ".join(f"'{w}'" for w in STOP_WORDS)),
    ),
)
def _(spark, d):
    articles = views.articles(spark, d)
    index = op.build_index(articles, True, STOP_WORDS)
    out = op.retrieve(articles, index, benchmark_queries(spark, d), 5)
    return shaped(out.select("query_id", "article_id", "headline", "publication_date", "rank", "score"))


@query(
    "search_conversations",
    """WITH words AS (SELECT conv_id * 100 + turn AS turn_id, conv_id, role, string_split(trim(regexp_replace(translate(lower(role || ' ' || text), '%s', '%s'), '[^a-z]+', ' ', 'g')), ' ') AS toks FROM conversations),
    listed AS (SELECT turn_id, conv_id, role, list_filter(toks, lambda t: t <> '') AS toks FROM words),
    postings AS (SELECT turn_id, term, count(*) AS tf FROM (SELECT turn_id, unnest(toks) AS term FROM listed) GROUP BY 1, 2),
    terms AS (SELECT term, count(*) AS df FROM postings GROUP BY 1), stats AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM listed),
    asked AS (SELECT * FROM (VALUES (0, 'the'), (0, 'and'), (1, 'der'), (1, 'die')) t(query_id, term)),
    scores AS (SELECT query_id, p.turn_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / mean))) AS score
      FROM asked JOIN terms USING (term) JOIN postings p USING (term) JOIN listed l ON l.turn_id = p.turn_id, stats GROUP BY 1, 2),
    r AS (SELECT query_id, turn_id, conv_id, role, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, turn_id) AS rank FROM scores JOIN listed USING (turn_id) WHERE role <> 'system')
    SELECT * FROM r WHERE rank <= 20""" % (ACCENTED, PLAIN),
)
def _(spark, d):
    turns = views.table(spark, d, "conversations").withColumn("turn_id", F.col("conv_id") * 100 + F.col("turn"))
    index = op.build_index(turns, False, fields=["role", "text"], id_col="turn_id")
    asked = spark.sql("SELECT * FROM VALUES (0, 'the and'), (1, 'der die') AS q(query_id, query)")
    found = op.search_table(turns, index, asked, ["conv_id", "role"], [("role", "!=", "system")], 20)
    return found.select("query_id", "turn_id", "conv_id", "role", "rank", "score")
