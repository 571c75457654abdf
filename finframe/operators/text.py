"""Operators on the dated article corpus: counts by pattern and date, search.

Counts look at four fields (headline, subhead, intro, text) and take an article
once; the search index covers headline, subhead and text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.functions.matching import combined, has_case_twins, is_word, literal_regex, literal_regex_of, spaced_words, tokens, word_runs
from finframe.functions.scalars import present
from finframe.functions.stemming import stem
from finframe.operators import windows
from finframe.operators.align import NO_MATCHING_RECORDS, OK
from finframe.operators.ordering import row_numbers
from finframe.operators.tables import where
from finframe.session import checkpointed

COUNT_FIELDS = ("headline", "subhead", "intro", "text")
INDEX_FIELDS = ("headline", "subhead", "text")
DAY = "publication_date"


def all_text(articles: DataFrame) -> Column:
    """The searched text: the column kept at ingest, else the four fields joined."""
    return F.col("all_text") if "all_text" in articles.columns else combined(*COUNT_FIELDS)


def in_dates(articles: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a publication window, with the partition column narrowed too; none where the bounds are inverted."""
    for bound, low in ((start, True), (end, False)):
        if bound:
            day = F.lit(bound).cast("date")
            articles = articles.where(F.col(DAY) >= day if low else F.col(DAY) <= day)
            if "year" in articles.columns:
                year = int(bound[:4])
                articles = articles.where(F.col("year") >= year if low else F.col("year") <= year)
    return articles


def _counts(rows: DataFrame, patterns: Sequence[str], whole_word: bool, anchor: str = "edge") -> tuple[DataFrame, list[Column]]:
    """The rows with what is searched next to ``_text``, and a count for each pattern.

    Words are found in a copy of the text that holds one space on each side of
    every word, made once per row; regular expressions are left for other
    patterns, and for texts with letters that only they match.
    """
    words = [whole_word and is_word(p) for p in patterns]
    if any(words):
        rows = rows.withColumn("_words", F.when(~has_case_twins(F.col("_text")), spaced_words(F.col("_text"))))

    def held(pattern: str, word: bool) -> Column:
        matched = F.col("_text").rlike(literal_regex(pattern, whole_word, anchor))
        return F.when(F.col("_words").isNotNull(), F.contains("_words", F.lit(f" {pattern.lower()} "))).otherwise(matched) if word else matched

    return rows, [F.count_if(held(p, w)).alias(f"p{i}") for i, (p, w) in enumerate(zip(patterns, words))]


def _unfold(patterns: Sequence[str]) -> Column:
    return F.inline(
        F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"p{i}").alias("article_count")) for i, p in enumerate(patterns)])
    )


def pattern_count(
    articles: DataFrame, patterns: Sequence[str], whole_word: bool = True, start: str | None = None, end: str | None = None,
    anchor: str = "edge",
) -> DataFrame:
    """Articles that hold each pattern, ranked; one scan for the whole list, however long."""
    rows = in_dates(articles, start, end).select(all_text(articles).alias("_text"))
    rows, counts = _counts(rows, patterns, whole_word, anchor)
    one = rows.agg(*counts, F.count(F.lit(1)).alias("articles_in_window"))
    out = one.select(_unfold(patterns), "articles_in_window")
    # one row per given pattern is left here, so one sorted window is enough
    ranked = Window.partitionBy("articles_in_window").orderBy(F.col("article_count").desc(), "pattern")
    return out.withColumn("rank", F.row_number().over(ranked).cast("bigint"))


def pattern_hits(articles: DataFrame, patterns: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``pattern, article_id, publication_date``: the articles that hold each pattern of a table as whole words.

    A text that holds a pattern holds each of its runs of word characters as a
    whole run.  Texts are cut into runs once; those that occur in some pattern
    are kept by equality; and a pattern is looked up by the run that fewest
    articles hold.  Only candidates of patterns that are more than one run are
    tested on the text.  Patterns without a word character are tested on every
    text; they are expected to be few.
    """
    named = checkpointed(patterns.where(F.col("pattern") != "").select("pattern").distinct().withColumn("_runs", word_runs(F.col("pattern"))))
    worded, signs = named.where(F.size("_runs") > 0), named.where(F.size("_runs") == 0)
    rows = in_dates(articles, start, end)
    texts = rows.select("article_id", DAY, all_text(articles).alias("_text"))

    parts = worded.select("pattern", F.explode("_runs").alias("_run"))
    found = texts.select("article_id", DAY, F.explode(word_runs(F.col("_text"))).alias("_run"))
    held = checkpointed(found.join(parts.select("_run").distinct(), "_run", "left_semi"))
    common = held.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    # a run that no article holds rules its pattern out
    rarest = parts.join(common, "_run", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_run").alias("run"))).alias("_r"))
    candidates = rarest.select("pattern", F.col("_r.run").alias("_run")).join(held, "_run")
    alone = F.lower("pattern") == F.col("_run")
    sure = candidates.where(alone).select("pattern", "article_id", DAY)
    doubtful = candidates.where(~alone).select("pattern", "article_id", DAY)
    # a text moves once, however many patterns it may hold
    asked = doubtful.groupBy("article_id", DAY).agg(F.collect_list("pattern").alias("_patterns"))
    lowered = texts.select("article_id", "_text", F.lower("_text").alias("_low"), has_case_twins(F.col("_text")).alias("_twins"))
    tested = asked.join(lowered, "article_id").select("article_id", DAY, "_text", "_low", "_twins", F.explode("_patterns").alias("pattern"))
    # lower case alone tells nothing of letters outside ASCII
    plain = (F.length("pattern") == F.octet_length("pattern")) & ~F.col("_twins")
    tested = tested.where(F.when(plain, F.contains("_low", F.lower("pattern"))).otherwise(True))
    tested = tested.where(F.regexp_like("_text", literal_regex_of(F.col("pattern"))))
    listed = signs.agg(F.collect_list("pattern").alias("p")).scalar()
    by_sign = texts.withColumn("_signs", listed).select("article_id", DAY, F.explode(F.filter("_signs", lambda p: F.contains(F.lower("_text"), F.lower(p)))).alias("pattern"))
    return sure.unionByName(tested.select("pattern", "article_id", DAY)).unionByName(by_sign.select("pattern", "article_id", DAY))


def pattern_table_count(articles: DataFrame, patterns: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Articles that hold each pattern of a table, ranked; patterns without any count 0."""
    counts = pattern_hits(articles, patterns, start, end).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    total = in_dates(articles, start, end).agg(F.count(F.lit(1)).alias("t")).scalar()
    out = patterns.where(F.col("pattern") != "").select("pattern").distinct().join(counts, "pattern", "left")
    out = out.select("pattern", F.coalesce("n", F.lit(0)).alias("article_count"), total.alias("articles_in_window"))
    return row_numbers(out, [F.col("article_count").desc(), F.col("pattern")])


def date_counts(articles: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(pattern, start, end, ..)``: articles of each window that hold its pattern, the first and the last day.

    From one table of counts by pattern and day, whose windows are summed in blocks.
    """
    days = pattern_hits(articles, requests).groupBy("pattern", DAY).agg(F.count(F.lit(1)).alias("n"))
    out = windows.totals(requests, checkpointed(days), {"article_count": "n"}, key="pattern", date=DAY)
    # a pattern that no article holds is not unknown
    status = F.when(F.col("start") > F.col("end"), windows.DATE_RANGE_INVALID).when(F.col("status") == OK, OK).otherwise(NO_MATCHING_RECORDS)
    return out.withColumn("status", status).withColumn("article_count", F.coalesce("article_count", F.lit(0)))


def pattern_share(articles: DataFrame, patterns: Sequence[str], **kw) -> DataFrame:
    out = pattern_count(articles, patterns, **kw)
    return out.withColumn("share_pct", F.round(F.try_divide(F.col("article_count"), F.col("articles_in_window")) * 100, 4))


def pattern_by_year(articles: DataFrame, patterns: Sequence[str], whole_word: bool = True) -> DataFrame:
    """Pattern by year grid, one scan."""
    rows = articles.select(F.year(DAY).cast("bigint").alias("year"), all_text(articles).alias("_text"))
    rows, counts = _counts(rows, patterns, whole_word)
    grid = rows.groupBy("year").agg(*counts, F.count(F.lit(1)).alias("articles"))
    return grid.select("year", "articles", _unfold(patterns))


def _matching(
    articles: DataFrame, pattern: str | None, whole_word: bool, field: str, start: str | None, end: str | None
) -> DataFrame:
    rows = in_dates(articles, start, end)
    if pattern:
        text = F.coalesce(F.col("headline"), F.lit("")) if field == "headline" else all_text(articles)
        rows = rows.where(text.rlike(literal_regex(pattern, whole_word)))
    return rows


def _bucket(granularity: str) -> Column:
    return F.col(DAY) if granularity == "day" else F.trunc(DAY, granularity)


def date_count(
    articles: DataFrame, granularity: str = "total", pattern: str | None = None, whole_word: bool = True,
    field: str = "all", start: str | None = None, end: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Totals and span, or buckets by day, month or year, the busiest first.

    The total comes from all buckets before the limit, which are written once and
    read twice.  No match gives a total of zero with NULL dates and a status, or
    no bucket.
    """
    rows = _matching(articles, pattern, whole_word, field, start, end)
    if granularity == "total":
        status = F.when(F.count(F.lit(1)) > 0, OK).otherwise(NO_MATCHING_RECORDS)
        return rows.agg(F.count(F.lit(1)).alias("article_count"), F.min(DAY).alias("earliest"), F.max(DAY).alias("latest"), status.alias("status"))
    # at most one row per day
    buckets = checkpointed(rows.groupBy(_bucket(granularity).alias("period")).agg(F.count(F.lit(1)).alias("article_count")))
    total = buckets.agg(F.sum("article_count").alias("t")).scalar()
    out = buckets.withColumn("total", total).orderBy(F.col("article_count").desc(), "period")
    return out if limit is None else out.limit(limit)


def busiest_periods(articles: DataFrame, pattern: str) -> DataFrame:
    """The month and the year with most matches, from one scan."""
    months = _matching(articles, pattern, True, "all", None, None).groupBy(F.trunc(DAY, "month").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    years = months.groupBy(F.trunc("m", "year").alias("y")).agg(F.sum("c").alias("yc"), F.min(F.struct((-F.col("c")).alias("k"), "m")).alias("top"))
    best_year = F.min(F.struct((-F.col("yc")).alias("k"), F.col("y")))
    return years.agg(F.min("top").alias("t"), best_year.alias("b")).select(
        F.lit(pattern).alias("pattern"), F.col("t.m").alias("month"), (-F.col("t.k")).alias("month_count"),
        F.year("b.y").cast("bigint").alias("year"), (-F.col("b.k")).alias("year_count"),
    )


def exact_search(articles: DataFrame, query: str, limit: int | None = None, start: str | None = None, end: str | None = None, excerpt: int = 400) -> DataFrame:
    """Whole-word matches by date, headline and id."""
    rows = _matching(articles, query, True, "all", start, end)
    found = rows.orderBy(DAY, "headline", "article_id")
    return (found if limit is None else found.limit(limit)).select(
        "article_id", "headline", "subhead", DAY, F.substring(F.coalesce("text", F.lit("")), 1, excerpt).alias("excerpt")
    )


def corpus_stats(articles: DataFrame) -> DataFrame:
    """Size with date-less rows counted, and the dated span."""
    return articles.agg(
        F.count(F.lit(1)).alias("article_count"), F.count(DAY).alias("dated_count"), F.min(DAY).alias("earliest"), F.max(DAY).alias("latest")
    )


def longest_headline(articles: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    key = F.struct(F.length("headline"), -F.col("article_id"))
    return in_dates(articles, start, end).agg(F.max_by(F.struct("headline", DAY, "article_id"), key).alias("h")).select(
        F.col("h.article_id").alias("article_id"), F.length("h.headline").cast("bigint").alias("headline_chars"),
        F.col(f"h.{DAY}").alias(DAY), F.col("h.headline").alias("headline"),
    )


def articles_on_dates(articles: DataFrame, first: int = 10, days: Sequence[str] = ()) -> DataFrame:
    """The count of each day and its first headlines by id."""
    rows = articles.where(F.col(DAY).isin(*days)) if days else articles
    counts = rows.groupBy(DAY).agg(F.count(F.lit(1)).alias("article_count"))
    place = Window.partitionBy(DAY).orderBy("article_id")
    # the limit on the row number is applied in each task before the shuffle
    shown = rows.select(DAY, "article_id", "headline").withColumn("position", F.row_number().over(place)).where(F.col("position") <= first)
    return shown.join(counts, DAY).withColumn("position", F.col("position").cast("bigint"))


@dataclass(frozen=True)
class TextIndex:
    """An inverted index with its statistics, all written tables.

    The postings are cut by row, so all terms of a row lie in one file: scores
    are summed up where they arise.  Nothing is grouped over all postings again.
    """

    postings: DataFrame  # term, <id>, length, tf; all of a row in one file, each file sorted by term
    terms: DataFrame  # term, df, cf
    lengths: DataFrame  # <id>, length: terms per row, zero for rows without any
    stats: DataFrame  # n, mean: rows and mean length; one row
    stems: DataFrame | None  # word, term: the words of the corpus and their stems
    stop_words: tuple[str, ...]
    id_col: str = "article_id"

    def write(self, path: str) -> None:
        for name in ("postings", "terms", "lengths", "stats", "stems"):
            part = getattr(self, name)
            if part is not None:
                part.write.mode("overwrite").parquet(f"{path}/{name}")


def _sorted(postings: DataFrame) -> DataFrame:
    """Written in the order of the terms within each file."""
    return checkpointed(postings.sortWithinPartitions("term"))


def build_index(
    rows: DataFrame, stemmed: bool = True, stop_words: Sequence[str] = (), fields: Sequence[str] = INDEX_FIELDS, id_col: str = "article_id",
) -> TextIndex:
    """Terms per row over the whole texts of any table; only distinct words reach the stemmer.

    Texts move once, to the task that counts their words; the words themselves
    move for their stems only.
    """
    texts = rows.select(id_col, combined(*fields).alias("_text")).repartition(id_col)
    listed = texts.select(id_col, tokens(F.col("_text"), list(stop_words)).alias("_words"))
    listed = listed.select(id_col, F.size("_words").cast("bigint").alias("length"), F.explode("_words").alias("word"))
    words = listed.groupBy(id_col, "length", "word").agg(F.count(F.lit(1)).alias("tf"))
    stems = None
    if stemmed:
        words = checkpointed(words)
        stems = checkpointed(words.select("word").distinct().withColumn("term", stem("word")))
        # a frequent word has long postings; Spark splits its partition
        words = words.join(stems, "word").drop("word").repartition(id_col).groupBy(id_col, "length", "term").agg(F.sum("tf").alias("tf"))
    else:
        words = words.withColumnRenamed("word", "term")
    postings = _sorted(words)
    terms = checkpointed(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    counted = postings.groupBy(id_col).agg(F.max("length").alias("length"))
    lengths = checkpointed(rows.select(id_col).join(counted, id_col, "left").withColumn("length", F.coalesce("length", F.lit(0))))
    stats = checkpointed(lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")))
    return TextIndex(postings, terms, lengths, stats, stems, tuple(stop_words), id_col)


def read_index(spark, path: str, stemmed: bool = True, stop_words: Sequence[str] = (), id_col: str = "article_id") -> TextIndex:
    """An index that ``TextIndex.write`` left at a path."""
    parts = {n: spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "lengths", "stats")}
    return TextIndex(**parts, stems=spark.read.parquet(f"{path}/stems") if stemmed else None, stop_words=tuple(stop_words), id_col=id_col)


def asked_terms(index: TextIndex, queries: DataFrame) -> DataFrame:
    """``query_id, term, weight, df`` of ``queries(query_id, query)``: the terms that some row holds."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query"), list(index.stop_words)))).alias("word"))
    if index.stems is None:
        asked = asked.withColumnRenamed("word", "term")
    else:
        # words the corpus lacks have no postings under any stem of their own spelling, but may share one
        known = asked.join(index.stems, "word", "left")
        asked = known.withColumn("term", F.coalesce("term", stem("word"))).select("query_id", "term").distinct()
    n = index.stats.select("n").scalar()
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(index.terms, "term").select("query_id", "term", weight.alias("weight"), "df")


def bm25(index: TextIndex, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 of every (query, row) that shares a term.

    ``queries(query_id, query)``.  The asked terms are looked up first and
    written, so their number is known: where they are few, they go to the
    postings and no posting moves; only one score per query and row does.
    """
    mean = index.stats.select("mean").scalar()
    weighted = checkpointed(asked_terms(index, queries).select("query_id", "term", "weight"))
    tf = F.col("tf")
    part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / mean))
    scored = index.postings.join(weighted, "term")
    return scored.groupBy("query_id", index.id_col).agg(F.sum(part).alias("score"))


def top_articles(scores: DataFrame, articles: DataFrame, limit: int | None = None, excerpt: int = 400) -> DataFrame:
    """The articles per query by score, date, headline and id; the best ``limit`` of them, if given."""
    if limit is not None:
        # all that can be among the best, ties included, before any text is met
        first = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), DAY)
        placed = scores.join(articles.select("article_id", DAY), "article_id").withColumn("_r", F.rank().over(first))
        scores = checkpointed(placed.where(F.col("_r") <= limit).drop("_r", DAY))
    shown = articles.select("article_id", "headline", "subhead", DAY, F.substring(F.coalesce("text", F.lit("")), 1, excerpt).alias("excerpt"))
    best = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), DAY, "headline", "article_id")
    ranked = scores.join(shown, "article_id").withColumn("rank", F.row_number().over(best).cast("bigint"))
    return (ranked if limit is None else ranked.where(F.col("rank") <= limit)).withColumn("score", F.round("score", 4))


def retrieve(
    articles: DataFrame, index: TextIndex, queries: DataFrame, limit: int | None = None, start: str | None = None, end: str | None = None, excerpt: int = 400
) -> DataFrame:
    """BM25 search in a publication window; the filter applies before the ranking."""
    return top_articles(bm25(index, queries), in_dates(articles, start, end), limit, excerpt)


def search_table(
    rows: DataFrame, index: TextIndex, queries: DataFrame, columns: Sequence[str], filters: Sequence[tuple] = (), limit: int | None = None,
) -> DataFrame:
    """BM25 search over any indexed table: filters apply before the ranking; ties go to the smaller id."""
    held = where(rows, filters).select(index.id_col, *[c for c in columns if c != index.id_col])
    best = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), index.id_col)
    ranked = bm25(index, queries).join(held, index.id_col).withColumn("rank", F.row_number().over(best).cast("bigint"))
    return (ranked if limit is None else ranked.where(F.col("rank") <= limit)).withColumn("score", F.round("score", 4))


def search_notes(index: TextIndex, queries: DataFrame, found: DataFrame) -> DataFrame:
    """``query_id, query, warnings``: queries that found no row, and that stems were searched, not whole words."""
    hit = found.select("query_id").distinct().withColumn("_hit", F.lit(True))
    none = F.when(F.col("_hit").isNull(), F.lit("no row holds a word of the query"))
    stems = F.lit("found by stems: counts differ from those of whole words" if index.stems is not None else None).cast("string")
    return queries.join(hit, "query_id", "left").select("query_id", "query", present([none, stems]).alias("warnings"))
