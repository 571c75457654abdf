"""Questions that join rates, prices and articles.

Rates hold any number of series, and every result on rates carries its
``series_key``.  Where every ticker meets every event, each bar lists the
calendar days that align to it and joins the event days by equality.  The result
has one row per ticker and event, but no step pairs bars with events they do not
answer.  How the sides are joined is left to their sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.functions.matching import literal_regex
from finframe.functions.scalars import bp_to_pct, decimal_to_pct, ratio, round4
from finframe.operators import prices as px
from finframe.operators import rates as rt
from finframe.operators import text as tx
from finframe.operators.align import DATE_OUTSIDE_COVERAGE, OK, in_coverage
from finframe.operators.ordering import row_numbers
from finframe.operators.phrases import PhraseIndex, phrase_search
from finframe.session import checkpointed


KEY = "series_key"


def of_series(rates: DataFrame, series_key: str) -> DataFrame:
    return rates.where(F.col(KEY) == series_key)


def per_series(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Every row once for each series of the rates; the list of series is one value."""
    listed = rates.agg(F.array_sort(F.collect_set(KEY)).alias("s")).scalar()
    return rows.withColumn(KEY, F.explode(listed))


def aligned_days(bars: DataFrame, lo: Column, hi: Column, alignment: str = "nearest") -> DataFrame:
    """One row per calendar day in ``lo..hi`` and ticker, holding the bar the day aligns to."""
    series = Window.partitionBy("ticker").orderBy("date")
    date = F.col("date")
    before, after = F.lag("date").over(series), F.lead("date").over(series)
    if alignment == "nearest":
        # a day exactly between two bars goes to the earlier one
        first = F.date_add(before, F.floor(F.datediff(date, before) / 2).cast("int") + 1)
        last = F.date_add(date, F.floor(F.datediff(after, date) / 2).cast("int"))
        first, last = F.coalesce(first, F.least(lo, date)), F.coalesce(last, F.greatest(hi, date))
    elif alignment == "previous":
        first, last = date, F.coalesce(F.date_sub(after, 1), F.greatest(hi, date))
    elif alignment == "next":
        first, last = F.coalesce(F.date_add(before, 1), F.least(lo, date)), date
    else:
        first = last = date
    spread = bars.withColumns({"_first": F.greatest(first, lo), "_last": F.least(last, hi)})
    return spread.where(F.col("_first") <= F.col("_last")).withColumn(
        "day", F.explode(F.sequence("_first", "_last"))
    ).drop("_first", "_last")


def _span(events: DataFrame, day: str) -> tuple[Column, Column]:
    ends = events.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return ends.select("lo").scalar(), ends.select("hi").scalar()


def event_market_returns(
    events: DataFrame, rates: DataFrame, bars: DataFrame, sizes: Sequence[tuple[int, int]] = ((3, 3),), alignment: str = "nearest"
) -> DataFrame:
    """Window return of every ticker around every event day of a series, with its level in force.

    ``events(series_key, event_date)``.
    """
    # at most one row per series and calendar day, read by several branches below
    days = checkpointed(events.select(KEY, "event_date").distinct())
    known = rate_in_force(days, rates, "event_date").where(F.col("status") == OK)
    lo, hi = _span(days, "event_date")
    caught = aligned_days(px.with_event_windows(bars, sizes), lo, hi, alignment)
    hits = caught.join(known, caught["day"] == known["event_date"]).select(
        KEY, "event_date", "effective_date", "target_pct", "change_pct", "ticker", F.col("date").alias("resolved_event_date"),
        round4(F.col("close")).alias("event_close"), F.inline("windows"),
    )
    return hits.select(
        KEY, "event_date", F.col("effective_date").alias("rate_effective_date"), "target_pct", "change_pct", "ticker", "resolved_event_date",
        "event_close", "pre", "post", (F.col("pre") + F.col("post") + 1).cast("bigint").alias("window_trading_days"),
        F.col("lo.date").alias("window_start_date"), F.col("hi.date").alias("window_end_date"),
        (ratio(F.col("hi.close"), F.col("lo.close")) - 1).alias("return_decimal"), "truncated",
    )


def event_best_and_worst(returns: DataFrame) -> DataFrame:
    """Best and worst ticker per event and window, by map-side combined extremes; tickers without a return do not count."""
    order = F.when(F.col("return_decimal").isNotNull(), px.standing(F.col("return_decimal")))
    return returns.groupBy(KEY, "event_date", "pre", "target_pct").agg(
        F.min_by("ticker", order).alias("best"), F.max_by("ticker", order).alias("worst"), F.count("return_decimal").alias("tickers"),
        decimal_to_pct(F.max("return_decimal")).alias("best_pct"), decimal_to_pct(F.min("return_decimal")).alias("worst_pct"),
    )


def ranked_event_returns(returns: DataFrame) -> DataFrame:
    """Tickers ranked within each event and window."""
    # written first: the ranking reads its rows twice, once for the cuts
    ranked = row_numbers(checkpointed(returns), [F.col("return_decimal").desc_nulls_last(), F.col("ticker")], [KEY, "event_date", "pre"])
    return ranked.withColumn("window_return_pct", decimal_to_pct(F.col("return_decimal"))).drop("return_decimal")


def changes_in_price_coverage(rates: DataFrame, cover: DataFrame) -> DataFrame:
    """Days of rate changes that prices cover."""
    moves = rates.where(F.col("change_bp") != 0)
    return in_coverage(moves, cover, "effective_date").select(KEY, F.col("effective_date").alias("event_date"), "change_bp")


def rate_calendar(rates: DataFrame) -> DataFrame:
    """The level of each series on every calendar day from its first to its last decision."""
    series = Window.partitionBy("series_key").orderBy("effective_date")
    until = F.coalesce(F.date_sub(F.lead("effective_date").over(series), 1), F.col("effective_date"))
    spans = rates.withColumn("_until", until)
    return spans.select(
        F.col(KEY).alias("_key"), F.explode(F.sequence("effective_date", "_until")).alias("_day"), "effective_date",
        bp_to_pct(F.col("target_bp")).alias("target_pct"), bp_to_pct(F.col("change_bp")).alias("change_pct"),
    )


def rate_in_force(rows: DataFrame, rates: DataFrame, date: str) -> DataFrame:
    """Each row with the level on its date; outside the decisions' span there is none.

    Rows with a ``series_key`` get the level of that series, other rows one
    answer for each series.  The calendar has one row per series and day.
    """
    calendar = rate_calendar(rates)
    rows = rows if KEY in rows.columns else per_series(rows, rates)
    out = rows.join(calendar, (rows[KEY] == calendar["_key"]) & (rows[date] == calendar["_day"]), "left").drop("_key", "_day")
    return out.withColumn("status", F.when(F.col("effective_date").isNull(), DATE_OUTSIDE_COVERAGE).otherwise(OK))


def literal_queries(spark, queries: Sequence[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("query")) for i, q in enumerate(queries)])
    return spark.range(1).select(F.inline(items))


def news_rate_context(
    articles: DataFrame, index: tx.TextIndex, rates: DataFrame, queries: Sequence[str], limit: int | None = None,
    start: str | None = None, end: str | None = None, excerpt: int = 600, phrases: PhraseIndex | None = None,
) -> DataFrame:
    """BM25 articles per query, whole-word matches for queries without any, and the rate on each day.

    With an index of places the matches come from its postings, else from the texts of the window.
    """
    asked = literal_queries(articles.sparkSession, queries)
    # a few rows per query, read twice below
    ranked = checkpointed(tx.retrieve(articles, index, asked, limit, start, end, excerpt))
    columns = ["query_id", "rank", "article_id", "headline", "subhead", tx.DAY, "excerpt", "score"]
    found = ranked.select(*columns)
    # no more rows than queries were given; without a miss no article is read again
    hit = {r["query_id"] for r in ranked.select("query_id").distinct().collect()}
    missed = [(i, q) for i, q in enumerate(queries) if i not in hit]
    if not missed:
        return rate_in_force(found, rates, tx.DAY).join(asked, "query_id")
    if phrases is not None:
        # a query may be asked twice
        held = phrase_search(articles, phrases, [q for _, q in missed], limit, start, end, excerpt)
        held = held.join(asked.where(F.col("query_id").isin([i for i, _ in missed])), held["pattern"] == asked["query"]).withColumn("score", F.lit(None).cast("double"))
        return rate_in_force(found.unionByName(held.select(*columns)), rates, tx.DAY).join(asked, "query_id")
    rows = tx.in_dates(articles, start, end)
    tests = F.array(*[F.struct(F.lit(i).alias("query_id"), F.col("_text").rlike(literal_regex(q)).alias("hit")) for i, q in missed])
    literal = (
        rows.withColumn("_text", tx.all_text(articles)).select("*", F.inline(F.filter(tests, lambda t: t["hit"])))
        .withColumn("excerpt", F.substring(F.coalesce("text", F.lit("")), 1, excerpt)).withColumn("score", F.lit(None).cast("double"))
    )
    place = Window.partitionBy("query_id").orderBy(tx.DAY, "headline", "article_id")
    fallback = literal.withColumn("rank", F.row_number().over(place).cast("bigint"))
    if limit is not None:
        fallback = fallback.where(F.col("rank") <= limit)
    found = found.unionByName(fallback.select(*columns))
    return rate_in_force(found, rates, tx.DAY).join(asked, "query_id")


def article_lookup(asked: DataFrame, articles: DataFrame, rates: DataFrame) -> DataFrame:
    """Articles by exact ``(headline, publication_date)`` with the rate in force; unknown ones keep NULLs."""
    found = articles.groupBy("headline", tx.DAY).agg(F.min("article_id").alias("article_id"))
    return rate_in_force(asked.join(found, ["headline", tx.DAY], "left"), rates, tx.DAY)


def rate_on_peak_day(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """The level on the day each ticker closed highest."""
    return rate_in_force(px.price_extreme(prices, "close", "highest", 1), rates, "date")


def rate_around_worst_day(bars: DataFrame, rates: DataFrame, ahead: int = 2) -> DataFrame:
    """The level of each series on each ticker's worst day and the first decision in the days after it."""
    worst = rate_in_force(px.biggest_move(bars, "decline", 1), rates, "date")
    # each decision answers the days up to ``ahead`` before it: few rows per calendar day
    near = rates.select(
        F.col(KEY).alias("_key"), F.explode(F.sequence(F.date_sub("effective_date", ahead), F.col("effective_date"))).alias("day"), F.col("effective_date").alias("next_decision"), "target_bp"
    ).groupBy("_key", "day").agg(F.min("next_decision").alias("next_decision"), F.min_by("target_bp", "next_decision").alias("next_bp"))
    on = (worst[KEY] == near["_key"]) & (worst["date"] == near["day"])
    return worst.join(near, on, "left").drop("_key", "day").withColumn("next_target_pct", bp_to_pct(F.col("next_bp"))).drop("next_bp")


def decisions_in_peak_month(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """Decisions of each series in the calendar month of each ticker's peak volume."""
    peaks = px.price_extreme(prices, "volume", "highest", 1).select("ticker", "date", F.col("value").alias("volume"), F.trunc("date", "month").alias("month"))
    monthly = rates.groupBy(KEY, F.trunc("effective_date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("change_bp") != 0).alias("changes"), F.sum("change_bp").alias("net_bp")
    )
    joined = per_series(peaks, rates).join(monthly, [KEY, "month"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("decisions", "changes")})


def articles_in_low_month(articles: DataFrame, rates: DataFrame) -> DataFrame:
    """How many articles appeared in the month a series first reached its lowest level."""
    low = rt.rate_extreme(rates, "lowest").select("series_key", "target_pct", "first_effective_date", F.trunc("first_effective_date", "month").alias("month"))
    monthly = articles.groupBy(F.trunc(tx.DAY, "month").alias("month")).agg(F.count(F.lit(1)).alias("article_count"))
    return low.join(monthly, "month", "left").withColumn("article_count", F.coalesce("article_count", F.lit(0)))


def year_summary(
    rates: DataFrame, articles: DataFrame, bars: DataFrame, pattern: str, windows: Sequence[tuple[str, str, str]], exclude: Sequence[str] = ()
) -> DataFrame:
    """Rate changes of each series, articles with a pattern and the held basket, per year."""
    moves = rt.change_summary(rates, by=[KEY, F.year("effective_date").cast("string").alias("label")]).select(
        KEY, "label", "changed_count", "increases", "decreases", "rate_before_pct", "rate_after_pct"
    )
    counts = tx.pattern_by_year(articles, [pattern]).select(F.col("year").cast("string").alias("label"), "pattern", "article_count")
    basket = px.basket_held(bars, windows, exclude=exclude).select("label", "return_pct", "member_count")
    return per_series(basket, rates).join(moves, [KEY, "label"], "left").join(counts, "label", "left")


def basket_after_events(events: DataFrame, bars: DataFrame, days: int = 7, alignment: str = "nearest") -> DataFrame:
    """Mean return of all tickers from each event day of a series to some days later.

    ``events(series_key, event_date)``; the two ends of a ticker's window meet in one
    aggregate per ticker and event.
    """
    both = F.array(
        F.struct(F.col("event_date").alias("day"), F.lit(True).alias("opens")),
        F.struct(F.date_add("event_date", days).alias("day"), F.lit(False).alias("opens")),
    )
    # two rows per series and event day, read by several branches below
    ends = checkpointed(events.select(KEY, "event_date").distinct().select(KEY, "event_date", F.inline(both)))
    lo, hi = _span(ends, "day")
    caught = aligned_days(bars.select("ticker", "date", "close"), lo, hi, alignment)
    pairs = caught.join(ends, "day").groupBy(KEY, "event_date", "ticker").agg(
        F.max(F.when(F.col("opens"), F.col("close"))).alias("a"), F.max(F.when(~F.col("opens"), F.col("close"))).alias("b")
    )
    return pairs.groupBy(KEY, "event_date").agg(
        decimal_to_pct(F.avg(ratio(F.col("b"), F.col("a")) - 1)).alias("return_pct"), F.count("b").alias("member_count")
    )


def annual_count_and_rank(
    articles: DataFrame, bars: DataFrame, pattern: str, ticker: str, windows: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """Per year: articles with a pattern, and one ticker's return and rank."""
    counts = tx.pattern_by_year(articles, [pattern]).select(F.col("year").cast("string").alias("label"), "article_count")
    returns = px.window_returns(bars, windows).where(F.col("status") == OK)
    own = returns.where(F.col("ticker") == ticker).select("label", F.col("return_decimal").alias("own"))
    # one own return per window rides along and only better ones are counted
    ahead = (F.col("return_decimal") > F.col("own")) | ((F.col("return_decimal") == F.col("own")) & (F.col("ticker") < ticker))
    ranked = returns.join(own, "label").groupBy("label").agg(
        (F.count_if(ahead) + 1).alias("rank"), decimal_to_pct(F.max("own")).alias("return_pct")
    )
    return ranked.join(counts, "label", "left").withColumn("ticker", F.lit(ticker))


def supported_windows(coverages: Sequence[DataFrame], windows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Whether all datasets cover each literal window, and which ones do not."""
    items = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(s).cast("date").alias("start"), F.lit(e).cast("date").alias("end")) for n, s, e in windows])
    rows = None
    for cover in coverages:
        one = cover.select("dataset", F.col("start").alias("_s"), F.col("end").alias("_e"), F.inline(items))
        rows = one if rows is None else rows.unionByName(one)
    covers = (F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end"))
    return rows.groupBy("label", "start", "end").agg(
        F.min(covers).alias("supported"),
        F.array_join(F.array_sort(F.collect_list(F.when(~covers, F.col("dataset")))), ", ").alias("missing"),
    )
