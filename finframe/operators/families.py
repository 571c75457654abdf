"""More question families, each over every series, ticker or article period."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finframe.functions.scalars import bp_to_pct, dollars, grouped_int, signed_pct
from finframe.operators import prices as px
from finframe.operators import rates as rt
from finframe.operators import text as tx
from finframe.operators.align import OK
from finframe.operators.corpus import (
    EXTRAPOLATION, UNANSWERABLE, article_cases, build_records, cases, event_cases, extrapolation_cases, grid, level, price_cases, rate_cases,
    return_cases, said, unanswerable_price_cases, unsupported_span_cases, year_cases,
)

KEY = F.col


def cycle_cases(rates: DataFrame) -> DataFrame:
    """The largest run of rises and of falls of each series."""
    out = []
    for direction, word in (("tightening", "rises"), ("easing", "falls")):
        rows = rt.rate_cycle(rates, direction)
        out.append(cases(
            rows, said(f"FF-RATE-cycle-{direction}-", KEY("series_key")), said(f"What was the largest run of {word} of ", KEY("series_key"), "?"),
            [said(KEY("move_count"), f" {word} from ", KEY("start_date"), " to ", KEY("end_date"), "."), said("It led from ", level("rate_before_pct"), " to ", level("rate_after_pct"), ".")],
            ["rates"], "rate_cycle", "medium",
        ))
    return reduce(DataFrame.unionByName, out)


def comparison_cases(rates: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Net moves of two periods."""
    rows = rt.period_comparison(rates, first, second).withColumns({t: bp_to_pct(F.col(f"{t}_move_bp")) for t in ("a", "b")})
    return cases(
        rows, said("FF-RATE-compare-", KEY("series_key")), said("Compare the moves of ", KEY("series_key"), f" from {first[0]} to {first[1]} and from {second[0]} to {second[1]}."),
        [said("It moved by ", signed_pct(F.col("a")), " in ", KEY("a_decisions"), " decisions and by ", signed_pct(F.col("b")), " in ", KEY("b_decisions"), ".")],
        ["rates"], "period_comparison", "medium",
    )


def rate_at_cases(rates: DataFrame, days: Sequence[str], category: str = "answerable") -> DataFrame:
    """The level in force on given days; the unanswerable ones are those outside the decisions' span, run for real."""
    asked = grid(rates.select("series_key").distinct(), {"date": days}).withColumn("date", F.col("date").cast("date"))
    found = rt.rate_at(asked, rates)
    if category == UNANSWERABLE:
        span = rates.groupBy("series_key").agg(F.min("effective_date").alias("s"), F.max("effective_date").alias("e"))
        rows = found.where(F.col("status") != OK).join(span, "series_key")
        fact = said("No. The decisions on ", KEY("series_key"), " run from ", KEY("s"), " to ", KEY("e"), ".")
        prefix = "FF-UNANS-rate-"
    else:
        rows, prefix = found.where(F.col("status") == OK), "FF-RATE-at-"
        fact = said("The level was ", level("target_pct"), ", in force since ", KEY("effective_date"), ".")
    return cases(rows, said(prefix, KEY("series_key"), "-", KEY("date")), said("What was the level of ", KEY("series_key"), " on ", KEY("date"), "?"), [fact], ["rates"], "rate_at", "easy", category)


def move_cases(bars: DataFrame) -> DataFrame:
    """The largest one-day gain and decline of each ticker."""
    out = []
    for direction in ("gain", "decline"):
        out.append(cases(
            px.biggest_move(bars, direction), said(f"FF-PRICE-{direction}-", KEY("ticker")), said(f"What was the largest one-day {direction} of ", KEY("ticker"), "?"),
            [said(signed_pct(F.round("pct_change", 2)), " on ", KEY("date"), ", from ", dollars(KEY("previous_close")), " to ", dollars(KEY("close")), ".")], ["prices"], "biggest_move",
        ))
    return reduce(DataFrame.unionByName, out)


def rank_cases(bars: DataFrame, windows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The place of every ticker among the returns of each window."""
    rows = px.rank_returns(bars, windows)
    return cases(
        rows, said("FF-PRICE-rank-", KEY("label"), "-", KEY("ticker")), said("What place did ", KEY("ticker"), " take by return in ", KEY("label"), "?"),
        [said("Place ", KEY("rank"), ", with ", signed_pct(F.round("return_pct", 2)), ".")], ["prices"], "rank_returns", "hard",
    )


def volume_rank_cases(bars: DataFrame) -> DataFrame:
    rows = px.volume_rank(bars)
    return cases(
        rows, said("FF-PRICE-traded-", KEY("ticker")), said("What place does ", KEY("ticker"), " take by total volume?"),
        [said("Place ", KEY("rank"), ", with ", grouped_int(KEY("total_volume")), " over ", KEY("trading_days"), " days.")], ["prices"], "volume_rank", "medium",
    )


def event_window_cases(bars: DataFrame, days: Sequence[str], size: int = 3) -> DataFrame:
    """The return of every ticker around given days."""
    events = grid(bars.select("ticker").distinct(), {"event_date": days}).withColumn("event_date", F.col("event_date").cast("date"))
    rows = px.event_window(events, bars, [(size, size)]).where((F.col("status") == OK) & ~F.col("truncated"))
    return cases(
        rows, said("FF-PRICE-window-", KEY("ticker"), "-", KEY("event_date")), said("What did ", KEY("ticker"), f" return over {size} trading days each way of ", KEY("event_date"), "?"),
        [said(signed_pct(F.round("window_return_pct", 2)), ", from ", KEY("window_start_date"), " to ", KEY("window_end_date"), ".")], ["prices"], "event_window", "medium",
    )


def basket_cases(bars: DataFrame, windows: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = px.basket_held(bars, windows)
    return cases(
        rows, said("FF-PRICE-basket-", KEY("label")), said("What did an equal basket of all tickers return in ", KEY("label"), "?"),
        [said(signed_pct(F.round("return_pct", 2)), " over ", KEY("member_count"), " members.")], ["prices"], "basket_held", "medium",
    )


def average_cases(bars: DataFrame) -> DataFrame:
    rows = px.summary_stat(bars)
    return cases(
        rows, said("FF-PRICE-average-", KEY("ticker")), said("What is the average close of ", KEY("ticker"), "?"),
        [said(dollars(KEY("value")), " over ", KEY("trading_days"), " days, place ", KEY("rank"), ".")], ["prices"], "summary_stat",
    )


def date_count_cases(articles: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """How many articles mention a pattern in all, and the month that has most of them."""
    out = []
    for pattern in patterns:
        total, top = tx.date_count(articles, pattern=pattern), tx.busiest_periods(articles, pattern)
        rows = top.withColumns({c: total.select(c).scalar() for c in ("article_count", "earliest", "latest")})
        out.append(cases(
            rows, said(f"FF-TEXT-dates-{pattern}"), said(f'How many articles mention "{pattern}", and when most?'),
            [said(grouped_int(KEY("article_count")), " from ", KEY("earliest"), " to ", KEY("latest"), "."), said("Most in the month of ", KEY("month"), ", with ", grouped_int(KEY("month_count")), ".")],
            ["articles"], "date_count", "medium",
        ))
    return reduce(DataFrame.unionByName, out)


def retrieve_cases(articles: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The first article that mentions a pattern."""
    out = []
    for pattern in patterns:
        rows = tx.exact_search(articles, pattern, 1)
        out.append(cases(
            rows, said(f"FF-TEXT-first-{pattern}"), said(f'Which article was the first to mention "{pattern}"?'),
            [said("Article ", KEY("article_id"), " of ", KEY(tx.DAY), ".")], ["articles"], "retrieve",
        ))
    return reduce(DataFrame.unionByName, out)


def unanswerable_article_cases(articles: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Patterns asked for in earnest that no article holds."""
    counted = tx.pattern_count(articles, patterns).where(F.col("article_count") == 0)
    return cases(
        counted, said("FF-UNANS-article-", F.regexp_replace("pattern", " ", "_")), said("What do the articles say about ", KEY("pattern"), "?"),
        [said("Nothing. None of ", grouped_int(KEY("articles_in_window")), " articles mentions it.")], ["articles"], "retrieve", "medium", UNANSWERABLE,
    )


def unanswerable_event_cases(rates: DataFrame, bars: DataFrame) -> DataFrame:
    """Rate changes on days that prices do not cover."""
    span = bars.agg(F.min("date").alias("s"), F.max("date").alias("e"))
    rows = rates.where(F.col("change_bp") != 0).withColumns({c: span.select(c).scalar() for c in ("s", "e")})
    rows = rows.where(~F.col("effective_date").between(F.col("s"), F.col("e")))
    return cases(
        rows, said("FF-UNANS-event-", KEY("series_key"), "-", KEY("effective_date")),
        said("How did prices react to the change of ", KEY("series_key"), " on ", KEY("effective_date"), "?"),
        [said("The data cannot tell. Prices run from ", KEY("s"), " to ", KEY("e"), ".")], ["rates", "prices"], "event_market_returns", "hard", UNANSWERABLE,
    )


def news_cases(context: DataFrame) -> DataFrame:
    """The best article of each query and the level of each series on its day; ``context`` comes from ``news_rate_context``."""
    rows = context.where((F.col("rank") == 1) & (F.col("status") == OK))
    return cases(
        rows, said("FF-CROSS-news-", F.regexp_replace("query", " ", "_"), "-", KEY("series_key")),
        said('Which article fits "', KEY("query"), '" best, and what was the level of ', KEY("series_key"), " on its day?"),
        [said("Article ", KEY("article_id"), " of ", KEY(tx.DAY), "."), said("The level was ", level("target_pct"), ".")], ["articles", "rates"], "news_rate_context", "hard",
    )


def next_decision_cases(rates: DataFrame) -> DataFrame:
    """Whether the next decision will be a rise: only the record so far can be told."""
    by_day = Window.partitionBy("series_key").orderBy(F.col("effective_date").desc())
    last = rates.where(F.col("change_bp") != 0).withColumn("_r", F.row_number().over(by_day)).where("_r = 1")
    word = F.when(F.col("change_bp") > 0, "rise").otherwise("fall")
    return cases(
        last, said("FF-EXTRAP-next-", KEY("series_key")), said("Will the next decision on ", KEY("series_key"), " be a rise?"),
        [said("The data cannot tell. The last change was a ", word, " to ", F.format_string("%.2f", KEY("target_bp") / 100.0), "% on ", KEY("effective_date"), ".")],
        ["rates"], "change_summary", "hard", EXTRAPOLATION,
    )


def trend_cases(bars: DataFrame, year: str) -> DataFrame:
    """Where a ticker will stand in a later year, if its whole-sample trend went on."""
    rows = px.total_return(bars).withColumn("pct", F.round(F.col("return_decimal") * 100, 2))
    return cases(
        rows, said(f"FF-EXTRAP-trend-{year}-", KEY("ticker")), said("Will ", KEY("ticker"), f" stand higher in {year}?"),
        [said("The data cannot tell. It returned ", signed_pct(KEY("pct")), " from ", KEY("first_date"), " to ", KEY("last_date"), ".")], ["prices"], "total_return", "hard", EXTRAPOLATION,
    )


RECORD_VERSION = "1"


def full_records(records: DataFrame) -> DataFrame:
    """Records with how they were made and how they are graded, next to question and answer."""
    steps = F.array(F.struct(F.col("question_type").alias("operation"), F.col("datasets"), F.size("required_facts").cast("bigint").alias("facts")))
    grading = F.struct(F.col("components"), F.lit("Numbers may differ by rounding; dates must agree.").alias("tolerance_note"))
    return records.select(
        F.lit(RECORD_VERSION).alias("schema_version"), "id", "template_family", "question_type", "category", "difficulty", "datasets", "dataset_scope", "prompt", "answer",
        F.col("answer").alias("reference_answer"), "required_facts", F.size("required_facts").cast("bigint").alias("steps"), steps.alias("tool_trace"),
        F.concat(F.lit("computed by "), "question_type", F.lit(" over "), F.array_join("datasets", ", ")).alias("derivation_methodology"),
        F.lit("operators").alias("generation_method"), F.lit("verified").alias("verification_status"), grading.alias("grading"),
    )


@dataclass(frozen=True)
class Grid:
    """The parameters over which the families ask."""

    windows: Sequence[tuple[str, str, str]]  # of returns, ranks and baskets
    rate_window: tuple[str, str, str]
    periods: tuple[tuple[str, str], tuple[str, str]]  # compared with one another
    rate_days: Sequence[str]  # asked for a level, inside the decisions' span or not
    events: Sequence[str]
    patterns: Sequence[str]  # counted in articles
    terms: Sequence[str]  # dated, and looked up first
    absent: Sequence[str]  # asked where no article may hold them
    future: Sequence[str]
    unknown: Sequence[str]  # tickers
    spans: Sequence[tuple[str, str, str]]  # all datasets are asked to support


def every_family(
    rates: DataFrame, bars: DataFrame, articles: DataFrame, moved_rates: DataFrame, returns: DataFrame, summary: DataFrame, context: DataFrame,
    covers: Sequence[DataFrame], asked: Grid,
) -> DataFrame:
    """One corpus over all families: single datasets, crossed ones, unanswerable and future questions.

    ``returns``, ``summary`` and ``context`` are results of the operators on
    several datasets; ``moved_rates`` are the decisions that meet the prices.
    Ids tell the families apart, so no id comes twice.
    """
    families = [
        rate_cases(rates, [asked.rate_window]), cycle_cases(rates), comparison_cases(rates, *asked.periods), rate_at_cases(rates, asked.rate_days),
        return_cases(bars, asked.windows), price_cases(bars), move_cases(bars), rank_cases(bars, asked.windows), volume_rank_cases(bars),
        event_window_cases(bars, asked.events), basket_cases(bars, asked.windows), average_cases(bars),
        article_cases(articles, asked.patterns), date_count_cases(articles, asked.terms), retrieve_cases(articles, asked.terms),
        event_cases(returns), year_cases(summary), news_cases(context),
        rate_at_cases(rates, asked.rate_days, "unanswerable"), unanswerable_price_cases(bars, asked.future[:1], asked.unknown),
        unanswerable_article_cases(articles, asked.absent), unanswerable_event_cases(moved_rates, bars), unsupported_span_cases(covers, asked.spans),
        extrapolation_cases(bars, rates, asked.future), next_decision_cases(rates), trend_cases(bars, "2040"),
    ]
    return build_records(reduce(DataFrame.unionByName, families))
