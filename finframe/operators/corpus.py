"""Grounded question-and-answer records from the operators' results.

A generator turns result rows into *cases* ``(id, category, difficulty,
datasets, question_type, prompt, facts)``; ``build_records`` turns cases into
records.  Grids are literal parameter lists exploded onto result rows, so a grid
grows with its entities and never pairs two tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finframe.functions.scalars import bp_to_pct, dollars, grouped_int, id_prefix, signed_pct
from finframe.operators import cross as cx
from finframe.operators import prices as px
from finframe.operators import rates as rt
from finframe.operators import text as tx
from finframe.operators.align import OK, asof

ANSWERABLE, UNANSWERABLE, EXTRAPOLATION = "answerable", "unanswerable", "extrapolation"


def said(*parts: Column | str) -> Column:
    """Text from literals and columns; NULL as soon as one column is NULL."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def level(column: str) -> Column:
    return F.concat(F.format_string("%.2f", F.col(column)), F.lit("%"))


def cases(
    rows: DataFrame, id: Column, prompt: Column, facts: Sequence[Column], datasets: Sequence[str], question_type: str,
    difficulty: str = "easy", category: str = ANSWERABLE,
) -> DataFrame:
    return rows.select(
        id.alias("id"), F.lit(category).alias("category"), F.lit(difficulty).alias("difficulty"),
        F.array(*[F.lit(d) for d in datasets]).alias("datasets"), F.lit(question_type).alias("question_type"),
        prompt.alias("prompt"), F.array(*facts).alias("facts"),
    )


def grid(entities: DataFrame, parameters: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Every entity with every combination of short literal lists."""
    return reduce(
        lambda df, item: df.withColumn(item[0], F.explode(F.array(*[F.lit(v) for v in item[1]]))), parameters.items(), entities
    )


def rate_cases(rates: DataFrame, windows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Extremes and change counts per window, and the longest stretch without a move, per series."""
    key = F.col("series_key")
    out = []
    for label, start, end in windows:
        for direction in ("highest", "lowest"):
            rows = rt.rate_extreme(rates, direction, start, end)
            out.append(cases(
                rows, said(f"FF-RATE-{direction}-{label}-", key),
                said(f"What was the {direction} level of ", key, f" from {start} to {end}, and when did it first apply?"),
                [said(f"The {direction} level was ", level("target_pct"), ", first on ", F.col("first_effective_date"), ", in ", F.col("record_count"), " records.")],
                ["rates"], "rate_extreme",
            ))
        rows = rt.change_summary(rates, start, end)
        out.append(cases(
            rows, said(f"FF-RATE-summary-{label}-", key), said("How often did ", key, f" change from {start} to {end}?"),
            [
                said(F.col("changed_count"), " of ", F.col("record_count"), " records changed it: ", F.col("increases"), " up and ", F.col("decreases"), " down."),
                said("It moved from ", level("rate_before_pct"), " to ", level("rate_after_pct"), "."),
            ],
            ["rates"], "change_summary", "medium",
        ))
    holds = rt.longest_hold(rates)
    out.append(cases(
        holds, said("FF-RATE-hold-", key), said("How long did ", key, " stay unchanged at most?"),
        [said(F.col("gap_days"), " days, from ", F.col("start_date"), " to ", F.col("end_date"), " at ", level("rate_during_pct"), ".")], ["rates"], "longest_hold", "medium",
    ))
    return reduce(DataFrame.unionByName, out)


def return_cases(bars: DataFrame, windows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Ticker by window returns; windows a ticker does not cover are left out."""
    rows = px.window_returns(bars, windows).where(F.col("status") == OK).withColumn("return_pct", F.round(F.col("return_decimal") * 100, 4))
    return cases(
        rows, said("FF-PRICE-return-", F.col("ticker"), "-", F.col("label")),
        said("What did ", F.col("ticker"), " return in ", F.col("label"), "?"),
        [
            said(F.col("ticker"), " returned ", signed_pct(F.round("return_pct", 2)), "."),
            said("It closed at ", dollars(F.col("start_close")), " on ", F.col("resolved_start"), " and at ", dollars(F.col("end_close")), " on ", F.col("resolved_end"), "."),
        ],
        ["prices"], "price_return",
    )


def price_cases(bars: DataFrame) -> DataFrame:
    """Extremes, best and worst days, and drawdowns per ticker."""
    out = []
    for direction in ("highest", "lowest"):
        rows = px.price_extreme(bars, "close", direction)
        out.append(cases(
            rows, said(f"FF-PRICE-{direction}-", F.col("ticker")), said("When did ", F.col("ticker"), f" close {direction}, and at what price?"),
            [said("Its ", f"{direction} close was ", dollars(F.col("value")), " on ", F.col("date"), ".")], ["prices"], "price_extreme",
        ))
    rows = px.price_extreme(bars, "volume", "highest")
    out.append(cases(
        rows, said("FF-PRICE-volume-", F.col("ticker")), said("On which day did ", F.col("ticker"), " trade most?"),
        [said("It traded ", grouped_int(F.col("value")), " on ", F.col("date"), ".")], ["prices"], "price_extreme",
    ))
    for basis in ("close", "intraday"):
        rows = px.max_drawdown(bars, basis)
        back = F.when(F.col("recovery_date").isNull(), F.lit("It did not recover.")).otherwise(said("It recovered on ", F.col("recovery_date"), "."))
        out.append(cases(
            rows, said(f"FF-PRICE-drawdown-{basis}-", F.col("ticker")), said("What was the deepest fall of ", F.col("ticker"), f" ({basis})?"),
            [said("It fell ", signed_pct(F.round("max_drawdown_pct", 2)), " from ", F.col("peak_date"), " to ", F.col("trough_date"), "."), back], ["prices"], "max_drawdown", "medium",
        ))
    return reduce(DataFrame.unionByName, out)


def article_cases(articles: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Pattern by year counts from one scan."""
    rows = tx.pattern_by_year(articles, patterns)
    return cases(
        rows, said("FF-TEXT-count-", F.regexp_replace("pattern", " ", "_"), "-", F.col("year")),
        said("How many articles of ", F.col("year"), " mention \"", F.col("pattern"), "\"?"),
        [said(grouped_int(F.col("article_count")), " of ", grouped_int(F.col("articles")), " articles mention it.")], ["articles"], "pattern_count",
    )


def event_cases(returns: DataFrame) -> DataFrame:
    """Best and worst ticker around every event and window size."""
    rows = cx.event_best_and_worst(returns)
    return cases(
        rows, said("FF-CROSS-event-", F.col("series_key"), "-", F.col("event_date"), "-", F.col("pre")),
        said("What was the level of ", F.col("series_key"), " on ", F.col("event_date"), ", and which tickers did best and worst over ", F.col("pre"), " trading days each way?"),
        [
            said("The level was ", level("target_pct"), "."),
            said(F.col("best"), " did best at ", signed_pct(F.round("best_pct", 2)), " and ", F.col("worst"), " worst at ", signed_pct(F.round("worst_pct", 2)), "."),
        ],
        ["rates", "prices"], "event_market_returns", "hard",
    )


def year_cases(summary: DataFrame) -> DataFrame:
    """Rates of a series, articles and basket of one year; years a dataset misses cannot be worded and are skipped."""
    return cases(
        summary, said("FF-CROSS-year-", F.col("series_key"), "-", F.col("label")),
        said("Sum up ", F.col("label"), " over the rates of ", F.col("series_key"), ", articles and prices."),
        [
            said(F.col("changed_count"), " changes (", F.col("increases"), " up, ", F.col("decreases"), " down) took the level from ", level("rate_before_pct"), " to ", level("rate_after_pct"), "."),
            said(grouped_int(F.col("article_count")), " articles mention \"", F.col("pattern"), "\"."),
            said("The basket returned ", signed_pct(F.round("return_pct", 2)), "."),
        ],
        ["rates", "articles", "prices"], "change_summary+pattern_count+basket_held", "hard",
    )


def unanswerable_price_cases(bars: DataFrame, days: Sequence[str], unknown: Sequence[str] = ()) -> DataFrame:
    """Closing prices asked for days and tickers the data lacks: run for real, kept where they fail."""
    names = bars.select("ticker").distinct()
    if unknown:
        extra = names.sparkSession.range(1).select(F.explode(F.array(*[F.lit(u) for u in unknown])).alias("ticker"))
        names = names.unionByName(extra)
    asked = grid(names, {"day": days}).withColumn("day", F.col("day").cast("date"))
    found = asof(asked, bars.select("ticker", "date", "close"), ["ticker"], "day", "date", "exact", ["ticker", "day"]).where(F.col("status") != OK)
    cover = bars.groupBy("ticker").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    rows = found.join(cover, "ticker", "left")
    fact = F.when(F.col("start").isNull(), said("No. ", F.col("ticker"), " is not in the price data.")).otherwise(
        said("No. ", F.col("ticker"), " has no bar on ", F.col("day"), "; its data runs from ", F.col("start"), " to ", F.col("end"), ".")
    )
    return cases(
        rows, said("FF-UNANS-price-", F.col("ticker"), "-", F.col("day")), said("What did ", F.col("ticker"), " close at on ", F.col("day"), "?"),
        [fact], ["prices"], "price_return", "easy", UNANSWERABLE,
    )


def unsupported_span_cases(coverages: Sequence[DataFrame], windows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Windows not all datasets cover, with the ones that miss it."""
    rows = cx.supported_windows(coverages, windows).where(~F.col("supported"))
    return cases(
        rows, said("FF-UNANS-span-", F.col("label")), said("Can all datasets support a study from ", F.col("start"), " to ", F.col("end"), "?"),
        [F.lit("No."), said("The window is not covered by: ", F.col("missing"), ".")], ["rates", "prices", "articles"], "coverage", "hard", UNANSWERABLE,
    )


def extrapolation_cases(bars: DataFrame, rates: DataFrame, days: Sequence[str]) -> DataFrame:
    """Questions about the future, answered with the last observation only."""
    last_bar = bars.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    asked = grid(last_bar, {"day": days})
    prices = cases(
        asked, said("FF-EXTRAP-price-", F.col("ticker"), "-", F.col("day")), said("What will ", F.col("ticker"), " close at on ", F.col("day"), "?"),
        [said("The data cannot tell. The last close of ", F.col("ticker"), " is ", dollars(F.col("close")), " on ", F.col("date"), ".")], ["prices"], "price_extreme", "medium", EXTRAPOLATION,
    )
    last_level = rates.groupBy("series_key").agg(F.max("effective_date").alias("date"), bp_to_pct(F.max_by("target_bp", "effective_date")).alias("target_pct"))
    asked = grid(last_level, {"day": days})
    levels = cases(
        asked, said("FF-EXTRAP-rate-", F.col("series_key"), "-", F.col("day")), said("What will the level of ", F.col("series_key"), " be on ", F.col("day"), "?"),
        [said("The data cannot tell. The last decision on record is ", F.col("date"), " at ", level("target_pct"), ".")], ["rates"], "rate_at", "medium", EXTRAPOLATION,
    )
    return prices.unionByName(levels)


def split_points(facts: Column, total: float = 10.0) -> Column:
    """Equal points per fact to two places, the remainder on the last."""
    n = F.size(facts)
    each = F.round(F.lit(total) / n, 2)

    def component(fact: Column, i: Column) -> Column:
        points = F.when(i + 1 < n, each).otherwise(F.round(total - F.round(each * (n - 1), 2), 2))
        return F.struct(F.format_string("C%02d", i + 1).alias("component_id"), fact.alias("expected_fact"), points.alias("points"))

    return F.transform(facts, component)


def build_records(found: DataFrame) -> DataFrame:
    """Cases as records; a case with a fact that could not be worded is left out, never guessed."""
    whole = ~F.exists("facts", lambda f: f.isNull()) & F.col("prompt").isNotNull() & F.col("id").isNotNull()
    return found.where(whole).select(
        "id", id_prefix(F.col("id")).alias("template_family"), "question_type", "category", "difficulty", "datasets",
        F.when(F.size("datasets") > 1, "cross").otherwise("single").alias("dataset_scope"), "prompt",
        F.array_join("facts", " ").alias("answer"), F.col("facts").alias("required_facts"), split_points(F.col("facts")).alias("components"),
    )


def unrendered(found: DataFrame) -> DataFrame:
    """How many cases per question type could not be worded."""
    missing = F.exists("facts", lambda f: f.isNull())
    return found.groupBy("question_type").agg(F.count_if(missing).alias("skipped"), F.count(F.lit(1)).alias("cases"))


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Ids used more than once; must be empty before a corpus is written."""
    return records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def corpus_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("category", "difficulty", "dataset_scope").agg(F.count(F.lit(1)).alias("n"))


def evaluation_set(
    rates: DataFrame, bars: DataFrame, articles: DataFrame, patterns: Sequence[str], windows: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """One corpus over every single-dataset family, with unanswerable and future questions."""
    families = [
        rate_cases(rates, windows[:1]),
        return_cases(bars, windows),
        price_cases(bars),
        article_cases(articles, patterns),
        extrapolation_cases(bars, rates, ["2035-01-01"]),
        unanswerable_price_cases(bars, ["2035-01-01"], ["nobody"]),
    ]
    return build_records(reduce(DataFrame.unionByName, families))
