"""Operators on level series: ``rates(series_key, effective_date, target_bp, change_bp)``.

Levels are whole basis points throughout; percent appears only in results.  A
series has one row per day, so a window over one series is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.functions.scalars import bp_to_pct, day_span
from finframe.operators.align import (
    DATE_OUTSIDE_COVERAGE,
    DATE_RANGE_INVALID,
    NO_MATCHING_RECORDS,
    OK,
    asof,
    asof_many,
)

KEY, DAY = "series_key", "effective_date"


def in_window(df: DataFrame, date: str, start: str | None, end: str | None) -> DataFrame:
    """Rows of a literal window; open where a bound is missing, empty where the bounds are inverted."""
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def rate_extreme(rates: DataFrame, direction: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Highest or lowest level per series: first and last day at it, and how many records."""
    rows = in_window(rates, DAY, start, end)
    # per (series, level) counts are small; the extreme level is then one max_by
    levels = rows.groupBy(KEY, "target_bp").agg(
        F.min(DAY).alias("first_date"), F.max(DAY).alias("last_date"), F.count(F.lit(1)).alias("record_count")
    )
    pick = F.max_by if direction == "highest" else F.min_by
    best = levels.groupBy(KEY).agg(
        pick(F.struct("target_bp", "first_date", "last_date", "record_count"), F.col("target_bp")).alias("b"),
        F.sum("record_count").alias("records_used"),
    )
    return best.select(
        KEY, F.lit(direction).alias("direction"), bp_to_pct(F.col("b.target_bp")).alias("target_pct"),
        F.col("b.first_date").alias("first_effective_date"), F.col("b.last_date").alias("last_effective_date"),
        F.col("b.record_count").alias("record_count"), "records_used",
    )


def rate_at(
    requests: DataFrame, rates: DataFrame, date: str = "date", resolution: str = "as_of", bound: str = "strict",
    row_id: Sequence[str] = (),
) -> DataFrame:
    """Level in force on each requested (series_key, date).

    ``bound='strict'`` refuses dates after the last decision, ``'lower'`` takes
    the last decision for them.
    """
    mode = "previous" if resolution == "as_of" else "exact"
    last_day = Window.partitionBy(KEY)
    series = rates.withColumn("_last", F.max(DAY).over(last_day)).select(
        KEY, F.col(DAY).alias("effective_date"), "target_bp", "change_bp", "_last"
    )
    out = asof(requests, series, [KEY], date, "effective_date", mode, row_id)
    late = (F.col(date) > F.col("_last")) if (bound == "strict" and mode == "previous") else F.lit(False)
    status = F.when(late, DATE_OUTSIDE_COVERAGE)
    if mode == "exact":
        status = status.when(F.col("status") == DATE_OUTSIDE_COVERAGE, NO_MATCHING_RECORDS)
    out = out.withColumn("status", status.otherwise(F.col("status")))
    good = F.col("status") == OK
    return out.select(
        *requests.columns,
        F.when(good, F.col("effective_date")).alias("effective_date"),
        F.when(good, bp_to_pct(F.col("target_bp"))).alias("target_pct"),
        F.when(good, bp_to_pct(F.col("change_bp"))).alias("change_pct"),
        "status",
    )


def _summary_columns() -> list[Column]:
    change = F.col("change_bp")
    return [
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(change != 0).alias("changed_count"),
        F.count_if(change > 0).alias("increases"),
        F.count_if(change < 0).alias("decreases"),
        F.count_if(change == 0).alias("holds"),
        F.sum(change).alias("cumulative_bp"),
        F.min_by(F.col("target_bp") - change, F.col(DAY)).alias("before_bp"),
        F.max_by(F.col("target_bp"), F.col(DAY)).alias("after_bp"),
        F.min(DAY).alias("window_start"),
        F.max(DAY).alias("window_end"),
    ]


def _in_percent(df: DataFrame) -> DataFrame:
    for source, name in (("cumulative_bp", "cumulative_pct"), ("before_bp", "rate_before_pct"), ("after_bp", "rate_after_pct")):
        df = df.withColumn(name, bp_to_pct(F.col(source))).drop(source)
    return df


def change_summary(
    rates: DataFrame, start: str | None = None, end: str | None = None, by: Sequence[Column | str] = (KEY,)
) -> DataFrame:
    """Record, change and hold counts and the net move, per series (or per ``by``) in one aggregate."""
    rows = in_window(rates, DAY, start, end)
    return _in_percent(rows.groupBy(*by).agg(*_summary_columns()))


def moves_in_period(rates: DataFrame, start: str, end: str) -> DataFrame:
    """Changes only: how many, up and down, and the net move."""
    moves = in_window(rates, DAY, start, end).where(F.col("change_bp") != 0)
    return moves.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("changes"), F.count_if(F.col("change_bp") > 0).alias("increases"),
        F.count_if(F.col("change_bp") < 0).alias("decreases"), bp_to_pct(F.sum("change_bp")).alias("net_pct"),
    )


def _events(rates: DataFrame, kind: str) -> DataFrame:
    change = F.col("change_bp")
    test = {"any_change": change != 0, "hike": change > 0, "cut": change < 0}[kind]
    return rates.where(test)


def longest_hold(rates: DataFrame, kind: str = "any_change", n: int | None = 1) -> DataFrame:
    """The n longest stretches between consecutive moves of a kind, per series; all of them without n."""
    series = Window.partitionBy(KEY).orderBy(DAY)
    gaps = (
        _events(rates, kind)
        .select(
            KEY, F.lag(DAY).over(series).alias("start_date"), F.col(DAY).alias("end_date"),
            bp_to_pct(F.lag("target_bp").over(series)).alias("rate_during_pct"),
            bp_to_pct(F.col("target_bp")).alias("rate_after_pct"),
        )
        .where(F.col("start_date").isNotNull())
        .withColumn("gap_days", day_span(F.col("start_date"), F.col("end_date")))
    )
    ranked = Window.partitionBy(KEY).orderBy(F.col("gap_days").desc(), "start_date")
    placed = gaps.withColumn("rank", F.row_number().over(ranked).cast("bigint"))
    return placed if n is None else placed.where(F.col("rank") <= n)


def rate_cycles(rates: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """All maximal runs of same-sign moves; holds do not break a run, a reversal does."""
    series = Window.partitionBy(KEY).orderBy(DAY)
    moves = in_window(rates, DAY, start, end).where(F.col("change_bp") != 0)
    turned = F.coalesce((F.signum("change_bp") != F.lag(F.signum("change_bp")).over(series)).cast("int"), F.lit(1))
    runs = moves.withColumn("_turn", turned).withColumn("run", F.sum("_turn").over(series))
    return runs.groupBy(KEY, "run").agg(
        F.when(F.max("change_bp") > 0, "tightening").otherwise("easing").alias("direction"),
        F.count(F.lit(1)).alias("move_count"),
        F.sum("change_bp").alias("cumulative_bp"),
        F.min(DAY).alias("start_date"),
        F.max(DAY).alias("end_date"),
        F.min_by(F.col("target_bp") - F.col("change_bp"), F.col(DAY)).alias("before_bp"),
        F.max_by("target_bp", F.col(DAY)).alias("after_bp"),
        day_span(F.min(DAY), F.max(DAY)).alias("duration_days"),
    )


def rate_cycle(
    rates: DataFrame, direction: str, select: str = "largest", start: str | None = None, end: str | None = None
) -> DataFrame:
    """One cycle per series: the largest by size, the one with most moves, or the latest."""
    runs = rate_cycles(rates, start, end).where(F.col("direction") == direction)
    # earlier runs win ties, so the second sort key falls as the run starts later
    earlier = -F.unix_date("start_date")
    order = {
        "largest": F.struct(F.abs("cumulative_bp"), earlier),
        "most_moves": F.struct(F.col("move_count"), earlier),
        "latest": F.struct(F.unix_date("start_date")),
    }[select]
    fields = ["move_count", "cumulative_bp", "start_date", "end_date", "before_bp", "after_bp", "duration_days"]
    best = runs.groupBy(KEY).agg(F.max_by(F.struct(*fields), order).alias("c"), F.count(F.lit(1)).alias("cycles_found"))
    return _in_percent(best.select(KEY, F.lit(direction).alias("direction"), "c.*", "cycles_found"))


def period_comparison(rates: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Opening, closing, move and decisions of two periods and the difference of their moves."""

    def inside(bounds: tuple[str, str]) -> Column:
        return F.col(DAY).between(F.lit(bounds[0]).cast("date"), F.lit(bounds[1]).cast("date"))

    aggs = []
    for tag, bounds in (("a", first), ("b", second)):
        test = inside(bounds)
        day = F.when(test, F.col(DAY))
        aggs += [
            F.min(day).alias(f"{tag}_start"),
            F.max(day).alias(f"{tag}_end"),
            F.min_by(F.col("target_bp") - F.col("change_bp"), day).alias(f"{tag}_open_bp"),
            F.max_by("target_bp", day).alias(f"{tag}_close_bp"),
            F.sum(F.when(test, F.col("change_bp"))).alias(f"{tag}_move_bp"),
            F.count_if(test).alias(f"{tag}_decisions"),
        ]
    out = rates.where(inside(first) | inside(second)).groupBy(KEY).agg(*aggs)
    return out.withColumn("difference_pct", bp_to_pct(F.col("b_move_bp") - F.col("a_move_bp")))


def compare_requested_periods(rates: DataFrame, requests: DataFrame) -> DataFrame:
    """Like ``period_comparison`` for a table of ``(request_id, series_key, a_start, a_end, b_start, b_end)``.

    Sums over a period are differences of running sums, so each request costs
    two as-of lookups per period instead of a range join.
    """
    series = Window.partitionBy(KEY).orderBy(DAY)
    running = rates.select(
        KEY, DAY, "target_bp", "change_bp",
        F.row_number().over(series).alias("rn"), F.sum("change_bp").over(series).alias("upto"),
    )
    ends = {"as_": "a_start", "ae_": "a_end", "bs_": "b_start", "be_": "b_end"}
    modes = {p: "next" if p[1] == "s" else "previous" for p in ends}
    out = asof_many(requests, running, [KEY], ends, DAY, modes, ["request_id"])
    for tag in ("a", "b"):
        valid = (F.col(f"{tag}s_status") == OK) & (F.col(f"{tag}e_status") == OK) & (F.col(f"{tag}s_rn") <= F.col(f"{tag}e_rn"))
        move = F.col(f"{tag}e_upto") - F.col(f"{tag}s_upto") + F.col(f"{tag}s_change_bp")
        out = (
            out.withColumn(f"{tag}_ok", valid)
            .withColumn(f"{tag}_open_bp", F.when(valid, F.col(f"{tag}s_target_bp") - F.col(f"{tag}s_change_bp")))
            .withColumn(f"{tag}_close_bp", F.when(valid, F.col(f"{tag}e_target_bp")))
            .withColumn(f"{tag}_move_bp", F.when(valid, move))
            .withColumn(f"{tag}_decisions", F.when(valid, F.col(f"{tag}e_rn") - F.col(f"{tag}s_rn") + 1).cast("bigint"))
        )
    status = (
        F.when((F.col("a_start") > F.col("a_end")) | (F.col("b_start") > F.col("b_end")), DATE_RANGE_INVALID)
        .when(F.col("a_ok") & F.col("b_ok"), OK)
        .otherwise(NO_MATCHING_RECORDS)
    )
    parts = [f"{t}_{c}" for t in ("a", "b") for c in ("open_bp", "close_bp", "move_bp", "decisions")]
    return out.select(
        *requests.columns, *parts, bp_to_pct(F.col("b_move_bp") - F.col("a_move_bp")).alias("difference_pct"),
        status.alias("status"),
    )


def levels_in_set(rates: DataFrame, levels_bp: Sequence[int]) -> DataFrame:
    return rates.where(F.col("target_bp").isin(*levels_bp)).groupBy(KEY).agg(F.count(F.lit(1)).alias("record_count"))


def moves_by_year(rates: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = in_window(rates, DAY, start, end)
    return rows.groupBy(KEY, F.year(DAY).cast("bigint").alias("year")).agg(
        F.count_if(F.col("change_bp") > 0).alias("increases"), F.count_if(F.col("change_bp") < 0).alias("decreases"),
        F.sum("change_bp").alias("net_bp"), F.max_by("target_bp", F.col(DAY)).alias("closing_bp"),
    )
