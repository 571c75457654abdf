"""Exact order statistics and other aggregates of any window of a series, from an index that is written once.

The values of a key are numbered by size, and the numbers are read in four
steps of four bits.  A step holds, for each row of a node (the rows whose
numbers agree so far, in the order of days), how many rows up to it go on with
each of the sixteen digits or a lower one.  The k-th value of a window is found by looking up
the two ends of the window at each step: equality joins with one row on the
index's side, so requests for a hot key spread like all others, and no window
is ever gathered.

A key has at most 2**16 days, as in ``windows``; what is sorted is one key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.functions.scalars import round4
from finframe.operators import windows
from finframe.operators.align import OK, UNKNOWN_TICKER
from finframe.operators.ordering import row_numbers
from finframe.session import checkpointed

BITS, STEPS = 4, 4
DIGITS = 1 << BITS
AGGREGATES = ("avg", "min", "max", "median", "stddev", "sum")


@dataclass(frozen=True)
class RankIndex:
    """Written tables: rows up to each calendar day, counts by digit at each step, and the values by their number."""

    days: DataFrame  # <key>, _day, _upto
    steps: tuple[DataFrame, ...]  # <key>, _node, _upto, _counts
    values: DataFrame  # <key>, _rank, _value
    key: str


def rank_index(series: DataFrame, value: str, key: str = "ticker", date: str = "date") -> RankIndex:
    """The index of one column; NULLs have no place in it, and equal values share a number."""
    rows = series.select(key, F.unix_date(date).alias("_day"), F.col(value).alias("_value")).where("_day IS NOT NULL")
    along = Window.partitionBy(key).orderBy("_day")
    counted = rows.groupBy(key, "_day").agg(F.count("_value").alias("_n"))
    spans = counted.select(key, "_day", F.sum("_n").over(along).cast("int").alias("_upto"), F.coalesce(F.lead("_day").over(along) - 1, "_day").alias("_last"))
    days = checkpointed(spans.select(key, "_upto", F.explode(F.sequence("_day", "_last")).alias("_day")))

    number = F.dense_rank().over(Window.partitionBy(key).orderBy("_value")) - 1
    many = F.raise_error(F.lit(f"a key has more than {DIGITS ** STEPS} values")).cast("int")
    placed = rows.where("_value IS NOT NULL").withColumn("_rank", number)
    placed = placed.withColumn("_rank", F.when(F.col("_rank") < DIGITS**STEPS, F.col("_rank")).otherwise(many))
    placed = checkpointed(placed.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy("_day", "_rank"))))

    steps = []
    for step in range(STEPS):
        below = BITS * (STEPS - step - 1)
        node, digit = F.shiftright("_rank", below + BITS), F.shiftright("_rank", below).bitwiseAND(F.lit(DIGITS - 1))
        inside = Window.partitionBy(key, "_node").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        counts = F.array(*[F.sum((F.col("_digit") <= d).cast("int")).over(inside).cast("int") for d in range(DIGITS)])
        at_node = placed.select(key, "_at", node.alias("_node"), digit.alias("_digit"))
        steps.append(checkpointed(at_node.select(key, "_node", F.row_number().over(inside).alias("_upto"), counts.alias("_counts"))))
    return RankIndex(days, tuple(steps), checkpointed(placed.select(key, "_rank", "_value").distinct()), key)


def order_statistics(asked: DataFrame, index: RankIndex) -> DataFrame:
    """``asked(<key>, _s, _e, _k)``, days within the span of their key: the value with ``_k`` values before it, as ``_value``.

    A window of ``_k`` values or fewer has no row.
    """
    key = index.key
    ends = index.days.select(key, F.col("_day").alias("_e"), F.col("_upto").alias("_r"))
    starts = index.days.select(key, (F.col("_day") + 1).alias("_s"), F.col("_upto").alias("_l"))
    rows = asked.join(ends, [key, "_e"]).join(starts, [key, "_s"], "left").withColumn("_l", F.coalesce("_l", F.lit(0)))
    rows = rows.where(F.col("_k") < F.col("_r") - F.col("_l")).withColumns({"_node": F.lit(0), "_left": F.col("_k").cast("int")})

    def upto(counts: str, digit: Column | int) -> Column:
        # no row stands for the place before the first, and no count for the digit before zero
        return F.coalesce(F.get(counts, digit if isinstance(digit, Column) else F.lit(digit)), F.lit(0))

    for step in index.steps:
        upper = step.select(key, "_node", F.col("_upto").alias("_r"), F.col("_counts").alias("_high"))
        lower = step.select(key, "_node", F.col("_upto").alias("_l"), F.col("_counts").alias("_low"))
        rows = rows.join(upper, [key, "_node", "_r"]).join(lower, [key, "_node", "_l"], "left")
        # the value's digit is the number of digits whose rows are all passed
        passed = [(upto("_high", d) - upto("_low", d) <= F.col("_left")).cast("int") for d in range(DIGITS)]
        rows = rows.withColumn("_digit", reduce(add, passed))
        at, before = F.col("_digit"), F.col("_digit") - 1
        # written, as a key of the next join that is worked out here would be worked out again in every filter on it
        rows = checkpointed(rows.select(
            key, "_s", "_e", "_k", (F.col("_node") * DIGITS + at).alias("_node"), (F.col("_left") - upto("_high", before) + upto("_low", before)).alias("_left"),
            (upto("_low", at) - upto("_low", before)).alias("_l"), (upto("_high", at) - upto("_high", before)).alias("_r")))
    return rows.withColumnRenamed("_node", "_rank").join(index.values, [key, "_rank"]).select(key, "_s", "_e", "_k", "_value")


def window_stats(
    requests: DataFrame, series: DataFrame, value: str, aggs: Sequence[str] = AGGREGATES, *, key: str = "ticker", date: str = "date", index: RankIndex | None = None,
) -> DataFrame:
    """The aggregates of a column in each request's window, with a status; NULLs count as rows but not as values.

    ``stddev`` is that of a population.  Sums, extremes and deviations are
    merged from blocks of days; the median takes the index, which is built
    unless it is given.
    """
    unknown = set(aggs) - set(AGGREGATES)
    if unknown:
        raise ValueError(f"aggregates are {', '.join(AGGREGATES)}")
    asked = checkpointed(windows.clamped(requests, series, key, date))
    rows = series.select(key, F.unix_date(date).alias("_day"), F.col(value).alias("_value"))
    squares = F.var_pop(F.col("_value").cast("double")) * F.count("_value")
    blocks = windows.in_blocks(rows).groupBy(key, "_level", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("_value").alias("_n"), F.min("_value").alias("_min"), F.max("_value").alias("_max"), F.sum("_value").alias("_sum"),
        squares.alias("_m2"))
    met = windows.pieces(asked, key).join(blocks, [key, "_level", "_block"])
    # at most two blocks of each size
    parts = F.collect_list(F.when(F.col("_n") > 0, F.struct("_n", (F.col("_sum").cast("double") / F.col("_n")).alias("mean"), "_m2")))
    total = blocks.schema["_sum"].dataType  # has room for any window; a wider decimal leaves its mean fewer digits
    merged = met.groupBy(key, "_s", "_e").agg(
        F.sum("_rows").alias("_rows"), F.sum("_n").alias("_n"), F.min("_min").alias("_min"), F.max("_max").alias("_max"), F.sum("_sum").cast(total).alias("_sum"), parts.alias("_parts"))
    # of decimals the mean has at least the digits that its rounding needs
    merged = merged.withColumn("_avg", F.try_divide(F.col("_sum"), F.col("_n")))
    spread = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["_m2"] + p["_n"] * F.pow(p["mean"] - F.col("_avg").cast("double"), F.lit(2.0)))
    found = {"avg": F.col("_avg"), "min": F.col("_min"), "max": F.col("_max"), "sum": F.col("_sum"), "stddev": F.sqrt(F.try_divide(spread, F.col("_n")))}
    one = merged.select(key, "_s", "_e", "_rows", "_n", *[found[a].alias(f"_a_{a}") for a in aggs if a != "median"])
    if "median" in aggs:
        one = checkpointed(one)
        middle = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
        places = one.where("_n > 0").select(key, "_s", "_e", F.explode(middle).alias("_k"))
        held = order_statistics(places, index or rank_index(series, value, key, date)).withColumn("_value", F.col("_value").cast("double"))
        half = held.groupBy(key, "_s", "_e").agg(((F.min("_value") + F.max("_value")) / 2).alias("_a_median"))
        one = one.join(half, [key, "_s", "_e"], "left")
    columns = [F.col(f"_a_{a}").alias(a) for a in aggs]
    return windows.answered(asked, one, key, [*columns, F.col("_n").alias("value_count"), F.col("_rows").alias("days")], requests.columns)


def stat_ranks(requests: DataFrame, prices: DataFrame, field: str = "close", agg: str = "avg") -> DataFrame:
    """``requests(request_id, start, end, tickers, compare_to)``: the asked tickers (all, where none is named) ranked by one statistic in each window.

    With ``compare_to``, each ranked ticker is flagged above or below that one;
    ``anchor_status`` says why there are no flags where it is not among the
    ranked.  Unknown tickers and those without values keep their row.
    """
    asked = windows.asked_tickers(requests, prices)
    out = window_stats(asked, prices.where(F.col(field).isNotNull()), field, [agg])
    out = checkpointed(out.withColumn("value", round4(F.col(agg).cast("double"))))
    ranked = row_numbers(out.where(F.col("status") == OK), [F.col("value").desc(), F.col("ticker")], ["request_id"])
    columns = ["request_id", "start", "end", "ticker", "rank", "value", "days", "status"]
    rest = out.where(F.col("status") != OK).withColumn("rank", F.lit(None).cast("bigint"))
    every = ranked.select(*columns).unionByName(rest.select(*columns))
    # one anchor for each request, at most
    anchors = requests.where(F.col("compare_to").isNotNull()).select("request_id", F.col("compare_to").alias("ticker")).join(
        out.select("request_id", "ticker", F.col("value").alias("anchor_value"), F.col("status").alias("_anchor")), ["request_id", "ticker"], "left")
    anchors = anchors.select("request_id", F.col("ticker").alias("compare_to"), "anchor_value", F.coalesce("_anchor", F.lit(UNKNOWN_TICKER)).alias("anchor_status"))
    flagged = every.join(anchors, "request_id", "left")
    return flagged.withColumn("above", F.col("value") > F.col("anchor_value")).withColumn("below", F.col("value") < F.col("anchor_value")).withColumnRenamed("days", "trading_days")
