"""Invariants as frames of violations, and the evidence that goes with a result.

Each check takes operator results and returns the rows that break a rule, so an
empty frame is a pass.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finframe.operators.align import INVARIANT_FAILED


def violations(df: DataFrame, rule: str, broken: Column) -> DataFrame:
    return df.where(broken).withColumn("rule", F.lit(rule)).withColumn("status", F.lit(INVARIANT_FAILED))


def summary_reconciles(summary: DataFrame) -> DataFrame:
    """The sum of changes is the net move of the level, and the counts add up."""
    gap = F.abs(F.col("rate_before_pct") + F.col("cumulative_pct") - F.col("rate_after_pct"))
    counts = F.col("increases") + F.col("decreases") + F.col("holds") != F.col("record_count")
    return violations(summary, "changes add up to the net move", (gap > 1e-9) | counts)


def cycles_reconcile(cycles: DataFrame) -> DataFrame:
    """A cycle's moves lead from the level before to the level after, in its own direction."""
    moved = F.col("before_bp") + F.col("cumulative_bp") != F.col("after_bp")
    sign = F.when(F.col("direction") == "tightening", F.col("cumulative_bp") > 0).otherwise(F.col("cumulative_bp") < 0)
    return violations(cycles, "a cycle moves in its direction by its sum", moved | ~sign)


def gaps_match_dates(holds: DataFrame) -> DataFrame:
    return violations(holds, "gap days are the date difference", F.col("gap_days") != F.datediff("end_date", "start_date"))


def returns_match_prices(returns: DataFrame) -> DataFrame:
    """Start closes are positive and a return has the sign of its price move."""
    sign = F.signum("return_decimal") != F.signum(F.col("end_close") - F.col("start_close"))
    return violations(returns, "a return has the sign of its move", (F.col("start_close") <= 0) | sign)


def drawdowns_ordered(drawdowns: DataFrame) -> DataFrame:
    wrong = (F.col("max_drawdown_pct") > 0) | (F.col("trough_date") < F.col("peak_date"))
    return violations(drawdowns, "a fall is not positive and ends after its peak", wrong)


def counts_within_window(counts: DataFrame) -> DataFrame:
    wrong = (F.col("article_count") < 0) | (F.col("article_count") > F.col("articles_in_window"))
    return violations(counts, "a pattern matches at most the articles of its window", wrong)


def buckets_within_total(buckets: DataFrame) -> DataFrame:
    """Shown buckets together hold no more than the total that travels with them."""
    sums = buckets.groupBy("total").agg(F.sum("article_count").alias("shown"))
    return violations(sums, "buckets stay within the total", F.col("shown") > F.col("total"))


def with_evidence(df: DataFrame, dataset: str, method: str, records_used: Column, start: Column, end: Column, notes: Mapping[str, str] | None = None) -> DataFrame:
    """Adds what a result rests on: dataset, method, rows used, days covered, notes."""
    items = [x for k, v in (notes or {}).items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn(
        "evidence",
        F.struct(
            F.lit(dataset).alias("dataset"), F.lit(method).alias("method"), records_used.cast("bigint").alias("records_used"),
            F.concat(start.cast("string"), F.lit(" to "), end.cast("string")).alias("coverage"),
            (F.create_map(*items) if items else F.create_map().cast("map<string,string>")).alias("notes"),
        ),
    )
