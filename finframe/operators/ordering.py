"""Ordered operators for groups of any size.

A plain window sorts one whole group in one task.  That is fine where the group
is bounded (a ticker has at most one bar per calendar day) and wrong where it is
not.  Here a group is first cut into sorted ranges, and only one summary row per
range crosses the cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.session import checkpointed

_POS, _PID = "_pos", "_pid"


def _match_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys that may be NULL, keeping the left key columns."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_r_{k}"), keys, right)
    cond = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    )
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def positioned(
    df: DataFrame, order: Sequence[Column], partition: Sequence[str] = (), copies: bool = False
) -> DataFrame:
    """Rows in range-sorted order with a position that grows along it.

    Ranges are cut on ``partition + order``, so a hot group spreads over many
    tasks.  The frame is checkpointed because the positions are read twice.
    ``copies`` adds the scan position as the last tie-break, so that identical
    rows of a scan can be cut apart too.
    """
    if copies:
        df = df.withColumn("_src", F.monotonically_increasing_id())
        order = [*order, F.col("_src")]
    keys = [*[F.col(p) for p in partition], *order]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_src")
    # the id holds the partition in its upper bits and the row in its lower 33
    out = checkpointed(laid.withColumn(_POS, F.monotonically_increasing_id()))
    return out.withColumn(_PID, F.shiftright(_POS, 33))


def _join_ranges(rows: DataFrame, ranges: DataFrame, partition: Sequence[str]) -> DataFrame:
    # without partition keys there is one row per range, so the size is bounded
    side = ranges if partition else F.broadcast(ranges)
    return _match_nulls(rows, side, [*partition, _PID], "inner")


def row_numbers(
    df: DataFrame,
    order: Sequence[Column],
    partition: Sequence[str] = (),
    name: str = "rank",
    copies: bool = False,
) -> DataFrame:
    """``row_number`` 1..n per group without gathering a group in one task."""
    rows = positioned(df, order, partition, copies)
    ranges = rows.groupBy(*partition, _PID).agg(F.count(F.lit(1)).alias("_n"), F.min(_POS).alias("_first"))
    before = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        _join_ranges(rows, ranges, partition)
        .withColumn(name, F.col("_before") + F.col(_POS) - F.col("_first") + 1)
        .drop(_POS, _PID, "_first", "_before")
    )


def lagged(
    df: DataFrame, order: Sequence[Column], partition: Sequence[str], values: Mapping[str, str]
) -> DataFrame:
    """Add the previous row's values (``new name -> column``) along an order.

    Inside a range this is a window; the first row of a range takes the last
    row of the range before it.
    """
    rows = positioned(df, order, partition)
    carried = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    ranges = rows.groupBy(*partition, _PID).agg(
        F.min(_POS).alias("_first"), F.max_by(carried, F.col(_POS)).alias("_last")
    )
    along = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(_PID)
    ranges = ranges.withColumn("_edge", F.lag("_last").over(along)).drop("_last")
    inside = Window.partitionBy(*partition, _PID).orderBy(_POS)
    joined = _join_ranges(rows, ranges, partition)
    for new, col in values.items():
        joined = joined.withColumn(
            f"_lag_{new}",
            F.when(F.col(_POS) == F.col("_first"), F.col(f"_edge.{new}")).otherwise(F.lag(col).over(inside)),
        )
    joined = joined.drop(_POS, _PID, "_first", "_edge")
    return reduce(lambda d, n: d.withColumnRenamed(f"_lag_{n}", n), values, joined)


def running_sum(df: DataFrame, order: Sequence[Column], partition: Sequence[str], value: str, name: str) -> DataFrame:
    """The sum of a value up to each row, per group, without gathering a group in one task."""
    rows = positioned(df, order, partition)
    inside = Window.partitionBy(*partition, _PID).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.sum(value).over(inside))
    sums = rows.groupBy(*partition, _PID).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(_PID)  # one row per group and range
    sums = sums.withColumn("_before", F.sum("_sum").over(before) - F.col("_sum")).drop("_sum")
    joined = _join_ranges(rows, sums, partition)
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop(_POS, _PID, "_before")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str, accuracy: int = 10000) -> DataFrame:
    """Exact median per group, for groups that fit no single task.

    A mergeable sketch gives a bracket that must hold the median.  Everything
    below the bracket is only counted, map-side; what is inside (a few parts in
    ``accuracy`` of the group) is sorted.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    margin = 5.0 / accuracy
    sketch = F.percentile_approx(value, F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), F.lit(accuracy))
    # fixed by a checkpoint, so that every task sees the same bracket
    brackets = checkpointed(known.groupBy(*keys).agg(sketch.alias("_b"), F.count(F.lit(1)).alias("_total")))
    if keys:
        placed = _match_nulls(known, brackets, keys, "inner")
    else:
        placed = known.withColumns({c: brackets.select(c).scalar() for c in ("_b", "_total")})
    placed = placed.where(F.col(value) <= F.col("_b")[1])
    # one row counts all that lies below the bracket; NULL sorts before the values inside
    inside = F.when(F.col(value) >= F.col("_b")[0], F.col(value))
    counts = placed.groupBy(*keys, "_total", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = running_sum(counts, [F.col("_v").asc_nulls_first()], keys, "_n", "_upto")

    def at(rank: Column) -> Column:
        covers = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(covers, F.col("_v").cast("double")))

    found = counts.groupBy(*keys).agg(
        at(F.floor((F.col("_total") - 1) / 2)).alias("_lo"), at(F.floor(F.col("_total") / 2)).alias("_hi")
    )
    missed = F.raise_error(F.lit("the bracket missed the median; raise accuracy")).cast("double")
    middle = (F.col("_lo") + F.col("_hi")) / 2
    return found.select(*keys, F.when(middle.isNull(), missed).otherwise(middle).alias(name))
