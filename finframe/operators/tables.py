"""Generic table operators: filters, extremes, aggregates, movers and gaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finframe.functions.scalars import all_of, any_of
from finframe.operators.ordering import exact_median, lagged

Filter = tuple[str, str] | tuple[str, str, Any]

_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
}


def predicate(column: str, op: str, value: Any = None) -> Column:
    """One ``(column, op, value)`` filter as a Column that can be pushed down."""
    col, op = F.col(column), op.lower()
    if op == "is_null":
        return col.isNull()
    if op == "is_not_null":
        return col.isNotNull()
    if op == "in":
        if not isinstance(value, (list, tuple)) or not value:
            raise ValueError("'in' needs a non-empty list")
        return col.isin(*value)
    if op not in _COMPARE:
        raise ValueError(f"unknown filter {op!r}")
    if value is None:
        raise ValueError(f"filter {op!r} needs a value")
    return _COMPARE[op](col, value)


def where(df: DataFrame, filters: Sequence[Filter] = ()) -> DataFrame:
    return df.where(all_of([predicate(*f) for f in filters])) if filters else df


def table_schema(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of every table, with the table's row count."""

    def listing(name: str, df: DataFrame) -> DataFrame:
        fields = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("column_type")) for c, t in df.dtypes])
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
        return counted.select(F.lit(name).alias("table_name"), F.inline(fields), "row_count")

    return reduce(DataFrame.unionByName, [listing(n, d) for n, d in sorted(tables.items())])


def distinct_values(df: DataFrame, column: str, filters: Sequence[Filter] = (), limit: int | None = None) -> DataFrame:
    out = where(df, filters).select(column).distinct().orderBy(F.col(column).asc_nulls_last())
    return out if limit is None else out.limit(limit)


def filter_rows(
    df: DataFrame,
    filters: Sequence[Filter] = (),
    columns: Sequence[str] = (),
    order_by: str | None = None,
    ascending: bool = True,
    ties: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    out = where(df, filters)
    if order_by:
        col = F.col(order_by)
        lead = col.asc_nulls_last() if ascending else col.desc_nulls_last()
        out = out.orderBy(lead, *[F.col(t).asc_nulls_last() for t in ties])
    if limit is not None:
        out = out.limit(limit)
    return out.select(*columns) if columns else out


def count_matching(df: DataFrame, filters: Sequence[Filter] = ()) -> DataFrame:
    return where(df, filters).agg(F.count(F.lit(1)).alias("row_count"))


def extremes(
    df: DataFrame,
    column: str,
    direction: str = "max",
    n: int = 1,
    filters: Sequence[Filter] = (),
    columns: Sequence[str] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """The n rows with the highest or lowest value, as a distributed top-k."""
    if direction not in ("max", "min"):
        raise ValueError("direction is 'max' or 'min'")
    return filter_rows(df, filters, columns, column, direction == "min", ties, n)


def min_row(df: DataFrame, column: str, **kw: Any) -> DataFrame:
    return extremes(df, column, "min", 1, **kw)


def max_row(df: DataFrame, column: str, **kw: Any) -> DataFrame:
    return extremes(df, column, "max", 1, **kw)


def date_range(df: DataFrame, column: str, filters: Sequence[Filter] = ()) -> DataFrame:
    return where(df, filters).agg(
        F.min(column).alias("earliest"), F.max(column).alias("latest"), F.count(F.lit(1)).alias("row_count")
    )


_AGGREGATES = {
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
    "sum": F.sum,
    "count": F.count,
    "count_distinct": F.countDistinct,
    "approx_count_distinct": F.approx_count_distinct,
    "stddev": F.stddev_samp,
    "stddev_pop": F.stddev_pop,
}


def aggregate_many(
    df: DataFrame, measures: Sequence[tuple[str, str]], group_by: Sequence[str] = (), filters: Sequence[Filter] = ()
) -> DataFrame:
    """Several ``(aggregate, column)`` measures in one pass; columns are ``column_aggregate``.

    All but the median combine map-side.  The median takes its own bracketed
    pass (``exact_median``), so that no group has to fit in one task.
    """
    rows = where(df, filters)
    plain = [(a, c) for a, c in measures if a != "median"]
    medians = [c for a, c in measures if a == "median"]
    exprs = [_AGGREGATES[a](c).alias(f"{c}_{a}") for a, c in plain] or [F.count(F.lit(1)).alias("_rows")]
    out = rows.groupBy(*group_by).agg(*exprs)
    for c in medians:
        found = exact_median(rows, group_by, c, f"{c}_median")
        if group_by:
            out = out.join(found, list(group_by), "left")
        else:
            out = out.withColumn(f"{c}_median", found.scalar())
    return out.select(*group_by, *[f"{c}_{a}" for a, c in measures])


def aggregate(
    df: DataFrame,
    column: str,
    agg: str = "count",
    filters: Sequence[Filter] = (),
    group_by: Sequence[str] = (),
    order_by_agg: str = "none",
    limit: int | None = None,
) -> DataFrame:
    """One aggregate, optionally grouped, ordered by its value and limited."""
    name = f"{column}_{agg}"
    out = aggregate_many(df, [(agg, column)], group_by, filters)
    if order_by_agg == "asc":
        out = out.orderBy(F.col(name).asc_nulls_last(), *group_by)
    elif order_by_agg == "desc":
        out = out.orderBy(F.col(name).desc_nulls_last(), *group_by)
    elif order_by_agg != "none":
        raise ValueError("order_by_agg is 'none', 'asc' or 'desc'")
    return out if limit is None else out.limit(limit)


def conditional_counts(df: DataFrame, conditions: dict[str, Column], group_by: Sequence[str] = ()) -> DataFrame:
    """Many counts over one scan."""
    return df.groupBy(*group_by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def distinct_groups(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("groups"))


def period_over_period_change(
    df: DataFrame,
    value: str,
    date: str,
    partition_by: Sequence[str] = (),
    direction: str = "desc",
    n: int | None = 1,
    filters: Sequence[Filter] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """Rows with the largest change against the previous row; filters apply before the lag."""
    rows = where(df, filters)
    order = [F.col(date).asc_nulls_last(), *[F.col(t) for t in ties]]
    moved = lagged(rows, order, partition_by, {"previous_value": value}).where(F.col("previous_value").isNotNull())
    # a zero previous value gives NULL and leaves the ranking
    pct = F.round(F.try_divide(F.col(value) - F.col("previous_value"), F.col("previous_value")) * 100, 4)
    moved = moved.withColumn("pct_change", pct).where(F.col("pct_change").isNotNull())
    if n is None:
        return moved
    lead = F.col("pct_change").desc() if direction == "desc" else F.col("pct_change").asc()
    return moved.orderBy(lead, *partition_by, date, *ties).limit(n)


def longest_gap(
    df: DataFrame,
    date: str,
    partition_by: Sequence[str] = (),
    n: int | None = 1,
    filters: Sequence[Filter] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """Longest stretches in days between consecutive rows that match the filters."""
    rows = where(df, filters)
    order = [F.col(date).asc_nulls_last(), *[F.col(t) for t in ties]]
    gaps = lagged(rows, order, partition_by, {"previous_date": date}).where(F.col("previous_date").isNotNull())
    gaps = gaps.withColumn("gap_days", F.datediff(date, "previous_date").cast("bigint"))
    if n is None:
        return gaps
    return gaps.orderBy(F.col("gap_days").desc(), *partition_by, date, *ties).limit(n)


def text_search(
    df: DataFrame,
    columns: Sequence[str],
    keyword: str,
    match_all: bool = False,
    filters: Sequence[Filter] = (),
    limit: int | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Case-insensitive substring search; wildcards in the keyword stand for themselves."""
    literal = keyword.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    hits = [F.col(c).ilike(f"%{literal}%") for c in columns]
    out = where(df, filters).where((all_of if match_all else any_of)(hits))
    if ties:
        out = out.orderBy(*ties)
    return out if limit is None else out.limit(limit)
