"""Date alignment: as-of joins, coverage, window clamping and request status.

A series has one row per key and day.  Requests are first reduced to distinct
(key, day) points, so the ordered pass over a key is bounded by calendar days on
both sides, however many requests a key draws.  The answers then join back on
(key, day), each a lookup with one row per point, so Spark can split the
requests of a hot point.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.session import checkpointed

# Status of a request row.
OK = "ok"
UNKNOWN_TICKER = "UNKNOWN_TICKER"
DATE_RANGE_INVALID = "DATE_RANGE_INVALID"
DATE_OUTSIDE_COVERAGE = "DATE_OUTSIDE_COVERAGE"
NO_MATCHING_RECORDS = "NO_MATCHING_RECORDS"
INVARIANT_FAILED = "INVARIANT_FAILED"
DEPENDENCY_FAILED = "DEPENDENCY_FAILED"

MODES = ("previous", "next", "nearest", "exact")


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"alignment is one of {MODES}")


def resolve_points(
    points: DataFrame, series: DataFrame, keys: Sequence[str], point_date: str, series_date: str, mode: str
) -> DataFrame:
    """Align distinct (key, day) points to the days of a series.

    Returns ``keys, point_date, hit`` (the series row that applies, as a struct,
    or NULL) and ``known`` (whether the key has any series row).  Linear in both
    sides: one sort per direction, no range join.
    """
    _check_mode(mode)
    row = F.struct(*[F.col(c) for c in series.columns if c not in keys])
    merged = points.select(*keys, F.col(point_date).alias("_d"), F.lit(True).alias("_point")).unionByName(
        series.select(*keys, F.col(series_date).alias("_d"), F.lit(False).alias("_point"), row.alias("_row")), allowMissingColumns=True
    )
    group = [F.col(k) for k in keys] or [F.lit(0)]
    # on one day the series row sorts before the points, in both directions
    past = Window.partitionBy(*group).orderBy("_d", "_point").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*group).orderBy(F.col("_d").desc(), "_point").rowsBetween(Window.unboundedPreceding, 0)
    before, after = F.last("_row", True).over(past), F.last("_row", True).over(ahead)
    if mode == "previous":
        placed = merged.withColumn("hit", before)
    elif mode == "next":
        placed = merged.withColumn("hit", after)
    elif mode == "exact":
        placed = merged.withColumn("_before", before)
        placed = placed.withColumn("hit", F.when(F.col("_before").getField(series_date) == F.col("_d"), F.col("_before")))
    else:
        placed = merged.withColumn("_before", before).withColumn("_after", after)
        back = F.datediff("_d", F.col("_before").getField(series_date))
        ahead_days = F.datediff(F.col("_after").getField(series_date), "_d")
        earlier = F.col("_after").isNull() | (F.col("_before").isNotNull() & (back <= ahead_days))
        placed = placed.withColumn("hit", F.when(earlier, F.col("_before")).otherwise(F.col("_after")))
    known = F.max(~F.col("_point")).over(Window.partitionBy(*group))
    return placed.withColumn("known", known).where(F.col("_point")).select(*keys, F.col("_d").alias(point_date), "hit", "known")


def asof(
    requests: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    request_date: str,
    series_date: str,
    mode: str = "previous",
    row_id: Sequence[str] = (),
    prefix: str = "",
) -> DataFrame:
    """Every request with the series row that applies on its date, and a status."""
    return asof_many(requests, series, keys, {prefix: request_date}, series_date, mode, row_id)


def asof_many(
    requests: DataFrame, series: DataFrame, keys: Sequence[str], dates: Mapping[str, str], series_date: str,
    mode: str | Mapping[str, str] = "previous", row_id: Sequence[str] = (),
) -> DataFrame:
    """Several dates of each request aligned in one ordered pass per mode.

    ``dates`` maps the prefix of the added columns to a request's date column.
    """
    modes = {p: mode if isinstance(mode, str) else mode[p] for p in dates}
    values = [c for c in series.columns if c not in keys]
    answers = {}
    for one in sorted(set(modes.values())):
        asked = [requests.select(*keys, F.col(c).alias("_at")) for p, c in dates.items() if modes[p] == one]
        points = reduce(DataFrame.unionByName, asked).where(F.col("_at").isNotNull()).distinct()
        answers[one] = resolve_points(points, series, keys, "_at", series_date, one)
    out = requests
    for prefix, column in dates.items():
        lookup = answers[modes[prefix]].select(*keys, F.col("_at").alias(column), F.col("hit").alias("_hit"), F.col("known").alias("_known"))
        status = (
            F.when(F.col("_hit").isNotNull(), OK)
            .when(F.col("_known"), DATE_OUTSIDE_COVERAGE)
            .otherwise(UNKNOWN_TICKER if keys else DATE_OUTSIDE_COVERAGE)
        )
        had = out.columns
        out = out.join(lookup, [*keys, column], "left").select(
            *had, *[F.col("_hit").getField(c).alias(prefix + c) for c in values], status.alias(f"{prefix}status")
        )
    return out


def moved_note(requested: Column, resolved: Column, mode: str) -> Column:
    """A warning text where alignment moved a date, else NULL."""
    text = F.concat(
        requested.cast("string"), F.lit(" is not in the series; took "), resolved.cast("string"), F.lit(f" ({mode})")
    )
    return F.when(requested != resolved, text)


def with_moved_note(rows: DataFrame, requested: str, resolved: str, mode: str = "previous") -> DataFrame:
    """The rows with ``warning``: where the day that answers is not the day asked for, else NULL."""
    return rows.withColumn("warning", moved_note(F.col(requested), F.col(resolved), mode))


def with_available(rows: DataFrame, series: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """The rows with the first and the last day that the series has of their key; NULL for unknown keys."""
    days = series.groupBy(*keys).agg(F.min(date).alias("available_start"), F.max(date).alias("available_end"))
    return rows.join(days, list(keys), "left")


def coverage(df: DataFrame, dataset: str, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last day and row count, per key or for the whole frame."""
    out = df.groupBy(*keys).agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("record_count"))
    return out.select(F.lit(dataset).alias("dataset"), *keys, "start", "end", "record_count")


def combined_coverage(per_key: DataFrame, dataset: str) -> DataFrame:
    return per_key.agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("record_count").alias("record_count")
    ).select(F.lit(dataset).alias("dataset"), "start", "end", "record_count")


def overlap(coverages: Sequence[DataFrame]) -> DataFrame:
    """The days all datasets share; NULL bounds when they are disjoint."""
    rows = reduce(DataFrame.unionByName, coverages)
    shared = rows.agg(
        F.max("start").alias("lo"), F.min("end").alias("hi"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("dataset", "start", "end"))),
                lambda r: F.concat(r["dataset"], F.lit(" "), r["start"].cast("string"), F.lit(" to "), r["end"].cast("string")),
            ),
            "; ",
        ).alias("described"),
    )
    fits = F.col("lo") <= F.col("hi")
    return shared.select(
        F.when(fits, F.col("lo")).alias("shared_start"), F.when(fits, F.col("hi")).alias("shared_end"), "described"
    )


def clamp(requests: DataFrame, cover: DataFrame, keys: Sequence[str] = (), row_id: Sequence[str] = ()) -> DataFrame:
    """Narrow each requested ``start``/``end`` to the coverage of its key; NULL bounds stay open.

    Adds ``lo``, ``hi`` and ``status``.
    """
    if keys:
        side = cover.select(*keys, F.col("start").alias("_cs"), F.col("end").alias("_ce"))
        out = requests.join(side, list(keys), "left")
    else:
        bounds = {"_cs": cover.select("start").scalar(), "_ce": cover.select("end").scalar()}
        out = requests.withColumns(bounds)
    lo, hi = F.greatest("start", "_cs"), F.least("end", "_ce")
    status = (
        F.when(F.col("_cs").isNull(), UNKNOWN_TICKER)
        .when(F.col("start") > F.col("end"), DATE_RANGE_INVALID)
        .when(lo > hi, DATE_OUTSIDE_COVERAGE)
        .otherwise(OK)
    )
    out = out.withColumn("status", status)
    good = F.col("status") == OK
    return out.select(*requests.columns, F.when(good, lo).alias("lo"), F.when(good, hi).alias("hi"), "status")


def in_coverage(events: DataFrame, cover: DataFrame, date: str) -> DataFrame:
    """Events that fall inside the (one-row) coverage of another dataset."""
    lo, hi = cover.select("start").scalar(), cover.select("end").scalar()
    return events.where(F.col(date).between(lo, hi))


def answered(
    found: DataFrame, rows: DataFrame, key: str, date: str, start: str | None = None, end: str | None = None, asked: Sequence[str] = ()
) -> DataFrame:
    """What an operator found, and one row for every asked key without a result.

    Adds ``status``, ``available_start`` and ``available_end`` (the days the key
    has at all).  Without ``asked`` every key of ``rows`` is asked for.
    """
    cover = rows.groupBy(key).agg(F.min(date).alias("available_start"), F.max(date).alias("available_end"))
    if asked:
        named = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(a) for a in dict.fromkeys(asked)])).alias(key))
        cover = named.join(cover, key, "left")
    inverted = bool(start and end and start > end)
    status = (
        F.when(F.col("available_start").isNull(), UNKNOWN_TICKER).when(F.lit(inverted), DATE_RANGE_INVALID)
        .when(F.col("_found"), OK).otherwise(NO_MATCHING_RECORDS)
    )
    out = cover.join(found.withColumn("_found", F.lit(True)), key, "left")
    return out.select(*found.columns, status.alias("status"), "available_start", "available_end")


def skipped_warning(results: DataFrame, key: str) -> DataFrame:
    """One warning text that names the keys without a result, or NULL."""
    missed = F.array_sort(F.collect_set(F.when(F.col("status") != OK, F.col(key).cast("string"))))
    return results.agg(F.when(F.size(missed) > 0, F.concat(F.lit("skipped: "), F.array_join(missed, ", "))).alias("warning"))


def dependent(results: DataFrame) -> DataFrame:
    """Requests that rest on these results: a failed one fails them, with its own status as the cause."""
    failed = F.col("status") != OK
    return results.withColumn("cause", F.when(failed, F.col("status"))).withColumn("status", F.when(failed, DEPENDENCY_FAILED).otherwise(OK))


def unknown_keys(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested keys the dataset does not hold, each with the number of valid keys and the first and last of them."""
    valid = known.select(key).distinct()
    summed = valid.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    told = {n: summed.select(c).scalar() for n, c in (("available", "n"), ("first_key", "first"), ("last_key", "last"))}
    return requests.select(key).distinct().join(valid, key, "left_anti").select(
        key, F.lit(UNKNOWN_TICKER).alias("status"), *[c.alias(n) for n, c in told.items()]
    )


def key_report(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested keys the dataset does not hold and, if there are any, each key it holds; one row per key."""
    valid, asked = known.select(key).distinct(), requests.select(key).distinct()
    unknown = checkpointed(asked.join(valid, key, "left_anti").withColumn("status", F.lit(UNKNOWN_TICKER)))
    some = unknown.agg(F.count(F.lit(1)) > 0).scalar()
    return unknown.unionByName(valid.withColumn("status", F.lit("VALID")).where(some))


def batch_status(results: DataFrame, status: str = "status") -> DataFrame:
    """ok when all rows are ok, error when none is, else partial."""
    good, total = F.count_if(F.col(status) == OK), F.count(F.lit(1))
    return results.agg(
        total.alias("requests"), good.alias("succeeded"),
        F.when(good == total, "ok").when(good == 0, "error").otherwise("partial").alias("overall"),
    )
