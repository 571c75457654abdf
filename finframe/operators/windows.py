"""Operators over a table of requests, each with a key and a window of days of its own.

A series is summed up once, in blocks of 2**k calendar days per key, k from 0 to
``LEVELS - 1``.  A window is cut into at most two blocks of each size, which meet
the summaries by equality and are merged: no range join, and a request costs the
logarithm of its window.  Windows are clamped to the days of their key first and
then made distinct, so many requests for one window are answered once, and a key
with a third of all requests is a join whose other side has one row per block.

Every request keeps its row, with a status (``ok``, ``UNKNOWN_TICKER``,
``DATE_RANGE_INVALID``, ``NO_MATCHING_RECORDS``) and the days its key has.  A
missing bound is open.  Nothing raises on data but a series of more than
2**16 days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.functions.scalars import bp_to_pct, decimal_to_pct, round4
from finframe.operators.align import DATE_RANGE_INVALID, NO_MATCHING_RECORDS, OK, UNKNOWN_TICKER
from finframe.operators.ordering import row_numbers
from finframe.session import checkpointed

LEVELS = 17  # blocks of 1 to 2**16 days
_BLOCK = ["_level", "_block"]


def _shift(day: Column, by: Column) -> Column:
    return F.call_function("shiftright", day, by)


def in_blocks(rows: DataFrame, day: str = "_day") -> DataFrame:
    """Every row once for each size of block, with the block that holds its day."""
    levels = rows.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    return levels.withColumn("_block", _shift(F.col(day), F.col("_level")))


def clamped(requests: DataFrame, series: DataFrame, key: str, date: str, start: str = "start", end: str = "end") -> DataFrame:
    """The requests with the days of their key, a status, and the days ``_s`` to ``_e`` that are left of a valid window."""
    cover = series.groupBy(key).agg(F.min(date).alias("available_start"), F.max(date).alias("available_end"))
    out = requests.join(cover, key, "left")
    status = (
        F.when(F.col("available_start").isNull(), UNKNOWN_TICKER).when(F.col(start) > F.col(end), DATE_RANGE_INVALID)
        .when((F.col(start) > F.col("available_end")) | (F.col(end) < F.col("available_start")), NO_MATCHING_RECORDS).otherwise(OK)
    )
    long = F.raise_error(F.lit(f"a series spans more than {2 ** (LEVELS - 1)} days")).cast("int")
    fits = F.datediff("available_end", "available_start") < 2 ** (LEVELS - 1)
    first = F.when(fits, F.unix_date(F.greatest(start, "available_start"))).otherwise(long)
    valid = F.col("status") == OK
    return out.withColumn("status", status).withColumn("_s", F.when(valid, first)).withColumn("_e", F.when(valid, F.unix_date(F.least(end, "available_end"))))


def pieces(windows: DataFrame, key: str) -> DataFrame:
    """The distinct windows ``_s`` to ``_e`` cut into blocks; ``_at`` is the first day of each."""
    levels = windows.where(F.col("_s") <= F.col("_e")).select(key, "_s", "_e").distinct().withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    size = F.call_function("shiftleft", F.lit(1), F.col("_level"))
    # the blocks of a size that lie inside reach from left to before right; an odd end has no partner in the next size
    ends = levels.withColumn("_left", _shift(F.col("_s") + size - 1, F.col("_level"))).withColumn("_right", _shift(F.col("_e") + 1, F.col("_level")))
    ends = ends.where(F.col("_left") < F.col("_right"))
    odd = F.array_compact(F.array(
        F.when(F.col("_left").bitwiseAND(F.lit(1)) == 1, F.col("_left")), F.when(F.col("_right").bitwiseAND(F.lit(1)) == 1, F.col("_right") - 1)))
    cut = ends.select(key, "_s", "_e", "_level", F.explode(odd).alias("_block"))
    return cut.withColumn("_at", F.call_function("shiftleft", F.col("_block"), F.col("_level")))


def answered(asked: DataFrame, found: DataFrame, key: str, columns: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The requests with what was found for their windows."""
    out = asked.join(found.withColumn("_found", F.lit(True)), [key, "_s", "_e"], "left")
    status = F.when((F.col("status") == OK) & F.col("_found").isNull(), NO_MATCHING_RECORDS).otherwise(F.col("status"))
    return out.select(*kept, *columns, status.alias("status"), "available_start", "available_end")


def _merged(stretches: Column, kind: str, merge) -> Column:
    """The stretches of an array of (place, stretch), merged in the order of places."""
    return F.aggregate(
        F.array_sort(stretches), F.lit(None).cast(kind), lambda a, s: F.when(a.isNull(), s["_stretch"].cast(kind)).otherwise(merge(a, s["_stretch"]).cast(kind)))


def extremes(
    requests: DataFrame, series: DataFrame, value: str, *, direction: str = "highest", n: int = 1, carry: Sequence[str] = (), key: str = "ticker", date: str = "date",
) -> DataFrame:
    """The n highest or lowest values in each request's window, earliest dates first among equals.

    ``rank, date, value`` and the ``carry`` columns; a request without rows has one row.
    """
    asked = checkpointed(clamped(requests, series, key, date))
    order = [F.col("_value").desc() if direction == "highest" else F.col("_value").asc(), "_day"]
    rows = series.where(F.col(value).isNotNull()).select(
        key, F.unix_date(date).alias("_day"), F.col(value).alias("_value"), F.struct(F.col(date).alias("_date"), *[F.col(c) for c in carry]).alias("_row"))
    # a row that is not among the n of its block is not among the n of a window that holds the block
    nth = F.row_number().over(Window.partitionBy(key, *_BLOCK).orderBy(*order))
    best = in_blocks(rows).withColumn("_nth", nth).where(F.col("_nth") <= n)
    met = pieces(asked, key).join(best, [key, *_BLOCK])
    rank = F.row_number().over(Window.partitionBy(key, "_s", "_e").orderBy(*order))
    found = met.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= n)
    found = found.select(key, "_s", "_e", "rank", F.col("_row._date").alias("_date"), F.col("_value"), *[F.col("_row")[c].alias(f"_c_{c}") for c in carry])
    columns = ["rank", F.col("_date").alias("date"), F.col("_value").alias("value"), *[F.col(f"_c_{c}").alias(c) for c in carry]]
    return answered(asked, found, key, columns, requests.columns)


def price_extremes(requests: DataFrame, prices: DataFrame, field: str = "close", direction: str = "highest", n: int = 1) -> DataFrame:
    out = extremes(requests, prices, field, direction=direction, n=n)
    return out.withColumn("value", F.col("value") if field == "volume" else round4(F.col("value")))


def biggest_moves(requests: DataFrame, bars: DataFrame, direction: str = "gain", n: int = 1) -> DataFrame:
    """The n largest one-day gains or declines in each request's window; the first day of a window looks back past it."""
    out = extremes(requests, bars, "daily_return", direction="highest" if direction == "gain" else "lowest", n=n, carry=["previous_close", "previous_date", "close"])
    return out.withColumn("value", decimal_to_pct(F.col("value"))).withColumnRenamed("value", "pct_change").withColumns(
        {c: round4(F.col(c)) for c in ("previous_close", "close")})


def rate_extremes(requests: DataFrame, rates: DataFrame, direction: str = "highest", key: str = "series_key", date: str = "effective_date") -> DataFrame:
    """Highest or lowest level in each request's window: first and last day at it, how many records hold it, how many there are."""
    asked = checkpointed(clamped(requests, rates, key, date))
    pick = F.max_by if direction == "highest" else F.min_by
    at = F.struct("target_bp", "_first", "_last", "_held")

    def best(levels: DataFrame, groups: Sequence[str]) -> DataFrame:
        """Of counts by level, the extreme level of each group and the number of all records."""
        return levels.groupBy(*groups).agg(pick(at, F.col("target_bp")).alias("_b"), F.sum("_used").alias("_used")).select(*groups, "_b.*", "_used")

    rows = rates.where(F.col("target_bp").isNotNull()).select(key, F.unix_date(date).alias("_day"), "target_bp")
    held = [F.min("_day").alias("_first"), F.max("_day").alias("_last"), F.count(F.lit(1)).alias("_held"), F.count(F.lit(1)).alias("_used")]
    blocks = best(in_blocks(rows).groupBy(key, *_BLOCK, "target_bp").agg(*held), [key, *_BLOCK])
    met = pieces(asked, key).join(blocks, [key, *_BLOCK])
    merged = met.groupBy(key, "_s", "_e", "target_bp").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_held").alias("_held"), F.sum("_used").alias("_used"))
    found = best(merged, [key, "_s", "_e"])
    columns = [
        bp_to_pct(F.col("target_bp")).alias("target_pct"), F.date_from_unix_date("_first").alias("first_effective_date"),
        F.date_from_unix_date("_last").alias("last_effective_date"), F.col("_held").alias("record_count"), F.col("_used").alias("records_used")]
    return answered(asked, found, key, columns, requests.columns)


_FALL = "struct<fall: double, day: int, peak: double, peak_day: int, trough: double>"
_STRETCH = f"struct<high: double, high_day: int, low: double, low_day: int, worst: {_FALL}, days: bigint>"


def _fall(fall: Column, day: Column, peak: Column, peak_day: Column, trough: Column) -> Column:
    return F.struct(fall.alias("fall"), day.alias("day"), peak.alias("peak"), peak_day.alias("peak_day"), trough.alias("trough"))


def _day_alone(peak: Column, trough: Column, day: Column) -> Column:
    fall = F.least(F.try_divide(trough, peak) - 1, F.lit(0.0))
    return F.struct(
        peak.alias("high"), day.alias("high_day"), trough.alias("low"), day.alias("low_day"), _fall(fall, day, peak, day, trough).alias("worst"), F.lit(1).cast("bigint").alias("days"))


def _followed(a: Column, b: Column) -> Column:
    """The stretch of days that two stretches make, the first before the second.

    The deepest fall is that of either, or from the highest day of the first to
    the lowest of the second; the earlier trough, then the earlier peak, wins.
    """
    fall = F.try_divide(b["low"], a["high"]) - 1
    across = F.when(fall < 0, _fall(fall, b["low_day"], a["high"], a["high_day"], b["low"]))
    # equal falls: the earlier trough; a peak that both reach belongs to the first
    options = F.filter(F.array(a["worst"], b["worst"], across), lambda w: w.isNotNull())
    ordered = F.array_min(F.transform(options, lambda w: F.struct(w["fall"].alias("f"), w["day"].alias("d"), w["peak_day"].alias("p"), w.alias("w"))))
    higher, lower = b["high"] > a["high"], b["low"] < a["low"]
    return F.struct(
        F.greatest(a["high"], b["high"]).alias("high"), F.when(higher, b["high_day"]).otherwise(a["high_day"]).alias("high_day"),
        F.least(a["low"], b["low"]).alias("low"), F.when(lower, b["low_day"]).otherwise(a["low_day"]).alias("low_day"),
        ordered["w"].alias("worst"), (a["days"] + b["days"]).alias("days"))


def drawdowns(requests: DataFrame, prices: DataFrame, basis: str = "close", key: str = "ticker", date: str = "date") -> DataFrame:
    """Deepest fall from a running peak in each request's window, and the first later close of the window back at that peak.

    A block's summary is its highest and lowest day and its deepest fall; two
    summaries side by side make one.  For the recovery, the first block after
    the trough whose highest close reaches the peak is found the same way, and
    in it the first day, from the days on which its close was higher than ever before.
    """
    peak, trough = ("high", "low") if basis == "intraday" else ("close", "close")
    asked = checkpointed(clamped(requests, prices, key, date))
    rows = prices.where(F.col(peak).isNotNull() & F.col(trough).isNotNull()).select(
        key, F.unix_date(date).alias("_day"), F.col(peak).cast("double").alias("_p"), F.col(trough).cast("double").alias("_t"), F.col("close").cast("double").alias("_c"))
    alone = F.struct(F.col("_day").alias("_place"), _day_alone(F.col("_p"), F.col("_t"), F.col("_day")).alias("_stretch"))
    # a block holds at most its calendar days
    days = F.array_sort(F.collect_list(F.struct("_day", "_c")))
    blocks = in_blocks(rows).groupBy(key, *_BLOCK).agg(_merged(F.collect_list(alone), _STRETCH, _followed).alias("_stretch"), F.max("_c").alias("_top"), days.alias("_days"))
    # closes that are higher than all before them in the block
    none = F.array().cast("array<struct<_day: int, _c: double>>")
    rising = F.aggregate("_days", none, lambda a, d: F.when((F.size(a) == 0) | (d["_c"] > F.element_at(a, -1)["_c"]), F.concat(a, F.array(d))).otherwise(a))
    blocks = checkpointed(blocks.withColumn("_rising", rising).drop("_days"))

    met = pieces(asked, key).join(blocks.select(key, *_BLOCK, "_stretch"), [key, *_BLOCK])
    worst = met.groupBy(key, "_s", "_e").agg(_merged(F.collect_list(F.struct(F.col("_at").alias("_place"), "_stretch")), _STRETCH, _followed).alias("_w"))  # two blocks of each size
    worst = checkpointed(worst.select(key, "_s", "_e", "_w.worst.*", "_w.days"))

    later = worst.select(key, (F.col("day") + 1).alias("_s"), "_e", "peak").distinct()
    after = pieces(later, key).join(later, [key, "_s", "_e"]).join(blocks.select(key, *_BLOCK, "_top"), [key, *_BLOCK]).where(F.col("_top") >= F.col("peak"))
    first = after.groupBy(key, "_s", "_e", "peak").agg(F.min(F.struct("_at", *_BLOCK)).alias("_f")).select(key, "_s", "_e", "peak", "_f._level", "_f._block")
    back = first.join(blocks.select(key, *_BLOCK, "_rising"), [key, *_BLOCK])
    recovery = F.filter("_rising", lambda d: d["_c"] >= F.col("peak"))[0]["_day"]
    back = back.select(key, (F.col("_s") - 1).alias("day"), "_e", "peak", recovery.alias("_recovery"))

    found = worst.join(back, [key, "day", "_e", "peak"], "left")
    columns = [
        decimal_to_pct(F.col("fall")).alias("max_drawdown_pct"), F.date_from_unix_date("peak_day").alias("peak_date"), round4(F.col("peak")).alias("peak_price"),
        F.date_from_unix_date("day").alias("trough_date"), round4(F.col("trough")).alias("trough_price"), (F.col("day") - F.col("peak_day")).cast("bigint").alias("drawdown_days"),
        F.date_from_unix_date("_recovery").alias("recovery_date"), F.col("days").alias("records_used")]
    return answered(asked, found, key, columns, requests.columns)


def totals(requests: DataFrame, series: DataFrame, sums: Mapping[str, str], *, key: str = "ticker", date: str = "date") -> DataFrame:
    """Sums of whole numbers over each request's window, with its first and last day and its number of days that have rows."""
    asked = checkpointed(clamped(requests, series, key, date))
    rows = series.select(
        key, F.unix_date(date).alias("_day"), F.unix_date(date).alias("_first"), F.unix_date(date).alias("_last"), F.lit(1).cast("bigint").alias("_days"),
        *[F.col(c).alias(f"_s_{n}") for n, c in sums.items()])
    merged = [F.min("_first").alias("_first"), F.max("_last").alias("_last"), *[F.sum(c).alias(c) for c in ("_days", *[f"_s_{n}" for n in sums])]]
    blocks = in_blocks(rows).groupBy(key, *_BLOCK).agg(*merged)
    found = pieces(asked, key).join(blocks, [key, *_BLOCK]).groupBy(key, "_s", "_e").agg(*merged)
    columns = [*[F.col(f"_s_{n}").alias(n) for n in sums], F.date_from_unix_date("_first").alias("earliest"), F.date_from_unix_date("_last").alias("latest"), F.col("_days").alias("days")]
    return answered(asked, found, key, columns, requests.columns)


def asked_tickers(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """``requests(request_id, start, end, tickers)`` by ticker; all that there are, where a request names none."""
    every = prices.select("ticker").distinct()
    named = requests.where(F.size("tickers") > 0).select("request_id", "start", "end", F.explode(F.array_distinct("tickers")).alias("ticker"))
    # all tickers of an open request, by equality on a constant that the requests are salted with
    salts = 32
    open_ = requests.where(F.coalesce(F.size("tickers"), F.lit(0)) <= 0).withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(salts)).cast("int"))
    spread = every.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return named.unionByName(open_.join(spread, "_salt").select("request_id", "start", "end", "ticker"))


def volume_ranks(requests: DataFrame, prices: DataFrame, agg: str = "total") -> DataFrame:
    """``requests(request_id, start, end, tickers)``: the asked tickers (all that there are, where none is named) ranked by volume in each window.

    A ticker without rows in the window, or an unknown one, keeps its row with a
    status and no rank.  Requests are ranked in sorted ranges, none in one task.
    """
    asked = asked_tickers(requests, prices)
    out = totals(asked, prices.where(F.col("volume").isNotNull()), {"volume": "volume"})
    value = F.col("volume") if agg == "total" else F.round(F.col("volume") / F.col("days")).cast("bigint")
    out = checkpointed(out.withColumn("volume", value))
    ranked = row_numbers(out.where(F.col("status") == OK), [F.col("volume").desc(), F.col("ticker")], ["request_id"])
    rest = out.where(F.col("status") != OK).withColumn("rank", F.lit(None).cast("bigint"))
    columns = ["request_id", "start", "end", "ticker", "rank", F.col("volume").alias(f"{agg}_volume"), F.col("days").alias("trading_days"), "status"]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def rate_changes(requests: DataFrame, rates: DataFrame, key: str = "series_key", date: str = "effective_date") -> DataFrame:
    """Record, change and hold counts, the net move and the levels around each request's window."""
    asked = checkpointed(clamped(requests, rates, key, date))
    change = F.col("change_bp")
    first = F.struct(F.unix_date(date).alias("day"), (F.col("target_bp") - change).alias("bp"))
    last = F.struct(F.unix_date(date).alias("day"), F.col("target_bp").alias("bp"))
    counts = {"record_count": F.lit(True), "changed_count": change != 0, "increases": change > 0, "decreases": change < 0, "holds": change == 0}
    rows = rates.select(key, F.unix_date(date).alias("_day"), first.alias("_first"), last.alias("_last"), change.alias("cumulative_bp"), *[c.cast("bigint").alias(n) for n, c in counts.items()])
    merged = [F.min("_first").alias("_first"), F.max("_last").alias("_last"), *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in (*counts, "cumulative_bp")]]
    blocks = in_blocks(rows).groupBy(key, *_BLOCK).agg(*merged)
    found = pieces(asked, key).join(blocks, [key, *_BLOCK]).groupBy(key, "_s", "_e").agg(*merged)
    columns = [
        *counts, bp_to_pct(F.col("cumulative_bp")).alias("cumulative_pct"), bp_to_pct(F.col("_first.bp")).alias("rate_before_pct"), bp_to_pct(F.col("_last.bp")).alias("rate_after_pct"),
        F.date_from_unix_date("_first.day").alias("window_start"), F.date_from_unix_date("_last.day").alias("window_end")]
    return answered(asked, found, key, columns, requests.columns)


_MOVE = "struct<day: int, bp: bigint>"
_HOLDS = f"struct<first: {_MOVE}, last: {_MOVE}, best: struct<short: int, from: {_MOVE}, to: {_MOVE}>>"


def _held_on(a: Column, b: Column) -> Column:
    """Two stretches of moves side by side: the hold between them competes with the longest of each."""
    across = F.struct((a["last"]["day"] - b["first"]["day"]).alias("short"), a["last"].alias("from"), b["first"].alias("to"))
    return F.struct(a["first"].alias("first"), b["last"].alias("last"), F.array_min(F.array(a["best"], b["best"], across)).alias("best"))


def _moves(rates: DataFrame, kind: str, key: str, date: str) -> DataFrame:
    change = F.col("change_bp")
    test = {"any_change": change != 0, "hike": change > 0, "cut": change < 0}[kind]
    return rates.where(test).select(key, F.unix_date(date).alias("_day"), "target_bp", "change_bp")


def longest_holds(requests: DataFrame, rates: DataFrame, kind: str = "any_change", key: str = "series_key", date: str = "effective_date") -> DataFrame:
    """The longest stretch between two consecutive moves of a kind in each request's window, the earliest of equals."""
    asked = checkpointed(clamped(requests, rates, key, date))
    move = F.struct(F.col("_day").alias("day"), F.col("target_bp").alias("bp"))
    alone = F.struct(F.col("_day").alias("_place"), F.struct(move.alias("first"), move.alias("last"), F.lit(None).alias("best")).cast(_HOLDS).alias("_stretch"))
    blocks = in_blocks(_moves(rates, kind, key, date)).groupBy(key, *_BLOCK).agg(_merged(F.collect_list(alone), _HOLDS, _held_on).alias("_stretch"))
    met = pieces(asked, key).join(blocks, [key, *_BLOCK])
    found = met.groupBy(key, "_s", "_e").agg(_merged(F.collect_list(F.struct(F.col("_at").alias("_place"), "_stretch")), _HOLDS, _held_on)["best"].alias("_b")).where("_b IS NOT NULL")
    columns = [
        F.date_from_unix_date("_b.from.day").alias("start_date"), F.date_from_unix_date("_b.to.day").alias("end_date"),
        bp_to_pct(F.col("_b.from.bp")).alias("rate_during_pct"), bp_to_pct(F.col("_b.to.bp")).alias("rate_after_pct"), (-F.col("_b.short")).cast("bigint").alias("gap_days")]
    return answered(asked, found, key, columns, requests.columns)


_RUN = "struct<up: boolean, moves: bigint, sum: bigint, from: int, to: int, before: bigint, after: bigint>"
_RUNS = f"struct<first: {_RUN}, last: {_RUN}, one: boolean, best: {_RUN}, found: bigint>"


def _joined_run(a: Column, b: Column) -> Column:
    return F.struct(
        a["up"].alias("up"), (a["moves"] + b["moves"]).alias("moves"), (a["sum"] + b["sum"]).alias("sum"), a["from"].alias("from"), b["to"].alias("to"),
        a["before"].alias("before"), b["after"].alias("after"))


def _run_order(select: str, run: Column) -> Column:
    """Smaller is better; earlier runs win ties."""
    return {"largest": F.struct(-F.abs(run["sum"]), run["from"]), "most_moves": F.struct(-run["moves"], run["from"]), "latest": F.struct(-run["from"])}[select]


def _best_run(runs: Column, up: bool, select: str) -> Column:
    fit = F.filter(runs, lambda r: r.isNotNull() & (r["up"] == up))
    return F.array_min(F.transform(fit, lambda r: F.struct(_run_order(select, r).alias("o"), r.alias("r"))))["r"]


def _run_on(up: bool, select: str):
    def merge(a: Column, b: Column) -> Column:
        same = a["last"]["up"] == b["first"]["up"]
        joined = _joined_run(a["last"], b["first"]).cast(_RUN)
        # runs that now have others on both sides are complete
        closed = F.when(same, F.array(F.when(~a["one"] & ~b["one"], joined))).otherwise(F.array(F.when(~a["one"], a["last"]), F.when(~b["one"], b["first"])))
        new = F.size(F.filter(closed, lambda r: r.isNotNull() & (r["up"] == up))).cast("bigint")
        return F.struct(
            F.when(same & a["one"], joined).otherwise(a["first"]).alias("first"), F.when(same & b["one"], joined).otherwise(b["last"]).alias("last"),
            (same & a["one"] & b["one"]).alias("one"), _best_run(F.concat(F.array(a["best"], b["best"]), closed), up, select).alias("best"), (a["found"] + b["found"] + new).alias("found"))

    return merge


def rate_cycles(
    requests: DataFrame, rates: DataFrame, direction: str = "tightening", select: str = "largest", key: str = "series_key", date: str = "effective_date",
) -> DataFrame:
    """One run of same-sign moves in each request's window: the largest by size, the one with most moves, or the latest.

    A block knows its first and last run, which may go on outside of it, and the
    best of those between them.
    """
    up = direction == "tightening"
    asked = checkpointed(clamped(requests, rates, key, date))
    change = F.col("change_bp").cast("bigint")
    run = F.struct(
        (change > 0).alias("up"), F.lit(1).cast("bigint").alias("moves"), change.alias("sum"), F.col("_day").alias("from"), F.col("_day").alias("to"),
        (F.col("target_bp") - change).cast("bigint").alias("before"), F.col("target_bp").cast("bigint").alias("after"))
    alone = F.struct(run.alias("first"), run.alias("last"), F.lit(True).alias("one"), F.lit(None).alias("best"), F.lit(0).cast("bigint").alias("found")).cast(_RUNS)
    merge = _run_on(up, select)
    moves = in_blocks(_moves(rates, "any_change", key, date))
    blocks = moves.groupBy(key, *_BLOCK).agg(_merged(F.collect_list(F.struct(F.col("_day").alias("_place"), alone.alias("_stretch"))), _RUNS, merge).alias("_stretch"))
    met = pieces(asked, key).join(blocks, [key, *_BLOCK])
    whole = met.groupBy(key, "_s", "_e").agg(_merged(F.collect_list(F.struct(F.col("_at").alias("_place"), "_stretch")), _RUNS, merge).alias("_w"))
    ends = F.array(F.col("_w.first"), F.when(~F.col("_w.one"), F.col("_w.last")))
    found = whole.select(
        key, "_s", "_e", _best_run(F.concat(F.array("_w.best"), ends), up, select).alias("_r"),
        (F.col("_w.found") + F.size(F.filter(ends, lambda r: r.isNotNull() & (r["up"] == up)))).alias("cycles_found")).where("_r IS NOT NULL")
    columns = [
        F.col("_r.moves").alias("move_count"), F.date_from_unix_date("_r.from").alias("start_date"), F.date_from_unix_date("_r.to").alias("end_date"),
        (F.col("_r.to") - F.col("_r.from")).cast("bigint").alias("duration_days"), "cycles_found", bp_to_pct(F.col("_r.sum")).alias("cumulative_pct"),
        bp_to_pct(F.col("_r.before")).alias("rate_before_pct"), bp_to_pct(F.col("_r.after")).alias("rate_after_pct")]
    return answered(asked, found, key, columns, requests.columns)
