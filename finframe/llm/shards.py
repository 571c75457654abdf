"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``nodes`` places on a ring of 60-bit hashes.  A key belongs to
the first place clockwise from its own hash.  Keys come in the order of a second
hash; a key that meets a full shard goes on clockwise to the next one.  Then the
outcome depends on one number per shard alone: the turn after which it was full.
So no key is moved one by one.  Rounds count, per shard, how many keys of each
stretch of turns would stop there, and lower each shard's last turn to the one
that fills it.  Turns only fall, and at least one more shard is settled each
round, so there are at most as many rounds as shards, each a map-side count.

With ``slack`` 0 the capacities add up to the number of rows and differ by at
most one, so counts differ by at most one.  A positive ``slack`` lets each shard
take that share more, and fewer keys leave their first place.

Defined results: null ids share one place on the ring.  Repeated rows are keys
of their own in a fixed order.  An empty table gives no rows.  Columns of the
input are kept, but for those that clash with the outputs or begin with an
underscore.  The ring is a table of ``shards * nodes`` rows, whatever the
data; it is worked out from parameters alone and is the only thing broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finframe.llm.columns import without
from finframe.session import checkpointed

NODES = 64
STRETCHES = 4096  # counts per shard in one pass
RING_BITS = 60


def hashed(*parts: Column, half: int = 0) -> Column:
    """A 60-bit number out of the MD5 of the parts, from its first or second half."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1 + 16 * half, 15), 16, 10).cast("long")


def key_hash(key: Column, half: int = 0) -> Column:
    return hashed(F.lit("key"), F.coalesce(key.cast("string"), F.lit("")), half=half)


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> DataFrame:
    """``_cell, _until, _choices``: for each stretch of the ring its shards in clockwise order.

    The ring is cut at places and at the bounds of ``2**k`` equal cells, so that
    a key finds its stretch by its cell (an equality) and one comparison.
    """
    bits = max(1, (shards * nodes).bit_length())
    width = 1 << (RING_BITS - bits)
    places = spark.range(shards * nodes).select(
        hashed(F.lit("shard"), (F.col("id") % shards).cast("string"), F.floor(F.col("id") / shards).cast("string")).alias("_at"),
        (F.col("id") % shards).cast("int").alias("_shard"),
    )
    line = places.agg(F.array_sort(F.collect_list(F.struct("_at", "_shard"))).alias("_line"))

    def clockwise(at: Column) -> Column:
        ahead = F.filter("_line", lambda p: p["_at"] >= at)
        behind = F.filter("_line", lambda p: p["_at"] < at)
        return F.array_distinct(F.transform(F.concat(ahead, behind), lambda p: p["_shard"]))

    cells = spark.range(1 << bits).select((F.col("id") + 1).alias("_next"), F.lit(width).alias("_w"))
    ends = cells.select((F.col("_next") * F.col("_w") - 1).alias("_until")).union(places.select("_at"))
    ends = ends.distinct().withColumn("_cell", F.shiftright("_until", RING_BITS - bits))
    return ends.withColumn("_line", line.scalar()).select("_cell", "_until", clockwise(F.col("_until")).alias("_choices"))


def _cell_bits(shards: int, nodes: int) -> int:
    return max(1, (shards * nodes).bit_length())


def _choices(rows: DataFrame, shards: int, nodes: int) -> DataFrame:
    """Add the clockwise shards of each row's place."""
    by_cell = (
        ring(rows.sparkSession, shards, nodes).groupBy("_cell")
        .agg(F.array_sort(F.collect_list(F.struct("_until", "_choices"))).alias("_stretches"))
    )
    placed = rows.withColumn("_cell", F.shiftright("_at", RING_BITS - _cell_bits(shards, nodes)))
    first = F.filter("_stretches", lambda s: s["_until"] >= F.col("_at"))[0]["_choices"]
    return placed.join(F.broadcast(by_cell), "_cell").withColumn("_choices", first).drop("_cell", "_stretches")


def in_turn(rows: DataFrame, key: Column) -> DataFrame:
    """Rows with a gapless ``_turn`` from 0 in the order of the second hash, cut into ranges ``_range``."""
    order = [F.col("_prio"), F.col("_tie")]
    laid = rows.withColumns({"_at": key_hash(key), "_prio": key_hash(key, 1), "_tie": F.monotonically_increasing_id()})
    laid = checkpointed(laid.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()).drop("_prio", "_tie"))
    laid = laid.withColumn("_range", F.shiftright("_pos", 33))
    sizes = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range, a number that the number of partitions bounds
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    within = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(before), "_range").withColumn("_turn", F.col("_before") + within).drop("_before", "_pos")


def _stop(last: dict[int, int]) -> Column:
    """The first of a row's choices that still takes it, given the last turn of each full shard."""
    if not last:
        return F.col("_choices")[0]
    full = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    open_ones = F.filter("_choices", lambda s: F.coalesce(F.try_element_at(full, s) >= F.col("_turn"), F.lit(True)))
    return F.get(open_ones, 0)


def _last_turns(rows: DataFrame, caps: list[int], total: int) -> dict[int, int]:
    """For every shard that fills, the turn of the key that fills it."""
    last: dict[int, int] = {}
    while True:
        placed = rows.select("_turn", _stop(last).alias("shard"))
        # the turn that fills a shard lies in one stretch of [low, low + width); stretches shrink until they hold one turn
        low = dict.fromkeys(range(len(caps)), 0)
        need = dict(enumerate(caps))
        width = max(1, total)
        while width >= 1 and need:
            step = max(1, -(-width // STRETCHES))
            origin = F.create_map(*[F.lit(x) for s in need for x in (s, low[s])])
            at = F.try_element_at(origin, F.col("shard"))
            inside = placed.where((F.col("_turn") >= at) & (F.col("_turn") < at + width))
            counted = inside.groupBy("shard", F.floor((F.col("_turn") - at) / step).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
            upto = F.sum("_n").over(Window.partitionBy("shard").orderBy("_k"))
            wanted = F.try_element_at(F.create_map(*[F.lit(x) for pair in need.items() for x in pair]), F.col("shard"))
            cut = counted.withColumn("_upto", upto).where(F.col("_upto") >= wanted).groupBy("shard").agg(
                F.min_by(F.struct("_k", "_upto", "_n"), "_k").alias("_c"))
            found = {r["shard"]: r["_c"] for r in cut.collect()}  # one row per shard
            need = {s: need[s] - (c["_upto"] - c["_n"]) for s, c in found.items()}
            low = {s: low[s] + c["_k"] * step for s, c in found.items()}
            if step == 1:
                break
            width = step
        filled = {s: low[s] for s in need}
        if filled == last:
            return last
        last = filled


def assign(
    rows: DataFrame, *, key: str = "doc_id", shards: int = 8, nodes: int = NODES, slack: float = 0.0,
) -> DataFrame:
    """The rows with ``home_shard`` (first place), ``shard`` and ``slot``, gapless from 0 in each shard."""
    rows = without(rows, ["home_shard", "shard", "slot"], [key])
    ranked = checkpointed(_choices(in_turn(rows, F.col(key)), shards, nodes).drop("_at"))
    total = ranked.count()
    if slack:
        caps = [max(1, -(-int(total * (1 + slack)) // shards))] * shards
    else:
        caps = [total // shards + (s < total % shards) for s in range(shards)]
    slim = ranked.select("_turn", "_choices")
    # a shard without room (fewer rows than shards) is full before the first turn
    none = {s: -1 for s, c in enumerate(caps) if c == 0}
    last = none | _last_turns(slim.withColumn("_choices", F.array_except("_choices", F.array(*map(F.lit, none)))) if none else slim, caps, total) if total else {}
    placed = ranked.withColumns({"home_shard": F.col("_choices")[0], "shard": _stop(last)}).drop("_choices")
    counts = placed.groupBy("_range", "shard").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_range")
    counts = counts.withColumn("_before", F.sum("_n").over(earlier) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range", "shard").orderBy("_turn"))
    return (
        placed.withColumn("_in", inside).join(counts, ["_range", "shard"])
        .withColumn("slot", F.col("_before") + F.col("_in") - 1).drop("_range", "_turn", "_before", "_in")
    )
