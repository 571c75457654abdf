"""Question records: mapping, validation, dedupe, group-aware split, rendering, lengths.

A record is ``(id, task, target, inputs MAP, components ARRAY, meta MAP)`` plus
``group_key`` and a ``row_index`` that fixes the input order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.functions.scalars import content_id, token_estimate
from finframe.operators.ordering import row_numbers

SPLITS = ("train", "val", "test")

# Sequence lengths a suggested length is rounded up to.
LENGTH_BUCKETS = (256, 512, 768, 1024, 1536, 2048, 4096)


def _map_of(columns: Sequence[str]) -> Column:
    """The non-NULL columns as a map of text; nested values as JSON."""
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def canonical_records(
    rows: DataFrame, source: str, row_index: str, target: str, inputs: Sequence[str], task: str | None = None, task_default: str = "default",
    components: str | None = None, group: str | None = None, meta: Sequence[str] = (),
) -> DataFrame:
    """Arbitrary rows as records, by configured column names; ``reject`` names what is missing."""
    index = F.col(row_index)
    label = F.coalesce(F.col(task).cast("string"), F.lit(task_default)) if task else F.lit(task_default)
    own_group = F.concat(F.lit("row:"), index.cast("string"))
    given = _map_of(inputs)
    reject = F.when(F.col(target).isNull(), f"missing {target}").when(F.size(given) == 0, "no input field")
    return rows.select(
        content_id(F.lit(source), index, F.col(target)).alias("id"), label.alias("task"), F.col(target).cast("string").alias("target"), given.alias("inputs"),
        (F.col(components) if components else F.lit(None).cast("array<string>")).alias("components"),
        _map_of(meta).alias("meta") if meta else F.create_map().cast("map<string,string>").alias("meta"),
        (F.coalesce(F.col(group).cast("string"), own_group) if group else own_group).alias("group_key"),
        index.cast("bigint").alias("row_index"), reject.alias("reject"),
    )


def structural_rejects(records: DataFrame) -> DataFrame:
    """Records that break the shape, each with the first reason."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    reason = F.when(empty("id"), "empty id").when(empty("task"), "empty task").when(empty("target"), "empty target").when(F.col("inputs").isNull(), "inputs is not a map")
    return records.withColumn("reason", reason).where(F.col("reason").isNotNull())


def input_hash(inputs: str = "inputs") -> Column:
    """Hash of the inputs with their keys in order."""
    return F.substring(F.sha2(F.to_json(F.array_sort(F.map_entries(inputs))), 256), 1, 16)


def dedupe_inputs(records: DataFrame) -> DataFrame:
    """The first record of each distinct input, by row index and id; copies collapse before the shuffle."""
    names = records.columns
    kept = records.groupBy(input_hash().alias("input_hash")).agg(F.min_by(F.struct(*names), F.struct("row_index", "id")).alias("r"), F.count(F.lit(1)).alias("copies"))
    return kept.select("r.*", "input_hash", "copies")


def group_split(records: DataFrame, fractions: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0, group: str = "group_key") -> DataFrame:
    """Whole groups to train, val or test: ``int(n * f)`` groups each, the rest to test.

    Groups are ordered by a seeded hash.  Only the two hashes at the cuts are
    looked up; every record then finds its split from its own hash, without a join.
    """
    if abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError("the fractions add up to 1")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group)), 256)
    groups = records.select(key.alias("_h")).distinct()
    ranked = row_numbers(groups, [F.col("_h")], name="_rank")
    total = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    train = F.floor(total * fractions[0])
    val = train + F.floor(total * fractions[1])
    # no hash is below the empty string, so an empty split stays empty
    cut_a = ranked.where(F.col("_rank") <= train).agg(F.coalesce(F.max("_h"), F.lit("")).alias("h")).scalar()
    cut_b = ranked.where(F.col("_rank") <= val).agg(F.coalesce(F.max("_h"), F.lit("")).alias("h")).scalar()
    return records.withColumn("split", F.when(key <= cut_a, "train").when(key <= cut_b, "val").otherwise("test"))


def split_leaks(split: DataFrame, group: str = "group_key") -> DataFrame:
    """Groups found in more than one split; must be empty."""
    return split.groupBy(group).agg(F.countDistinct("split").alias("splits")).where(F.col("splits") > 1)


def split_summary(split: DataFrame, group: str = "group_key") -> DataFrame:
    return split.groupBy("split", "task").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("groups"))


def _rendered(template: str, inputs: str, strict: bool) -> Column:
    parts: list[Column] = []
    for text, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
        if text:
            parts.append(F.lit(text))
        if name:
            value = F.element_at(F.col(inputs), name)
            missing = F.raise_error(F.lit(f"the template asks for {name!r}, which a record lacks")).cast("string") if strict else F.lit("")
            parts.append(F.coalesce(value, missing))
    return F.concat(*parts)


def render_messages(records: DataFrame, template: str, system: str | None = None, strict: bool = True, gold: bool = True) -> DataFrame:
    """Chat messages from one template; the gold answer closes training rows."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = [turn("system", F.lit(system))] if system else []
    turns.append(turn("user", _rendered(template, "inputs", strict)))
    if gold:
        turns.append(turn("assistant", F.col("target")))
    extra = [c for c in ("split",) if c in records.columns]
    return records.select("id", "task", *extra, F.array(*turns).alias("messages"))


def prompts_only(rendered: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages without the gold turn, optionally the first n by id."""
    out = rendered.withColumn("messages", F.filter("messages", lambda m: m["role"] != "assistant"))
    return out if limit is None else out.orderBy("id").limit(limit)


def length_report(rendered: DataFrame, by: str = "split") -> DataFrame:
    """Nearest-rank p50, p95 and max of the estimated lengths, per split.

    Rows are folded to one per distinct length first, so the ordered pass runs
    over the few distinct lengths, not over the rows.
    """
    chars = F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(m["content"]))
    rows = rendered.select(by, chars.alias("chars"))
    sizes = rows.select(by, F.explode(F.array(
        F.struct(F.lit("total").alias("kind"), token_estimate(F.col("chars")).alias("length")),
        F.struct(F.lit("prompt").alias("kind"), F.floor(F.col("chars") / 5).cast("bigint").alias("length")),
    )).alias("s")).select(by, "s.kind", "s.length")
    counts = sizes.groupBy(by, "kind", "length").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(by, "kind").orderBy("length")
    counts = counts.withColumns({"upto": F.sum("n").over(up), "total": F.sum("n").over(Window.partitionBy(by, "kind"))})

    def at(share: float) -> Column:
        place = F.bround((F.col("total") - 1) * share, 0)
        return F.min(F.when(F.col("upto") > place, F.col("length")))

    return counts.groupBy(by, "kind").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("length").alias("max"), F.max("total").alias("n"))


def suggested_length(report: DataFrame) -> DataFrame:
    """The largest p95, rounded up to the next usual length."""
    worst = F.max(F.when(F.col("kind") == "total", F.col("p95")))
    column = F.col("p95")
    rounded = None
    for size in LENGTH_BUCKETS:
        rounded = F.when(column <= size, size) if rounded is None else rounded.when(column <= size, size)
    return report.agg(worst.alias("p95")).withColumn("suggested", rounded.otherwise(column).cast("bigint"))
