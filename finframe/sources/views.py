"""Rate, price, article and question views derived from the given tables.

The given tables hold no rate, price or article data, so these views give the
operators frames of that shape.  Each view has one row per key and day, which
bounds a key's series by the number of calendar days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# The columns of the given tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read without inferring its columns."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly level per order priority, in whole basis points."""
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_key"), F.trunc("o_orderdate", "month").alias("effective_date"))
        .agg(F.sum(_cents("o_totalprice")).alias("cents"), F.count(F.lit(1)).alias("n"))
        .select("series_key", "effective_date", F.expr("((cents div n) div 2000000) * 25").alias("target_bp"))
    )
    # one row per series and month, so a series is a bounded window
    by_day = Window.partitionBy("series_key").orderBy("effective_date")
    change = F.col("target_bp") - F.lag("target_bp").over(by_day)
    return monthly.withColumn("change_bp", F.coalesce(change, F.lit(0)).cast("bigint"))


def rates_for_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series moved by twenty years, into the span of the articles."""
    return rates(spark, sf_dir).withColumn("effective_date", F.add_months("effective_date", 240))


def _event_bars(spark: SparkSession, sf_dir: str, ticker: Column) -> DataFrame:
    when = F.struct("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy(ticker.cast("string").alias("ticker"), F.to_date("ts").alias("date"))
        .agg(
            F.min_by("value", when).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", when).alias("close"),
            F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("volume"),
        )
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_bars(spark, sf_dir, F.col("event_type"))


def prices_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_bars(spark, sf_dir, F.col("user_id"))


def prices_big(spark: SparkSession, sf_dir: str, shift_years: int = 0) -> DataFrame:
    """Bars per part brand."""
    price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100.0
    # rows that tie on all of these have the same price, so the first and last price are fixed
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "price")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    lines = table(spark, sf_dir, "lineitem")
    return (
        lines.withColumn("price", price)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("ticker", F.add_months(F.to_date("l_shipdate"), 12 * shift_years).alias("date"))
        .agg(
            F.min(at).getField("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max(at).getField("price").alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"),
        )
    )


def prices_for_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices_big(spark, sf_dir, shift_years=20)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2015-01-01").cast("date"), F.pmod("doc_id", F.lit(2555)).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.substring_index("text", "\n", 1).alias("headline"),
        F.col("source").alias("subhead"),
        F.col("lang").alias("intro"),
        "text",
        day.alias("publication_date"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
    )


def articles_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles as text columns, with some publication dates left empty."""
    stamp = F.date_format("publication_date", "yyyyMMdd")
    return articles(spark, sf_dir).select(
        "article_id", "headline", "subhead", "intro", "text",
        F.when(F.col("article_id") % 97 == 0, "").otherwise(stamp).alias("publication_date"),
    )


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn with the assistant turn after it; the target states a level and a date."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    told = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said")
    )
    number = F.pmod(F.col("conv_id") * 37 + F.col("turn") * 11, F.lit(800))
    level = F.format_string("%d.%02d", F.floor(number / 100), F.pmod(number, F.lit(100)))
    day = F.date_add(F.lit("2015-01-01").cast("date"), number.cast("int"))
    # every word of the answer is a fact, next to its level and day
    words = F.array_sort(F.array_distinct(F.split("said", " ")))
    return asked.join(told, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.element_at(F.array(F.lit("rate"), F.lit("price"), F.lit("article")), (F.col("conv_id") % 3 + 1).cast("int")).alias("task"),
        "prompt",
        F.concat(F.col("said"), F.lit(" The level was "), level, F.lit("% on "), F.date_format(day, "d MMMM yyyy"), F.lit(".")).alias("target"),
        F.concat(words, F.array(F.rtrim(level, F.lit("0")), day.cast("string"))).alias("components"),
        F.col("conv_id").cast("string").alias("group_key"),
        number.alias("number"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three answer sets for every question: the prompt, a cut target, the target."""
    cut = F.expr("substring(target, 1, cast(floor(length(target) * 0.6) as int))")
    variants = F.array(
        F.struct(F.lit("base").alias("label"), F.lit(0).cast("bigint").alias("step"), F.concat(F.lit("I will answer. "), F.col("prompt")).alias("prediction")),
        F.struct(F.lit("step-100").alias("label"), F.lit(100).cast("bigint").alias("step"), cut.alias("prediction")),
        F.struct(F.lit("step-200").alias("label"), F.lit(200).cast("bigint").alias("step"), F.col("target").alias("prediction")),
    )
    return (
        qa(spark, sf_dir)
        .withColumn("v", F.explode(variants))
        .select("v.label", "v.step", "id", "v.prediction", (F.pmod(F.col("number") + F.col("v.step"), F.lit(400))).cast("double").alias("seconds"))
    )


def spread(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """The rows dealt to ``parts`` tasks (the cluster's cores by default) by a key.

    For work on each row that outweighs moving it, over files that few tasks can
    read, such as a table of one row group.
    """
    return rows.repartition(parts or rows.sparkSession.sparkContext.defaultParallelism, key)
