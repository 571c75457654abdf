"""Tolerant readers and partitioned writers: raw text files to typed Parquet.

Every reader passes an explicit schema, keeps what it cannot parse as rejects,
and leaves counting to ``ingest_report``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finframe.functions.scalars import NORMAL_DATE_FORMATS, iso, parse_date, pct_to_bp
from finframe.operators.ordering import row_numbers
from finframe.session import checkpointed


def _text_schema(names: Sequence[str], corrupt: str | None = None) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in names]
    return T.StructType(fields + ([T.StructField(corrupt, T.StringType())] if corrupt else []))


def split_rejects(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) rows; a condition that is NULL keeps the row."""
    flag = F.coalesce(bad, F.lit(False))
    return df.where(~flag), df.where(flag)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names of the first line, as Spark reads them; folder columns are not among them."""
    named = spark.read.option("header", True).option("encoding", "UTF-8").csv(path).columns
    folders = {f.split("=", 1)[0] for f in path_parts(spark, path)}
    return [n.lstrip("\ufeff").strip() for n in named if n not in folders]


def path_parts(spark: SparkSession, path: str) -> list[str]:
    """``name=value`` parts of the folders below a path, from one of its files."""
    files = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path).select("path").limit(1).collect()
    return [p for r in files for p in r["path"].split("/") if "=" in p]


def csv_text(spark: SparkSession, path: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """CSV fields as text; extra fields of ragged lines are dropped and such lines listed."""
    reader = spark.read.schema(_text_schema(names, "_line")).option("columnPruning", "false")
    rows = reader.csv(path, header=True, encoding="UTF-8", mode="PERMISSIVE", columnNameOfCorruptRecord="_line", enforceSchema=True)
    # the reader only judges lines whose fields are read too, so the filter names them all
    ragged = rows.where(F.col("_line").isNotNull() & (F.length(F.concat_ws(",", "_line", *names)) > 0)).select(F.col("_line").alias("line"))
    return rows.drop("_line"), ragged


def csv_by_name(spark: SparkSession, path: str, columns: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, ragged lines) of files that each name their columns in their own order.

    ``columns`` maps names in the files to names in the rows.  The first line of
    every file is a row of its own here, joined back to the file's lines, so
    fields are bound by name and file.  Columns that are not asked for are
    dropped, and so are the extra fields of ragged lines, whose number of fields
    differs from their header's.  Quoted fields may not hold line ends.
    """
    scan = spark.read.text(path)
    folders = [c for c in scan.columns if c != "value"]
    # the lines of one file come in order, and only its first block holds its first line
    lines = scan.select(
        "*", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") == 0).alias("_top"),
        F.monotonically_increasing_id().alias("_line")).where(F.trim("value") != "")
    first = lines.where("_top").groupBy("_file").agg(F.min(F.struct("_line", "value")).alias("_h"))
    commas = F.regexp_replace("value", '"(?:[^"]|"")*"', "")
    fields = F.length(commas) - F.length(F.regexp_replace(commas, ",", "")) + 1
    headers = checkpointed(first.select("_file", F.col("_h.value").alias("value"), F.col("_h._line").alias("_first")).withColumn("_width", fields))
    width = headers.agg(F.max("_width")).collect()[0][0] or 1

    def cells(line: Column) -> Column:
        row = F.from_csv(line, ", ".join(f"c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
        return F.array(*[row[f"c{i}"] for i in range(width)])

    names = F.transform(cells(F.regexp_replace("value", "^\ufeff", "")), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    headers = headers.select("_file", "_first", "_width", names.alias("_names"))
    missing = F.filter(F.array(*[F.lit(c) for c in columns]), lambda c: ~F.array_contains("_names", c))
    lacking = headers.where(F.size(missing) > 0).select("_file", missing.alias("m")).limit(1).collect()
    if lacking:
        raise ValueError(f"the file {lacking[0]['_file']} lacks the columns {lacking[0]['m']}")
    body = lines.join(headers, "_file").where(F.col("_line") != F.col("_first"))
    held = body.withColumn("_cells", cells(F.col("value")))
    rows = held.select(*folders, *[F.element_at("_cells", F.array_position("_names", F.lit(c)).cast("int")).alias(n) for c, n in columns.items()])
    return rows, body.where(fields != F.col("_width")).select(*folders, F.col("value").alias("line"))


# The columns of the raw decision file.
RATE_COLUMNS = {"Effective Date": "day", "Change % points": "change", "Cash rate target%": "level"}


def rates_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, ragged lines) of decision files, with the columns of each file found by their names in any order."""
    return csv_by_name(spark, path, RATE_COLUMNS)


def read_rates_csv(spark: SparkSession, path: str, series_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Decision series with day, signed change and level columns, as whole basis points.

    Without a key, ``path`` holds one ``series_key=...`` folder per series.
    ``rates_text`` lists the ragged lines.
    """
    rows, _ = rates_text(spark, path)
    key = F.lit(series_key) if series_key else F.col("series_key").cast("string")
    typed = rows.select(
        key.alias("series_key"), parse_date(F.col("day")).alias("effective_date"),
        pct_to_bp(F.col("level").try_cast("double")).alias("target_bp"),
        F.coalesce(pct_to_bp(F.col("change").try_cast("double")), F.lit(0)).alias("change_bp"),
    )
    return split_rejects(typed, F.col("effective_date").isNull() | F.col("target_bp").isNull())


def read_prices_json(spark: SparkSession, path: str, name_marker: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Price bars from JSON lines, files united by column name.

    A volume that is no whole number turns NULL.  With ``name_marker`` a missing
    ticker is taken from the file name up to the marker.
    """
    schema = _text_schema(["date", "open", "high", "low", "close", "volume", "ticker"])
    rows = spark.read.schema(schema).json(path)
    ticker = F.col("ticker")
    if name_marker:
        ticker = F.coalesce(ticker, F.upper(F.substring_index(F.col("_metadata.file_name"), name_marker, 1)))
    # a whole number may be written with decimals
    volume = F.coalesce(F.col("volume").try_cast("bigint"), F.col("volume").try_cast("double").try_cast("bigint"))
    typed = rows.select(
        ticker.alias("ticker"), parse_date(F.col("date")).alias("date"),
        *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"),
    )
    return split_rejects(typed, F.col("date").isNull() | F.col("ticker").isNull())


# The keys of the raw article lines.
ARTICLE_KEYS = ("HEADLINE", "SUBHEAD", "INTRO", "TEXT", "NEWSPAPER", "PUBLICATIONDATE")


def read_articles_json(spark: SparkSession, path: str, extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Articles from JSON lines with upper-case keys; rows without a readable day are rejects."""
    rows = spark.read.schema(_text_schema([*ARTICLE_KEYS, *extra])).json(path)
    day = F.try_to_date(F.trim("PUBLICATIONDATE"), "yyyyMMdd")
    typed = rows.select(
        *[F.col(k).alias(k.lower()) for k in ARTICLE_KEYS if k != "PUBLICATIONDATE"], *[F.col(e).alias(e.lower()) for e in extra],
        day.alias("publication_date"), F.year(day).alias("year"), F.month(day).alias("month"), F.col("PUBLICATIONDATE").alias("raw_date"),
    )
    kept, bad = split_rejects(typed, F.col("publication_date").isNull())
    return kept.drop("raw_date"), bad


def with_article_ids(articles: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Ids 1..n by day and headline; identical rows may still be cut apart between tasks."""
    rest = ties or [c for c in articles.columns if c not in ("publication_date", "headline")]
    order = [F.col(c).asc_nulls_last() for c in ("publication_date", "headline", *rest)]
    return row_numbers(articles, order, name="article_id", copies=True)


def with_all_text(articles: DataFrame) -> DataFrame:
    """The searched text kept next to the articles, so counts need not join the fields again."""
    from finframe.operators.text import all_text

    return articles.withColumn("all_text", all_text(articles))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, optionally by partition columns.

    Rebalancing groups a partition's rows into few files and splits a partition
    that is too large for one task.  A rerun replaces the partitions it writes.
    """
    writer = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def in_parts(df: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """Adds ``<key>_part``, a number below ``parts`` that the key decides, to partition by where keys are many.

    A folder per key would hold a few rows, and the folders would grow with the
    keys.  A rerun replaces whole parts, so it must hold all keys of a part.
    """
    return df.withColumn(f"{key}_part", part_of(F.col(key), parts))


def part_of(key: Column, parts: int = 64) -> Column:
    """The part of a key; a filter on it reads that key's folder alone."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Partitioned Parquet with its partition columns typed by the schema, not guessed."""
    return spark.read.schema(schema).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def normalise_dates(df: DataFrame, formats: Sequence[str] = NORMAL_DATE_FORMATS) -> tuple[DataFrame, DataFrame]:
    """Every text column with ``date`` in its name as ISO, and the values no format fits.

    Such values stay as they are; empty ones are no rejects.
    """
    names = [f.name for f in df.schema.fields if "date" in f.name.lower() and isinstance(f.dataType, T.StringType)]
    fixed = df.withColumns({n: F.coalesce(iso(parse_date(F.col(n), formats)), F.col(n)) for n in names})
    unread = F.array(*[
        F.when((F.trim(n) != "") & parse_date(F.col(n), formats).isNull(), F.struct(F.lit(n).alias("column"), F.trim(n).alias("value"))) for n in names
    ]).cast("array<struct<column:string,value:string>>")
    # one scan for all columns
    return fixed, df.select(F.inline(F.array_compact(unread)))


def _json_value(column: str) -> Column:
    text = F.trim(F.col(column))
    quoted = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    whole = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    number = F.regexp_replace(F.to_json(F.array(text.try_cast("double"))), r"^\[|\]$", "")
    return (
        F.when(text.isNull() | (text == ""), "null")
        .when(text.rlike(r"^[+-]?\d+$"), whole)
        .when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number)
        .otherwise(quoted)
    )


def csv_to_jsonl(spark: SparkSession, source: str, target: str, constants: dict[str, str] | None = None) -> None:
    """CSV to JSON lines; each value is a whole number, a number, text or null by its own form."""
    rows = spark.read.csv(source, header=True, encoding="UTF-8")
    fields = [F.concat(F.lit(f'"{c.strip()}": '), _json_value(c)) for c in rows.columns]
    for name, value in (constants or {}).items():
        fields.append(F.concat(F.lit(f'"{name}": '), F.regexp_replace(F.to_json(F.array(F.lit(value))), r"^\[|\]$", "")))
    rows.select(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")).alias("value")).write.mode("overwrite").text(target)


def ticker_aliases(names: DataFrame, suffix: str = ".AX") -> DataFrame:
    """``names(company, ticker)`` as one row per accepted spelling."""
    full = F.upper("ticker")
    spellings = F.array(F.upper("company"), full, F.regexp_replace(full, rf"\{suffix}$", ""))
    return names.select(F.explode(F.array_distinct(spellings)).alias("alias"), "ticker").where(F.col("alias") != "").distinct()


def resolve_tickers(requests: DataFrame, aliases: DataFrame, name: str, suffix: str = ".AX") -> DataFrame:
    """Company names, full or bare codes to tickers; NULL where no alias fits."""
    key = F.regexp_replace(F.upper(F.trim(name)), rf"\{suffix}$", "")
    found = aliases.groupBy("alias").agg(F.min("ticker").alias("ticker"))
    return requests.withColumn("alias", key).join(found, "alias", "left").drop("alias")


def read_records(spark: SparkSession, path: str, schema: T.StructType, list_key: str | None = None) -> DataFrame:
    """Rows from JSON lines, from one JSON list, or from the list under a key of one JSON object."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    if list_key is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    wrapped = T.StructType([T.StructField(list_key, T.ArrayType(schema))])
    return spark.read.schema(wrapped).json(path, multiLine=True).select(F.inline(list_key))


GRADING_SCHEMA = """id string, difficulty string, prompt string, question string, reference_answer string, answer string,
 grading struct<components: array<struct<component_id: string, expected_fact: string, points: double>>, tolerance_note: string>,
 grading_components array<string>"""


def grading_cases(rows: DataFrame) -> DataFrame:
    """Rich or flat grading rows in one shape; a flat component is worth one point."""
    flat = F.transform(
        "grading_components", lambda x, i: F.struct(F.format_string("C%02d", i + 1).alias("component_id"), x.alias("expected_fact"), F.lit(1.0).alias("points"))
    )
    return rows.select(
        F.coalesce("id", F.coalesce("prompt", "question")).alias("id"), "difficulty", F.coalesce("prompt", "question").alias("question"),
        F.coalesce("reference_answer", "answer").alias("reference_answer"),
        F.coalesce("grading.components", flat).alias("components"), F.col("grading.tolerance_note").alias("tolerance_note"),
    )


def ingest_report(df: DataFrame, required: Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct keys, and NULLs per required column; a column that is all NULL was missing."""
    aggs = [F.count(F.lit(1)).alias("row_count"), *[F.countDistinct(c).alias(f"{c}_distinct") for c in distinct]]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in required]
    out = df.agg(*aggs)
    empty = [F.when(F.col(f"{c}_nulls") == F.col("row_count"), c) for c in required]
    return out.withColumn("missing", F.concat_ws(", ", *empty))
