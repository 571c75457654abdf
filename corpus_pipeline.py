"""The training-data pipeline over ``documents``: quality, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of the documents.  A stage first deletes the steps of the
stages before it, whose results are written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finframe.llm import neardup, packing, pii, quality
from finframe.llm.bitmaps import marked
from finframe.llm.queries import WORD_BPE
from finframe.session import checkpointed, clear_steps, steps

_BEGUN: list[str] = []


def _stage(run: Callable) -> Callable:
    name = f"stage-{run.__name__}"
    _BEGUN.append(name)

    @wraps(run)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for earlier in _BEGUN[: _BEGUN.index(name)]:
            clear_steps(spark, earlier)
        with steps(name):
            return run(spark, docs, sf_dir)

    return staged


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.judge(docs, carry_text=True).where("kept").select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest id; documents without words stay.

    Rows are told apart by hashes of all their columns, so nothing rests on their
    order: of rows that are equal in every column any one may stay.  Rows that
    surely stay are not shuffled.
    """
    columns, marks = docs.columns, ["_near_mark", "_near_mark_2"]
    named = docs.withColumns({marks[0]: F.xxhash64(*columns), marks[1]: F.xxhash64(F.lit(1), *columns)})
    rows = neardup.near_duplicates(named, carry=marks)
    # of equal rows with words one may stay, of equal rows without words all do
    seen = rows.groupBy(*marks).agg(F.max("first_row").alias("_stays"), F.min("first_row").alias("_all"))
    odd = checkpointed(seen.where(~F.col("_all")).drop("_all"))
    flagged = marked(named, odd, marks[0], "_maybe")
    doubtful = flagged.where("_maybe").join(odd, marks, "left")
    clean = flagged.where(~F.col("_maybe")).unionByName(doubtful.where(F.col("_stays").isNull()).select(*flagged.columns))
    return clean.unionByName(doubtful.where("_stays").dropDuplicates(marks).select(*flagged.columns)).select(*columns)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind and ``n_chars`` counted anew."""
    clean = pii.find(docs).withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their sequence and place."""
    pieces = packing.token_pieces(docs, WORD_BPE)
    placed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]

#: Tokens and near-duplicates go beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
