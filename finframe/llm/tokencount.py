"""Token counts of flat, unindexed token files by a scan for separators.

A flat file holds the ids of one document after the other as big-endian 16-bit
numbers, each document followed by a separator id, and nothing else.  Files are
read as bytes and cut into blocks of a fixed size; each block is searched for
the separator with one vectorised comparison.  A document may begin in one block
and end in another: a prefix scan over one small row per block (the running
count of separators and the place of the last one) tells every block which
document it opens with and where that one began.

Files are written by Spark's text writer, whose line separator is the last byte
of the separator id, so any store that Spark reaches will do.  Spark's reader
for binary files takes a file as one row, of 2 GB at most; ``write_flat`` writes
one file per task.

Defined results: an empty document (or a null text) counts 0 tokens; tokens
after the last separator are a last document that is not closed; an empty file,
or none, gives no rows; a file of an odd number of bytes is an error, and so is
an id that 16 bits do not hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finframe.llm.tokens import byte_ids, portions
from finframe.session import checkpointed

SEPARATOR = 50256
BLOCK = 1 << 20  # bytes


def narrowed(ids: np.ndarray) -> bytes:
    """Ids as big-endian 16-bit numbers; an id that does not fit is an error."""
    if len(ids) and ids.max() >= 1 << 16:
        raise OverflowError(f"the id {ids.max()} does not fit 16 bits")
    return ids.astype(">u2").tobytes()


def write_flat(docs: DataFrame, folder: str, tokenizer_path: str, *, text_col: str = "text", separator: int = SEPARATOR) -> None:
    """Write the documents' ids as flat files, one per partition, in the order of the rows.

    Special strings in a text are plain text, so no document holds the separator.
    """
    high, low = divmod(separator, 256)
    if low > 127:
        raise ValueError("the low byte of the separator id must be an ASCII character")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_ids(tokenizer_path, False).encode_all
        for batch in portions(batches, text_col):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            ids = [narrowed(np.frombuffer(i, np.uint32)) + bytes([high]) for i in encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    rows = docs.select(F.col(text_col)).mapInArrow(flat, "ids binary")
    rows.select(F.col("ids").cast("string")).write.option("lineSep", chr(low)).option("compression", "none").text(folder)


def manifest(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``part, doc, <id_col>``: which document is which in the files that ``write_flat`` made of the same table."""
    place = F.monotonically_increasing_id()
    return docs.select(F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("doc"), id_col)


def _search(separator: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for block in batch.column("_bytes"):
                ids = np.frombuffer(block.as_buffer(), ">u2")
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == separator).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["file", "block", "n", "seps"])

    return search


def count_tokens(spark: SparkSession, folder: str, *, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """``file, doc, start, n_tokens, closed`` per document, ``doc`` from 0 and ``start`` in ids from the file's begin."""
    files = spark.read.format("binaryFile").load(folder)
    even = F.when(F.col("length") % 2 == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("odd number of bytes in "), F.col("path"))).cast("long"))
    blocks = files.where("length > 0").select(
        F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((even - 1) / block))).alias("block"))
    blocks = blocks.select("file", "block", F.substring("content", (F.col("block") * block + 1).cast("int"), block).alias("_bytes"))
    blocks = checkpointed(blocks.mapInArrow(_search(separator), "file string, block long, n long, seps array<int>"))

    half = block // 2
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slim = blocks.select("file", "block", "n", F.size("seps").alias("_found"), (F.col("block") * half + F.array_max("seps")).alias("_last"))
    scan = slim.select(
        "file", "block", F.coalesce(F.sum("_found").over(before), F.lit(0)).alias("_docs"), F.coalesce(F.max("_last").over(before) + 1, F.lit(0)).alias("_open"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("_ends"))
    stitched = blocks.join(scan, ["file", "block"])
    at = F.transform("seps", lambda s: F.col("block") * half + s)
    last = F.when(F.col("_ends"), F.col("block") * half + F.col("n"))
    # each document ends at a separator; what follows a file's last one ends with the file
    ends = F.concat(F.transform(at, lambda a: F.struct(a.alias("end"), F.lit(True).alias("closed"))), F.when(
        last.isNotNull(), F.array(F.struct(last.alias("end"), F.lit(False).alias("closed")))).otherwise(F.array().cast("array<struct<end:bigint,closed:boolean>>")))
    starts = F.concat(F.array("_open"), F.transform(at, lambda a: a + 1))
    pairs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e["end"].alias("end"), e["closed"].alias("closed")))
    docs = stitched.select("file", "_docs", F.posexplode(F.filter(pairs, lambda p: p["end"].isNotNull())).alias("_i", "_d"))
    docs = docs.where(F.col("_d.closed") | (F.col("_d.end") > F.col("_d.start")))
    return docs.select("file", (F.col("_docs") + F.col("_i")).alias("doc"), F.col("_d.start").alias("start"), (F.col("_d.end") - F.col("_d.start")).alias("n_tokens"), F.col("_d.closed").alias("closed"))


def part_of(file):
    """The number of the task that wrote a file."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("int")
