"""Exact top-k by integer inner product: histograms first, rows last.

Components become ``floor(scale * x)``.  Queries and candidates are cut into
blocks, and every block of queries meets every block of candidates once a pass.
A pass scores everything and returns no scores but counts per query and score
bin.  The bin that holds a query's k-th best score is cut into finer bins, until
it is one score wide.  The last pass returns the rows above that score, and the
k smallest ids at it, from each pair of blocks; k rows per query are left after
one more ranking.  Scores are computed again in each pass: numbers are cheap,
storing queries times rows is not.

Scores are exact at any size of the components: in floating point where no sum
can round, in 64 bits where none can overflow, else in whole numbers of Python.
A score that does not fit 64 bits is an error, and so is a component whose
multiple by ``scale`` is no longer finite.

Defined results: a vector that is null, or holds a null or non-finite component,
takes no part.  Shorter vectors count as
padded with zeros.  Repeated rows are candidates each; a query's own row is not.
Two rows of one id are two queries.  An empty table gives no rows.  Ties go to
the smaller id, then to the earlier row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.session import checkpointed

BINS = 512
QUERY_BLOCK = 1024
ROW_BLOCK = 4096
NARROW = float(1 << 31)  # components below travel as 32-bit numbers
FITS = 9223372036854774784.0  # the largest double below 2**63
ALL = -1  # the width of a stretch that holds every score from its lowest on


def _quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``_id, _x, _row``: whole components as doubles, which hold them exactly."""
    x = F.col(vec_col).cast("array<double>")
    fit = F.forall(x, lambda v: F.coalesce((F.abs(v) < math.inf) & ~F.isnan(v), F.lit(False)))
    large = F.raise_error(F.lit("a component is too large to be scaled")).cast("double")

    def whole(v):
        y = v * F.lit(float(scale))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).when(F.abs(y) < math.inf, y).otherwise(large)

    rows = vectors.where(x.isNotNull()).withColumn("_fit", fit).where("_fit").select(F.col(id_col).cast("long").alias("_id"), F.transform(x, whole).alias("_x"))
    return checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``_ids, _rows, _dims, _wide, _flat``: runs of at most ``size`` rows of a partition, as bytes; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, nos, xs = part.column(0), part.column(1), part.column(2)
                matrix = _matrix(xs)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([null.astype("u1").tobytes()], pa.binary()),
                    pa.array([nos.to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                    pa.array([matrix.shape[1]], pa.int32()), pa.array([wide := bool(np.abs(matrix).max(initial=0) >= NARROW)], pa.bool_()),
                    pa.array([matrix.astype("<f8" if wide else "<i4").tobytes()], pa.binary()),
                ], ["_ids", "_nulls", "_rows", "_dims", "_wide", "_flat"])

    return rows.select("_id", "_row", "_x").mapInArrow(run, "_ids binary, _nulls binary, _rows binary, _dims int, _wide boolean, _flat binary")


def _matrix(lists: pa.Array) -> np.ndarray:
    lengths = np.diff(lists.offsets.to_numpy())
    dims = int(lengths.max()) if len(lengths) else 0
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def _scores(queries: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Integer inner products of whole components; those of a query and itself may be anything."""
    dims = min(queries.shape[1], rows.shape[1])
    q, r = queries[:, :dims], rows[:, :dims]
    tops = np.abs(q).max(1, initial=0)[:, None] * np.abs(r).max(1, initial=0)[None, :] * float(max(1, dims))
    # sums of products below 2**53 are exact in doubles
    out = np.rint(np.where(tops < 2**53, q @ r.T, 0)).astype(np.int64)
    left = np.argwhere((tops >= 2**53) & ~own)
    for i in np.unique(left[:, 0]):
        rest = left[left[:, 0] == i, 1]
        whole = tops[i, rest] < 2**62
        out[i, rest[whole]] = r[rest[whole]].astype(np.int64) @ q[i].astype(np.int64) if whole.any() else 0
        for j in rest[~whole].tolist():
            total = sum(int(x) * int(y) for x, y in zip(q[i].tolist(), r[j].tolist(), strict=True))
            if not -(2**63) <= total < 2**63:
                raise OverflowError(f"a score does not fit 64 bits: {total}")
            out[i, j] = total
    return out


def _query_blocks(queries: DataFrame, state: DataFrame | None, blocks: int) -> DataFrame:
    """One row per block of queries: their vectors with the stretch of scores each one looks at."""
    rows = queries if state is None else queries.join(state, "_row")
    packed = F.collect_list(F.struct("_row", "_id", "_low", "_width", "_step", "_x"))
    return rows.groupBy(F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_block")).agg(packed.alias("_q"))


def _pairs(blocks: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """Every block of rows next to every block of queries, by equality on the block number."""
    spread = blocks.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return spread.join(queries, "_block")


def _each_pair(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            one = {n: batch.column(n)[i] for n in batch.schema.names}
            nos = np.frombuffer(one["_rows"].as_py(), "<i8")
            rows = np.frombuffer(one["_flat"].as_py(), "<f8" if one["_wide"].as_py() else "<i4").reshape(len(nos), one["_dims"].as_py()).astype(np.float64)
            ids = np.frombuffer(one["_ids"].as_py(), "<i8")
            nulls = np.frombuffer(one["_nulls"].as_py(), "u1")
            q = one["_q"].values
            qno = q.field("_row").to_numpy(zero_copy_only=False)
            low, width, step = (q.field(n).to_numpy(zero_copy_only=False) for n in ("_low", "_width", "_step"))
            own = qno[:, None] == nos[None, :]
            yield qno, low, width, step, _scores(_matrix(q.field("_x")), rows, own), own, nos, ids, nulls


def _histogram(bins: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qno, low, width, step, scores, own, *_ in _each_pair(batches):
            # how far above the lowest, without overflow
            above = scores.view(np.uint64) - low.astype(np.int64).view(np.uint64)[:, None]
            at = above // step.astype(np.uint64)[:, None]
            beyond = (width[:, None] != ALL) & (above >= width.astype(np.uint64)[:, None])
            at = np.where(own | (scores < low[:, None]) | beyond, -1, at.astype(np.int64))
            flat = np.bincount(((at + 1) + np.arange(len(qno))[:, None] * (bins + 1)).ravel(), minlength=len(qno) * (bins + 1))
            cells = flat.reshape(len(qno), bins + 1)[:, 1:]
            query, cell = np.nonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(qno[query], pa.int64()), pa.array(cell.astype(np.int32)), pa.array(cells[query, cell].astype(np.int64))], ["_row", "_bin", "_n"])

    return count


def _winners(k: int):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qno, low, _, _, scores, own, nos, ids, nulls in _each_pair(batches):
            above = (scores > low[:, None]) & ~own
            query, row = np.nonzero(above)
            even_q, even_r = np.nonzero((scores == low[:, None]) & ~own)
            order = np.lexsort((nos[even_r], ids[even_r], nulls[even_r], even_q))
            even_q, even_r = even_q[order], even_r[order]
            first = np.r_[True, even_q[1:] != even_q[:-1]] if len(even_q) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(first, np.arange(len(even_q)), 0))
            few = np.arange(len(even_q)) - start < k
            query, row = np.r_[query, even_q[few]], np.r_[row, even_r[few]]
            yield pa.RecordBatch.from_arrays([
                pa.array(qno[query], pa.int64()), pa.array(nos[row], pa.int64()),
                pa.array(ids[row], pa.int64(), mask=nulls[row].astype(bool)), pa.array(scores[query, row], pa.int64()),
            ], ["_row", "_found", "_found_id", "score"])

    return pick


def top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
    bins: int = BINS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the k best rows of every query, against all rows but its own.

    ``is_query`` is a condition on the id column.  Fewer than k candidates are returned all.
    """
    rows = _quantised(vectors, id_col, vec_col, scale)
    queries = rows.withColumnRenamed("_id", id_col).where(is_query).withColumnRenamed(id_col, "_id")
    blocks = _blocks(rows, row_block)
    asked, total = queries.count(), rows.count()
    count = max(1, math.ceil(asked / query_block))
    largest = rows.agg(F.max(F.array_max(F.transform("_x", lambda v: F.abs(v)))).alias("_m")).collect()[0]["_m"] or 0.0
    # |score| <= bound for each query, from its own components and the largest one of all rows
    bound = F.ceil(F.least(F.aggregate("_x", F.lit(0.0), lambda a, v: a + F.abs(v)) * F.lit(largest) * (1 + 1e-9) + 1, F.lit(FITS)))
    low = F.when(bound < F.lit(int(FITS)), -bound).otherwise(F.lit(-(2**63)))
    step = F.floor(bound / (bins // 2)).cast("long") + 2
    start = queries.select("_row", low.alias("_low"), F.lit(ALL).cast("long").alias("_width"), step.alias("_step"), F.least(F.lit(k), F.lit(total - 1)).cast("long").alias("_need"))
    state = checkpointed(start)
    widest = (state.agg(F.max("_step")).collect()[0][0] or 1) if asked else 0
    while widest >= 1:
        pairs = _pairs(blocks, _query_blocks(queries, state, count), count)
        cells = pairs.mapInArrow(_histogram(bins), "_row long, _bin int, _n long").groupBy("_row", "_bin").agg(F.sum("_n").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_row").orderBy(F.desc("_bin")))
        hit = cells.withColumn("_upto", upto).join(state, "_row").where(F.col("_upto") >= F.col("_need"))
        hit = hit.groupBy("_row", "_low", "_width", "_step", "_need").agg(F.max_by(F.struct("_bin", "_upto", "_n"), "_bin").alias("_c"))
        low = (F.col("_low").cast("decimal(20,0)") + F.col("_c._bin").cast("decimal(10,0)") * F.col("_step").cast("decimal(20,0)")).cast("long")
        state = checkpointed(hit.select(
            "_row", low.alias("_low"), F.col("_step").alias("_width"), F.expr(f"(_step - 1) div {bins} + 1").alias("_step"),
            (F.col("_need") - (F.col("_c._upto") - F.col("_c._n"))).alias("_need")))
        widest = -(-widest // bins) if widest > 1 else 0
    found = _pairs(blocks, _query_blocks(queries, state, count), count).mapInArrow(_winners(k), "_row long, _found long, _found_id long, score long")
    order = Window.partitionBy("_row").orderBy(F.desc("score"), F.asc_nulls_last("_found_id"), "_found")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(queries.select("_row", F.col("_id").alias("query_id")), "_row").select("query_id", F.col("rank").cast("int"), F.col("_found_id").alias(id_col), "score")
