"""Nearest neighbours by a block matrix join: int8 tiles first, floats for what survives.

Queries are dealt to blocks and candidates to stripes; a cell is one block with
one stripe, and rows reach their cells by equality.  A cell holds its queries
and streams its candidates past them, so its memory does not depend on the size
of a stripe.  A tile is a few hundred queries by a few thousand candidates: both
are coded as ``x = scale * code + rest`` with codes of 8 bits, and the product
of the codes gives every inner product but for an error of at most
``|q| * |rest_c| + |rest_q| * |scale_c * code_c|`` (Cauchy-Schwarz).  A pair
whose upper bound lies below the k-th best of its query so far (or below the
k-th best lower bound of the tile) goes no further.  Survivors are computed
again in double precision and kept in one heap per query; the heaps of a query's
cells are merged last.  Nothing is approximate in the result: the bounds hold.

Of equal vectors only the ``k + 1`` with the smallest ids can be in an answer
(one of them may be the query itself), so the others are no candidates.

Defined results: a vector that is null, empty, all zero, or holds a null or
non-finite component takes no part.  Shorter vectors count as padded with zeros.
Repeated rows are candidates each; a query's own row is not.  Two rows of one id
are two queries.  Ties go to the smaller id, null ids last, then to the earlier
row.  The score is the sum of products from the first component to the last.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.session import checkpointed

QUERY_BLOCK = 16_384  # queries a cell holds
TILE_QUERIES, TILE_ROWS = 512, 2048
EXACT_DIMS = 1024  # products of codes add up exactly in single precision up to here
PAIRS = 1 << 16  # survivors computed at a time
SLACK = 1e-9  # of the norms' product; far above what rounding can do to either side


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of doubles, padded with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    dims = int(lengths.max()) if len(lengths) else 0
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = values
    return out


class Coded:
    """Vectors with their 8-bit codes and the norms that bound the error of a product of codes."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.scale = np.abs(x).max(1, initial=0) / 127
        codes = np.rint(x / np.maximum(self.scale, np.finfo(float).tiny)[:, None])
        self.codes = np.clip(codes, -127, 127).astype(np.int8)
        back = self.codes * self.scale[:, None]
        self.norm, self.back, self.rest = (np.sqrt((v * v).sum(1)) for v in (x, back, x - back))

    def part(self, rows: slice) -> Coded:
        out = object.__new__(Coded)
        for name, value in vars(self).items():
            setattr(out, name, value[rows])
        return out


def tile_bounds(q: Coded, c: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of a tile."""
    dims = min(q.codes.shape[1], c.codes.shape[1])
    near = np.zeros((len(q.x), len(c.x)))
    for at in range(0, dims, EXACT_DIMS):
        to = min(dims, at + EXACT_DIMS)
        near += q.codes[:, at:to].astype(np.float32) @ c.codes[:, at:to].astype(np.float32).T
    near *= q.scale[:, None]
    near *= c.scale[None, :]
    off = q.norm[:, None] * (c.rest + SLACK * c.norm)[None, :]
    off += q.rest[:, None] * c.back[None, :]
    return near - off, near + off


def products(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed from the first component to the last."""
    out = np.empty(len(i))
    dims = min(q.shape[1], c.shape[1])
    for at in range(0, len(i), PAIRS):
        x, y = q[i[at : at + PAIRS], :dims].T, c[j[at : at + PAIRS], :dims].T
        total = np.zeros(x.shape[1])
        for k in range(dims):
            total += x[k] * y[k]
        out[at : at + PAIRS] = total
    return out


class Cell:
    """One block of queries and, per query, a heap of its k best candidates so far."""

    def __init__(self, k: int, rows: np.ndarray, x: np.ndarray):
        self.k, self.rows, self.q = k, rows, Coded(x)
        # the root of a heap is its worst entry: lowest score, then no id, then the largest id, then the latest row
        self.heaps: list[list] = [[] for _ in rows]
        self.worst = np.full(len(rows), -np.inf)

    def meet(self, rows: np.ndarray, ids: np.ndarray, null: np.ndarray, x: np.ndarray) -> None:
        coded = Coded(x)
        for at in range(0, len(rows), TILE_ROWS):
            part = slice(at, at + TILE_ROWS)
            c = coded.part(part)
            for first in range(0, len(self.rows), TILE_QUERIES):
                self._tile(slice(first, first + TILE_QUERIES), c, rows[part], ids[part], null[part])

    def _tile(self, part: slice, c: Coded, rows: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        q, worst = self.q.part(part), self.worst[part]
        low, high = tile_bounds(q, c)
        own = self.rows[part][:, None] == rows[None, :]
        low[own], high[own] = -np.inf, -np.inf
        new = np.flatnonzero(np.isneginf(worst))
        if len(new) and low.shape[1] > self.k:
            worst = worst.copy()
            worst[new] = np.partition(low[new], -self.k, axis=1)[:, -self.k]
        # a bound that is no number (components near the largest double) rules nothing out
        i, j = np.nonzero(~(high < worst[:, None]) & ~own)
        if not len(i):
            return
        score = products(q.x, c.x, i, j)
        score[np.isnan(score)] = -np.inf
        good = score >= self.worst[part][i]
        i, j, score = i[good], j[good], score[good]
        order = np.lexsort((rows[j], ids[j], null[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        start = np.searchsorted(i, i)
        few = np.arange(len(i)) - start < self.k  # no more than k of a tile can stay
        for n, s, none, d, r in zip((i[few] + part.start).tolist(), score[few].tolist(), null[j[few]].tolist(), ids[j[few]].tolist(), rows[j[few]].tolist(), strict=True):
            heap, entry = self.heaps[n], (s, not none, -d, -r)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        for n in set((i[few] + part.start).tolist()):
            if len(self.heaps[n]) == self.k:
                self.worst[n] = self.heaps[n][0][0]

    def results(self) -> pa.RecordBatch:
        """One row per query: its candidates, best first."""
        best = [sorted(h, reverse=True) for h in self.heaps]
        return pa.RecordBatch.from_arrays([
            pa.array(self.rows, pa.int64()),
            pa.array([[{"score": s, "id": -d if known else None, "row": -r} for s, known, d, r in b] for b in best], _BEST),
        ], ["_row", "_best"])


_BEST = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64()), ("row", pa.int64())]))
_BEST_SQL = "array<struct<score: double, id: bigint, row: bigint>>"


def _cells(k: int):
    """The rows of cells, each cell's queries in front of its candidates, to the best candidates of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_no, waiting, cell = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, asks = batch.column("_cell").to_numpy(), batch.column("_asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1]), True])
            for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(at, end - at)
                if cells[at] != cell_no:
                    if cell is not None:
                        yield cell.results()
                    cell_no, waiting, cell = cells[at], [], None
                if asks[at]:
                    waiting.append(part)
                    continue
                if waiting:
                    queries = pa.Table.from_batches(waiting).combine_chunks()
                    cell, waiting = Cell(k, queries.column("_row").to_numpy(), matrix(queries.column("_x").chunk(0))), []
                if cell is not None:
                    ids = part.column("_id")
                    cell.meet(part.column("_row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), matrix(part.column("_x")))
        if cell is not None:
            yield cell.results()

    return run


def _merged(k: int):
    def order(entry: dict) -> tuple:
        return -entry["score"], entry["id"] is None, entry["id"] or 0, entry["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [list(islice(heapq.merge(*runs, key=order), k)) for runs in batch.column("_runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(best, _BEST)], ["_row", "_best"])

    return run


def vectors_of(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``_id, _x, _row`` of the vectors that take part, written once so that row numbers stand."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: F.coalesce((F.abs(v.cast("double")) < F.lit(math.inf)) & ~F.isnan(v.cast("double")), F.lit(False)))
    some = F.exists(x, lambda v: v != 0)
    rows = vectors.where(x.isNotNull()).where(finite & some)
    return checkpointed(rows.select(F.col(id_col).cast("long").alias("_id"), x.alias("_x")).withColumn("_row", F.monotonically_increasing_id()))


def nearest(
    vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the k rows of largest inner product with every query, but its own.

    ``is_query`` is a condition on the id column.  Fewer than k candidates are returned all.
    """
    spark = vectors.sparkSession
    rows = vectors_of(vectors, id_col, vec_col)
    queries = rows.withColumnRenamed("_id", id_col).where(is_query).withColumnRenamed(id_col, "_id")
    blocks = max(1, math.ceil(queries.count() / query_block))
    stripes = max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / blocks))

    alike = Window.partitionBy("_x").orderBy(F.asc_nulls_last("_id"), "_row")
    able = rows.withColumn("_nth", F.row_number().over(alike)).where(F.col("_nth") <= k + 1)

    block, stripe = F.pmod(F.xxhash64("_row"), F.lit(blocks)), F.pmod(F.xxhash64("_row"), F.lit(stripes))
    asked = queries.select("_row", "_id", "_x", F.lit(True).alias("_asks"), block.alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("_stripe"))
    met = able.select("_row", "_id", "_x", F.lit(False).alias("_asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), stripe.alias("_stripe"))
    both = asked.unionByName(met).select((F.col("_block") * stripes + F.col("_stripe")).cast("long").alias("_cell"), "_asks", "_row", "_id", "_x")
    dealt = both.repartition("_cell").sortWithinPartitions("_cell", F.desc("_asks"))
    found = dealt.mapInArrow(_cells(k), f"_row long, _best {_BEST_SQL}")
    # a query has one run of at most k entries per stripe
    runs = found.groupBy("_row").agg(F.collect_list("_best").alias("_runs"))
    best = runs.mapInArrow(_merged(k), f"_row long, _best {_BEST_SQL}").join(queries.select("_row", F.col("_id").alias("query_id")), "_row")
    ranked = best.select("query_id", F.posexplode("_best").alias("_at", "_b"))
    return ranked.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_b.id").alias(id_col), F.col("_b.score").alias("score"))
