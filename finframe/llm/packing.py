"""Sum-of-squares packing of token pieces into sequences of a fixed size.

A sequence with ``g`` free tokens has gap ``g``; ``N(g)`` counts the open
sequences of each gap.  A piece goes to the gap (or a new sequence) that leaves
the sum of ``N(g)**2`` smallest, so no gap piles up and small pieces find exact
places.  Only lengths matter, so the rows that travel hold a row number and a
length.  Pieces are dealt at random to lanes of bounded size that pack alone;
what lies in sequences that stayed open is dealt again to fewer lanes.

Defined results: a null text counts as empty and gives one piece with the
separator alone; a null or negative length counts as 0; a length of the
capacity or more takes a sequence of its own.  Repeated rows are packed each.
An empty table gives no rows.  Columns of the input are kept, but for those that
clash with the outputs or begin with an underscore.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finframe.llm.columns import without
from finframe.llm.tokens import portions, word_ids
from finframe.session import checkpointed

CAPACITY = 4096
SEPARATOR = 1
LANE_ROWS = 8192  # pieces that one task packs together
SLACK = 8  # free tokens with which a sequence counts as full
ROUNDS = 4


def token_pieces(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, separator: int = SEPARATOR,
) -> DataFrame:
    """``id_col, piece, start, length, ids`` of every document's ids and separator.

    Only longer documents are cut, into pieces of ``capacity`` ids whose last
    may be shorter.  ``ids`` are little-endian unsigned 32-bit numbers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path).encode_all
        end = int(separator).to_bytes(4, "little")
        step = 4 * capacity
        for batch in portions(batches, "_text"):
            keys, piece, start, length, ids = [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for key, flat in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                flat += end
                for at in range(0, len(flat), step):
                    part = flat[at : at + step]
                    keys.append(key)
                    piece.append(at // step)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                [id_col, "piece", "start", "length", "ids"],
            )

    source = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    key_type = source.schema[0].dataType
    kind = pa.string() if key_type.simpleString() == "string" else {"int": pa.int32()}.get(key_type.simpleString(), pa.int64())
    return source.mapInArrow(cut, f"`{id_col}` {key_type.simpleString()}, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in the given order, and the free room of each sequence."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    room: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.int64(1) << 40
    for i, size in enumerate(lengths.tolist()):
        fresh = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
        # moving one sequence from gap g to g - size changes the sum by 2 (N(g - size) - N(g)) + 2, to gap 0 by 1 - 2 N(g)
        had = count[size:capacity]
        change = np.where(had > 0, 2 * (count[: capacity - size] - had) + 2, never)
        if size and had.size:
            if had[0]:
                change[0] = 1 - 2 * had[0]
            at = int(change.argmin())
            gap = at + size if change[at] <= fresh else 0
        else:
            gap = 0
        if gap:
            bin_no = open_at[gap].pop()
            count[gap] -= 1
        else:
            bin_no, gap = len(room), capacity
            room.append(capacity)
        where[i], offset[i] = bin_no, capacity - gap
        room[bin_no] = left = gap - size
        if left:
            open_at[left].append(bin_no)
            count[left] += 1
    return where, offset, np.array(room, np.int64)


def _lane(turn: int, capacity: int):
    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_size", "_row"], ascending=[False, True], ignore_index=True)
        where, offset, room = sum_of_squares(frame["_size"].to_numpy(), capacity)
        base = ((turn << 36) + int(frame["_lane"].iloc[0])) << 24
        return pd.DataFrame({"_row": frame["_row"], "_size": frame["_size"], "sequence_id": base + where, "offset": offset, "_room": room[where]})

    return fill


def pack(
    pieces: DataFrame, *, length_col: str = "length", capacity: int = CAPACITY,
    lane_rows: int = LANE_ROWS, slack: int = SLACK, rounds: int = ROUNDS,
) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    ``lane_rows`` bounds the rows of one task.  After each round but the last,
    pieces in sequences with more than ``slack`` free tokens are packed again,
    while their number falls.
    """
    pieces = without(pieces, ["sequence_id", "offset"], [length_col])
    rows = checkpointed(pieces.withColumn("_row", F.monotonically_increasing_id()))
    size = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    slim = rows.select("_row", size.alias("_size"))
    alone = slim.where(F.col("_size") >= capacity).select("_row", (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts, left, before = [alone], slim.where(F.col("_size") < capacity), None
    for turn in range(rounds):
        todo = left.count()
        last = turn == rounds - 1 or todo <= lane_rows or (before is not None and todo > 0.7 * before)
        lanes = max(1, math.ceil(todo / lane_rows))

        packed = left.withColumn("_lane", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(lanes)))
        packed = packed.groupBy("_lane").applyInPandas(_lane(turn, capacity), "_row long, _size long, sequence_id long, offset long, _room long")
        packed = checkpointed(packed)
        done = packed if last else packed.where(F.col("_room") <= slack)
        parts.append(done.select("_row", "sequence_id", "offset"))
        if last:
            break
        left, before = packed.where(F.col("_room") > slack).select("_row", "_size"), todo
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    return rows.join(placed, "_row").drop("_row")


def sequences(placed: DataFrame, *, ids_col: str = "ids") -> DataFrame:
    """``sequence_id, n_pieces, ids``: the packed sequences themselves, each of at most the capacity."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.col(ids_col).alias("ids"))))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part["ids"]))
    return placed.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_pieces"), joined.alias("ids"))
