"""Alignment of two tokenisers' tokens by products of sparse incidence matrices.

A text with a space in front is cut into byte-level tokens (A) and into pieces
(B).  Tokens by bytes are incidence matrices in CSR form: ``indptr`` and
``indices``, no values.  The row products of Gustavson, ``A . B^T``, go through
the bytes of each A token and add up the B tokens that hold them: every entry is
an overlap link with the number of bytes in common.  Byte offsets where an A and
a B token both end cut the tokens into groups; tokens by groups are incidence
matrices too, and their product gives the links between tokens of one group.

Counts over the corpus need every link once.  A task takes documents a
megabyte at a time, as a block, and keeps of a block only: its distinct id
pairs with their counts, and a matrix of documents by distinct pairs.  The pairs
of all blocks are summed, the sums go back to the blocks that hold them, and
each block's matrix times its vector of sums gives its documents' figures.  So
ids and links are never shuffled, and a document is encoded once.

Defined results: a text that is null or empty, or whose tokens do not spell the
space and the text in either vocabulary (a text with U+2581, which B takes for a
space), has no tokens, no groups and no links.  Strings of special tokens in a
text are plain text.  Repeated rows count each.  An empty table gives no rows.
Other columns are not read.  Long texts are encoded in parts where no token of
either vocabulary reaches across; a word of any length is one part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finframe.llm.tokens import byte_ids, portions
from finframe.session import checkpointed

BLOCK = 1 << 20  # bytes of text of a block
PART = 1 << 16  # characters of a text that B encodes at a time
ROWS = 1 << 18  # rows of a product worked out at a time
_MARK = "▁"
#: In front of a space that follows something else (the model takes the mark for a space, too).
_SAFE = re.compile(rf"(?<=[^ {_MARK}])(?= )")


@dataclass
class Incidence:
    """A 0/1 matrix in CSR form."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    @classmethod
    def of_runs(cls, widths: np.ndarray) -> Incidence:
        """Rows of consecutive columns, as tokens hold consecutive bytes."""
        ends = np.r_[0, np.cumsum(widths)]
        return cls(ends, np.arange(ends[-1]), int(ends[-1]))

    @classmethod
    def of_labels(cls, labels: np.ndarray, columns: int) -> Incidence:
        """Rows of one column each."""
        return cls(np.arange(len(labels) + 1), labels, columns)

    def transposed(self) -> Incidence:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        sizes = np.bincount(self.indices, minlength=self.columns)
        return Incidence(np.r_[0, np.cumsum(sizes)], rows[order], len(self.indptr) - 1)


def row_products(a: Incidence, b: Incidence, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries ``row, column, value`` of ``a . b``, some rows at a time, by rows and then columns.

    Row i of the product is the sum of those rows of b that row i of a names.
    """
    sizes = np.diff(b.indptr)
    for first in range(0, len(a.indptr) - 1, rows):
        last = min(len(a.indptr) - 1, first + rows)
        named = a.indices[a.indptr[first] : a.indptr[last]]
        row = np.repeat(np.arange(first, last), np.diff(a.indptr[first : last + 1]))
        many = sizes[named]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(b.indptr[named], many)
        key = np.repeat(row, many) * b.columns + b.indices[at]
        if (key[1:] < key[:-1]).any():
            key.sort()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        found = key[starts]
        yield found // max(1, b.columns), found % max(1, b.columns), np.diff(np.r_[starts, len(key)])


def product_sizes(a: Incidence, b: Incidence) -> np.ndarray:
    """How many entries each row of ``a . b`` has, where a names one row of b in each of its rows."""
    return np.diff(b.indptr)[a.indices]


class Pieces:
    """Ids of texts with a space in front, by a piece vocabulary."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.width = np.array([len(b) for b in self.bytes_of], np.int64)
        #: whether no piece goes on with a space after something else, so that texts may be cut there
        self.cuttable = not any(_SAFE.search(p.replace(_MARK, " ")) for p in pieces)

    def encode_all(self, texts: list[str], most: int = PART) -> list[np.ndarray]:
        parts, owner = [], []
        for i, text in enumerate(texts):
            found = self._parts(text, most) if len(text) > most and self.cuttable else [text]
            parts += found
            owner += [i] * len(found)
        out: list[list] = [[] for _ in texts]
        for i, ids in zip(owner, self.model.encode(parts, num_threads=1) if parts else [], strict=True):
            out[i].append(np.array(ids, np.int64))
        return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]

    @staticmethod
    def _parts(text: str, most: int) -> list[str]:
        """Parts whose spaces in front are left to the model, which adds one."""
        parts, at = [], 0
        while len(text) - at > most:
            cut = _SAFE.search(text, at + most)
            if not cut or cut.start() + 1 == len(text):  # the model takes an empty part for none
                break
            parts.append(text[at : cut.start()])
            at = cut.start() + 1
        return [*parts, text[at:]]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@dataclass
class Block:
    """Tokens, groups and links of some texts, one after the other; the bounds of texts are common ends."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_ends: np.ndarray  # of each text, in tokens
    b_ends: np.ndarray
    a_width: np.ndarray
    b_width: np.ndarray

    def __post_init__(self):
        self.a_bytes, self.b_bytes = Incidence.of_runs(self.a_width), Incidence.of_runs(self.b_width)
        a_ends, b_ends = self.a_bytes.indptr[1:], self.b_bytes.indptr[1:]
        self.cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(self.cuts, a_ends), np.searchsorted(self.cuts, b_ends)
        self.a_groups, self.b_groups = Incidence.of_labels(self.a_group, len(self.cuts)), Incidence.of_labels(self.b_group, len(self.cuts))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A token, B token and bytes in common of every overlap link."""
        found = list(row_products(self.a_bytes, self.b_bytes.transposed()))
        return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def group_links(self, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A token and B token of every pair in one group, some A tokens at a time."""
        yield from row_products(self.a_groups, self.b_groups.transposed(), rows)

    def group_link_counts(self) -> np.ndarray:
        """How many tokens of B share the group of each token of A."""
        return product_sizes(self.a_groups, self.b_groups.transposed())


class Aligner:
    """Both vocabularies of a task."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = byte_ids(byte_path, False), pieces(piece_path)
        self.a_bytes = self.a.bytes_of
        # every token as text, ended by a comma, by the bar between A and B, or by the semicolon between groups
        self.a_text = np.array([f"{i}{end}".encode() for i in range(len(self.a.width)) for end in ",|"], object)
        self.b_text = np.array([f"{i}{end}".encode() for i in range(len(self.b.width)) for end in ",;"], object)

    def block(self, texts: list[str]) -> Block:
        """The texts' tokens; none for those that the tokens do not spell."""
        a = [np.frombuffer(i, np.uint32).astype(np.int64) for i in self.a.encode_all([" " + t for t in texts])]
        b = self.b.encode_all(texts)
        for n, text in enumerate(texts):
            raw = b" " + text.encode()
            spelt = text and b"".join(map(self.a_bytes.__getitem__, a[n].tolist())) == raw and b"".join(map(self.b.bytes_of.__getitem__, b[n].tolist())) == raw
            if not spelt:
                a[n] = b[n] = np.zeros(0, np.int64)
        flat_a, flat_b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
        return Block(
            flat_a, flat_b, np.cumsum([len(x) for x in a], dtype=np.int64), np.cumsum([len(x) for x in b], dtype=np.int64), self.a.width[flat_a], self.b.width[flat_b])

    def group_texts(self, block: Block) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        a_last = np.r_[block.a_group[1:] != block.a_group[:-1], np.ones(min(1, len(block.a)), bool)]
        b_last = np.r_[block.b_group[1:] != block.b_group[:-1], np.ones(min(1, len(block.b)), bool)]
        words = np.concatenate([self.a_text[2 * block.a + a_last], self.b_text[2 * block.b + b_last]])
        order = np.argsort(np.concatenate([2 * block.a_group, 2 * block.b_group + 1]), kind="stable")
        flat = words[order].tolist()
        ends = (block.a_ends + block.b_ends).tolist()
        return [b"".join(flat[at:end])[:-1] for at, end in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(values)]
    return np.diff(np.r_[0, sums[ends]])


def align(docs: DataFrame, byte_path: str, piece_path: str, *, text_col: str = "text") -> DataFrame:
    """The rows with both token lists, every token's group, and the links in CSR form.

    Row i of the CSR matrix is the i-th A token: ``link_indices`` from
    ``link_indptr[i]`` on are its B tokens, ``link_bytes`` the bytes in common.
    """
    added = {"a_ids": "array<int>", "b_ids": "array<int>", "a_group": "array<int>", "b_group": "array<int>",
             "link_indptr": "array<int>", "link_indices": "array<int>", "link_bytes": "array<int>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text_col, BLOCK):
            lists: dict[str, list] = {n: [] for n in added}
            for text in batch.column(text_col).to_pylist():
                one = aligner(byte_path, piece_path).block([text or ""])
                i, j, n = one.links()
                values = (one.a, one.b, one.a_group, one.b_group, np.r_[0, np.cumsum(np.bincount(i, minlength=len(one.a)))], j, n)
                for name, v in zip(added, values, strict=True):
                    lists[name].append(v.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(v, pa.list_(pa.int32())) for v in lists.values()]], [*kept, *added])

    kept = [c for c in docs.columns if c.lower() not in added]
    schema = T.StructType([docs.schema[c] for c in kept])
    for name in added:
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return docs.select(*kept).mapInArrow(run, schema)


_DOCS = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]
_BLOCK_ARROW = pa.schema([
    ("ids", pa.list_(pa.int64())), *[(n, pa.list_(pa.int64())) for n in _DOCS], ("groups", pa.list_(pa.string())),
    ("indptr", pa.binary()), ("indices", pa.binary()), ("values", pa.binary()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())),
])
_BLOCK_SQL = ", ".join(["ids array<long>", *[f"{n} array<long>" for n in _DOCS], "groups array<string>",
                        "indptr binary", "indices binary", "values binary", "a array<int>", "b array<int>", "n array<long>"])


def _blocks(byte_path: str, piece_path: str, size: int):
    """Documents to one row per block: their figures, its distinct pairs, and the matrix of documents by pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text", size):
            both = aligner(byte_path, piece_path)
            block = both.block([t or "" for t in batch.column("_text").to_pylist()])
            i, j, _ = block.links()
            link_ends = np.searchsorted(i, block.a_ends)
            text_of = np.repeat(np.arange(batch.num_rows), np.diff(np.r_[0, link_ends]))
            pair, place = np.unique(block.a[i] * len(both.b.width) + block.b[j], return_inverse=True)
            # documents by pairs in CSR: how many links of a document are of a pair
            cell, values = np.unique(text_of * max(1, len(pair)) + place, return_counts=True)
            rows, columns = cell // max(1, len(pair)), cell % max(1, len(pair))
            indptr = np.r_[0, np.cumsum(np.bincount(rows, minlength=batch.num_rows))]
            figures = [
                np.diff(np.r_[0, block.a_ends]), np.diff(np.r_[0, block.b_ends]),
                np.diff(np.r_[0, np.searchsorted(block.cuts, np.r_[0, np.cumsum(block.a_width)][block.a_ends], "right")]),
                np.diff(np.r_[0, link_ends]), _per_text(block.group_link_counts(), block.a_ends),
            ]
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in both.group_texts(block)]
            yield pa.RecordBatch.from_arrays([
                *[pa.array([v], t) for v, t in zip([batch.column("_id").to_numpy(zero_copy_only=False) if not batch.column("_id").null_count else batch.column("_id").to_pylist(), *figures], _BLOCK_ARROW.types[:6], strict=True)],
                pa.array([digests], pa.list_(pa.string())),
                *[pa.array([v.astype("<i4").tobytes()], pa.binary()) for v in (indptr, columns, values)],
                pa.array([pair // len(both.b.width)], pa.list_(pa.int32())), pa.array([pair % len(both.b.width)], pa.list_(pa.int32())),
                pa.array([np.bincount(place, minlength=len(pair))], pa.list_(pa.int64())),
            ], schema=_BLOCK_ARROW)

    return run


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a, b, count, best``: how many links hold each id pair, and whether no A id has more with that B id."""
    pairs = blocks.select(F.inline(F.arrays_zip("a", "b", "n")))
    counts = checkpointed(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")))
    tops = counts.groupBy("b").agg(F.max("count").alias("_top"))
    return counts.join(tops, "b").select("a", "b", "count", (F.col("count") == F.col("_top")).alias("best"))


_OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_group_links"]


def _figures(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row] for n in batch.schema.names}
                indptr, indices, values = (np.frombuffer(one[n].as_py(), "<i4") for n in ("indptr", "indices", "values"))
                sums = one["sums"].values
                count, best = (sums.field(n).to_numpy(zero_copy_only=False) for n in ("count", "best"))
                if float(values @ count[indices].astype(np.float64) if len(indices) else 0) >= 2.0**62:
                    raise OverflowError("the counts of a block's links do not fit 64 bits")
                totals = {"count_sum": _per_text(values * count[indices], indptr[1:]), "n_best": _per_text(values * best[indices], indptr[1:])}
                columns = [pa.array(totals[n], pa.int64()) if n in totals else one[n].values for n in _OUT]
                yield pa.RecordBatch.from_arrays([one["ids"].values, *columns, one["groups"].values], [id_col, *_OUT, "groups_sha256"])

    return run


def link_figures(docs: DataFrame, byte_path: str, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``<id_col>, n_a, n_b, n_groups, n_links, n_best, count_sum, n_group_links, groups_sha256`` of every document.

    ``count_sum`` adds up, over a document's links, how many links of the whole
    corpus hold the same id pair; ``n_best`` counts the links whose pair no other
    A id of that B id exceeds.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    blocks = source.mapInArrow(_blocks(byte_path, piece_path, block), _BLOCK_SQL)
    blocks = checkpointed(blocks.withColumn("_block", F.monotonically_increasing_id()))
    counts = pair_counts(blocks)
    held = blocks.select("_block", F.posexplode(F.arrays_zip("a", "b")).alias("_at", "_p")).select("_block", "_at", "_p.a", "_p.b")
    # a block's distinct pairs, in its own order
    sums = held.join(counts, ["a", "b"]).groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_at", "count", "best"))).alias("sums"))
    none = F.array().cast("array<struct<_at: int, count: bigint, best: boolean>>")
    both = blocks.drop("a", "b", "n").join(sums, "_block", "left").withColumn("sums", F.coalesce("sums", none)).drop("_block")
    schema = ", ".join([f"`{id_col}` long", *[f"{n} long" for n in _OUT], "groups_sha256 string"])
    return both.mapInArrow(_figures(id_col), schema)
