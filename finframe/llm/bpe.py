"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last 16 bytes cuts every text where the hash has a
certain form, so equal passages are cut alike wherever they stand.  A chunk that
was met before is not encoded again: each Python worker holds a bounded memo of
two generations, of which the one not used longest is let go.  (Chunks are not
carried between executors: a shuffle of all texts and ids would move about twice
the input to save encoding a fifth of it.)

A cut may fall inside a word, so joins are repaired.  A chunk is encoded in
parts, split in front of white space that follows something else, where no token
reaches across.  At each join the last part before it and the first one after it
are encoded again as one, and as long as that part reaches the end of its chunk
the next chunk is drawn in.  Outside of the joined part no id can change, as no
token reaches across its ends; so agreement there holds by construction and is
not compared, and a chunk's memo keeps no ids for its two end parts.

Defined results: a null text is encoded as empty, with no ids.  Special strings
in a text become special ids, as the library does by default.  Repeated rows are
encoded each.  Other columns are kept; ``ids`` and ``decoded`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finframe.llm.tokens import ODD_SPACE, ByteIds, byte_ids, portions

AVERAGE = 256  # bytes of a chunk; a power of two
MEMO_CHUNKS = 30_000  # of one generation

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)


def cuts(data: bytes) -> np.ndarray:
    """Where chunks end: after bytes whose rolling hash has its top bits zero, between characters."""
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for width in (1, 2, 4, 8):  # sums over 2, 4, 8 and 16 bytes
        if len(h) > width:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    ends = np.flatnonzero(h < np.uint32((1 << 32) // AVERAGE)) + 1
    ends = ends[ends < len(raw)]
    return ends[(raw[ends] & 0xC0) != 0x80]


class ChunkCoder:
    """Ids of texts by chunks; one per Python worker."""

    def __init__(self, path: str):
        self.ids: ByteIds = byte_ids(path)
        self.fresh: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _known(self, chunk: str):
        found = self.fresh.get(chunk)
        if found is None:
            found = self.older.get(chunk)
            if found is not None:
                self._keep(chunk, found)
        return found

    def _keep(self, chunk: str, value: tuple) -> None:
        if len(self.fresh) >= MEMO_CHUNKS:
            self.fresh, self.older = {}, self.fresh
        self.fresh[chunk] = value

    def _learn(self, chunks: list[str]) -> dict[str, tuple]:
        """First part, ids of what lies between, last part (None if the first is the only one)."""
        split = [self.ids.parts(c) for c in chunks]
        inner = self.ids.encode_parts([p[1:-1] for p in split])
        learnt = {}
        for chunk, parts, ids in zip(chunks, split, inner, strict=True):
            learnt[chunk] = (parts[0], ids, parts[-1] if len(parts) > 1 else None)
        return learnt

    def encode_all(self, texts: list[str]) -> list[bytes]:
        plain = [not ODD_SPACE.search(t) for t in texts]
        chunked = [self._chunks(t) if ok else [] for t, ok in zip(texts, plain, strict=True)]
        known, new = {}, {}
        for c in set().union(*chunked):
            found = self._known(c)
            if found is None:
                new[c] = None
            else:
                known[c] = found
        learnt = self._learn(list(new))
        for c, value in learnt.items():
            self._keep(c, value)
        known |= learnt
        joins = [self._joins([known[c] for c in chunks]) for chunks in chunked]
        # the parts at the joins, as they read when joined
        repaired = self.ids.encode_all([j for parts, _ in joins for j in parts])
        out, at = [], 0
        for text, ok, (parts, inner) in zip(texts, plain, joins, strict=True):
            if not ok:
                out.append(self.ids.library(text))
                at += len(parts)
                continue
            ids = []
            for i in range(len(parts)):
                ids.append(repaired[at + i])
                if i < len(inner):
                    ids.append(inner[i])
            at += len(parts)
            out.append(b"".join(ids))
        return out

    def _chunks(self, text: str) -> list[str]:
        data = text.encode()
        edges = [0, *cuts(data).tolist(), len(data)]
        return [data[a:b].decode() for a, b in zip(edges, edges[1:], strict=False) if b > a]

    @staticmethod
    def _joins(chunks: list[tuple]) -> tuple[list[str], list[bytes]]:
        """Texts at the joins (and both ends) and the ids that stand between them."""
        texts, inner, held = [], [], ""
        for first, ids, last in chunks:
            held += first
            if last is not None:
                texts.append(held)
                inner.append(ids)
                held = last
        texts.append(held)
        return texts, inner


@lru_cache(maxsize=2)
def coder(path: str) -> ChunkCoder:
    return ChunkCoder(path)


def _others(df: DataFrame, name: str) -> list[str]:
    return [c for c in df.columns if c != name]


def encode(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text") -> DataFrame:
    """The rows with ``ids``, the tokeniser's ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text_col):
            found = coder(tokenizer_path).encode_all([t or "" for t in batch.column(text_col).to_pylist()])
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(i) // 4 for i in found], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], ids], [*kept, "ids"])

    kept = _others(docs, "ids")
    schema = T.StructType([docs.schema[c] for c in kept]).add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*kept).mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer_path: str, *, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_ids(tokenizer_path).bytes_of
        for batch in portions(batches, ids_col):
            lists = batch.column(ids_col)
            flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
            ends = lists.offsets.to_numpy()
            ends = (ends - ends[0]).tolist()
            texts = [b"".join([table[i] for i in flat[a:b]]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, "decoded"])

    kept = _others(rows, "decoded")
    schema = T.StructType([rows.schema[c] for c in kept]).add("decoded", T.StringType())
    return rows.select(*kept).mapInArrow(run, schema)
