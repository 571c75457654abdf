"""Token ids of texts, as the ``tokenizers`` library gives them, inside tasks.

The library encodes about 1 MB of text a second.  Neither pre-tokeniser here
lets a token hold white space after a character that is none, so a text may be
cut in front of white space and its parts encoded alone.  Parts made of plain
letters, digits and signs go through ``tiktoken`` with ranks taken from the same
vocabulary file; all others go to ``tokenizers`` itself.  Each Python worker
remembers a bounded number of short parts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: The published split patterns of the two vocabularies, and the
#: published order in which byte-level vocabularies name bytes by characters.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_MARK = re.compile(r"'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+|\d")
PRINTABLE_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

WORD_END = "</w>"
#: Parts that both libraries are known to treat alike.
PLAIN_WORD = re.compile(r"[!-~À-įı-ſ]+")
PLAIN_BYTE = re.compile(r"[\t\n -~À-įı-ſ]+")
#: White space to Python that the tokeniser takes for signs.
ODD_SPACE = re.compile(r"[\x1c-\x1f]")
SPACED = re.compile(r"\s*\S+|\s+")

LONG_PART = 500  # characters; longer parts go to ``tokenizers``, whose merges stay fast on long words
MEMO_PARTS = 300_000  # entries a Python worker remembers between batches


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows that hold about ``most`` bytes of text, or list items, in a column."""
    for batch in batches:
        lists = batch.column(column)
        sizes = pc.list_value_length(lists) if pa.types.is_list(lists.type) else pc.binary_length(lists)
        portion = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
        edges = np.flatnonzero(np.r_[True, portion[1:] != portion[:-1], True]) if batch.num_rows else []
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(at, end - at)


def _byte_of_char() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE_BYTES)]
    return {chr(b): b for b in PRINTABLE_BYTES} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    """Parts of texts to little-endian 32-bit ids; emptied when full, which costs time only."""

    def __init__(self, path: str, specials: bool = True):
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = not specials
        of_char = _byte_of_char()
        self.ranks = {}
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            ends = token.endswith(WORD_END) and len(token) > len(WORD_END)
            body = token[: -len(WORD_END)] if ends else token
            self.ranks[bytes(of_char[c] for c in body) + (b" " if ends else b"")] = i

    def library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def parts(self, text: str) -> list[str]:
        raise NotImplementedError

    def plain(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that both libraries treat alike, in one call."""
        raise NotImplementedError

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return self.encode_parts([self.parts(t) for t in texts])

    def encode_parts(self, split: list[list[str]]) -> list[bytes]:
        """Ids of each list of parts."""
        new = [p for p in set().union(*split) if p not in self]
        if len(self) + len(new) > MEMO_PARTS:
            self.clear()
            new = list(set().union(*split))
        plain = [p for p in new if self.is_plain(p)]
        self.update(zip(plain, self.plain(plain), strict=True))
        self.update((p, self.library(p)) for p in new if p not in self)
        out = [b"".join(map(self.__getitem__, parts)) for parts in split]
        if len(self) > MEMO_PARTS:
            self.clear()
        return out


class WordIds(_Memo):
    """Ids of a vocabulary with word ends, which drops white space and case."""

    def __init__(self, path: str):
        super().__init__(path)
        # a word's end is one byte that no word holds, merged first as the vocabulary has it
        self.bulk = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=self.ranks, special_tokens={})
        self.mark = self.ranks[b"\x00 "]

    def parts(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def is_plain(self, part: str) -> bool:
        return len(part) <= LONG_PART and PLAIN_WORD.fullmatch(part) is not None and "<|" not in part

    def plain(self, parts: list[str]) -> list[bytes]:
        if not parts:
            return []
        units = WORD_MARK.sub(r" \g<0> ", "\n".join(parts).lower()).replace("\n", " \x00 ")
        ids = np.array(self.bulk.encode_ordinary(units + " "), np.uint32)
        return _slices(ids, np.flatnonzero(ids == self.mark), 1)


class ByteIds(_Memo):
    """Ids of a byte-level vocabulary; ``specials`` says whether special strings in a text become special ids."""

    def __init__(self, path: str, specials: bool = True):
        super().__init__(path, specials)
        self.bulk = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in self.ranks.items()} | {i: t.content.encode() for i, t in self.tok.get_added_tokens_decoder().items()}
        self.width = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.width[i] = len(b)

    def parts(self, text: str) -> list[str]:
        return [text] if ODD_SPACE.search(text) else SPACED.findall(text)

    def is_plain(self, part: str) -> bool:
        return len(part) <= LONG_PART and PLAIN_BYTE.fullmatch(part) is not None and not part.isspace() and "<|" not in part

    def plain(self, parts: list[str]) -> list[bytes]:
        # a line end in front keeps a part without leading white space from joining the part before it
        led = [p if p[0].isspace() else "\n" + p for p in parts]
        ids = np.array(self.bulk.encode_ordinary("".join(led)), np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) for p in led])) + 1
        return [i if p is q else i[4:] for i, p, q in zip(_slices(ids, ends[:-1], 0), parts, led, strict=True)] if parts else []


def _slices(ids: np.ndarray, cuts: np.ndarray, skip: int) -> list[bytes]:
    """Bytes between cuts, leaving out ``skip`` ids at each cut."""
    starts, ends = [0, *(4 * (cuts + skip)).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
    flat = ids.tobytes()
    return [flat[a:b] for a, b in zip(starts, ends, strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(maxsize=2)
def byte_ids(path: str, specials: bool = True) -> ByteIds:
    return ByteIds(path, specials)
