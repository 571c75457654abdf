r"""Phrase collocations: longest windows counted once, shorter phrases by ROLLUP.

Every word position opens one window: its word and the next ones of its piece as
lead columns ``w1 .. w5``, padded with nulls where the piece ends.  Only these
longest windows are counted.  Each contiguous occurrence of a phrase is a prefix
of exactly one window, so ``ROLLUP (lang, w1, .., w5)`` sums them to the counts
of all shorter phrases, of single words, and of all words of a language.

Windows are also padded where a phrase can no longer be frequent: a phrase that
occurs ``least`` times holds no pair and no three neighbours that occur less
often.  Two passes (pairs, then threes of frequent pairs) count hashes and fold
the frequent ones into a bitmap of fixed size (8 MB at any size of the corpus).
What shares a hash or a bit only leaves a window longer than need be, so counts
stay exact.  A window that ends early still counts for its first words.

Words are runs of anything but space and tab, with A-Z lower-cased, inside
pieces cut at ``[.,;:!?\x0A-\x0D]``.  A phrase cut after its first k words has
the score ``floor(1000 * a * n / (l * r))``, worked out in 38-digit decimals; an
overflow is an error.  The lowest of its cuts counts, ties to the smallest k.

Defined results: a null text has no words; a null language is ``und``, like the
language of that name.  Repeated rows count each.  An empty table gives no rows.
Only the two named columns are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import batched
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.llm.bitmaps import gathered, known
from finframe.llm.tokens import portions
from finframe.session import checkpointed

LONGEST = 5  # words of a phrase
LEAST = 100  # occurrences of a candidate
PORTION = 2 << 20  # bytes of text a task counts at a time
HELD = 300_000  # distinct windows a task adds up before it hands them on
ROWS = 20_000  # windows of one Arrow batch
COUNTED = (2, 3)  # words of the phrases whose hashes a pass counts
KEY_BITS = 40  # of a hash; the three bytes that are left out cost nothing in a shuffle
MAP_BITS = 26  # the bitmap of what is frequent holds 2**26 bits
SALTS = 64  # parts of a language that are ranked alone first
UNKNOWN = "und"

#: Ends of pieces become full stops, which no word holds.
_STOP = b"."
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _STOP * 9)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Words to odd 64-bit hashes and the full stop to 0, with a bounded number remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = found = 0 if word == _STOP else xxhash.xxh3_64_intdigest(word) | 1
        return found


def segments(texts: list[str], size: int) -> Iterator[list[bytes]]:
    """Words of the texts with a full stop at every end of a piece, of about ``size`` bytes of text at a time."""
    raw = _STOP.join(t.encode() for t in texts).translate(_FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(_STOP, at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end].replace(_STOP, b" . ").split()
        at = end + 1


def _spread(key: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(32))) * _LEFT
    return (key ^ (key >> np.uint64(29))) & np.uint64((1 << KEY_BITS) - 1)


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """What stands ``by`` places further on, and nothing past the end."""
    return np.r_[values[by:], np.zeros(min(by, len(values)), values.dtype)]


def phrases_of(words: list[bytes], lang: str, hashes: _Hashes, upto: int, bitmap: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1 to ``upto`` words at each word: their hash, and whether they stand in one piece.

    With a bitmap, a phrase must also consist of pairs, or longer ones, that may be frequent.
    """
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    key, shorter = h * _LEFT ^ np.uint64(xxhash.xxh3_64_intdigest(lang)), h != 0
    out = [(key, shorter)]
    for k in range(1, upto):
        able, key = shorter & _ahead(shorter, 1), _spread(key * _LEFT ^ _ahead(h, k) * _RIGHT)
        out.append((key, able))
        shorter = able if bitmap is None else able & known(bitmap, key)
    return out


def _by_lang(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes]]]:
    for batch in portions(batches, "_text", size):
        texts = defaultdict(list)
        for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            texts[lang].append(text)
        for lang, some in texts.items():
            for words in segments(some, size):
                yield lang, words


def _keys(length: int, bitmap: np.ndarray | None, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for lang, words in _by_lang(batches, size):
            key, able = phrases_of(words, lang, hashes, length, bitmap)[-1]
            keys, n = np.unique(key[able].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["_key", "_n"])

    return run


def frequent(docs: DataFrame, least: int, longest: int, size: int, bits: int) -> np.ndarray:
    """A bitmap with the bits of all phrases of two or three words that occur ``least`` times, and of few others."""
    out = None
    for length in COUNTED:
        if length > longest:
            break
        counted = docs.mapInArrow(_keys(length, out, size), "_key long, _n long").groupBy("_key").agg(F.sum("_n").alias("_n"))
        new = gathered(counted.where(F.col("_n") >= least), "_key", bits)
        if not new.any():
            break  # what is longer is not frequent either
        out = new if out is None else out | new
    return np.zeros((1 << bits) // 8, np.uint8) if out is None else out


def _windows(bitmap: np.ndarray, longest: int, size: int):
    upto = min(longest, COUNTED[-1])

    def lengths(words: list[bytes], lang: str, hashes: _Hashes) -> np.ndarray:
        """How many words a window holds from each place on; none at the end of a piece."""
        (_, word), *longer = phrases_of(words, lang, hashes, upto, bitmap)
        often = [word, *[able & known(bitmap, key) for key, able in longer]]
        length, going = np.sum(often, axis=0, dtype=np.int64), often[-1]
        for k in range(1, longest - upto + 1):
            going = going & _ahead(often[-1], k)
            length += going
        return length

    def rows(windows: Counter) -> Iterator[pa.RecordBatch]:
        for some in batched(windows.items(), ROWS):
            columns = [pa.array([w[k].decode() if len(w) > k else None for (_, w), _ in some], pa.string()) for k in range(longest)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for (lang, _), _ in some], pa.string()), *columns, pa.array([n for _, n in some], pa.int64())], ["lang", *_leads(longest), "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, windows = _Hashes(), Counter()
        for lang, words in _by_lang(batches, size):
            length = lengths(words, lang, hashes)
            for k in range(1, longest + 1):
                windows.update((lang, tuple(words[i : i + k])) for i in np.flatnonzero(length == k).tolist())
            if len(windows) > HELD:
                yield from rows(windows)
                windows = Counter()
        yield from rows(windows)

    return run


def _leads(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
    portion: int = PORTION, bits: int = MAP_BITS) -> DataFrame:
    """``lang, words, f``: all phrases of 1 to ``longest`` words that occur ``least`` times, and all words of a language as the phrase of none."""
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("_lang"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    bitmap = frequent(source, least, longest, portion, bits)
    leads = _leads(longest)
    schema = ", ".join(["lang string", *[f"{w} string" for w in leads], "_n long"])
    sums = source.mapInArrow(_windows(bitmap, longest, portion), schema).rollup("lang", *leads).agg(F.sum("_n").alias("f"), F.grouping_id().alias("_level"))
    held = reduce(add, [F.col(w).isNotNull().cast("int") for w in leads])
    # a sum over the first k leads stands for a phrase where the k-th is a word and no padding
    whole = sums.where(F.col("lang").isNotNull()).where(held == F.lit(longest) - F.bit_count("_level"))
    return whole.where((F.col("f") >= least) | (held == 0)).select("lang", F.array_compact(F.array(*leads)).alias("words"), "f")


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def scored(counts: DataFrame, *, absorb: int = 100) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases of two words or more that no longer one absorbs.

    A phrase is absorbed by a longer one that holds it and occurs at least ``absorb`` percent as often.
    """
    named = checkpointed(counts.withColumn("phrase", _text(F.col("words"))).withColumn("_k", F.size("words")))
    several = named.where("_k >= 2")
    parts = named.where("_k >= 1").select("lang", F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    cuts = several.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("_k") - 1)).alias("_cut"))
    cuts = cuts.select("lang", "phrase", "a", "_cut", _text(F.slice("words", 1, F.col("_cut"))).alias("_left"), _text(F.slice("words", F.col("_cut") + 1, F.size("words"))).alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(parts.withColumnsRenamed({"_part": side, "_f": name}), ["lang", side])
    # one row per language meets all of its cuts: parts of a language meet a copy each
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("_salt")
    totals = named.where("_k = 0").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    whole = "CAST({} AS DECIMAL(38, 0))".format
    score = F.expr(f"({whole(1000)} * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    cuts = cuts.withColumn("_salt", salt).join(totals, ["lang", "_salt"]).withColumn("score", score)
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "_cut", "l", "r")).alias("_low"))

    held = several.where("_k >= 3").select("lang", "words", "f", F.explode(F.sequence(F.lit(2), F.col("_k") - 1)).alias("_len"))
    held = held.select("lang", "words", "f", "_len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("_len") + 1)).alias("_at"))
    held = held.groupBy("lang", _text(F.slice("words", F.col("_at"), F.col("_len"))).alias("phrase")).agg(F.max("f").alias("_longer"))
    kept = lowest.join(held, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("_longer") >= absorb * F.col("a"), F.lit(False)))
    return kept.select("lang", "phrase", "a", F.col("_low.l").alias("l"), F.col("_low.r").alias("r"), "n", F.col("_low.score").alias("score"))


def collocations(docs: DataFrame, *, top: int = 2000, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, absorb: int = 100) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language; ties to the more frequent, then by bytes."""
    rows = scored(phrase_counts(docs, text_col=text_col, lang_col=lang_col, longest=longest, least=least), absorb=absorb)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
