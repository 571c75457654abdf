"""Sets of hashed keys in a fixed number of bits: a cheap test in front of an exact one.

A bitmap has the same size for any number of keys, so it may be sent to every
task.  A key of the set always passes; others pass by chance, the more often the
fuller the bitmap, and whatever follows must sort those out.  A full bitmap
spares nothing and loses nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 1 << 15  # bits of one row of a bitmap that is gathered
WORD_BITS = 24  # bits of a bitmap that is joined: at most 2**18 rows of 64 bits


def gathered(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """The bitmap of a long column, as bytes: at most ``2**bits / PAGE`` rows of 4 KB reach the driver."""
    at = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    pages = keys.select(F.floor(at / PAGE).cast("int").alias("_page"), (at % PAGE).alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for page in pages.collect():
        out[page["_page"] * PAGE // 8 : (page["_page"] + 1) * PAGE // 8] = np.frombuffer(page["_bits"], np.uint8)
    return out


def known(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bits of unsigned keys are set."""
    at = key & np.uint64(8 * len(bitmap) - 1)
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _word_and_bit(key: Column, bits: int) -> tuple[Column, Column]:
    at = key.bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")


def marked(rows: DataFrame, keys: DataFrame, key: str, flag: str, bits: int = WORD_BITS) -> DataFrame:
    """The rows with ``flag``: false where their long key is surely none of the keys of the other frame."""
    word, bit = _word_and_bit(F.col(key), bits)
    # 2**(bits - 6) rows at most, however many keys there are
    words = keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_set")).groupBy("_word").agg(F.bit_or("_set").alias("_set"))
    joined = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    found = F.call_function("shiftright", F.col("_set"), bit).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn(flag, F.coalesce(found, F.lit(False))).drop("_word", "_set")
