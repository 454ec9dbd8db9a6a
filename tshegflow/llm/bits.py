"""Sets of 64-bit hashes as bits of a bounded size: what is in the set is always found, and few others are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a set: 16 for each member, within these powers of two.
POWERS = (16, 26)


def build(hashes: DataFrame, count: int, powers: tuple[int, int] | None = None) -> np.ndarray:
    """The set of the ``hash`` column of ``hashes``, as words of 64 bits. What comes to the driver is bounded by the set's size, at most 8 MB."""
    low, high = powers or POWERS
    bits = 1 << max(low, min(high, (16 * count).bit_length()))
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.where(F.col("hash").isNotNull()).groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # toPandas may make a Python object of every number
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in the set."""
    slot = hashes & np.uint64(len(words) * 64 - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


class Probe:
    """The set, asked for one hash after another."""

    def __init__(self, words: np.ndarray):
        self.bytes, self.mask = words.tobytes(), len(words) * 64 - 1

    def __call__(self, hash_: int) -> bool:
        slot = hash_ & self.mask
        return bool(self.bytes[slot >> 3] >> (slot & 7) & 1)
