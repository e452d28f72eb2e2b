"""A bit filter over 64-bit hashes: small enough to send to every task however many hashes there are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the largest filter: 16 MB. Beyond about 2**23 hashes more strangers pass, and the join behind it drops them.
MAX_BITS = 1 << 27


class HashFilter:
    """Holds every hash it was made from; others pass by chance, one in ``bits / hashes``."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def build(hashes: DataFrame, column: str, max_bits: int = MAX_BITS) -> HashFilter:
        """From a bigint column. At most ``max_bits / 64`` numbers reach the driver, whatever the number of rows."""
        count = hashes.count()
        bits = max_bits
        while bits > 1 << 12 and bits >= 64 * max(1, count):
            bits //= 2
        at = F.col(column).bitwiseAND(F.lit(bits - 1))
        words = hashes.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask")).toArrow()
        out = np.zeros(bits // 64, np.uint64)
        out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
        return HashFilter(out)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(len(self.words) * 64 - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
