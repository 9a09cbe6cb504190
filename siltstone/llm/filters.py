"""A set of 64-bit keys as a filter of bounded size that every task can hold.

The filter has no false negatives.  Beyond ``MAX_BITS`` it grows no further and
lets more foreign keys through, which costs its user work and never results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 32 MB at most
MAX_BITS = 28
_BUCKET_BITS = 15


class KeyFilter:
    """Two bits a key: its high and its low bits name them."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for few others."""
        high = self._bit(keys >> np.uint64(64 - self.bits)).astype(bool)
        some = np.flatnonzero(high)
        high[some] = self._bit(keys[some] & np.uint64((1 << self.bits) - 1)).astype(bool)
        return high


def key_filter(keys: DataFrame, column: str = "key", max_bits: int = MAX_BITS) -> KeyFilter:
    """The filter of a table's distinct, well mixed long keys, built where the keys are.

    The driver gets bitmaps of 4 KB, ``2 ** max_bits / 32768`` of them at most.
    """
    n = keys.count()
    bits = min(max_bits, max(_BUCKET_BITS, (16 * n).bit_length()))
    places = keys.select(F.explode(F.array(F.shiftrightunsigned(column, 64 - bits), F.col(column).bitwiseAND(F.lit((1 << bits) - 1)))).alias("p"))
    at = F.col("p") + 1
    rows = places.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    data = np.zeros(1 << (bits - 3), dtype=np.uint8)
    size = 1 << (_BUCKET_BITS - 3)
    for row in rows:
        data[(row["b"] - 1) * size : row["b"] * size] = np.frombuffer(row["bits"], np.uint8)
    return KeyFilter(bits, data)
