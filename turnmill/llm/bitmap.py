"""A set of hashes as a bitmap of fixed size, made by Spark aggregates and tested in numpy. It may hold too much, never too little."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that one row of bitmap_construct_agg holds.
ROW_BITS = 32768


def build(hashes: DataFrame, column: str, bits: int) -> bytes:
    """Of a long column. The result has 2**bits / 8 bytes, whatever the rows."""
    bit = F.col(column).bitwiseAND((1 << bits) - 1)
    parts = hashes.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map"))
    out = np.zeros(((1 << bits) // ROW_BITS + 2, ROW_BITS // 8), np.uint8)
    for row in parts.toLocalIterator():
        out[row["k"]] = np.frombuffer(row["map"], np.uint8)
    return out.tobytes()


def test(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of the unsigned hashes may be in the set. Number b > 0 lies in row 1 + (b - 1) // 32768, 0 at the front."""
    bit = (hashes & np.uint64((1 << bits) - 1)).astype(np.int64) - 1
    place = np.where(bit < 0, 0, bit + ROW_BITS)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
