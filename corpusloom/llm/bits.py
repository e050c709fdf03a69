"""A filter of fixed size that tells tasks which rows may be wanted; a join takes the false ones out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**26 bits are 8 MB, whatever the number of keys.
BITS = 1 << 26


def bit_filter(keys: DataFrame, column: str):
    """A broadcast of the bits of a column of 64-bit hashes."""
    bit = F.pmod(F.col(column), F.lit(BITS))
    made = keys.select(F.floor(bit / 32768).cast("int").alias("block"), (bit % 32768).alias("place")).groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
    held = np.zeros(BITS // 8, np.uint8)
    for r in made.collect():  # at most 2048 blocks of 4 KB
        held[r.block * 4096 : r.block * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(held)


def wanted(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes may be in the filter."""
    at = keys.astype(np.int64) & (BITS - 1)
    return ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
