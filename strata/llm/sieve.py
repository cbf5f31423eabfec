"""A bitmap of keys, so that rows whose key is surely not among some keys stay out of a join.

The bitmap has 16 bits a key, up to BITS; so about one row in 16 passes for nothing, and more
do beyond BITS / 16 keys, which costs time but no result: the join itself follows. A null key
is a key like any other. Without keys no row passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many bits (16 MB) go through the driver and to each executor.
BITS = 1 << 27


def marks(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of different keys that are hashes (long) themselves, for marked()."""
    size = min(BITS, max(64, 1 << (16 * keys.count()).bit_length()))
    return bitmap(keys.select(F.pmod(F.col(column), F.lit(size)).alias("b")), size)


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a bitmap."""
    b = keys & (64 * len(table) - 1)
    return table[b >> 6] >> (b & 63) & 1 > 0


def bitmap(places: DataFrame, size: int) -> np.ndarray:
    """So many bits, in words of 64, with those at the places (b) set."""
    words = places.select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, int(b & 63))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(size >> 6, np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    return table


def passing(keys: DataFrame, column: str, count: int):
    """A function from a key column to whether it may be among keys; count: how many there are."""
    size = min(BITS, max(64, 1 << (16 * count).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(size))
    sent = keys.sparkSession.sparkContext.broadcast(bitmap(keys.select(place.alias("b")), size))

    @F.arrow_udf("boolean")
    def found(at: pa.Array) -> pa.Array:
        b = at.to_numpy()
        return pa.array(sent.value[b >> 6] >> (b & 63) & 1 > 0)

    return lambda key: found(F.pmod(F.xxhash64(key), F.lit(size)))
