"""A set of values as bits: of a fixed size, whatever the number of values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place_of(values: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(bits)).cast("bigint")


def bit_filter(df: DataFrame, values: list[str], bits: int) -> np.ndarray:
    """64-bit words with the bit of every row of ``df`` set; a full filter lets everything pass and stays right."""
    place = place_of(values, bits)
    words = df.select(F.floor(place / 64).cast("int").alias("word"), (place % 64).cast("int").alias("bit")).groupBy(
        "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("held"))
    found = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("held").to_numpy()
    return out


def passes(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (words[place >> 6] >> (place & 63)) & 1 > 0
