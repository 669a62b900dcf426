"""Which rows of a wide table can be in a list of ids, told before any text is moved.

The ids set bits of a bitmap that the tasks look their rows up in. A row whose bit is not set is
not in the list; the others, the listed ones and a few more, go on to an exact join. The bitmap
has a bound: with very many ids it spares fewer rows, and the result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from harvestline.session import ship_package

BITS_PER_ID = 16
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 25  # 4 MB at most, full to a quarter with 10 million ids


@dataclass
class Members:
    bits: int
    words: Broadcast  # 64 bits each

    def place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("long")), F.lit(self.bits))

    def may_hold(self, places: np.ndarray) -> np.ndarray:
        """Whether the bits at these places are set."""
        return (self.words.value[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1


def members(ids: DataFrame, column: str) -> Members:
    """The bitmap of a column of long ids. Repeated ids count once; null is never joined with."""
    ship_package(ids.sparkSession)
    bits = min(max(LEAST_BITS, 1 << (BITS_PER_ID * ids.count()).bit_length()), MOST_BITS)
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))
    found = ids.select(place.alias("place")).selectExpr("place div 64 as word", "shiftleft(1L, cast(place % 64 as int)) as bit").groupBy(
        "word").agg(F.bit_or("bit").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return Members(bits, ids.sparkSession.sparkContext.broadcast(words))


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` (long) is not among ``ids`` (a table with a column of that name), or is null.
    Only rows that may be listed are shuffled. Both tables are read more than once, so they should be stored."""
    listed = members(ids, column)
    flag = "__may" + "_" * max(map(len, rows.columns))  # longer than any name of rows
    told = rows.withColumn(flag, F.pandas_udf(lambda places: pd.Series(listed.may_hold(places.to_numpy())), "boolean")(listed.place(F.col(column))))
    doubtful = told.where(F.col(flag)).join(ids.select(F.col(column).alias(f"{flag}_")), F.col(column) == F.col(f"{flag}_"), "left_anti")
    return told.where(~F.col(flag)).union(doubtful).drop(flag)
