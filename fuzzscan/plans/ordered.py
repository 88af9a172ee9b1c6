"""Running sums over a whole table without one task that sees all of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _range_of(key: Column, bounds: list) -> Column:
    """How many of the bounds are at or below the key; null keys come first."""
    ends = np.array(bounds, dtype=object)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, keys.to_numpy(dtype=object), "right") + 1, dtype="int32")

    return F.when(key.isNull(), 0).otherwise(place(key)) if bounds else F.when(key.isNull(), 0).otherwise(1)


def running_before(df: DataFrame, key: str, value: str, buckets: int = 4096) -> DataFrame:
    """Adds `before`: the sum of `value` over all rows before a row in the order of the key, of whatever type. Keys are cut
    into about `buckets` ranges at keys picked by hash, so that ranges hold about as many keys each, however these are
    spread; sums of ranges are a small table, and windows work inside one range. The driver gets about two keys for each
    range. Rows of one key follow each other in any order."""
    one_of = max(1, df.count() // (2 * buckets))
    picked = df.select(key).where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(one_of)) == 0)).distinct().orderBy(key)
    bounds = [r[0] for r in picked.collect()]
    ranged = df.withColumn("__range", _range_of(F.col(key), bounds[:: max(1, len(bounds) // buckets)]))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))  # about `buckets` rows
    up = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(up), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(starts), "__range").withColumn("before", F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__range", "__start")
