"""Ranks within keys that may be very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def two_level_rank(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence, out: str = "rank",
                   descending: bool = False, dtype: str = "int") -> DataFrame:
    """``row_number`` per key without one task sorting a whole key.

    ``bucket`` is a non-null leading part of the order. Rows are numbered inside
    (key, bucket) and shifted by the counts of the earlier buckets, which come
    from a combined aggregation. The result equals a plain row number over
    ``bucket`` then ``order``. Keys of more than 2**31 rows need ``dtype`` long.
    """
    rows = df.withColumn("_bucket", bucket)
    first = F.desc("_bucket") if descending else F.asc("_bucket")
    before = W.partitionBy(*keys).orderBy(first).rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).withColumn(
        "_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return rows.withColumn("_local", F.row_number().over(local)).join(offsets, [*keys, "_bucket"]).withColumn(
        out, (F.col("_local") + F.col("_offset")).cast(dtype)).drop("_bucket", "_local", "_offset")
