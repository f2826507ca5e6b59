"""Running sums and ranks that never put all rows of a key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence, value: str, out: str) -> DataFrame:
    """Exclusive running sum of value within keys, ordered by (bucket, *order), in two levels.

    bucket must not decrease along the order. Sums of the buckets are accumulated first (one row per bucket), then rows
    within a bucket; no task holds all rows of a key, however large it is.
    """
    keys = list(keys)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_bucket_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, bucket, F.coalesce(F.sum("_bucket_sum").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(offsets, [*keys, bucket])
        .withColumn(out, F.col("_offset") + F.col("_inner"))
        .drop("_offset", "_inner")
    )


def rank_desc(df: DataFrame, key: str, score: str, id_col: str, out: str, cells: float | None = 64.0, spread: int = 1 << 16) -> DataFrame:
    """0-based rank by score descending, then id ascending, within key; ties get distinct ranks.

    Scores are cut into cells of 1 / cells; the score 0, which most rows of a sparse signal share, is cut by ranges of ids. A
    score of few values has cells None: each value is a cell, and is cut by ranges of ids.
    """
    cell = -F.col(score) if cells is None else F.floor(-F.col(score) * F.lit(cells))
    ranges = F.floor(F.col(id_col) / F.lit(spread))
    inside = ranges if cells is None else F.when(F.col(score) == 0, ranges).otherwise(F.lit(0))
    marked = df.withColumn("_cell", F.struct(cell.alias("c"), inside.alias("i"))).withColumn("_one", F.lit(1))
    return running_sum(marked, [key], "_cell", [F.desc(score), id_col], "_one", out).drop("_cell", "_one")


def top(df: DataFrame, key: str, order: Sequence[Column], k: int, out: str = "rank0") -> DataFrame:
    """The first k rows of each key by order, with their 0-based rank; the literal k lets Spark cut before the shuffle."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", number).where(F.col("_n") <= k).withColumn(out, F.col("_n") - 1).drop("_n")
