"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.windows import running_sum
from quernstone.plans.scratch import forget, scratch_dir, tidy, written

#: A key is hot when it has more than 1/HOT_SHARE of all rows; so there are at most HOT_SHARE hot keys, whatever the input.
HOT_SHARE = 1000

#: Up to this number of row numbers (8 bytes each) a list of them is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000

__all__ = ["HOT_SHARE", "forget", "free_name", "integer_ids", "join_counted", "join_rows", "numbered", "running_sum", "scratch_dir", "table", "tidy", "word_count", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integer_ids(docs: DataFrame, id_col: str) -> None:
    """Raises a TypeError unless id_col holds integers: smallest ids are compared as numbers."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")


def free_name(columns: list[str], name: str) -> str:
    """name, or what comes of it by underscores so that no column is named like it (case does not matter)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a number for each row, and that column's name: its id where no id is null or repeated, else one that is written
    with the rows, so that it never changes."""
    column = free_name(docs.columns, "_row")
    counts = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    if not counts.where((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).count():
        return docs.withColumn(column, F.col(id_col).cast("long")), column
    return written(docs.withColumn(column, F.monotonically_increasing_id()), "numbered"), column


def join_rows(docs: DataFrame, side: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """docs joined with side by the row numbers of numbered, which are unique in both."""
    side = written(side, "rows")
    return docs.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, column, how)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in text; null has none."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(
        F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1
    ).cast("long")


def join_counted(rows: DataFrame, entries: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """Joins rows with entries (unique by key, count = how many rows have the key) without a hot partition.

    Keys of more than total / HOT_SHARE rows number fewer than HOT_SHARE, so broadcasting those few entries has a proven
    bound; all other keys have at most total / HOT_SHARE rows each and go through an ordinary shuffle join.
    """
    limit = max(1, total // HOT_SHARE)
    hot = entries.where(F.col(count) > limit)
    payload = [c for c in entries.columns if c != key]
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*payload).alias("_hot"))), key, "left")
    # Rows that are served already leave the shuffle join's key, and are dealt by a key of their own.
    cold_key = F.when(F.col("_hot").isNull(), F.col(key))
    salted = marked.withColumn("_cold", cold_key).withColumn("_salt", F.when(F.col("_cold").isNull(), F.monotonically_increasing_id()).otherwise(0))
    cold = entries.where(F.col(count) <= limit).select(F.col(key).alias("_cold"), F.lit(0).cast("long").alias("_salt"), F.struct(*payload).alias("_rest"))
    joined = salted.join(cold, ["_cold", "_salt"], "left").withColumn("_got", F.coalesce("_hot", "_rest"))
    if how == "inner":
        joined = joined.where(F.col("_got").isNotNull())
    return joined.select(*rows.columns, *[F.col(f"_got.{c}").alias(c) for c in payload])
