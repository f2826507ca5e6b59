"""Readers: profiles and labels as JSON lines, embeddings and specs as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("operational_name", "website", "year_founded", "address", "employee_count", "revenue", "primary_naics", "secondary_naics", "description", "business_model", "target_markets", "core_offerings", "is_public")
RAW = T.StructType([T.StructField(c, T.StringType()) for c in FIELDS])


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Every field as a string (objects and lists as their JSON), the line as raw, and pos, which grows along a file.

    Blank lines go. The schema is fixed, so nothing is read to infer one.
    """
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).where(F.trim("value") != "")
    return lines.select("pos", F.from_json("value", RAW).alias("r"), F.col("value").alias("raw")).select("pos", "r.*", "raw")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, company, grade, note; blank lines and // comments go."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("//"))
    return lines.select(F.from_json("value", "query_id string, company string, grade int, note string").alias("r")).select("r.*")


def stored_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint, embedding of a store of embeddings, the latest of each; none if there is no store yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], "fingerprint string, embedding array<double>")
    rows = spark.read.schema("fingerprint string, embedding array<double>, created timestamp").parquet(path)
    return rows.groupBy("fingerprint").agg(F.max_by("embedding", "created").alias("embedding"))


def embedding_fingerprint(text, model: str, dimension: int):
    """Of the text, the model and its dimension, so a change of any of them is a miss."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(dimension)), text), 256)
