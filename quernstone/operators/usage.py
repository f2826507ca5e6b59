"""Usage counters, costs, and the content-addressed result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.config import DEFAULT_PRICE


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls(model, prompt_tokens, output_tokens) with cost in USD; an unknown model has the default price. prices is a constant table."""
    met = calls.join(F.broadcast(prices.select("model", "price_in", "price_out")), "model", "left")
    cost = (F.col("prompt_tokens") * F.coalesce("price_in", F.lit(DEFAULT_PRICE[0])) + F.col("output_tokens") * F.coalesce("price_out", F.lit(DEFAULT_PRICE[1]))) / 1e6
    return met.withColumn("cost", cost).drop("price_in", "price_out")


def usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Sums per model."""
    return costs(calls, prices).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))


def cache_key(namespace: Column, model: Column, payload: Column) -> Column:
    """sha256 over namespace, model and payload; the model is the one that answers."""
    return F.sha2(F.concat_ws("\x1f", namespace, model, payload), 256)


class ResultCache:
    """key, ns, value, created as Parquet, partitioned by ns; a later write of a key replaces an earlier one on reading."""

    SCHEMA = "key string, value string, created timestamp, ns string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows.groupBy("ns", "key").agg(F.max_by("value", "created").alias("value"), F.max("created").alias("created"))

    def put(self, rows: DataFrame) -> None:
        rows.select("key", "value", F.current_timestamp().alias("created"), "ns").write.mode("append").partitionBy("ns").parquet(self.path)

    def probe(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """wanted(key, ...) split into hits (with value) and misses."""
        known = self.read().select("key", "value")
        return wanted.join(known, "key"), wanted.join(known, "key", "left_anti")

    def stats(self) -> DataFrame:
        return self.read().groupBy("ns").agg(F.count(F.lit(1)).alias("entries"))

    def clear(self, namespace: str | None = None) -> None:
        target = self.path if namespace is None else f"{self.path}/ns={namespace}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """Per model, what now(model, calls, prompt_tokens, output_tokens, cost) has more than before; models without a change go."""
    figures = ("calls", "prompt_tokens", "output_tokens", "cost")
    old = before.select("model", *[F.col(c).alias(f"_{c}") for c in figures])
    met = now.join(old, "model", "left")
    return met.select("model", *[(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in figures]).where("calls <> 0")


def merge(*parts: DataFrame) -> DataFrame:
    """Sums per model over several usages."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("calls", "prompt_tokens", "output_tokens", "cost")])


def funnel(queries: DataFrame, database: int, kept: DataFrame, listed: DataFrame, judged: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per query: database, after_filter, relaxed, shortlist, escalated, returned, qualified; 0 where a stage has no row."""
    count = lambda df, name, *more: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name), *more)
    out = queries.select("query_id").withColumn("database", F.lit(database).cast("long"))
    for part in (
        count(kept, "after_filter", F.max(F.col("relaxed").cast("int")).alias("relaxed")),
        count(listed, "shortlist"),
        judged.groupBy("query_id").agg(F.count_if("escalated").alias("escalated")),
        count(ranked, "returned", F.count_if(F.col("verdict") == "QUALIFIED").alias("qualified")),
    ):
        out = out.join(part, "query_id", "left")
    return out.fillna(0)
