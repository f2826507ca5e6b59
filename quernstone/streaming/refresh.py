"""Incremental embedding refresh: new or changed profiles of a stream are embedded once and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.functions.vector import l2_normalise
from quernstone.sources.profiles import embedding_fingerprint


def misses(documents: DataFrame, known: DataFrame, model: str, dimension: int) -> DataFrame:
    """documents(org_id, document) whose fingerprint is not in known(fingerprint)."""
    marked = documents.withColumn("fingerprint", embedding_fingerprint(F.col("document"), model, dimension))
    return marked.join(known.select("fingerprint"), "fingerprint", "left_anti")


def embed(documents: DataFrame, embedder: Callable, chars: int = 8000) -> DataFrame:
    """org_id, fingerprint, embedding (of length 1). embedder is a Column function, native or a pandas UDF, of the cut text."""
    return documents.select("org_id", "fingerprint", l2_normalise(embedder(F.substring("document", 1, chars))).alias("embedding"))


def refresh(stream: DataFrame, path: str, checkpoint: str, embedder: Callable, model: str, dimension: int) -> StreamingQuery:
    """Starts the refresh; a batch that is run again finds its rows there already, so it appends nothing twice."""
    spark = stream.sparkSession

    def known(session: SparkSession) -> DataFrame:
        jpath = session._jvm.org.apache.hadoop.fs.Path(path)
        if not jpath.getFileSystem(session._jsc.hadoopConfiguration()).exists(jpath):
            return session.createDataFrame([], "fingerprint string")
        return session.read.parquet(path).select("fingerprint")

    def append(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession or spark
        fresh = misses(batch.select("org_id", "document").dropDuplicates(["org_id", "document"]), known(session), model, dimension)
        embed(fresh, embedder).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
