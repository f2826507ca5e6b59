"""Profiles to a searchable corpus: parse, merge duplicates, render, embed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import embed as embedders
from quernstone.functions import text
from quernstone.functions.vector import l2_normalise
from quernstone.operators import cleaning
from quernstone.plans.engine import Engine
from quernstone.plans.planner import heuristic_specs
from quernstone.plans.scratch import forget, portions, written
from quernstone.sources import profiles


def load(spark: SparkSession, path: str, deduplicate: bool = True) -> DataFrame:
    companies = cleaning.parse_profiles(profiles.read_profiles(spark, path))
    if deduplicate:
        companies = cleaning.dense_ids(cleaning.dedupe(companies).drop("merged"))
    return companies


def engine(companies: DataFrame, embedder: Callable = embedders.hashed, config=None, store: str | None = None, model: str = "hashed", rebuild: bool = False) -> Engine:
    """The engine over companies. With a store (a folder) embeddings are kept there and only new or changed texts are embedded."""
    ready = companies.withColumn("document", text.company_document())
    if store is None:
        ready = ready.withColumn("embedding", l2_normalise(embedder(F.substring("document", 1, 8000))))
    else:
        embed_corpus(ready.select("org_id", "document"), store, embedder, model, rebuild=rebuild)
        ready = with_embeddings(ready, store, model)
    ready = written(ready, "corpus")
    return Engine(ready) if config is None else Engine(ready, config)


#: Texts that are embedded and appended together: what an interrupted run has bought stays.
WAVE_ROWS = 100_000
#: Texts that one task embeds at most where no service is asked.
TASK_ROWS = 5_000
#: A task's file is moved to its place when the task ends, not when the whole job does.
KEPT_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def embed_corpus(documents: DataFrame, store: str, embedder: Callable, model: str, dimension: int = embedders.DIMENSION, chars: int = 8000, rebuild: bool = False, wave_rows: int = WAVE_ROWS, service: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Embeds the texts of documents(org_id, document) that the store lacks; hits and misses. rebuild takes all for misses.

    service(rows of fingerprint, text), which adds embedding (``connector.embed``), takes the place of the embedder. Texts are known by
    fingerprint (of text, model and dimension), so equal texts are embedded once. Misses go in waves by fingerprint, each appended
    when it is done. Waves of the embedder are tasks of one job; a service is handed one wave after the other, each read from its
    own files, so no wave reads the misses of another.
    """
    spark = documents.sparkSession
    marked = documents.select(profiles.embedding_fingerprint(F.col("document"), model, dimension).alias("fingerprint"), F.substring("document", 1, chars).alias("text"))
    texts = written(marked.dropDuplicates(["fingerprint"]), "texts")
    known = profiles.stored_embeddings(spark, store)
    missing = texts if rebuild else texts.join(known.select("fingerprint"), "fingerprint", "left_anti")
    missing = written(missing, "missing")
    n, total = missing.count(), texts.count()
    if n and service is None:
        append(missing.repartition(-(-n // min(wave_rows, TASK_ROWS)), "fingerprint").withColumn("embedding", embedder(F.col("text"))), store)
    elif n:
        for wave in portions(missing.select("fingerprint", "text").repartition(-(-n // wave_rows), "fingerprint"), "waves"):
            append(service(wave), store)
            forget(wave)
    return {"hits": total - n, "misses": n}


def append(embedded: DataFrame, store: str) -> None:
    vectors = embedded.select("fingerprint", l2_normalise(F.col("embedding")).alias("embedding"), F.current_timestamp().alias("created"))
    vectors.write.mode("append").options(**KEPT_BY_TASK).parquet(store)


def with_embeddings(companies: DataFrame, store: str, model: str, dimension: int = embedders.DIMENSION) -> DataFrame:
    """companies(document) with embedding from the store, its latest; the zero vector where it has none."""
    known = profiles.stored_embeddings(companies.sparkSession, store)
    keyed = companies.withColumn("fingerprint", profiles.embedding_fingerprint(F.col("document"), model, dimension))
    zero = F.array_repeat(F.lit(0.0), dimension)
    return keyed.join(known, "fingerprint", "left").withColumn("embedding", F.coalesce("embedding", zero)).drop("fingerprint")


def probe(specs: DataFrame) -> DataFrame:
    """query_id, probe: the ideal profile, else the role, else the text; it is embedded like a document."""
    return specs.select("query_id", F.coalesce(text.present(F.col("ideal_profile")), text.present(F.col("role_statement")), F.col("text")).alias("probe"))


def answer(own: Engine, queries: DataFrame, embedder: Callable = embedders.hashed, specs: DataFrame | None = None, include_rejected: bool = False, **options) -> DataFrame:
    """Ranked rows for queries(query_id, text); the probe is the ideal profile, else the role, else the text."""
    specs = heuristic_specs(queries) if specs is None else specs
    vectors = probe(specs).select("query_id", l2_normalise(embedder(F.col("probe"))).alias("vector"))
    return own.run(specs, vectors, include_rejected=include_rejected, **options)


def baseline_embedding(own: Engine, queries: DataFrame, k: int = 20, embedder: Callable = embedders.hashed) -> DataFrame:
    """query_id, org_id, pos: the nearest by the raw query text alone."""
    from quernstone.operators.retrieval import nearest

    vectors = queries.select("query_id", l2_normalise(embedder(F.col("text"))).alias("vector"))
    return nearest(own.companies.select("org_id", "embedding"), vectors, k).select("query_id", "org_id", (F.col("rank0") + 1).alias("pos"))


def rule_match(batch):
    """A judge of one company by the longer words of a request: exercises the plan, says nothing of a model."""
    import pandas as pd

    rows = []
    for r in batch.itertuples():
        words = {w for w in r.text.lower().split() if len(w) > 3}
        share = sum(w in r.card.lower() for w in words) / max(1, len(words))
        rows.append((r.local_id, "QUALIFIED" if share > 0 else "REJECTED", share, "words"))
    return pd.DataFrame(rows, columns=["local_id", "verdict", "confidence", "reason"])


def baseline_exhaustive(own: Engine, queries: DataFrame, judge: Callable, k: int = 25, pool: DataFrame | None = None) -> DataFrame:
    """query_id, org_id, pos, score: every company (or every one of pool(query_id, org_id)) judged on its own.

    The score is match (1 for QUALIFIED, else 0) times confidence; positive ones only, the best k.
    """
    from quernstone.functions.windows import top
    from quernstone.operators.qualify import adjudicate

    cards = own.companies.select("org_id", text.company_card().alias("card"))
    asked = F.broadcast(queries.select("query_id", "text"))
    rows = cards.crossJoin(asked) if pool is None else pool.join(cards, "org_id").join(asked, "query_id")
    verdicts = adjudicate(rows.withColumn("rank0", F.col("org_id")), judge, 1, "exhaustive")
    worth = F.when(F.col("verdict") == "QUALIFIED", F.col("confidence")).otherwise(0.0)
    best = top(verdicts.withColumn("score", worth).where("score > 0"), "query_id", [F.desc("score"), F.col("org_id")], k)
    return best.select("query_id", "org_id", (F.col("rank0") + 1).alias("pos"), "score")
