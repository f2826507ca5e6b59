"""Registered queries of the engine's operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.config import Config
from quernstone.functions import coerce, geo, text, vector
from quernstone.functions.windows import top
from quernstone.operators import cleaning, filters, metrics, qualify, retrieval, sampling, usage
from quernstone.plans import fixture as fx
from quernstone.plans.benchmark import QUERIES as BENCHMARK
from quernstone.plans.engine import Engine
from quernstone.plans.planner import heuristic_specs
from quernstone.plans.scratch import written

R = 9


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    rows = fx.embedded(spark, sf_dir).withColumn("document", F.col("description"))
    return Engine(rows)


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.survivors(fx.companies(spark, sf_dir), fx.specs(spark)).select("query_id", "org_id")


def coerce_companies(spark, sf_dir):
    k = F.col("c_custkey")
    raw = fx.table(spark, sf_dir, "customer").select(
        k.alias("org_id"),
        F.when(k % 7 == 0, "n/a").when(k % 7 == 1, F.concat((1950 + k % 75).cast("string"), F.lit(".0"))).when(k % 7 == 2, "NaN").when(k % 7 != 3, (1950 + k % 75).cast("string")).alias("year"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), F.substring("c_mktsegment", 1, 2), F.lit(" "))).when(k % 3 == 1, "UK").otherwise("c_name").alias("country"),
        F.when(k % 4 == 0, "true").when(k % 4 == 1, "false").when(k % 4 == 2, "1").alias("public"),
        F.when(k % 5 == 0, "4.8e7").when(k % 5 == 1, "Infinity").otherwise(k.cast("string")).alias("revenue"),
    )
    return raw.select("org_id", coerce.as_long(F.col("year")).alias("year_founded"), geo.normalise_code(F.col("country")).alias("country_code"), coerce.as_boolean(F.col("public")).alias("is_public"), coerce.as_double(F.col("revenue")).alias("revenue"))


def dedupe_pairs(spark, sf_dir):
    return cleaning.pairs_of_duplicates(fx.companies(spark, sf_dir))


def dedupe_companies(spark, sf_dir):
    merged = cleaning.dedupe(fx.companies(spark, sf_dir))
    return merged.select("org_id", "operational_name", "year_founded", "employee_count", "revenue", "is_public", "country_code", F.size("secondary_codes").alias("n_codes"), "merged")


def dense_company_ids(spark, sf_dir):
    kept = cleaning.dedupe(fx.companies(spark, sf_dir)).select("org_id", F.col("org_id").alias("old_id"))
    return cleaning.dense_ids(kept).select("old_id", F.col("org_id").cast("long").alias("org_id"))


def dataset_summary(spark, sf_dir):
    out = cleaning.dataset_summary(fx.companies(spark, sf_dir))
    return out.select(*[F.round(c, R).alias(c) if c != "n" else F.col(c) for c in out.columns])


def country_histogram(spark, sf_dir):
    return cleaning.country_histogram(fx.companies(spark, sf_dir))


def company_documents(spark, sf_dir):
    return fx.companies(spark, sf_dir).select("org_id", F.sha2(text.company_document(), 256).alias("document_sha256"))


def company_cards(spark, sf_dir):
    return fx.companies(spark, sf_dir).select("org_id", F.sha2(text.company_card(), 256).alias("card_sha256"))


def geo_expand(spark, sf_dir):
    tokens = fx.table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*map(F.lit, _TOKENS)), (F.col("n_nationkey") % len(_TOKENS) + 1).cast("int")).alias("token"))
    return geo.resolve(tokens).select("n_nationkey", "token", F.array_join("resolved", ",").alias("resolved"))


_TOKENS = ("Nordics", "germany", "UK", "zz", "deu", "Atlantis", "european union", "Asia-Pacific", "el", "worldwide", " France! ")


def _benchmark(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, t) for q, _, t in BENCHMARK], "query_id string, text string")


def geo_text_scan(spark, sf_dir):
    return geo.scan_text(_benchmark(spark), "query_id", "text").select("query_id", "phrase", F.array_join("codes", ",").alias("codes"))


def heuristic_plan(spark, sf_dir):
    return heuristic_specs(_benchmark(spark)).select("query_id", "complexity", "employees_min", "employees_max", "revenue_min", "founded_min", "founded_max", "want_public", F.array_join("keywords", " ").alias("keywords"), F.array_join("countries", ",").alias("countries"))


def filter_tri(spark, sf_dir):
    return filters.apply_filters(fx.companies(spark, sf_dir), fx.specs(spark))


def filter_tally(spark, sf_dir):
    return filters.tally(fx.companies(spark, sf_dir), fx.specs(spark))


def filter_relaxed(spark, sf_dir):
    return filters.survivors_relaxed(fx.companies(spark, sf_dir), fx.specs(spark)).select("query_id", "org_id", "relaxed", F.array_join("unknown", ",").alias("unknown"))


def filter_survivors(spark, sf_dir):
    return filters.survivors(fx.companies(spark, sf_dir), fx.specs(spark)).select("query_id", "org_id", F.array_join("unknown", ",").alias("unknown"))


def tokenize_postings(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("org_id"), F.col("text").alias("document"))
    return retrieval.postings(docs)


def bm25_scores(spark, sf_dir):
    docs = fx.companies(spark, sf_dir).select("org_id", F.col("description").alias("document"))
    out = retrieval.bm25(_keys(spark, sf_dir), retrieval.postings(docs), retrieval.lengths(docs), retrieval.query_terms(fx.specs(spark)))
    return out.select("query_id", "org_id", F.round("bm25", 6).alias("bm25"))


def prefix_affinity(spark, sf_dir):
    codes = fx.companies(spark, sf_dir).select("org_id", F.col("primary_code.code").alias("code"))
    return retrieval.prefix_affinity(codes, fx.specs(spark)).select("query_id", "org_id", F.round("code_score", 6).alias("code_score"), F.col("matched").cast("int").alias("matched"))


def dense_topk(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("org_id"), "embedding")
    return retrieval.nearest(vectors, fx.query_vectors(spark, sf_dir), 25).select("query_id", "org_id", F.round("similarity", 6).alias("similarity"), F.col("rank0").cast("int").alias("rank0"))


def dense_search(spark, sf_dir):
    """Every vector whose id is divisible by 50 as a query, in blocks, against all vectors."""
    vectors = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("org_id"), "embedding")
    asked = vectors.where("org_id % 50 = 0").select(F.col("org_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.nearest(vectors, asked, 10, 16).select("query_id", "org_id", F.round("similarity", 6).alias("similarity"), F.col("rank0").cast("int").alias("rank0"))


def normalise_vectors(spark, sf_dir):
    length = F.sqrt(vector.dot(F.col("v"), F.col("v")))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", vector.l2_normalise(F.col("embedding")).alias("v")).select("vec_id", F.round(length, 6).alias("length"), F.round(F.element_at("v", 1), 6).alias("first"))


def rrf_fusion(spark, sf_dir):
    out = _engine(spark, sf_dir).fused(fx.specs(spark), fx.query_vectors(spark, sf_dir))
    return out.select("query_id", "org_id", F.round("fused", R).alias("fused"))


def hybrid_shortlist(spark, sf_dir):
    out = _engine(spark, sf_dir).shortlist(fx.specs(spark), fx.query_vectors(spark, sf_dir))
    return out.select("query_id", "org_id", F.round("fused", R).alias("fused"), F.col("rank0").cast("int").alias("rank0"))


def _judged(spark, sf_dir):
    engine, specs = _engine(spark, sf_dir), fx.specs(spark)
    listed = qualify.keyword_hits(engine.shortlist(specs, fx.query_vectors(spark, sf_dir)), engine.lexicon(specs)[0], specs)
    return qualify.adjudicate_by_rules(listed)


def adjudicate_batches(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", "org_id", F.col("batch").cast("int").alias("batch"), "local_id", "verdict", F.round(F.col("confidence") * 100).cast("int").alias("conf_pct"))


def escalation_pick(spark, sf_dir):
    return qualify.escalation_pick(_judged(spark, sf_dir)).select("query_id", "org_id", F.col("pick").cast("int").alias("pick"))


def banded_rank(spark, sf_dir):
    out = _engine(spark, sf_dir).run(fx.specs(spark), fx.query_vectors(spark, sf_dir))
    return out.select("query_id", "org_id", "place", "verdict", F.round("score", 6).alias("score"), "escalated", "tier")


def rank_all(spark, sf_dir):
    out = _engine(spark, sf_dir).run(fx.specs(spark), fx.query_vectors(spark, sf_dir), include_rejected=True)
    return out.select("query_id", "org_id", "verdict", F.round("score", 6).alias("score"))


def _runs(spark, sf_dir):
    """Two systems over vec_id as org_id: dense neighbours, and the same in order of id; the search is done once."""
    near = written(retrieval.nearest(fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("org_id"), "embedding"), fx.query_vectors(spark, sf_dir), 25), "near")
    dense = near.select("query_id", F.lit("dense").alias("system"), "org_id", (F.col("rank0") + 1).alias("pos"))
    plain = top(near.where("rank0 % 2 = 0"), "query_id", [F.col("org_id")], 25, "at").select("query_id", F.lit("plain").alias("system"), "org_id", (F.col("at") + 1).alias("pos"))
    return dense.unionByName(plain)


def metrics_at_k(spark, sf_dir):
    out = metrics.summarise(_runs(spark, sf_dir), fx.grades(spark, sf_dir))
    whole = ("returned", "found", "in_pool")
    return out.select(*[F.col(c).cast("long").alias(c) if c in whole else c if c in ("query_id", "system") else F.round(c, R).alias(c) for c in out.columns])


def pool_union(spark, sf_dir):
    return metrics.pool(_runs(spark, sf_dir)).select("query_id", "org_id", F.col("first_pos").cast("int").alias("first_pos"), F.col("systems").cast("int").alias("systems"))


def _raters(spark, sf_dir):
    return fx.table(spark, sf_dir, "labels").select("doc_id", (2 * F.col("quality") + 1 - F.col("toxic")).alias("a"), F.when(F.col("doc_id") % 5 == 0, 1 + F.col("quality")).otherwise(2 * F.col("quality") + 1 - F.col("toxic")).alias("b"))


def kappa(spark, sf_dir):
    return metrics.kappa(_raters(spark, sf_dir)).select("n", *[F.round(c, R).alias(c) for c in ("observed", "expected", "kappa")])


def binary_scores(spark, sf_dir):
    out = metrics.binary_scores(_raters(spark, sf_dir), F.col("b") >= 2, F.col("a") >= 2)
    return out.select("tp", "fp", "fn", *[F.round(c, R).alias(c) for c in ("precision", "recall", "f1")])


def rater_agreement(spark, sf_dir):
    out = metrics.agreement(_raters(spark, sf_dir))
    return out.select("n", *[F.round(c, R).alias(c) for c in ("exact", "within_one", "mean_a", "mean_b")])


def jaccard(spark, sf_dir):
    lists = _runs(spark, sf_dir).select("query_id", F.col("system").alias("run"), "org_id", "pos")
    return metrics.run_pairs(lists).select("query_id", "run_a", "run_b", F.round("jaccard", R).alias("jaccard"), F.round("head_overlap", R).alias("head_overlap"))


def verdict_flips(spark, sf_dir):
    runs = _runs(spark, sf_dir).select("query_id", F.col("system").alias("run"), "org_id", F.when(F.col("pos") <= 5, "QUALIFIED").otherwise("PARTIAL").alias("verdict"))
    return metrics.verdict_flips(runs, 2)


def stratified_sample(spark, sf_dir):
    graded = fx.table(spark, sf_dir, "labels").select("doc_id", (2 * F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return sampling.stratified(graded, "grade", "doc_id", {3: 5, 2: 6, 1: 6, 0: 3}, seed=11, top_up=20)


def usage_costs(spark, sf_dir):
    calls = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 997).alias("prompt_tokens"), (F.col("user_id") % 97).alias("output_tokens"))
    prices = spark.createDataFrame([("click", 0.10, 0.40), ("view", 0.15, 0.0)], "model string, price_in double, price_out double")
    return usage.usage(calls, prices).select("model", "calls", "prompt_tokens", "output_tokens", F.round("cost", R).alias("cost"))


def cache_probe(spark, sf_dir):
    """Misses of a cache that holds every text of even id: texts are wanted by content, so copies of a cached text hit."""
    keyed = fx.table(spark, sf_dir, "documents").select("doc_id", usage.cache_key(F.lit("embed"), F.lit("m"), F.col("text")).alias("key"))
    return keyed.join(keyed.where("doc_id % 2 = 0").select("key").distinct(), "key", "left_anti").select("doc_id", "key")


def embed_batches(spark, sf_dir):
    """All texts through an embedding service that answers with a text's length and the size of its batch."""
    from quernstone.sources import connector

    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = connector.embed(docs, lambda texts: [[len(t), len(texts)] for t in texts], 2, Config(embed_per_minute=10**9))
    return out.select("doc_id", F.element_at("embedding", 1).cast("long").alias("chars"), (F.element_at("embedding", 2) <= Config().embed_batch).alias("in_batch"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        coerce_companies, dedupe_pairs, dedupe_companies, dense_company_ids, dataset_summary, country_histogram, company_documents, company_cards,
        geo_expand, geo_text_scan, heuristic_plan, filter_tri, filter_tally, filter_relaxed, filter_survivors, tokenize_postings, bm25_scores,
        prefix_affinity, dense_topk, dense_search, normalise_vectors, rrf_fusion, hybrid_shortlist, adjudicate_batches, escalation_pick, banded_rank, rank_all,
        metrics_at_k, pool_union, kappa, binary_scores, rater_agreement, jaccard, verdict_flips, stratified_sample, usage_costs, cache_probe, embed_batches,
    )
}
