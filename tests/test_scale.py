"""What only shows at size: shuffled joins of unions, and work that must not grow faster than its input."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone import queries
from quernstone.config import Config
from quernstone.functions import embed, vector
from quernstone.operators import metrics, retrieval
from quernstone.plans import corpus, engine, evaluation, scratch
from quernstone.plans import fixture as fx
from quernstone.sources import connector

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled(spark):
    """No join is a broadcast, as on large tables."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    yield spark
    for n in names:
        spark.conf.unset(n)


def test_runs_of_a_union_are_compared_by_shuffles(shuffled):
    rows = queries._runs(shuffled, DATA).withColumnRenamed("system", "run")
    assert {(r.run_a, r.run_b) for r in metrics.run_pairs(rows).collect()} == {("dense", "plain")}
    # The same with lists that come straight from a window.
    near = shuffled.createDataFrame([(q, i) for q in "ab" for i in range(9)], "query_id string, org_id long")
    lists = lambda run, order: queries.top(near, "query_id", [order], 4).select("query_id", F.lit(run).alias("run"), "org_id", (F.col("rank0") + 1).alias("pos"))
    union = lists("x", F.col("org_id")).unionByName(lists("y", F.desc("org_id")))
    assert [r.jaccard for r in metrics.run_pairs(union).collect()] == [0.0, 0.0]
    got = evaluation.stability(union.withColumn("verdict", F.lit("QUALIFIED")), 2).collect()
    assert sorted((r.query_id, r.mean_jaccard, r.unstable, r.stable) for r in got) == [("a", 0.0, 8, 0), ("b", 0.0, 8, 0)]


def test_waves_of_an_embedder_are_one_job_and_each_stays(spark, tmp_path):
    def jobs(n):
        docs = spark.createDataFrame([(i, f"text {i}") for i in range(n)], "org_id long, document string")
        spark.sparkContext.setJobGroup(f"waves-{n}", "")
        assert corpus.embed_corpus(docs, str(tmp_path / f"s{n}"), embed.hashed, "m", wave_rows=1)["misses"] == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"waves-{n}"))

    few, many = jobs(4), jobs(40)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + 2

    def broken(text):  # one text fails; the waves that were done before stay
        return embed.hashed(F.when(text == "text 7", F.raise_error(F.lit("quota"))).otherwise(text))

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "org_id long, document string")
    with pytest.raises(Exception, match="quota"):
        corpus.embed_corpus(docs, str(tmp_path / "broken"), broken, "m", wave_rows=1)
    got = corpus.embed_corpus(docs, str(tmp_path / "broken"), embed.hashed, "m", wave_rows=1)
    assert got["hits"] + got["misses"] == 40 and 0 < got["hits"] < 40


def test_hashed_counts_tokens_by_cell(spark):
    text = "red apples red pears " * 3 + "green"
    want = [0.0] * 64
    for t in text.split():
        cell = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 128
        want[cell % 64] += 1 if cell < 64 else -1
    rows = spark.createDataFrame([(0, text), (1, ""), (2, None)], "i int, t string").select("i", embed.hashed(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in rows] == [want, [0.0] * 64, None]


def test_many_queries_are_searched_in_one_pass(spark):
    vectors = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)] + [(999, None)]
    rows = spark.createDataFrame(vectors, "org_id long, embedding array<float>")
    asked = rows.where("org_id % 5 = 0").select(F.col("org_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    listed = lambda df: sorted((r.query_id, r.rank0, r.org_id, r.similarity) for r in df.collect())
    found = retrieval.nearest(rows, asked, 6, 3)
    assert found._jdf.queryExecution().toString().count("Scan") <= 4 and listed(found) == listed(retrieval.nearest(rows, asked, 6))
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in vectors[:-1]}
    want = [(str(q), n, i, s) for q in range(0, 200, 5) for n, (s, i) in enumerate(sorted(((-round(float(v[q] @ v[i]), 12), i) for i in v))[:6])]
    assert [x[:3] for x in listed(found)] == sorted(x[:3] for x in want)
    assert len(retrieval.nearest(rows, asked.limit(0), 6, 3).collect()) == 0


def test_a_service_reads_in_rounds_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(connector, "ROUND_BYTES", 1)
    monkeypatch.setattr(scratch, "PORTION_ROWS", 10)

    def service(texts):
        from pyspark import TaskContext

        return [[float(TaskContext.get().stageId()), float(len(t))] for t in texts]

    rows = connector.embed(spark.range(60).coalesce(1).select("id", F.concat(F.lit("t"), "id").alias("text")), service, 2, Config(embed_per_minute=10**9)).collect()
    assert sorted(r.id for r in rows) == list(range(60)) and all(r.embedding[1] == len(r.text) for r in rows)
    stages = [r.embedding[0] for r in rows]
    assert max(map(stages.count, set(stages))) <= 10
    assert connector.embed(spark.range(0).select("id", F.lit("").alias("text")), service, 2).count() == 0
    assert connector.TokenBucket(60, clock=lambda: 0.0, full=False).tokens == 0


def test_terms_are_counted_within_a_row_and_frequent_ones_are_cut(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "red apples red Red"), (1, ""), (2, None), (3, "pears")], "org_id long, document string")
    listed = lambda df: sorted(tuple(r) for r in df.collect())
    assert listed(retrieval.postings(docs)) == [(0, "apples", 1, 4), (0, "red", 3, 4), (3, "pears", 1, 1)]
    assert listed(retrieval.postings(docs.unionByName(docs.where("org_id = 0")))) == [(0, "apples", 2, 4), (0, "red", 6, 4), (3, "pears", 1, 1)]
    assert "Exchange" not in retrieval.postings(docs)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "PART_TOKENS", 100)
    same = spark.range(1000).select(F.col("id").alias("org_id"), F.lit("same").alias("term"), F.lit(1).alias("tf"), F.lit(1).alias("length"))
    sizes = [r["count"] for r in retrieval.by_term(same, 1000).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 300


def test_a_run_counts_its_own_terms_only(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(engine, "written", lambda df, name: kept.setdefault(name, []).append(out := scratch.written(df, name)) or out)
    rows = fx.embedded(spark, DATA).withColumn("document", F.col("description"))
    specs, vectors, one = fx.specs(spark), fx.query_vectors(spark, DATA), F.col("query_id") == "s01"
    listed = lambda e, which: sorted(map(str, e.shortlist(which, vectors).collect()))
    own = engine.Engine(rows)
    assert listed(own, specs.where(one)) and "postings" not in kept
    assert own.lexicon(specs.where(one)) and len(kept["words"]) == 1
    named = {r.term for r in retrieval.query_terms(specs.where(one)).collect()}
    assert {r.term for r in kept["words"][0].select(F.explode("_runs").alias("r")).select("r.term").collect()} <= named
    assert kept["words"][0].select("org_id", "length").exceptAll(retrieval.lengths(rows)).count() == 0 == retrieval.lengths(rows).exceptAll(kept["words"][0].select("org_id", "length")).count()
    # Other terms: now the whole index is built, and kept. An engine with an index from outside gives the same.
    every = listed(own, specs)
    outside = engine.Engine(rows, index=own.index, sizes=own.sizes)
    assert every == listed(engine.Engine(rows), specs) and outside.lexicon(specs) == own.lexicon(specs) and len(kept["postings"]) == 1
    # More terms than can be named.
    monkeypatch.setattr(retrieval, "PUSHED_TERMS", 2)
    assert listed(engine.Engine(rows), specs) == every and len(kept["postings"]) == 2


def test_lengths_of_vectors_and_prefixes_are_worked_out_once_a_row(spark):
    vectors = [(i, [float(i % 7) / 3, float(i % 5), 0.1]) for i in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0])]
    rows = spark.createDataFrame(vectors, "org_id long, embedding array<float>")
    asked = spark.createDataFrame([("a", [0.3, 1.0, 2.0]), ("b", [1.0, 0.0, 0.7])], "query_id string, vector array<float>")
    kept = rows.select("org_id").crossJoin(asked.select("query_id"))
    found = retrieval.dense(kept, rows, asked)
    met = kept.join(rows, "org_id").join(asked, "query_id")
    assert sorted(map(str, found.collect())) == sorted(map(str, met.select("query_id", "org_id", vector.cosine(F.col("embedding"), F.col("vector")).alias("dense")).collect()))
    top = found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert top.count("aggregate(") == 1

    specs = spark.createDataFrame([("a", ["31", "3112", "31"]), ("b", [""]), ("c", []), ("d", ["9"])], "query_id string, prefixes array<string>")
    codes = spark.createDataFrame([(1, "311299"), (1, "9"), (2, "31"), (3, ""), (4, None), (5, "3")], "org_id long, code string")
    got = retrieval.prefix_affinity(codes, specs)
    assert sorted((r.query_id, r.org_id, r.matched) for r in got.collect()) == [("a", 1, 4), ("a", 2, 2), ("d", 1, 1)]
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert retrieval.prefix_affinity(codes, specs.where("query_id = 'c'")).count() == 0
