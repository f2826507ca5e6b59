"""Registered queries of planning, adjudication, evaluation, embedding stores and reports."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.config import Config
from quernstone.functions import coerce, embed, text
from quernstone.operators import cleaning, filters, metrics, prompts, qualify, ranking, usage, verdicts
from quernstone.plans import corpus, evaluation, planner
from quernstone.plans import fixture as fx
from quernstone.plans.engine import Engine
from quernstone.plans.scratch import scratch_dir
from quernstone.sources import profiles, sinks
from quernstone.streaming import refresh

R = 9
#: Names and weights of the criteria that the answers speak of (fixed values).
CRITERIA = (("Scope", 0.75), ("Place", 0.25))
CRITERIA_SCHEMA = "query_id string, criteria array<struct<name:string,weight:double,must_have:boolean,description:string>>"


def _answers(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers of a model about customers in batches of eight, with every flaw that an answer may have; members; specs."""
    k = F.col("c_custkey")
    rows = fx.table(spark, sf_dir, "customer").select(k.alias("org_id"), F.floor(k / 8).alias("batch"), (k % 8 + 1).cast("int").alias("local_id"))
    k = F.col("org_id")
    item = F.to_json(
        F.struct(
            F.when(k % 13 == 0, F.col("local_id") + 8).otherwise(F.col("local_id")).alias("id"),
            F.when(k % 7 == 0, "MAYBE").when(k % 3 == 0, "qualified").when(k % 3 == 1, "PARTIAL").otherwise("REJECTED").alias("verdict"),
            F.when(k % 11 == 0, "abc").otherwise(((k % 150) / 100).cast("string")).alias("confidence"),
            F.concat(F.lit(" seen "), k.cast("string")).alias("reason"),
            F.when(k % 2 == 0, F.array(F.lit("SCOPE"))).otherwise(F.array(F.lit("other"))).alias("criteria_met"),
            F.when(k % 3 == 0, F.array(F.lit("place"))).otherwise(F.array().cast("array<string>")).alias("criteria_failed"),
            F.when(k % 9 != 0, (k % 7 - 1).cast("string")).otherwise("x").alias("grade"),
            F.concat(F.lit("as "), k.cast("string"), F.lit(" ")).alias("justification"),
        )
    )
    listed = rows.withColumn("_item", F.struct("local_id", item.alias("j"))).groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_item")), lambda x: x["j"]), ",").alias("_items"))
    body = F.concat(F.lit('{"results":['), F.col("_items"), F.lit('],"grades":['), F.col("_items"), F.lit("]}"))
    b = F.col("batch")
    answer = F.when(b % 10 == 9, F.substring(body, 1, 20)).when(b % 4 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" - done"))).otherwise(body)
    answers = listed.select(F.lit("c").alias("query_id"), "batch", answer.alias("answer"))
    specs = spark.createDataFrame([("c", [(n, w, True, "") for n, w in CRITERIA])], CRITERIA_SCHEMA)
    return answers, rows.withColumn("query_id", F.lit("c")), specs


def parse_verdicts(spark, sf_dir):
    answers, members, specs = _answers(spark, sf_dir)
    got = verdicts.parse_verdicts(answers, members, specs, "cheap").withColumn("escalated", F.lit(False))
    out = ranking.with_verdicts(members.select("query_id", "org_id"), got)
    return out.select("org_id", "verdict", F.round("confidence", 4).alias("confidence"), "reason", "tier")


def rank_with_criteria(spark, sf_dir):
    answers, members, specs = _answers(spark, sf_dir)
    got = verdicts.parse_verdicts(answers, members, specs, "cheap").withColumn("escalated", F.lit(False))
    candidates = members.select(
        "query_id", "org_id", F.col("org_id").alias("rank0"), ((F.col("org_id") % 97) / 97.0).alias("fused"), F.when(F.col("org_id") % 5 == 0, F.array(F.lit("revenue"))).otherwise(F.array().cast("array<string>")).alias("unknown"), F.concat(F.lit("Name "), F.col("org_id").cast("string")).alias("name")
    )
    judged = ranking.with_satisfaction(ranking.with_verdicts(candidates, got), specs)
    grouped = judged.withColumn("query_id", F.concat(F.lit("g"), F.floor(F.col("org_id") / 50).cast("string")))
    out = ranking.rank(grouped)
    return out.select("query_id", "org_id", "place", "verdict", F.round("satisfaction", R).alias("satisfaction"), F.round("score", R).alias("score"), "tier")


def judge_grades(spark, sf_dir):
    answers, members, _ = _answers(spark, sf_dir)
    return verdicts.parse_grades(answers, members).select("org_id", "grade", "justification")


#: query_id, text and a planner's answer (fixed values): odd types, odd fences, places by name, code or text, malformed criteria.
PLANS = (
    ("p1", "banks in France", '{"complexity": "structured", "geography": ["Nordics", "zz top"], "employee_min": "100", "employee_max": 250.5, "is_public": true, "naics_prefixes": ["52", "5x", " 522 "], "keywords": [" bank ", ""], "criteria": [{"name": " Lends ", "weight": "0.8", "must_have": true, "description": " x "}, {"name": "Bad", "weight": "heavy"}], "disqualifiers": ["fintech "]}'),
    ("p2", "banks in France", '{"complexity": "HARD", "geography": [], "revenue_min_usd": "1e6", "is_public": "yes", "role_statement": " lends "}'),
    ("p3", "mills", 'Sure:\n```json\n{"complexity": "REASONING", "geography": ["deu", "UK"], "founded_after": 1990, "founded_before": "n/a", "is_public": false}\n```'),
    ("p4", "more than 50 employees in Romania", '{"complexity": "STRUCT'),
    ("p5", "private mills founded after 2001", None),
)


def _planned(spark):
    rows = spark.createDataFrame([(q, t, a) for q, t, a in PLANS], "query_id string, text string, answer string")
    return planner.plan_queries(rows, rows)


def plan_from_json(spark, sf_dir):
    """Planned by the model, or by rules where its answer is of no use."""
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",")
    criteria = F.transform("criteria", lambda c: F.concat_ws(":", c["name"], c["weight"].cast("string"), c["must_have"].cast("string"), c["description"]))
    return _planned(spark).select("query_id", "planned_by", "complexity", "employees_min", "employees_max", "revenue_min", "founded_min", "founded_max", "want_public", joined(F.col("prefixes")).alias("prefixes"), joined(F.col("countries")).alias("countries"), joined(F.col("keywords")).alias("keywords"), "role_statement", joined(criteria).alias("criteria"), joined(F.col("disqualifiers")).alias("disqualifiers"))


def hard_constraints(spark, sf_dir):
    return fx.specs(spark).unionByName(_planned(spark).select(*[c for c in fx.specs(spark).columns if c != "vec_id"], F.lit(0).cast("long").alias("vec_id"))).select("query_id", filters.has_hard_constraints().alias("hard"))


def query_probes(spark, sf_dir):
    specs = fx.specs(spark).withColumn("text", F.array_join("keywords", " "))
    return corpus.probe(specs)


def funnel_counts(spark, sf_dir):
    engine = Engine(fx.embedded(spark, sf_dir).withColumn("document", F.col("description")))
    out = engine.funnel(fx.specs(spark), fx.query_vectors(spark, sf_dir))
    return out.select("query_id", *[F.col(c).cast("long").alias(c) for c in ("database", "after_filter", "relaxed", "shortlist", "escalated", "returned", "qualified")])


def prompt_batches(spark, sf_dir):
    """All companies as candidates of one spec, in batches of eight."""
    spec = fx.specs(spark).where("query_id = 's05'").withColumns({"text": F.lit("the request"), "criteria": F.expr("array(named_struct('name', 'Scope', 'weight', 0.75D, 'must_have', true, 'description', 'does it'))"), "disqualifiers": F.array(F.lit("vendors"))})
    rows = fx.companies(spark, sf_dir).select(F.lit("s05").alias("query_id"), "org_id", F.col("org_id").alias("rank0"), text.company_card().alias("card"), F.when(F.col("org_id") % 4 == 0, F.array(F.lit("revenue"), F.lit("year_founded"))).otherwise(F.array().cast("array<string>")).alias("unknown"))
    out = prompts.verdict_prompts(rows, spec, Config().qualify_batch)
    return out.select("batch", F.sha2("prompt", 256).alias("prompt_sha256"), F.substring_index("prompt", "\n\n", 1).alias("header"))


def coerce_codes(spark, sf_dir):
    """Mappings, lists and codes as JSON, as printed literals, and as junk."""
    k = F.col("c_custkey")
    show = lambda c: c.cast("string")
    one = F.when(k % 6 == 0, F.concat(F.lit('{"code": "'), show(k), F.lit('", "label": "a"}'))).when(k % 6 == 1, F.concat(F.lit("{'code': "), show(k), F.lit(", 'label': None, 'share': 0.5}"))).when(k % 6 == 2, "{}").when(k % 6 == 3, "junk").when(k % 6 == 4, "[]")
    many = F.when(k % 5 == 0, F.concat(F.lit("[{'code': '"), show(k), F.lit("', 'label': 'x'}, {'label': 'none'}, {'code': '7', 'share': 0.25}]"))).when(k % 5 == 1, "{'code': '9'}").when(k % 5 == 2, "[None, {'code': 'z', 'label': None}]").when(k % 5 == 3, "")
    texts = F.when(k % 4 == 0, '[" a ", "", null, "b"]').when(k % 4 == 1, "one").when(k % 4 == 2, " ")
    address = F.when(k % 3 == 0, F.concat(F.lit("{'country_code': 'RO', 'region_name': None, 'town': '"), show(k), F.lit("'}"))).when(k % 3 == 1, '{"country_code": "x"}').otherwise("nowhere")
    raw = fx.table(spark, sf_dir, "customer").select(k.alias("org_id"), one.alias("one"), many.alias("many"), texts.alias("texts"), address.alias("address"))
    codes = lambda c: coerce.as_codes(coerce.json_like(F.col(c)))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("/", x["code"], x["label"], x["share"].cast("string"))), ";")
    place = coerce.as_address(coerce.json_like(F.col("address")))
    return raw.select("org_id", shown(codes("one")).alias("one"), shown(codes("many")).alias("many"), F.array_join(coerce.as_texts(F.col("texts")), "|").alias("texts"), F.concat_ws("/", place["country_code"], place["region_name"], place["town"]).alias("place"))


def describe_ranges(spark, sf_dir):
    size = F.col("p_size").cast("double")
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, size).alias("low"), F.when(F.col("p_partkey") % 2 != 0, size * 2 + F.when(F.col("p_partkey") % 5 == 0, 0.5).otherwise(0.0)).alias("high"))
    return rows.select("p_partkey", text.describe_range(F.col("low"), F.col("high")).alias("described"))


def cache_stats(spark, sf_dir):
    """A cache that takes each text of the documents twice, in namespaces by language; one namespace is cleared."""
    cache = usage.ResultCache(spark, f"{scratch_dir(spark)}/cache-{uuid.uuid4().hex[:8]}")
    rows = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("ns"), usage.cache_key(F.col("lang"), F.lit("m"), F.col("text")).alias("key"), F.col("lang").alias("value"))
    cache.put(rows.dropDuplicates(["ns", "key"]))
    cache.put(rows.dropDuplicates(["ns", "key"]))
    cache.clear("fr")
    return cache.stats().select("ns", "entries")


def usage_delta(spark, sf_dir):
    calls = fx.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 997).alias("prompt_tokens"), (F.col("user_id") % 97).alias("output_tokens"))
    prices = spark.createDataFrame([("click", 0.10, 0.40), ("view", 0.15, 0.0)], "model string, price_in double, price_out double")
    before = usage.usage(calls.where("event_id % 3 = 0 OR model = 'view'"), prices)
    rest = usage.usage(calls.where("NOT (event_id % 3 = 0 OR model = 'view')"), prices)
    return usage.delta(before, usage.merge(before, rest)).select("model", "calls", "prompt_tokens", "output_tokens", F.round("cost", 6).alias("cost"))


def project_costs(spark, sf_dir):
    """What judging every customer would cost at the price of the calls measured per event type, and the calls of a run."""
    rows = fx.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.count_if(F.col("event_type") != "view").alias("calls"), F.sum(F.col("event_id") % 997).alias("tokens"))
    rows = rows.select("model", "calls", (F.col("tokens") * 0.1 / 1e6).alias("cost"))
    n = fx.table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    out = metrics.project_cost(rows.crossJoin(F.broadcast(n)), F.col("n"))
    return out.select("model", F.round("projected", R).alias("projected"), metrics.model_calls(F.col("n") % 80, F.col("n") % 13).cast("long").alias("run_calls"))


def _judged_labels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Labels by name, some of names that nobody judged, and judged rows, some names twice."""
    rows = fx.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(2 * F.col("quality") + 1 - F.col("toxic")).alias("g"))
    query = F.concat(F.lit("q"), (F.col("doc_id") % 3).cast("string")).alias("query_id")
    name = F.concat(F.lit("n"), F.floor(F.col("doc_id") / 6).cast("string"))
    labels = rows.where("doc_id % 5 < 3").select(query, F.concat(F.when(F.col("doc_id") % 11 == 0, "no ").otherwise(""), F.lit("n"), F.floor(F.col("doc_id") / 6).cast("string")).alias("name"), F.col("g").alias("grade"), "doc_id")
    judged = rows.select(query, name.alias("name"), F.when(F.col("doc_id") % 4 == 0, 3 - F.col("g")).otherwise(F.col("g")).alias("grade"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("org_id"))
    return labels, judged


def label_pairs(spark, sf_dir):
    labels, judged = _judged_labels(spark, sf_dir)
    pairs = metrics.labelled_pairs(labels.groupBy("query_id", "name").agg(F.min_by("grade", "doc_id").alias("grade")), judged)
    return pairs.select("query_id", "name", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))


def grade_disagreements(spark, sf_dir):
    labels, judged = _judged_labels(spark, sf_dir)
    pairs = metrics.labelled_pairs(labels.groupBy("query_id", "name").agg(F.min_by("grade", "doc_id").alias("grade")), judged)
    return metrics.disagreements(pairs).select("query_id", "name", F.col("apart").cast("int").alias("apart"))


def calibration(spark, sf_dir):
    labels, judged = _judged_labels(spark, sf_dir)
    out = evaluation.calibration(labels.groupBy("query_id", "name").agg(F.min_by("grade", "doc_id").alias("grade")), judged)
    return out.select("pairs", "tp", "fp", "fn", *[F.round(c, R).alias(c) for c in ("exact", "within_one", "kappa_graded", "kappa_binary", "precision", "recall", "f1", "label_mean", "judge_mean")])


def label_sheet(spark, sf_dir):
    _, judged = _judged_labels(spark, sf_dir)
    return evaluation.sheet_rows(judged).select("query_id", "org_id", F.col("grade").cast("int").alias("grade"), F.col("place").cast("int").alias("place"))


def _systems(spark, sf_dir):
    from quernstone.queries import _runs

    return _runs(spark, sf_dir)


def eval_means(spark, sf_dir):
    out = metrics.means(metrics.summarise(_systems(spark, sf_dir), fx.grades(spark, sf_dir)))
    return out.select("system", "queries", *[F.col(c) for c in ("p_at_5", "p_at_10", "ndcg_at_10", "ndcg_at_20", "r_at_20", "average_precision", "returned")])


def query_allow_list(spark, sf_dir):
    """Named queries only; where no name is known, all of them."""
    specs = fx.specs(spark).select("query_id")
    some = evaluation.allowed(specs, ["s02", "s05", "none"]).select("query_id", F.lit("some").alias("asked"))
    return some.unionByName(evaluation.allowed(specs, ["none"]).select("query_id", F.lit("unknown").alias("asked")))


def stability_summary(spark, sf_dir):
    lists = _systems(spark, sf_dir).select("query_id", F.col("system").alias("run"), "org_id", "pos", F.when(F.col("pos") <= 5, "QUALIFIED").otherwise("PARTIAL").alias("verdict"))
    out = evaluation.stability(lists, 2)
    return out.select("query_id", F.round("mean_jaccard", R).alias("mean_jaccard"), F.round("mean_overlap", R).alias("mean_overlap"), F.col("unstable").cast("long").alias("unstable"), F.col("stable").cast("long").alias("stable"))


def judge_pool(spark, sf_dir):
    """Grades of the pooled heads by a judge that looks at the batch place and the record's length."""
    companies = fx.companies(spark, sf_dir).withColumn("card", text.company_card())
    pool = metrics.pool(_systems(spark, sf_dir)).select("query_id", "org_id")
    queries = fx.specs(spark).select("query_id", F.array_join("keywords", " ").alias("text"))

    def judge(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"local_id": batch["local_id"], "grade": batch["local_id"] - 3, "justification": [f" {len(c)} " for c in batch["card"]]})

    return evaluation.judge_pool(pool, queries, companies, judge)


def result_rows(spark, sf_dir):
    """The columns of a report, rounded as they are shown."""
    engine = Engine(fx.embedded(spark, sf_dir).withColumn("document", F.col("description")))
    ranked = engine.run(fx.specs(spark), fx.query_vectors(spark, sf_dir))
    # The last bits of a score depend on the order of its sum; they shall not decide how it is shown.
    out = sinks.result_rows(ranked.withColumns({c: F.round(c, R) for c in ("score", "fused", "confidence")}))
    return out.select("query_id", "place", "org_id", "name", "score", "verdict", "confidence", "fused", "escalated")


def hash_embedding(spark, sf_dir):
    """The built-in embedder over whole documents: the first and the last of its cells, and their sum."""
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", embed.hashed(F.substring("text", 1, 8000)).alias("v"))
    return rows.select("doc_id", F.element_at("v", 1).cast("long").alias("first"), F.element_at("v", -1).cast("long").alias("last"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).cast("long").alias("total"))


def embed_ingest(spark, sf_dir):
    """Documents put into a store twice: by odd ids first, then all; hits and misses of the second time, and what is kept."""
    store = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex[:8]}"
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("org_id"), F.col("text").alias("document"))
    corpus.embed_corpus(docs.where("org_id % 2 = 1"), store, embed.hashed, "m", wave_rows=300)
    got = corpus.embed_corpus(docs, store, embed.hashed, "m")
    kept = corpus.with_embeddings(docs, store, "m").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("embedding") == embed.DIMENSION).alias("embedded"))
    return kept.select(F.lit(got["hits"]).cast("long").alias("hits"), F.lit(got["misses"]).cast("long").alias("misses"), "rows", "embedded")


def _texts(spark):
    return fx.specs(spark).select("query_id", F.concat_ws(" ", F.array_join("keywords", " "), "role_statement").alias("text"))


def baseline_embedding(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("org_id"), F.col("text").alias("document"))
    ready = docs.select("org_id", embed.hashed(F.col("document")).alias("embedding"))
    from quernstone.operators.retrieval import nearest

    vectors = _texts(spark).select("query_id", embed.hashed(F.col("text")).alias("vector"))
    return nearest(ready, vectors, 20).select("query_id", "org_id", (F.col("rank0") + 1).cast("int").alias("pos"))


def exhaustive_baseline(spark, sf_dir):
    """Every company on its own: match and confidence as a model would answer them."""
    k = F.col("org_id")
    rows = fx.companies(spark, sf_dir).select("org_id").crossJoin(F.broadcast(fx.specs(spark).select("query_id", F.length("query_id").alias("_"))))
    answer = F.concat(F.lit('{"match": '), F.when(k % 3 == 0, "true").otherwise("false"), F.when(k % 5 != 0, F.concat(F.lit(', "confidence": '), ((k % 120) / 100).cast("string"))).otherwise(""), F.lit("}"))
    got = verdicts.parse_matches(rows.select("query_id", "org_id", F.when(k % 7 == 0, "no idea").otherwise(answer).alias("answer")))
    from quernstone.functions.windows import top

    return top(got.where("score > 0"), "query_id", [F.desc("score"), F.col("org_id")], 25).select("query_id", "org_id", F.round("score", R).alias("score"), (F.col("rank0") + 1).cast("int").alias("pos"))


def dedupe_groups(spark, sf_dir):
    """Companies that share a host by fives, folded in order."""
    rows = fx.companies(spark, sf_dir).withColumn("website", F.concat(F.when(F.col("org_id") % 2 == 0, "WWW.").otherwise(""), F.lit("host"), F.floor(F.col("org_id") / 5).cast("string")))
    thin = rows.select("org_id", "website", "operational_name", "country_code", "year_founded", "employee_count", "revenue", "is_public", "description")
    out = cleaning.dedupe(thin)
    return out.select("org_id", "operational_name", "country_code", "year_founded", "employee_count", "revenue", "is_public", F.col("merged").cast("int").alias("merged"))


def missing_verdicts(spark, sf_dir):
    """Which rows ask for a second opinion when some got none: those count as rejected, at 0."""
    answers, members, specs = _answers(spark, sf_dir)
    got = verdicts.parse_verdicts(answers, members, specs, "cheap").withColumn("escalated", F.lit(False))
    candidates = members.select(F.concat(F.lit("g"), F.floor(F.col("org_id") / 50).cast("string")).alias("query_id"), "org_id", (F.col("org_id") % 50).alias("rank0"), F.array().cast("array<string>").alias("unknown"))
    got = got.withColumn("query_id", F.concat(F.lit("g"), F.floor(F.col("org_id") / 50).cast("string")))
    out = qualify.escalation_pick(ranking.with_verdicts(candidates, got))
    return out.select("query_id", "org_id", F.col("pick").cast("int").alias("pick"))


def profile_scan(spark, sf_dir):
    """Customers as JSON lines, fields in all their raw forms and blank lines between, read and parsed."""
    k = F.col("c_custkey")
    part = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    line = F.concat(
        F.lit("{"),
        F.concat_ws(
            ", ",
            part("operational_name", F.concat(F.lit('"N'), k.cast("string"), F.lit('"'))),
            part("year_founded", F.concat((1900 + k % 100).cast("string"), F.lit(".0"))),
            part("address", F.when(k % 2 == 0, "\"{'country_code': 'RO', 'town': None}\"").otherwise('{"country_code": "uk", "town": "T"}')),
            part("employee_count", F.when(k % 3 == 0, "null").otherwise(k.cast("string"))),
            part("revenue", F.when(k % 4 == 0, '"n/a"').otherwise("4.5e3")),
            part("description", F.concat(F.lit('" d'), k.cast("string"), F.lit(' "'))),
            part("business_model", F.when(k % 5 == 0, '"solo"').otherwise('["a", " b "]')),
            part("is_public", F.when(k % 6 == 0, "true").when(k % 6 == 1, '"yes"').otherwise("null")),
        ),
        F.lit("}"),
    )
    path = f"{scratch_dir(spark)}/profiles-{uuid.uuid4().hex[:8]}"
    lines = fx.table(spark, sf_dir, "customer").select(F.explode(F.array(line, F.when(k % 9 == 0, "").otherwise("  "))).alias("value"))
    lines.write.text(path)
    rows = cleaning.parse_profiles(profiles.read_profiles(spark, path))
    return rows.select("operational_name", "year_founded", "country_code", "town", "employee_count", "revenue", "description", F.array_join("business_model", "|").alias("business_model"), "is_public")


def label_scan(spark, sf_dir):
    """Labels as JSON lines among comments and blank lines."""
    k = F.col("doc_id")
    line = F.when(k % 10 == 0, "// a comment").when(k % 10 == 1, "  ").otherwise(F.concat(F.lit('{"query_id": "q'), (k % 3).cast("string"), F.lit('", "company": "c'), k.cast("string"), F.lit('", "grade": '), F.col("quality").cast("string"), F.lit("}")))
    path = f"{scratch_dir(spark)}/labels-{uuid.uuid4().hex[:8]}"
    fx.table(spark, sf_dir, "labels").select(line.alias("value")).write.text(path)
    return profiles.read_labels(spark, path)


def json_sink(spark, sf_dir):
    """Ranked rows written as JSON and read again."""
    k = F.col("p_partkey")
    rows = fx.table(spark, sf_dir, "part").select(
        F.concat(F.lit("q"), (k % 4).cast("string")).alias("query_id"), F.floor(k / 4).cast("int").alias("place"), k.alias("org_id"), F.col("p_name").alias("name"), (k / 7.0).alias("score"),
        F.lit("PARTIAL").alias("verdict"), (k / 11.0).alias("confidence"), (k / 13.0).alias("fused"), F.when(k % 2 == 0, "r").alias("reason"), F.array(F.lit("revenue")).alias("unknown"),
    )
    path = f"{scratch_dir(spark)}/json-{uuid.uuid4().hex[:8]}"
    sinks.write_json(rows, path)
    read = spark.read.schema("query_id string, place int, org_id long, name string, score double, verdict string, confidence double, fused double, reason string, unknown array<string>").json(path)
    return read.withColumn("unknown", F.array_join("unknown", ","))


def stream_refresh(spark, sf_dir):
    """A stream of the documents embeds each text once; a second run over the same checkpoint and store adds nothing."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex[:8]}"
    schema = fx.table(spark, sf_dir, "documents").schema
    counts = []
    for k in range(2):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*").select(F.col("doc_id").alias("org_id"), F.col("text").alias("document"))
        refresh.refresh(stream.dropDuplicates(["document"]), f"{base}/store", f"{base}/check{k}", embed.hashed, "m", embed.DIMENSION).awaitTermination()
        counts.append(spark.read.parquet(f"{base}/store").count())
    store = spark.read.parquet(f"{base}/store")
    return store.agg(F.countDistinct("fingerprint").alias("texts"), F.count(F.lit(1)).alias("rows")).withColumn("added", F.lit(counts[1] - counts[0]).cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_verdicts, rank_with_criteria, judge_grades, plan_from_json, hard_constraints, query_probes, funnel_counts, prompt_batches, coerce_codes, describe_ranges,
        cache_stats, usage_delta, project_costs, label_pairs, grade_disagreements, calibration, label_sheet, eval_means, query_allow_list, stability_summary, judge_pool,
        result_rows, hash_embedding, embed_ingest, baseline_embedding, exhaustive_baseline, dedupe_groups, missing_verdicts,
        profile_scan, label_scan, json_sink, stream_refresh,
    )
}
