import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.config import Config
from quernstone.operators import cleaning, prompts, ranking, usage, verdicts
from quernstone.plans import corpus, evaluation, planner
from quernstone.plans import fixture as fx
from quernstone.sources import connector


def answered(spark, *texts):
    return spark.createDataFrame([("q", k, t) for k, t in enumerate(texts)], "query_id string, batch long, answer string")


def test_answers_are_salvaged(spark):
    rows = answered(spark, '{"a": 1}', 'Here: {"a": 2} ok', '{"a": ', "[1]", None, "", '```{"a": {"b": 3}}```').select("batch", verdicts.salvaged(F.col("answer")).alias("s")).orderBy("batch").collect()
    assert [r.s and json.loads(r.s) for r in rows] == [{"a": 1}, {"a": 2}, None, None, None, None, {"a": {"b": 3}}]


def test_verdicts_of_a_batch(spark):
    items = [
        {"id": 1, "verdict": "qualified", "confidence": 1.7, "reason": " r ", "criteria_met": ["A", "B", "C"], "criteria_failed": ["b"]},
        {"id": "2", "verdict": "PERHAPS", "confidence": "x"},
        {"id": 9, "verdict": "QUALIFIED"},
        {"id": "one", "verdict": "QUALIFIED"},
        {"id": 3, "verdict": "PARTIAL", "confidence": 0.2},
        {"id": 3, "verdict": "REJECTED", "confidence": 0.4},
    ]
    members = spark.createDataFrame([("q", 0, i, 10 + i) for i in (1, 2, 3, 4)] + [("q", 1, 1, 20)], "query_id string, batch long, local_id int, org_id long")
    specs = spark.createDataFrame([("q", [("a", 1.0, True, ""), ("b", 1.0, False, "")])], "query_id string, criteria array<struct<name:string,weight:double,must_have:boolean,description:string>>")
    got = {r.org_id: r for r in verdicts.parse_verdicts(answered(spark, json.dumps({"results": items}), "no JSON"), members, specs, "t").collect()}
    assert set(got) == {11, 12, 13, 20}
    assert (got[11].verdict, got[11].confidence, got[11].reason, got[11].met) == ("QUALIFIED", 1.0, "r", {"A": True, "B": True, "b": False}) or got[11].met == {"A": True, "b": False, "B": True}
    assert (got[12].verdict, got[12].confidence) == ("REJECTED", 0.0) and (got[13].verdict, got[13].confidence) == ("REJECTED", 0.4)
    assert (got[20].verdict, got[20].confidence, got[20].tier) == ("PARTIAL", 0.0, "error")
    ranked = ranking.with_satisfaction(spark.createDataFrame([("q", 1, {"A": True, "b": False}), ("q", 2, {}), ("q", 3, {"zz": True, "a": False})], "query_id string, org_id long, met map<string,boolean>"), specs)
    assert {r.org_id: r.satisfaction for r in ranked.collect()} == {1: 0.5, 2: None, 3: pytest.approx(1 / 3)}


def test_grades_are_clamped(spark):
    members = spark.createDataFrame([("q", 0, i, i) for i in (1, 2, 3)], "query_id string, batch long, local_id int, org_id long")
    text = json.dumps({"grades": [{"id": 1, "grade": 9, "justification": " x "}, {"id": 2, "grade": "y"}, {"id": 3}]})
    got = {r.org_id: (r.grade, r.justification) for r in verdicts.parse_grades(answered(spark, text), members).collect()}
    assert got == {1: (3, "x"), 3: (0, "")}


def test_prompt_of_a_spec_without_constraints(spark):
    spec = fx.specs(spark).where("query_id = 's08'").withColumn("countries", F.array().cast("array<string>"))
    rows = spark.createDataFrame([("s08", k, k, f"card {k}", []) for k in range(9)], "query_id string, org_id long, rank0 long, card string, unknown array<string>")
    got = {r.batch: r.prompt for r in prompts.verdict_prompts(rows, spec, 8).collect()}
    assert set(got) == {0, 1} and got[0].startswith("REQUEST: zzqx\n\n") and prompts.OPEN_RULE in got[0] and got[0].count("--- id ") == 8
    assert got[1].endswith("--- id 1 ---\ncard 8")
    graded = prompts.grade_prompts(rows, spark.createDataFrame([("s08", "ask")], "query_id string, text string"), 8)
    assert all("VERDICTS" not in r.prompt and r.prompt.startswith("REQUEST: ask") for r in graded.collect())


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def test_token_bucket_waits_for_its_rate():
    clock = Clock()
    bucket = connector.TokenBucket(60, clock, clock.sleep)
    assert sum(bucket.acquire() for _ in range(60)) == 0 and bucket.acquire(2) == pytest.approx(2)
    assert bucket.acquire(1000) <= 60 + 1e-6 and clock.now <= 62.1


def client(replies, clock, **options):
    asked = []

    def transport(model, prompt):
        asked.append(model)
        got = replies[model].pop(0) if replies[model] else (500, "", 0, 0)
        if isinstance(got, Exception):
            raise got
        return got

    return connector.Client(connector.ModelTier("a", ("b", "c")), transport, Config(max_retries=3), None, clock, clock.sleep, **options), asked


def test_client_falls_back_and_remembers():
    clock = Clock()
    own, asked = client({"a": [(404, "", 0, 0)], "b": [(429, "", 0, 0)], "c": [(200, "no object", 5, 1), (200, '{"x": 1}', 7, 2), (200, '{"x": 2}', 1, 1)]}, clock)
    got = own.ask("p")
    # a is dropped for good, b cools down, c answers in the second round; both of its answers are paid for.
    assert (got.answer, got.model, got.calls, got.prompt_tokens, got.output_tokens) == ('{"x": 1}', "c", 2, 12, 3) and asked == ["a", "b", "c", "c"] and len(clock.slept) == 1
    assert own.ask("p").answer == '{"x": 2}' and asked[4:] == ["c"]
    clock.now += Config().cooldown + 1
    assert own.ask("p").answer is None and "a" not in asked[5:] and "b" in asked[5:]


def test_client_gives_up_without_raising():
    clock = Clock()
    own, _ = client({"a": [OSError("down")] * 9, "b": [OSError("down")] * 9, "c": [OSError("down")] * 9}, clock)
    got = own.ask("p")
    assert got.answer is None and "down" in got.error and len(clock.slept) == 2


def test_cached_answers_cost_no_call(spark, tmp_path):
    def transport(model, prompt):
        return (200, json.dumps({"said": prompt}), 3, 1) if "bad" not in prompt else (500, "", 0, 0)

    cache, tier = usage.ResultCache(spark, str(tmp_path / "cache")), connector.ModelTier("m")
    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, "bad")], "k long, prompt string")
    config = Config(generate_per_minute=6000, max_concurrency=1, max_retries=1)
    first = {r.k: r for r in connector.ask_cached(rows, cache, "n", tier, transport, config).collect()}
    assert json.loads(first[3].answer) == {"said": "one"} and first[4].answer is None and first[4].error
    again = {r.k: r for r in connector.ask_cached(rows.where("k < 4"), cache, "n", tier, transport, config).collect()}
    assert all(r.calls == 0 and r.answer == first[k].answer for k, r in again.items())
    assert {r.ns: r.entries for r in cache.stats().collect()} == {"n": 2}


def test_plans_of_a_model_and_of_rules(spark):
    queries = spark.createDataFrame([("a", "more than 50 employees in Romania"), ("b", "banks in France"), ("c", "mills")], "query_id string, text string")
    answers = spark.createDataFrame([("a", "sorry"), ("b", '{"complexity": "reasoning"}')], "query_id string, answer string")
    got = {r.query_id: r for r in planner.plan_queries(queries, answers).collect()}
    assert {q: r.planned_by for q, r in got.items()} == {"a": "rules", "b": "model", "c": "rules"}
    assert got["a"].employees_min == 51 and got["b"].complexity == "REASONING" and got["b"].countries == ["fr"]


def test_usage_delta_and_merge(spark):
    rows = lambda *r: spark.createDataFrame(r, "model string, calls long, prompt_tokens long, output_tokens long, cost double")
    now = usage.merge(rows(("a", 1, 2, 3, 0.5), ("b", 1, 1, 1, 0.1)), rows(("a", 2, 2, 2, 0.5)))
    got = {r.model: r for r in usage.delta(rows(("b", 1, 1, 1, 0.1), ("a", 1, 2, 3, 0.5)), now).collect()}
    assert set(got) == {"a"} and (got["a"].calls, got["a"].cost) == (2, 0.5)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, f"Firm {i}", f"f{i}.example", "ro", None, None, 10 * i, None, 2000 + i, None, [], f"makes steel {i}" if i % 2 else "bakes bread", [], [], [], None) for i in range(12)]
    return spark.createDataFrame(rows, "org_id long, operational_name string, website string, country_code string, region_name string, town string, employee_count long, revenue double, year_founded long, primary_code struct<code:string,label:string,share:double>, secondary_codes array<struct<code:string,label:string,share:double>>, description string, business_model array<string>, target_markets array<string>, core_offerings array<string>, is_public boolean")


def steel_judge():
    def judge(batch):  # workers do not know this module, so the function travels whole
        if "fail" in batch["text"].iloc[0]:
            raise RuntimeError("no quota")
        return pd.DataFrame({"local_id": batch["local_id"], "grade": ["steel" in c and 3 or 0 for c in batch["card"]], "justification": " why "})

    return judge


def test_evaluation_report(spark, small):
    queries = spark.createDataFrame([("a", "steel makers", "k"), ("b", "fail please", "k")], "query_id string, text string, kind string")
    runs = [("a", "cascade", i, p) for p, i in enumerate((1, 3, 0), 1)] + [("a", "embedding", i, p) for p, i in enumerate((0, 2, 5), 1)] + [("b", "cascade", 1, 1)]
    runs = spark.createDataFrame(runs, "query_id string, system string, org_id long, pos int")
    said = spark.createDataFrame([("a", 1, "QUALIFIED", "r")], "query_id string, org_id long, verdict string, reason string")
    report = evaluation.evaluate(runs, queries, small, said, steel_judge())
    assert report["ungraded_queries"] == ["b"] and set(report["queries"]) == {"a"}
    own = report["queries"]["a"]
    assert own["pool_size"] == 5 and own["relevant_in_pool"] == 3 and own["systems"]["cascade"]["p_at_5"] == pytest.approx(2 / 3, abs=1e-4)
    assert own["detail"][0]["grade"] == 3 and {d["org_id"]: d["verdict"] for d in own["detail"]}[1] == "QUALIFIED"
    shown = evaluation.render_markdown(report | {"cost": {"cascade": {"queries": 1, "seconds": 1.0, "calls": 3, "cost": 0.1}}})
    assert "| **Cascade** | 1 | 0.667 |" in shown and "could not grade them: b" in shown
    with pytest.raises(evaluation.Ungraded):
        evaluation.evaluate(runs.where("query_id = 'b'"), queries.where("query_id = 'b'"), small, said, steel_judge())


def test_pool_order_is_fixed_and_tells_nothing(spark):
    pool = spark.createDataFrame([("q", i) for i in range(30)], "query_id string, org_id long")
    one = [r.org_id for r in evaluation.shuffled(pool).orderBy("rank0").collect()]
    assert one == [r.org_id for r in evaluation.shuffled(pool.orderBy(F.desc("org_id"))).orderBy("rank0").collect()] and one != sorted(one)


def test_sheet_hides_grades_and_fills_up(spark, small):
    graded = spark.createDataFrame([("a", i, 0 if i < 10 else 3) for i in range(12)], "query_id string, org_id long, grade int")
    rows = evaluation.sheet_rows(graded, per_query=8).collect()
    assert len(rows) == 8 and sum(r.grade == 3 for r in rows) == 2 and sorted(r.place for r in rows) == list(range(1, 9))
    sheet = evaluation.labelling_sheet(graded, spark.createDataFrame([("a", "steel")], "query_id string, text string"), small)
    assert sheet.count("### Firm") == 12 and "grade 3" not in sheet


def test_stability_of_equal_and_of_lost_runs(spark):
    rows = [("a", r, i, i + 1, "QUALIFIED") for r in (0, 1) for i in range(3)] + [("b", 0, 1, 1, "QUALIFIED"), ("b", 1, 1, 1, "PARTIAL"), ("b", 0, 2, 2, "PARTIAL"), ("c", 0, 1, 1, "PARTIAL")]
    got = {r.query_id: r for r in evaluation.stability(spark.createDataFrame(rows, "query_id string, run int, org_id long, pos int, verdict string"), 2).collect()}
    assert (got["a"].mean_jaccard, got["a"].unstable, got["a"].stable) == (1.0, 0, 3)
    assert (got["b"].mean_jaccard, got["b"].unstable) == (0.5, 2) and got["c"].mean_jaccard == 1.0


def test_embeddings_are_bought_once(spark, tmp_path):
    from quernstone.functions import embed

    store = str(tmp_path / "store")
    docs = spark.createDataFrame([(1, "red apples"), (2, "red apples"), (3, "green pears")], "org_id long, document string")
    assert corpus.embed_corpus(docs.where("org_id < 3"), store, embed.hashed, "m", wave_rows=1) == {"hits": 0, "misses": 1}
    assert corpus.embed_corpus(docs, store, embed.hashed, "m") == {"hits": 1, "misses": 1}
    assert corpus.embed_corpus(docs, store, embed.hashed, "other") == {"hits": 0, "misses": 2}
    assert corpus.embed_corpus(docs, store, embed.hashed, "m", rebuild=True) == {"hits": 0, "misses": 2}
    rows = corpus.with_embeddings(docs.unionByName(spark.createDataFrame([(4, "unseen")], docs.schema)), store, "m").orderBy("org_id").collect()
    assert rows[0].embedding == rows[1].embedding and sum(x * x for x in rows[2].embedding) == pytest.approx(1) and not any(rows[3].embedding)


def test_long_groups_fold_like_short_ones(spark, monkeypatch):
    rows = [(i, f"n{i}" if i % 3 else None, "www.h.example" if i % 2 else "H.example", "ro" if i % 4 == 3 else None, None if i % 5 else 100 + i, None if i % 7 else i * 1.5, i % 11 == 0 or None, "" if i % 6 else f"d{i}", ["x"] if i % 8 == 7 else []) for i in range(40)]
    table = spark.createDataFrame(rows, "org_id long, operational_name string, website string, country_code string, employee_count long, revenue double, is_public boolean, description string, core_offerings array<string>")
    short = cleaning.dedupe(table).collect()
    monkeypatch.setattr(cleaning, "FOLDED", 3)
    assert cleaning.dedupe(table).collect() == short and len(short) == 1 and short[0].merged == 39


def test_engine_uses_criteria_of_a_judge(spark):
    from quernstone.plans.engine import Engine

    own = Engine(fx.embedded(spark, "/root/testdata/sf0.001").withColumn("document", F.col("description")), Config(escalate=False))
    specs = fx.specs(spark).where("query_id = 's04'").withColumn("criteria", F.expr("array(named_struct('name', 'Scope', 'weight', 1.0D, 'must_have', true, 'description', ''))"))

    def said(batch):
        return pd.DataFrame({"local_id": batch["local_id"], "verdict": "QUALIFIED", "confidence": 0.5, "reason": "", "met": [{"scope": bool(i % 2)} for i in batch["org_id"]]})

    rows = own.run(specs, fx.query_vectors(spark, "/root/testdata/sf0.001"), judge=said).collect()
    assert {r.satisfaction for r in rows} == {0.0, 1.0} and all((r.satisfaction == 1.0) == (r.org_id % 2 == 1) for r in rows)


def test_services_from_plan_to_ranking(spark, small, tmp_path):
    from quernstone.plans import remote

    def transport(model, prompt):
        if prompt.startswith("Plan a search"):
            answer = {"complexity": "STRUCTURED", "role_statement": "makes steel", "geography": ["Romania"], "keywords": ["steel"], "criteria": [{"name": "Steel", "weight": 1.0, "must_have": True, "description": "makes it"}]}
            return (200, json.dumps(answer), 10, 5)
        blocks = prompt.split("--- id ")[1:]
        said = [{"id": int(b.split(" ")[0]), "verdict": "QUALIFIED" if "steel" in b else "REJECTED", "confidence": 0.5 if model == "cheap" else 0.9, "reason": model, "criteria_met": ["steel"] if "steel" in b else [], "criteria_failed": []} for b in blocks]
        graded = [{"id": x["id"], "grade": 3 if x["verdict"] == "QUALIFIED" else 0, "justification": "j"} for x in said]
        return (200, json.dumps({"results": said, "grades": graded, "match": "steel" in prompt.split("Name: ")[-1], "confidence": 0.7, "reason": "m"}), 100, 20)

    tiers = {k: connector.ModelTier(m) for k, m in (("plan", "big"), ("qualify", "cheap"), ("escalate", "big"), ("judge", "big"), ("match", "cheap"))}
    config = Config(generate_per_minute=10**6, max_concurrency=2)
    services = remote.Services(tiers, transport, config, usage.ResultCache(spark, str(tmp_path / "cache")))
    queries = spark.createDataFrame([("a", "who makes steel in Romania")], "query_id string, text string")
    specs = services.plan(queries).withColumn("prefixes", F.array().cast("array<string>"))
    engine = corpus.engine(small.withColumn("description", F.col("description")), config=config)
    ranked = corpus.answer(engine, queries, specs=specs, services=services).collect()
    assert ranked and all("steel" in x for x in [r.document for r in engine.companies.collect() if r.org_id in {r.org_id for r in ranked}])
    assert {r.verdict for r in ranked} == {"QUALIFIED"} and any(r.escalated and r.tier == "big" and r.confidence == 0.9 for r in ranked) and {r.satisfaction for r in ranked} == {1.0}
    cards = small.select("org_id", F.col("description").alias("card"))
    grades = services.grades(small.select(F.lit("a").alias("query_id"), "org_id"), queries, cards)
    assert {r.org_id: r.grade for r in grades.collect()} == {i: 3 if i % 2 else 0 for i in range(12)}
    matches = services.matches(small.select(F.lit("a").alias("query_id"), "org_id", F.lit("ask").alias("text"), F.concat(F.lit("Name: "), "description").alias("card")))
    assert {r.org_id: r.score for r in matches.collect()} == {i: 0.7 if i % 2 else 0.0 for i in range(12)}
    prices = spark.createDataFrame([("big", 1.0, 1.0)], "model string, price_in double, price_out double")
    assert {r.model: r.calls for r in services.usage(prices).collect()}["big"] >= 3


def test_embedding_service_in_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(99, "bad")], "org_id long, document string")

    def service(texts):
        if "bad" in texts:
            raise OSError("down")
        assert len(texts) <= 25
        return [[1.0, float(len(t))] for t in texts]

    config = Config(embed_per_minute=10**9, max_retries=1, max_concurrency=1, embed_batch=1)
    got = corpus.embed_corpus(docs, str(tmp_path / "s"), None, "m", 2, service=lambda rows: connector.embed(rows, service, 2, config))
    assert got == {"hits": 0, "misses": 61}
    rows = {r.org_id: r.embedding for r in corpus.with_embeddings(docs, str(tmp_path / "s"), "m", 2).collect()}
    assert rows[99] == [0.0, 0.0] and all(sum(x * x for x in v) == pytest.approx(1) for i, v in rows.items() if i != 99)
