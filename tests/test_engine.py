import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.config import Config
from quernstone.functions import text, vector
from quernstone.operators import cleaning, filters, metrics, qualify, ranking, retrieval, sampling, usage
from quernstone.plans import fixture as fx
from quernstone.plans.engine import Engine
from quernstone.sources import profiles, sinks
from quernstone.streaming import refresh

RAW = [
    {"operational_name": "Stringy", "website": "www.example.com", "year_founded": 2003.0, "address": "{'country_code': 'ro', 'region_name': 'B', 'town': None}", "employee_count": None, "revenue": 4.8e7, "primary_naics": "{'code': '4841', 'label': 'Trucks'}", "secondary_naics": "[{'code': '49', 'label': 'x'}]", "description": " moves ", "business_model": ["b2b"], "is_public": False},
    {"operational_name": "Dicty", "website": "example.com", "address": {"country_code": "RO"}, "employee_count": 12, "primary_naics": {"code": "4842", "label": "y", "share": 0.7}, "core_offerings": "one", "is_public": True},
    {},
    {"operational_name": "Twin ", "address": {"country_code": "se"}},
    {"operational_name": "twin", "address": {"country_code": "de"}},
    {"operational_name": "TWIN", "address": {"country_code": "SE"}, "revenue": 5},
    {},
    {"website": "WWW.example.com ", "town": "x", "employee_count": 99, "year_founded": 1990},
]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "companies.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in RAW) + "\n\n")
    return cleaning.parse_profiles(profiles.read_profiles(spark, str(path)))


def test_profiles_parse(parsed):
    rows = parsed.orderBy("org_id").collect()
    assert len(rows) == len(RAW)
    a, b, c = rows[:3]
    assert (a.year_founded, a.country_code, a.employee_count, a.revenue, a.is_public, a.description) == (2003, "ro", None, 4.8e7, False, "moves")
    assert a.primary_code.code == "4841" and [x.code for x in a.secondary_codes] == ["49"] and a.town is None
    assert b.country_code == "ro" and b.primary_code.share == 0.7 and b.core_offerings == ["one"]
    assert c.operational_name is None and c.description == "" and c.business_model == [] and c.primary_code is None


def test_cards_and_documents(parsed):
    rows = parsed.orderBy("org_id").select(text.company_card().alias("card"), text.company_document().alias("doc")).collect()
    assert "Employees: unknown | Revenue USD: 48,000,000 | Founded: 2003 | Public: False" in rows[0].card
    assert rows[0].doc.splitlines() == ["Stringy", "Industry: Trucks (4841)", "Also: x (49)", "Model: b2b", "moves", "Location: B, RO"]
    assert rows[2].doc == "Location: unknown location" and rows[2].card.startswith("Name: company-")


def test_duplicates_fold_in_order(parsed):
    rows = {r.operational_name or r.website or f"row{k}": r for k, r in enumerate(cleaning.dedupe(parsed).orderBy("org_id").collect())}
    assert len(rows) == 5
    web = rows["Stringy"]
    assert web.merged == 2 and web.org_id == 0 and web.employee_count == 12 and web.is_public is False and web.year_founded == 2003
    assert web.core_offerings == ["one"] and web.primary_code.code == "4841"
    assert rows["TWIN"].merged == 1 and rows["TWIN"].org_id == 3 and rows["twin"].country_code == "de"
    ids = [r.org_id for r in cleaning.dense_ids(cleaning.dedupe(parsed), spread=2).orderBy("org_id").collect()]
    assert ids == list(range(5))


def spec(spark, **values):
    base = dict(query_id="q", complexity="SEMANTIC", keywords=[], role_statement="", ideal_profile="", countries=[], employees_min=None, employees_max=None, revenue_min=None, revenue_max=None, founded_min=None, founded_max=None, want_public=None, prefixes=[], vec_id=0)
    return spark.createDataFrame([tuple((base | values).values())], fx.SPEC_SCHEMA)


@pytest.fixture(scope="module")
def few(spark):
    rows = [(i, None if i == 3 else "ro" if i % 2 else "se", None if i == 4 else 100 * i, 5.0 * i, 2000 + i, None if i == 5 else i % 2 == 0) for i in range(8)]
    return spark.createDataFrame(rows, "org_id long, country_code string, employee_count long, revenue double, year_founded long, is_public boolean")


def test_unknown_neither_passes_nor_fails(spark, few):
    got = {r.org_id: r for r in filters.apply_filters(few, spec(spark, countries=["ro"], employees_min=300.0, want_public=True)).collect()}
    assert got[3].country == "UNKNOWN" and got[4].employee_count == "UNKNOWN" and got[5].is_public == "UNKNOWN"
    assert got[3].employee_count == "PASS" and got[2].employee_count == "FAIL" and got[1].revenue is None
    tally = filters.tally(few, spec(spark, countries=["ro"], employees_min=300.0)).first()
    assert tally.country_failed == 4 and tally.employee_count_failed == 3


def test_relaxed_only_when_it_helps(spark, few):
    strict = spec(spark, employees_min=600.0, countries=["ro", "se"])
    rows = filters.survivors_relaxed(few, strict).collect()
    assert len(rows) == 8 and all(r.relaxed for r in rows) and {r.org_id: r.unknown for r in rows}[3] == ["country"]
    assert not any(r.relaxed for r in filters.survivors_relaxed(few, strict, Config(relax_below=2)).collect())
    assert not any(r.relaxed for r in filters.survivors_relaxed(few, spec(spark, countries=["ro"])).collect())
    soft = filters.soften(strict).first()
    assert soft.employees_min is None and soft.countries == ["ro", "se"]


def test_filters_are_monotone(spark, few):
    loose = {r.org_id for r in filters.survivors(few, spec(spark, employees_min=100.0)).collect()}
    assert {r.org_id for r in filters.survivors(few, spec(spark, employees_min=300.0)).collect()} <= loose


def test_bm25_finds_the_right_document(spark):
    docs = spark.createDataFrame([(0, "red apples grow"), (1, "green pears grow"), (2, "yellow bananas yellow bananas"), (3, "!!")], "org_id long, document string")
    keys = docs.select(F.lit("q").alias("query_id"), "org_id")
    score = lambda *kw: {r.org_id: r.bm25 for r in retrieval.bm25(keys, retrieval.postings(docs), retrieval.lengths(docs), retrieval.query_terms(spec(spark, keywords=list(kw)))).collect()}
    assert max(score("yellow", "bananas").items(), key=lambda x: x[1])[0] == 2
    assert score("kiwi") == {} and score("grow", "grow")[0] == pytest.approx(2 * score("grow")[0])
    assert retrieval.lengths(docs).where("org_id = 3").first().length == 0


def test_prefix_affinity_is_graded(spark):
    codes = spark.createDataFrame([(0, "326199"), (1, "541511")], "org_id long, code string")
    got = lambda *p: {r.org_id: r.code_score for r in retrieval.prefix_affinity(codes, spec(spark, prefixes=list(p))).collect()}
    assert got("3261")[0] == pytest.approx(0.68) and got("32")[0] == pytest.approx(0.35) and got("3")[0] == pytest.approx(0.185)
    assert got("326199", "3") == {0: pytest.approx(1.01) if False else pytest.approx(1.0)} and 1 not in got("3261")


def test_fusion_rewards_agreement(spark):
    lists = [("q", 0, 0, 1.0), ("q", 1, 1, 1.0), ("q", 2, 2, 1.0), ("q", 0, 0, 1.0), ("q", 2, 1, 1.0), ("q", 1, 2, 1.0), ("q", 9, 0, 0.0)]
    got = {r.item: r.fused for r in retrieval.reciprocal_rank_fusion(spark.createDataFrame(lists, "query_id string, item long, rank0 int, weight double")).collect()}
    assert got[0] == pytest.approx(2 / 61) and 9 not in got and got[1] == pytest.approx(got[2])


def judged(spark, rows):
    kinds = "org_id long, verdict string, confidence double, fused double, unknown array<string>, escalated boolean, tier string, rank0 int"
    return spark.createDataFrame(rows, kinds).withColumn("query_id", F.lit("q")).withColumn("name", F.concat(F.lit("n"), F.col("org_id"))).withColumn("satisfaction", F.lit(None).cast("double"))


def test_bands_never_overlap(spark):
    rows = [(0, "QUALIFIED", 0.0, 0.0, ["a", "b", "c"], False, "t", 0), (1, "PARTIAL", 1.0, 1.0, [], True, "t", 1), (2, "REJECTED", 0.0, 1.0, [], False, "t", 2)]
    got = {r.org_id: r.score for r in ranking.rank(judged(spark, rows), include_rejected=True).collect()}
    assert got[0] >= 0.6 > got[1] > got[2] and got[1] <= 0.55 and got[2] <= 0.2


def test_fallback_labels_near_misses(spark):
    rows = [(i, "REJECTED", 0.9, i / 20, [], False, "t", i) for i in range(14)]
    got = ranking.rank(judged(spark, rows)).orderBy("place").collect()
    assert len(got) == 10 and all(r.verdict == "PARTIAL" and r.tier == "t+fallback" and r.score <= 0.2 for r in got)
    assert [r.place for r in got] == list(range(1, 11)) and got[0].org_id == 13


def test_scores_do_not_saturate_and_order_is_stable(spark):
    rows = [(i, "QUALIFIED", 1.0, i / 20, [], False, "t", i) for i in range(20)]
    a = ranking.rank(judged(spark, rows)).collect()
    b = ranking.rank(judged(spark, rows[::-1])).collect()
    assert len({round(r.score, 6) for r in a}) > 10 and sorted((r.place, r.org_id) for r in a) == sorted((r.place, r.org_id) for r in b)


def test_missing_verdicts_surface(spark):
    cand = judged(spark, [(0, "x", 0.0, 0.5, [], False, "t", 0)]).drop("verdict", "confidence", "tier", "escalated")
    none = spark.createDataFrame([], "query_id string, org_id long, verdict string, confidence double, reason string, tier string, escalated boolean")
    row = ranking.with_verdicts(cand, none).first()
    assert (row.verdict, row.confidence, row.reason, row.tier) == ("PARTIAL", 0.0, "no verdict returned", "missing")


def test_rubric_coverage(spark):
    row = spark.createDataFrame([({"A": True, "b": False, "new": True}, [("a", 0.5), ("B", 0.5)], {}, [])], "met map<string,boolean>, criteria array<struct<name:string,weight:double>>, none map<string,boolean>, no array<struct<name:string,weight:double>>")
    got = row.select(ranking.criteria_satisfaction(F.col("met"), F.col("criteria")).alias("a"), ranking.criteria_satisfaction(F.col("none"), F.col("criteria")).alias("b"), ranking.criteria_satisfaction(F.col("met"), F.col("no")).alias("c")).first()
    assert got.a == pytest.approx(1.0 / 1.5) and got.b is None and got.c is None


def test_adjudication_survives_bad_batches(spark):
    rows = spark.createDataFrame([("q", i, i) for i in range(20)], "query_id string, org_id long, rank0 int")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["batch"].iloc[0] == 1:
            raise RuntimeError
        return pd.DataFrame({"local_id": [1, 2, 99], "verdict": ["qualified", "odd", "PARTIAL"], "confidence": [7, "x", 0.5], "reason": [" r ", None, ""]})

    got = {r.org_id: r for r in qualify.adjudicate(rows, judge, 8, "t").collect()}
    assert (got[0].verdict, got[0].confidence, got[0].reason) == ("QUALIFIED", 1.0, "r") and got[1].verdict == "REJECTED" and got[1].confidence == 0.0
    assert all(got[i].tier == "error" and got[i].verdict == "PARTIAL" for i in range(8, 16)) and 2 not in got


def test_escalation_is_capped(spark):
    rows = [(i, "PARTIAL", i / 40, 0.1, [], False, "t", i) for i in range(40)]
    got = qualify.escalation_pick(judged(spark, rows)).collect()
    assert len(got) == 10 and min(abs(r.confidence - 0.5) for r in got) == 0
    again = spark.createDataFrame([("q", 20, "QUALIFIED", 0.9, "two"), ("q", 21, "QUALIFIED", 0.9, "error")], "query_id string, org_id long, verdict string, confidence double, tier string")
    out = {r.org_id: r for r in qualify.escalate(judged(spark, rows), again).collect()}
    assert out[20].verdict == "QUALIFIED" and out[20].escalated and out[21].verdict == "PARTIAL" and not out[21].escalated


def test_metrics(spark):
    runs = spark.createDataFrame([("q", "s", i, i + 1) for i in range(4)] + [("r", "s", 0, 1)], "query_id string, system string, org_id long, pos int")
    grades = spark.createDataFrame([("q", i, g) for i, g in enumerate([3, 3, 2, 2])] + [("q", 9, 0), ("r", 5, 3)], "query_id string, org_id long, grade int")
    got = {r.query_id: r for r in metrics.summarise(runs, grades).collect()}
    assert got["q"].p_at_10 == 1.0 and got["q"].ndcg_at_10 == 1.0 and got["q"].average_precision == 1.0 and got["q"].r_at_5 == 1.0
    assert got["r"].p_at_5 == 0 and got["r"].average_precision == 0 and got["r"].in_pool == 1
    assert metrics.means(metrics.summarise(runs, grades)).first().p_at_10 == 0.5


@pytest.mark.parametrize(("pairs", "value"), [([(1, 1), (1, 1)], 1.0), ([(1, 1), (0, 0)], 1.0), ([(1, 0), (0, 1)], -1.0), ([], None)])
def test_kappa(spark, pairs, value):
    assert metrics.kappa(spark.createDataFrame(pairs, "a int, b int")).first().kappa == value


def test_calibration_and_costs(spark):
    labels = spark.createDataFrame([("q", "x", 3), ("q", "y", 1)], "query_id string, name string, grade int")
    judged_rows = spark.createDataFrame([("q", "x", 2, 1), ("q", "x", 0, 2)], "query_id string, name string, grade int, pos int")
    pairs = metrics.labelled_pairs(labels, judged_rows)
    assert [(r.a, r.b) for r in pairs.collect()] == [(3, 2)] and metrics.agreement(pairs).first().within_one == 1.0
    assert metrics.disagreements(pairs).first().apart == 1
    row = spark.createDataFrame([(55, 13)], "s int, e int").select(metrics.model_calls(F.col("s"), F.col("e")).alias("n")).first()
    assert row.n == 1 + 7 + 3
    calls = spark.createDataFrame([("m", 1000000, 0), ("other", 0, 1000000)], "model string, prompt_tokens long, output_tokens long")
    got = {r.model: r.cost for r in usage.usage(calls, spark.createDataFrame([("m", 0.1, 0.4)], "model string, price_in double, price_out double")).collect()}
    assert got == {"m": pytest.approx(0.1), "other": pytest.approx(2.5)}


def test_sample_fills_up(spark):
    rows = spark.createDataFrame([(i, 3 if i % 2 else 0) for i in range(50)], "doc_id long, grade int")
    got = sampling.stratified(rows, "grade", "doc_id", {3: 5, 2: 6, 1: 6, 0: 3}, 11, 20).collect()
    assert len(got) == 20 and len({r.doc_id for r in got}) == 20
    assert len(sampling.stratified(rows, "grade", "doc_id", {3: 5, 0: 3}, 11).collect()) == 8


def test_cache(spark, tmp_path):
    cache = usage.ResultCache(spark, str(tmp_path / "cache"))
    rows = spark.createDataFrame([("k1", "v1", "a"), ("k2", "v2", "b")], "key string, value string, ns string")
    assert cache.read().count() == 0
    cache.put(rows)
    cache.put(spark.createDataFrame([("k1", "v3", "a")], rows.schema))
    hits, misses = cache.probe(spark.createDataFrame([("k1",), ("k9",)], "key string"))
    assert [r.value for r in hits.collect()] == ["v3"] and [r.key for r in misses.collect()] == ["k9"]
    assert {r.ns: r.entries for r in cache.stats().collect()} == {"a": 1, "b": 1}
    cache.clear("a")
    assert [r.key for r in cache.read().collect()] == ["k2"]


def test_stream_embeds_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    embedder = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    run = lambda: refresh.refresh(spark.readStream.schema("org_id long, document string").parquet(source), out, str(tmp_path / "cp"), embedder, "m", 2).awaitTermination()
    spark.createDataFrame([(1, "aa"), (1, "aa"), (2, "b")], "org_id long, document string").write.parquet(source)
    run()
    spark.createDataFrame([(1, "aa"), (3, "ccc")], "org_id long, document string").write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(out).orderBy("org_id")
    assert [r.org_id for r in got.collect()] == [1, 2, 3]
    assert got.select(F.max(F.abs(vector.dot(F.col("embedding"), F.col("embedding")) - 1))).first()[0] < 1e-9


def test_labels_skip_comments(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('// note\n\n{"query_id":"q","company":"x","grade":2}\n')
    assert [(r.company, r.grade) for r in profiles.read_labels(spark, str(tmp_path / "l.jsonl")).collect()] == [("x", 2)]


def test_whole_run_and_reports(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = fx.embedded(spark, sf).withColumn("document", F.col("description"))
    engine = Engine(rows)
    ranked = engine.run(fx.specs(spark).where("query_id IN ('s01', 's03')"), fx.query_vectors(spark, sf)).withColumn("reason", F.lit("a|b")).cache()
    assert ranked.count() > 0 and {r.query_id for r in ranked.collect()} <= {"s01", "s03"}
    page = sinks.markdown(ranked, 3)
    assert page.startswith("## s0") and "a/b" in page and "QUALIFIED" in sinks.console(ranked, 3) + "QUALIFIED"
    sinks.write_json(ranked, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == ranked.count()


def test_requests_over_a_file(parsed):
    from quernstone.plans import corpus

    spark = parsed.sparkSession
    own = corpus.engine(cleaning.dense_ids(cleaning.dedupe(parsed).drop("merged")))
    queries = spark.createDataFrame([("a", "trucks in Romania"), ("b", "anything")], "query_id string, text string")
    got = corpus.answer(own, queries).orderBy("query_id", "place").collect()
    assert {r.query_id for r in got} == {"a", "b"} and got[0].name == "Stringy"
    assert corpus.baseline_embedding(own, queries, 2).count() == 4
    judge = lambda pdf: pd.DataFrame({"local_id": pdf["local_id"], "verdict": "QUALIFIED", "confidence": 0.5, "reason": ""})
    assert corpus.baseline_exhaustive(own, queries.where("query_id = 'a'"), judge, 3).count() == 3


def test_runs_are_of_bounded_size(spark, few, monkeypatch):
    monkeypatch.setattr(filters, "MOST_SPECS", 1)
    with pytest.raises(ValueError, match="several"):
        filters.survivors(few, spec(spark).unionByName(spec(spark, query_id="r")))
