import pytest
from pyspark.sql import functions as F

from quernstone.functions import coerce, geo, text, vector
from quernstone.functions.windows import rank_desc, running_sum
from quernstone.plans.benchmark import QUERIES
from quernstone.plans.planner import build_specs, heuristic_specs


def column(spark, values, kind, c):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", c(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    values = ["2003.0", "12", "abc", None, "NaN", "Infinity", "-3.9", "true", "4.8e7", ""]
    assert column(spark, values, "string", coerce.as_long) == [2003, 12, None, None, None, None, -3, 1, 48000000, None]
    assert column(spark, values, "string", coerce.as_double)[-2] == 4.8e7


def test_lists_and_codes(spark):
    assert column(spark, ['["a ", "", null, "b"]', "one", "  ", None], "string", coerce.as_texts) == [["a", "b"], ["one"], [], []]
    got = column(spark, ["{'code': '311', 'label': 'Food'}", "[{'code': '1', 'label': None}, {'label': 'x'}]", '[{"code":"2","label":"y","share":0.5}]', None, "junk"], "string", lambda c: coerce.as_codes(coerce.json_like(c)))
    assert [[(x.code, x.label, x.share) for x in r] for r in got] == [[("311", "Food", None)], [("1", "", None)], [("2", "y", 0.5)], [], []]


def test_country_codes(spark):
    assert column(spark, [" UK ", "el", "DE", "deu", None, ""], "string", geo.normalise_code) == ["gb", "gr", "de", None, None, None]


@pytest.mark.parametrize(
    ("token", "codes"),
    [("Scandinavia", "dk no se"), ("nordics", "dk fi is no se"), ("Romania", "ro"), ("ro", "ro"), ("usa", "us"), ("Atlantis", ""), ("global", ""), ("gbr", "gb"), ("UK", "gb"), ("zz", "zz")],
)
def test_places(spark, token, codes):
    row = geo.resolve(spark.createDataFrame([(token,)], "token string")).first()
    assert row.resolved == codes.split()


def test_tables_of_places():
    assert len(geo.region_rows()) == 37 and len(geo.country_rows()) == 137


def test_text_scan_takes_the_longest_phrase(spark):
    rows = [("a", "firms in the united states or us"), ("b", "wind in Scandinavia"), ("c", "no place here"), ("d", "France and Germany"), ("e", None), ("f", "asia-pacific trade")]
    got = {r.query_id: (r.phrase, r.codes) for r in geo.scan_text(spark.createDataFrame(rows, "query_id string, text string"), "query_id", "text").collect()}
    assert got["a"] == ("united states", ["us"]) and got["b"][1] == ["dk", "no", "se"]
    assert got["c"] == (None, []) and got["d"] == ("germany", ["de"]) and got["e"] == (None, []) and got["f"][0] == "asia pacific"


def test_heuristic_plans(spark):
    got = {r.query_id: r for r in heuristic_specs(spark.createDataFrame([(q, t) for q, _, t in QUERIES], "query_id string, text string")).collect()}
    assert got["q01"].countries == ["ro"]
    assert got["q02"].employees_min == 1001 and got["q02"].want_public is True
    assert got["q05"].revenue_min == 50e6 and got["q05"].countries == ["us"]
    assert got["q08"].founded_min == 2019 and got["q08"].employees_max == 199
    assert got["q11"].countries == ["dk", "no", "se"]
    assert got["q04"].employees_min is None and got["q04"].want_public is None and got["q04"].countries == []


def test_quirks_of_plans(spark):
    rows = [("a", "at least 100 employees"), ("b", "founded since 2010"), ("c", "revenue over 5 thousand"), ("d", "a privately held firm"), ("e", "established before 1990")]
    got = {r.query_id: r for r in heuristic_specs(spark.createDataFrame(rows, "query_id string, text string")).collect()}
    assert got["a"].employees_min == 101 and got["b"].founded_min == 2011 and got["c"].revenue_min == 5
    assert got["d"].want_public is False and got["e"].founded_max == 1989


def test_plans_from_json(spark):
    plan = '{"complexity":"odd","geography":["Nordics","xyz!"],"employee_min":"10","revenue_max_usd":"bad","is_public":"true","naics_prefixes":["31 ","3a"],"keywords":[" x ",""],"criteria":[{"name":"","weight":"0.4"},{"name":"b","weight":"heavy"}]}'
    rows = [("a", "t", plan), ("b", "makers in France", "{}")]
    got = {r.query_id: r for r in build_specs(spark.createDataFrame(rows, "query_id string, text string, plan string")).collect()}
    a = got["a"]
    assert a.complexity == "SEMANTIC" and a.countries == ["dk", "fi", "is", "no", "se"] and a.employees_min == 10 and a.revenue_max is None
    assert a.want_public is True and a.prefixes == ["31"] and a.keywords == ["x"] and [(c.name, c.weight) for c in a.criteria] == [("criterion", 0.4)]
    assert got["b"].countries == ["fr"] and got["b"].country_phrase == "france"


def test_tokens_and_renderings(spark):
    assert column(spark, ["The Éclair-2000 a b, Solutions x9!"], "string", text.tokenize) == [["clair", "2000", "x9"]]
    assert column(spark, ["a " * 300], "string", lambda c: text.shortened(c, 10)) == ["a a a a a..."]
    row = spark.createDataFrame([(1.0, 5.0), (None, 2.5), (3.0, None), (None, None)], "a double, b double").select(text.describe_range(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in row] == ["1-5", "<=2.5", ">=3", "any"]


def test_vectors(spark):
    got = column(spark, [[3.0, 4.0], [0.0, 0.0]], "array<double>", vector.l2_normalise)
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_two_level_ranks_and_sums(spark):
    rows = [("q", i, float(s)) for i, s in enumerate([0, 3, 0, 0.5, 0, 3, 0.01, 0])] + [("p", 1, -1.0), ("p", 0, 2.0)]
    got = rank_desc(spark.createDataFrame(rows, "query_id string, org_id long, s double"), "query_id", "s", "org_id", "r", spread=2).collect()
    for q in ("q", "p"):
        want = [i for _, i, s in sorted((x for x in rows if x[0] == q), key=lambda x: (-x[2], x[1]))]
        assert [r.org_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.r)] == want
    sums = running_sum(spark.createDataFrame([("a", k // 3, k, k) for k in range(10)], "g string, b int, o int, v int"), ["g"], "b", ["o"], "v", "before")
    assert [r.before for r in sums.orderBy("o").collect()] == [sum(range(k)) for k in range(10)]
