"""DuckDB SQL for the registered queries, on the same tables."""

from __future__ import annotations

from quernstone.functions import geo
from quernstone.functions.text import STOPWORDS
from quernstone.plans.benchmark import QUERIES as BENCHMARK
from quernstone.plans.fixture import SPECS


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words) -> str:
    return "CAST([" + ", ".join(map(_text, words)) + "] AS VARCHAR[])"


COMPANIES = """
spent AS (SELECT o_custkey, max(o_totalprice) AS spent FROM orders GROUP BY o_custkey),
companies AS (
  SELECT c_custkey AS org_id,
    CASE WHEN c_custkey % 25 <> 7 THEN c_name END AS operational_name,
    CASE WHEN c_custkey % 10 <> 9 THEN (CASE WHEN c_custkey % 4 = 0 THEN 'www.' ELSE '' END) || 'org' || CAST(CASE WHEN c_custkey % 22 = 21 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) || '.example' END AS website,
    CASE WHEN c_custkey % 100 >= 27 THEN 1950 + (c_custkey * 31) % 75 END AS year_founded,
    CASE WHEN c_custkey % 40 <> 3 THEN lower(n_name) END AS country_code,
    lower(r_name) AS region_name,
    CASE WHEN c_custkey % 50 >= 19 THEN (c_custkey * 7919) % 5000 END AS employee_count,
    CASE WHEN c_custkey % 50 < 41 THEN spent END AS revenue,
    CAST(311111 + (c_custkey * 37) % 22000 AS VARCHAR) AS primary_code,
    [CAST(311111 + (c_custkey * 37 + 4001 * (i + 1)) % 22000 AS VARCHAR) for i in range(CAST(c_custkey % 4 AS BIGINT)) if i < 3] AS secondary_codes,
    coalesce(text, '') AS description,
    CASE WHEN c_custkey % 3 = 0 THEN ['retail', 'b2b'] ELSE [] END AS business_model,
    CASE WHEN c_custkey % 2 = 0 THEN [lower(c_mktsegment)] ELSE [] END AS target_markets,
    CASE WHEN c_custkey % 5 < 3 THEN ['goods', 'line' || CAST(c_custkey % 7 AS VARCHAR)] ELSE [] END AS core_offerings,
    CASE WHEN c_custkey % 5 <> 4 THEN c_custkey % 3 = 0 END AS is_public
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN documents ON doc_id = c_custkey LEFT JOIN spent ON o_custkey = c_custkey
)"""


def _number(x) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x} AS DOUBLE)"


_rows = ",\n".join(
    f"({_text(q)}, {_text(c)}, {_list(kw.split())}, {_list(co.split())}, {', '.join(map(_number, (*e, *r, *f)))}, {'CAST(NULL AS BOOLEAN)' if p is None else str(p).upper()}, {_list(pre.split())}, {v}, {_text(role)}, {_text(ideal)})"
    for q, c, kw, co, e, r, f, p, pre, v, role, ideal in SPECS
)
SPEC_ROWS = f"""
specs(query_id, complexity, keywords, countries, emp_min, emp_max, rev_min, rev_max, year_min, year_max, want_public, prefixes, vec_id, role_statement, ideal_profile) AS (VALUES
{_rows})"""


def _range(value: str, low: str, high: str) -> str:
    return f"CASE WHEN {low} IS NULL AND {high} IS NULL THEN NULL WHEN {value} IS NULL THEN 'UNKNOWN' WHEN {value} < {low} OR {value} > {high} THEN 'FAIL' ELSE 'PASS' END"


CHECKS = f"""
checks AS (
  SELECT query_id, org_id, complexity, keywords, prefixes, vec_id,
    CASE WHEN len(countries) = 0 THEN NULL WHEN country_code IS NULL THEN 'UNKNOWN' WHEN list_contains(countries, country_code) THEN 'PASS' ELSE 'FAIL' END AS country,
    {_range("employee_count", "emp_min", "emp_max")} AS employee_count,
    {_range("revenue", "rev_min", "rev_max")} AS revenue,
    {_range("year_founded", "year_min", "year_max")} AS year_founded,
    CASE WHEN want_public IS NULL THEN NULL WHEN is_public IS NULL THEN 'UNKNOWN' WHEN is_public = want_public THEN 'PASS' ELSE 'FAIL' END AS is_public
  FROM companies, specs
)"""
NAMES = ("country", "employee_count", "revenue", "year_founded", "is_public")
_failed = " OR ".join(f"coalesce({c} = 'FAIL', FALSE)" for c in NAMES)
_failed_soft = " OR ".join(f"coalesce({c} = 'FAIL', FALSE)" for c in ("country", "is_public"))


def _unknown(names) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} = 'UNKNOWN' THEN '{c}' END" for c in names) + "], lambda x: x IS NOT NULL), ',')"


SURVIVORS = f"""
strict AS (SELECT *, NOT ({_failed}) AS passes, NOT ({_failed_soft}) AS passes_soft,
  (employee_count IS NOT NULL OR revenue IS NOT NULL OR year_founded IS NOT NULL) AS numeric_set FROM checks),
choice AS (
  SELECT query_id, bool_or(numeric_set) AND count(*) FILTER (WHERE passes) < 12 AND count(*) FILTER (WHERE passes_soft) > count(*) FILTER (WHERE passes) AS relaxed FROM strict GROUP BY query_id
),
kept AS (
  SELECT s.query_id, org_id, complexity, keywords, prefixes, vec_id, relaxed,
    CASE WHEN relaxed THEN {_unknown(("country", "is_public"))} ELSE {_unknown(NAMES)} END AS unknown
  FROM strict s JOIN choice c ON s.query_id = c.query_id WHERE passes OR (passes_soft AND relaxed)
)"""

TOKENS = f"[t for t in regexp_extract_all(lower(X), '[a-z0-9]+') if len(t) > 1 and NOT list_contains({_list(STOPWORDS)}, t)]"


def _tokens(column: str) -> str:
    return TOKENS.replace("X", column)


def _bm25(kept: str) -> str:
    return f"""
words AS (SELECT org_id, {_tokens("description")} AS w FROM companies),
post AS (SELECT org_id, term, count(*) AS tf, any_value(len(w)) AS length FROM (SELECT org_id, w, unnest(w) AS term FROM words) GROUP BY org_id, term),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_tokens("array_to_string(keywords, ' ') || ' ' || role_statement || ' ' || ideal_profile")}) AS term FROM specs) GROUP BY query_id, term),
stat AS (SELECT query_id, count(*) AS n, avg(len(w)) AS avg_length FROM {kept} JOIN words USING (org_id) GROUP BY query_id),
want AS (SELECT qt.query_id, post.org_id, post.term, tf, length, times FROM post JOIN qt USING (term) JOIN {kept} k ON k.query_id = qt.query_id AND k.org_id = post.org_id),
freq AS (SELECT query_id, term, count(*) AS df FROM want GROUP BY query_id, term),
bm AS (
  SELECT query_id, org_id, sum(times * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length))) AS bm25
  FROM want JOIN freq USING (query_id, term) JOIN stat USING (query_id) GROUP BY query_id, org_id
)"""


def _codes(source: str) -> str:
    return f"""
affinity AS (
  SELECT query_id, org_id, max(len(p)) AS matched FROM (SELECT org_id, unnest({source}) AS code FROM companies) c,
    (SELECT query_id, unnest(prefixes) AS p FROM specs) s WHERE starts_with(code, p) GROUP BY query_id, org_id
)"""




def _cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
    return f"({dot(a, b)} / greatest(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 1e-12))"


FUSED = f"""
vecs AS (SELECT query_id, embedding AS v FROM specs JOIN embeddings USING (vec_id)),
emb AS (SELECT org_id, embedding FROM companies JOIN embeddings ON vec_id = org_id % (SELECT count(*) FROM embeddings)),
sig AS (
  SELECT k.query_id, k.org_id, k.complexity, k.unknown, k.keywords, len(k.prefixes) > 0 AS has_prefixes,
    round({_cosine("emb.embedding", "vecs.v")}, 12) AS dense, round(coalesce(bm25, 0), 12) AS bm25, coalesce(matched, 0) AS matched,
    CASE WHEN matched IS NULL THEN 0 ELSE least(1.0::DOUBLE, 0.35::DOUBLE + 0.165::DOUBLE * (matched - 2)) END AS code_score
  FROM kept k JOIN emb USING (org_id) JOIN vecs ON vecs.query_id = k.query_id
  LEFT JOIN bm ON bm.query_id = k.query_id AND bm.org_id = k.org_id
  LEFT JOIN affinity a ON a.query_id = k.query_id AND a.org_id = k.org_id
),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, org_id) AS r1,
    row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, org_id) AS r2,
    row_number() OVER (PARTITION BY query_id ORDER BY code_score DESC, org_id) AS r3 FROM sig
),
fused AS (
  SELECT *, 1.0::DOUBLE / (60 + r1) + 0.7::DOUBLE / (60 + r2) + CASE WHEN has_prefixes THEN 0.6::DOUBLE / (60 + r3) ELSE 0 END AS fused FROM ranks
),
short AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, org_id) - 1 AS rank0 FROM fused)
  WHERE rank0 < CASE complexity WHEN 'STRUCTURED' THEN 30 WHEN 'REASONING' THEN 80 ELSE 55 END
)"""


def _verdict(four: int, part: str) -> str:
    return f"CASE WHEN need > 0 AND (matched >= {four} OR {part}) THEN 'QUALIFIED' WHEN matched >= 2 OR hits >= 1 THEN 'PARTIAL' ELSE 'REJECTED' END"


JUDGED = f"""
kw AS (SELECT query_id, list_distinct(keywords) AS kws FROM specs),
found AS (
  SELECT s.*, len(kws) AS need, CAST(len([x for x in kws if list_contains(w, x)]) AS BIGINT) AS hits FROM short s JOIN kw USING (query_id) JOIN words USING (org_id)
),
sure AS (SELECT *, least(100, 40 + 10 * matched + 40 * hits // greatest(need, 1)) AS pct, {_verdict(4, "2 * hits >= need")} AS v1, {_verdict(5, "3 * hits >= 2 * need")} AS v2 FROM found),
judged AS (
  SELECT *, v1 AS verdict, CAST(CASE WHEN v1 = 'REJECTED' THEN 100 - pct ELSE pct END AS INTEGER) AS conf_pct, count(*) OVER (PARTITION BY query_id) AS total FROM sure
),
picked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(conf_pct / 100.0::DOUBLE - 0.5::DOUBLE), rank0) - 1 AS pick FROM judged
    WHERE conf_pct BETWEEN 35 AND 72 OR verdict = 'PARTIAL' OR (rank0 < greatest(1, total // 10) AND verdict = 'REJECTED') OR (rank0 > 0.6::DOUBLE * total AND verdict = 'QUALIFIED') OR (unknown <> '' AND verdict <> 'REJECTED')
  ) WHERE pick < greatest(1, CAST(floor(total * 0.25::DOUBLE) AS BIGINT))
)"""

RANKED = """
final AS (
  SELECT j.query_id, j.org_id, j.rank0, j.fused, p.org_id IS NOT NULL AS escalated, CASE WHEN p.org_id IS NULL THEN j.v1 ELSE j.v2 END AS verdict,
    (CASE WHEN (CASE WHEN p.org_id IS NULL THEN j.v1 ELSE j.v2 END) = 'REJECTED' THEN 100 - j.pct ELSE j.pct END) / 100.0::DOUBLE AS confidence,
    CASE WHEN j.unknown = '' THEN 0 ELSE len(string_split(j.unknown, ',')) END AS n_unknown,
    (j.fused - min(j.fused) OVER (PARTITION BY j.query_id)) / CASE WHEN max(j.fused) OVER (PARTITION BY j.query_id) = min(j.fused) OVER (PARTITION BY j.query_id) THEN 1 ELSE max(j.fused) OVER (PARTITION BY j.query_id) - min(j.fused) OVER (PARTITION BY j.query_id) END AS norm
  FROM judged j LEFT JOIN picked p ON p.query_id = j.query_id AND p.org_id = j.org_id
),
scored AS (
  SELECT f.*, coalesce(nullif(operational_name, ''), nullif(website, ''), 'company-' || CAST(f.org_id AS VARCHAR)) AS name,
    CASE verdict WHEN 'QUALIFIED' THEN 0.6::DOUBLE WHEN 'PARTIAL' THEN 0.25::DOUBLE ELSE 0 END + CASE verdict WHEN 'QUALIFIED' THEN 0.4::DOUBLE WHEN 'PARTIAL' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END
      * least(1, greatest(0, 0.55::DOUBLE * CASE WHEN verdict = 'REJECTED' THEN 1 - confidence ELSE confidence END + 0.3::DOUBLE * least(1, greatest(0, norm)) + 0.15::DOUBLE * 0.5::DOUBLE
        - 0.06::DOUBLE * n_unknown + CASE WHEN escalated AND verdict <> 'REJECTED' THEN 0.03::DOUBLE ELSE 0 END)) AS score
  FROM final f JOIN companies USING (org_id)
)"""

BANDED = """
marked AS (
  SELECT *, score >= 0.35::DOUBLE AND verdict <> 'REJECTED' AS keep, count(*) FILTER (WHERE score >= 0.35::DOUBLE AND verdict <> 'REJECTED') OVER (PARTITION BY query_id) AS kept_n,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(name), rank0, org_id) AS spot FROM scored
)
SELECT query_id, org_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY spot) AS INTEGER) AS place, CASE WHEN kept_n = 0 THEN 'PARTIAL' ELSE verdict END AS verdict, round(score, 6) AS score, escalated,
  CASE WHEN escalated THEN 'rules-2' ELSE 'rules' END || CASE WHEN kept_n = 0 THEN '+fallback' ELSE '' END AS tier
FROM marked WHERE keep OR (kept_n = 0 AND spot <= 10)
"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_all_codes = "list_concat([primary_code], secondary_codes)"
_to_short = (COMPANIES, SPEC_ROWS, CHECKS, SURVIVORS, _bm25("kept"), _codes(_all_codes), FUSED)

RUNS = f"""
near AS (
  SELECT * FROM (SELECT query_id, e.vec_id AS org_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, e.vec_id) - 1 AS rank0
    FROM (SELECT s.query_id, e.vec_id, {_cosine("e.embedding", "v.embedding")} AS s FROM specs s JOIN embeddings v ON v.vec_id = s.vec_id, embeddings e) e) WHERE rank0 < 25
),
runs AS (
  SELECT query_id, 'dense' AS system, org_id, rank0 + 1 AS pos FROM near
  UNION ALL SELECT query_id, 'plain', org_id, row_number() OVER (PARTITION BY query_id ORDER BY org_id) FROM near WHERE rank0 % 2 = 0
)"""
GRADES = """
grades AS (SELECT query_id, doc_id AS org_id, max(2 * quality + 1 - toxic) AS grade FROM labels, specs GROUP BY query_id, doc_id)"""


def _metrics() -> str:
    ks = (5, 10, 20)
    gain = "(pow(2.0::DOUBLE, grade) - 1) / log2(CAST({0} AS DOUBLE) + 1)"
    ideal = ", ".join(f"sum(CASE WHEN i <= {k} THEN {gain.format('i')} END) AS ideal_{k}" for k in ks)
    sums = ", ".join(f"sum(CASE WHEN pos <= {k} THEN rel ELSE 0 END) AS rel_{k}, sum(CASE WHEN pos <= {k} THEN {gain.format('pos')} ELSE 0 END) AS dcg_{k}" for k in ks)
    out = ", ".join(
        f"round(CASE WHEN returned > 0 THEN rel_{k}::DOUBLE / least({k}, returned) ELSE 0 END, 9) AS p_at_{k}, round(CASE WHEN coalesce(in_pool, 0) > 0 THEN rel_{k}::DOUBLE / in_pool ELSE 0 END, 9) AS r_at_{k}, round(CASE WHEN coalesce(ideal_{k}, 0) > 0 THEN dcg_{k} / ideal_{k} ELSE 0 END, 9) AS ndcg_at_{k}"
        for k in ks
    )
    return f"""
g AS (SELECT r.*, coalesce(grade, 0) AS grade, CASE WHEN coalesce(grade, 0) >= 2 THEN 1 ELSE 0 END AS rel FROM runs r LEFT JOIN grades USING (query_id, org_id)),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id, system ORDER BY pos) AS hits FROM g),
pool AS (SELECT query_id, count(*) FILTER (WHERE grade >= 2) AS in_pool, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, org_id) AS i FROM grades) GROUP BY query_id),
per AS (SELECT query_id, system, count(*) AS returned, sum(rel) AS found, coalesce(avg(CASE WHEN rel = 1 THEN hits::DOUBLE / pos END), 0) AS ap, {sums} FROM h GROUP BY query_id, system)
SELECT query_id, system, {out}, round(ap, 9) AS average_precision, CAST(returned AS BIGINT) AS returned, CAST(found AS BIGINT) AS found, CAST(coalesce(in_pool, 0) AS BIGINT) AS in_pool
FROM per LEFT JOIN pool USING (query_id)
"""


RATERS = "raters AS (SELECT doc_id, 2 * quality + 1 - toxic AS a, CASE WHEN doc_id % 5 = 0 THEN 1 + quality ELSE 2 * quality + 1 - toxic END AS b FROM labels)"

_location = "coalesce(nullif(concat_ws(', ', nullif(region_name, ''), upper(nullif(country_code, ''))), ''), 'unknown location')"
DOCUMENT = f"""concat_ws(chr(10), nullif(operational_name, ''), 'Industry: sector (' || primary_code || ')', nullif(array_to_string(['Also: sector (' || c || ')' for c in secondary_codes], chr(10)), ''),
  CASE WHEN len(core_offerings) > 0 THEN 'Provides: ' || array_to_string(core_offerings[1:12], '; ') END, CASE WHEN len(target_markets) > 0 THEN 'Serves: ' || array_to_string(target_markets[1:10], ', ') END,
  CASE WHEN len(business_model) > 0 THEN 'Model: ' || array_to_string(business_model[1:8], ', ') END, nullif(description, ''), 'Location: ' || {_location})"""
_name = "coalesce(nullif(operational_name, ''), nullif(website, ''), 'company-' || CAST(org_id AS VARCHAR))"
CARD = f"""concat_ws(chr(10), 'Name: ' || {_name}, 'Location: ' || {_location}, 'NAICS: ' || primary_code || ' sector', CASE WHEN len(secondary_codes) > 0 THEN 'Secondary NAICS: ' || array_to_string([c || ' sector' for c in secondary_codes], '; ') END,
  'Employees: ' || coalesce(CAST(employee_count AS VARCHAR), 'unknown') || ' | Revenue USD: ' || coalesce(format('{{:,}}', CAST(round_even(revenue, 0) AS BIGINT)), 'unknown') || ' | Founded: ' || coalesce(CAST(year_founded AS VARCHAR), 'unknown') || ' | Public: ' || CASE WHEN is_public IS NULL THEN 'unknown' WHEN is_public THEN 'True' ELSE 'False' END,
  CASE WHEN len(business_model) > 0 THEN 'Business model: ' || array_to_string(business_model[1:6], ', ') END, CASE WHEN len(core_offerings) > 0 THEN 'Core offerings: ' || array_to_string(core_offerings[1:8], '; ') END,
  CASE WHEN len(target_markets) > 0 THEN 'Target markets: ' || array_to_string(target_markets[1:8], ', ') END,
  CASE WHEN description <> '' THEN 'Description: ' || CASE WHEN length(description) > 460 THEN regexp_replace(substring(description, 1, 460), ' [^ ]*$', '') || '...' ELSE description END END)"""

DEDUPE = """
keyed AS (
  SELECT *, CASE WHEN website IS NOT NULL THEN 'web:' || regexp_replace(lower(trim(website)), '^www[.]', '') WHEN operational_name IS NOT NULL THEN 'name:' || lower(operational_name) || '|' || coalesce(country_code, '?') END AS key,
    CAST(year_founded IS NOT NULL AS INT) + CAST(country_code IS NOT NULL AS INT) + CAST(employee_count IS NOT NULL AS INT) + CAST(revenue IS NOT NULL AS INT) + 1 + CAST(description <> '' AS INT) + CAST(is_public IS NOT NULL AS INT) + CAST(len(business_model) > 0 AS INT) + CAST(len(core_offerings) > 0 AS INT) AS c
  FROM companies
),
named AS (SELECT *, coalesce(key, 'row:' || CAST(org_id AS VARCHAR)) AS k FROM keyed),
ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, org_id) AS place, count(*) OVER (PARTITION BY k) AS n, min(org_id) OVER (PARTITION BY k) AS first_id FROM named),
merged AS (
  SELECT a.first_id AS org_id, coalesce(a.operational_name, b.operational_name) AS operational_name, coalesce(a.year_founded, b.year_founded) AS year_founded, coalesce(a.employee_count, b.employee_count) AS employee_count,
    coalesce(a.revenue, b.revenue) AS revenue, coalesce(a.is_public, b.is_public) AS is_public, coalesce(a.country_code, b.country_code) AS country_code,
    CAST(CASE WHEN len(a.secondary_codes) > 0 THEN len(a.secondary_codes) ELSE coalesce(len(b.secondary_codes), 0) END AS INT) AS n_codes, CAST(a.n - 1 AS INT) AS merged
  FROM ordered a LEFT JOIN ordered b ON a.k = b.k AND b.place = 2 WHERE a.place = 1
)"""


def _geo() -> tuple[str, str]:
    names = {n: [c] for n, c in geo.ALPHA3.items()} | {n: [c] for n, c in geo.country_rows()} | dict(geo.region_rows())
    table = ", ".join(f"({_text(n)}, {_list(sorted(c))})" for n, c in names.items())
    phrases: dict[str, list[str]] = dict(geo.region_rows())
    for n, c in geo.country_rows():
        phrases.setdefault(n, [c])
    places = ", ".join(f"({_text(n)}, {_list(c)}, {k})" for k, (n, c) in enumerate(phrases.items()) if len(n) > 2)
    return f"names(name, codes) AS (VALUES {table})", f"places(phrase, codes, place) AS (VALUES {places})"


_names, _places = _geo()
_bench = "bench(query_id, text) AS (VALUES " + ", ".join(f"({_text(q)}, {_text(t)})" for q, _, t in BENCHMARK) + ")"
_scan = """
met AS (SELECT query_id, phrase, codes, row_number() OVER (PARTITION BY query_id ORDER BY length(phrase) DESC, place) AS n FROM bench, places
  WHERE contains(' ' || regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g') || ' ', ' ' || phrase || ' '))"""


def _heuristic() -> str:
    from quernstone.plans import planner as p

    num = lambda pattern: f"TRY_CAST(replace(nullif(regexp_extract(lower(text), {_text(pattern)}, 1), ''), ',', '') AS DOUBLE)"
    unit = lambda pattern: f"CASE substring(regexp_extract(lower(text), {_text(pattern)}, 2), 1, 1) WHEN 'b' THEN 1e9 WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 ELSE 1.0 END"
    words = f"[w for w in regexp_extract_all(lower(text), '[a-z0-9-]{{3,}}') if NOT list_contains({_list(p.STOPWORDS)}, w)][1:{p.KEYWORDS}]"
    revenue = "coalesce(" + ", ".join(f"{num(x)} * {unit(x)}" for x in p.REVENUE_MIN) + ")"
    return f"""
SELECT b.query_id, 'SEMANTIC' AS complexity, {num(p.EMPLOYEES_MIN)} + 1 AS employees_min, {num(p.EMPLOYEES_MAX)} - 1 AS employees_max, CAST({revenue} AS DOUBLE) AS revenue_min,
  {num(p.FOUNDED_AFTER)} + 1 AS founded_min, {num(p.FOUNDED_BEFORE)} - 1 AS founded_max,
  CASE WHEN regexp_matches(lower(text), {_text(p.PUBLIC)}) THEN TRUE WHEN regexp_matches(lower(text), {_text(p.PRIVATE)}) THEN FALSE END AS want_public,
  array_to_string({words}, ' ') AS keywords, coalesce(array_to_string(codes, ','), '') AS countries
FROM bench b LEFT JOIN met ON met.query_id = b.query_id AND n = 1
"""


_SAMPLE = "((doc_id % 2147483647) * 48271 + 11 * 16807) % 2147483647 * 69621 % 2147483647"

ORACLES: dict[str, str] = {
    "coerce_companies": """
SELECT c_custkey AS org_id, CASE WHEN c_custkey % 7 IN (0, 2, 3) THEN NULL ELSE 1950 + c_custkey % 75 END AS year_founded,
  CASE WHEN c_custkey % 3 = 0 THEN lower(substring(c_mktsegment, 1, 2)) WHEN c_custkey % 3 = 1 THEN 'gb' END AS country_code,
  CASE c_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_public,
  CASE c_custkey % 5 WHEN 0 THEN 48000000.0::DOUBLE WHEN 1 THEN NULL ELSE CAST(c_custkey AS DOUBLE) END AS revenue FROM customer""",
    "dedupe_pairs": _with(COMPANIES, DEDUPE) + " SELECT key, min(org_id) AS first_id, max(org_id) AS second_id FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING count(*) = 2",
    "dedupe_companies": _with(COMPANIES, DEDUPE) + " SELECT * FROM merged",
    "dense_company_ids": _with(COMPANIES, DEDUPE) + " SELECT org_id AS old_id, row_number() OVER (ORDER BY org_id) - 1 AS org_id FROM merged",
    "dataset_summary": _with(COMPANIES, DEDUPE) + """ SELECT count(*) AS n, round(avg(CAST(employee_count IS NOT NULL AS INT)), 9) AS has_employee_count, round(avg(CAST(revenue IS NOT NULL AS INT)), 9) AS has_revenue,
  round(avg(CAST(year_founded IS NOT NULL AS INT)), 9) AS has_year_founded, round(avg(CAST(len(secondary_codes) > 0 AS INT)), 9) AS has_secondary_codes, round(avg(c / 9.0::DOUBLE), 9) AS mean_completeness FROM keyed""",
    "country_histogram": _with(COMPANIES) + " SELECT country_code, count(*) AS n FROM companies WHERE country_code IS NOT NULL GROUP BY country_code",
    "company_documents": _with(COMPANIES) + f" SELECT org_id, sha256({DOCUMENT}) AS document_sha256 FROM companies",
    "company_cards": _with(COMPANIES) + f" SELECT org_id, sha256({CARD}) AS card_sha256 FROM companies",
    "geo_expand": _with(_names, "t AS (SELECT n_nationkey, ['Nordics', 'germany', 'UK', 'zz', 'deu', 'Atlantis', 'european union', 'Asia-Pacific', 'el', 'worldwide', ' France! '][n_nationkey % 11 + 1] AS token FROM nation)", r"c AS (SELECT *, trim(regexp_replace(lower(trim(token)), '[^a-z\s-]', '', 'g')) AS clean FROM t)") + """
SELECT n_nationkey, token, coalesce(array_to_string(coalesce(codes, CASE WHEN length(clean) = 2 THEN [CASE clean WHEN 'uk' THEN 'gb' WHEN 'el' THEN 'gr' ELSE clean END] END), ','), '') AS resolved FROM c LEFT JOIN names ON name = clean""",
    "geo_text_scan": _with(_bench, _places, _scan) + " SELECT b.query_id, phrase, coalesce(array_to_string(codes, ','), '') AS codes FROM bench b LEFT JOIN met ON met.query_id = b.query_id AND n = 1",
    "heuristic_plan": _with(_bench, _places, _scan) + _heuristic(),
    "filter_tri": _with(COMPANIES, SPEC_ROWS, CHECKS) + f" SELECT query_id, org_id, {', '.join(NAMES)} FROM checks",
    "filter_tally": _with(COMPANIES, SPEC_ROWS, CHECKS) + f" SELECT query_id, {', '.join(f'''count(*) FILTER (WHERE {c} = 'FAIL') AS {c}_failed''' for c in NAMES)} FROM checks GROUP BY query_id",
    "filter_relaxed": _with(COMPANIES, SPEC_ROWS, CHECKS, SURVIVORS) + " SELECT query_id, org_id, relaxed, unknown FROM kept",
    "filter_survivors": _with(COMPANIES, SPEC_ROWS, CHECKS) + f" SELECT query_id, org_id, {_unknown(NAMES)} AS unknown FROM checks WHERE NOT ({_failed})",
    "tokenize_postings": f"WITH w AS (SELECT doc_id AS org_id, {_tokens('text')} AS w FROM documents) SELECT org_id, term, count(*) AS tf, CAST(any_value(len(w)) AS INT) AS length FROM (SELECT org_id, w, unnest(w) AS term FROM w) GROUP BY org_id, term",
    "bm25_scores": _with(COMPANIES, SPEC_ROWS, CHECKS, f"kept AS (SELECT query_id, org_id FROM checks WHERE NOT ({_failed}))", _bm25("kept")) + " SELECT query_id, org_id, round(bm25, 6) AS bm25 FROM bm",
    "prefix_affinity": _with(COMPANIES, SPEC_ROWS, _codes("[primary_code]")) + " SELECT query_id, org_id, round(least(1.0::DOUBLE, 0.35::DOUBLE + 0.165::DOUBLE * (matched - 2)), 6) AS code_score, CAST(matched AS INT) AS matched FROM affinity",
    "dense_topk": _with(SPEC_ROWS, RUNS) + " SELECT query_id, org_id, round(s, 6) AS similarity, CAST(rank0 AS INT) AS rank0 FROM near",
    "dense_search": f"""
WITH s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, e.vec_id AS org_id, round({_cosine("e.embedding", "q.embedding")}, 12) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
SELECT query_id, org_id, round(s, 6) AS similarity, CAST(rank0 AS INT) AS rank0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, org_id) - 1 AS rank0 FROM s) WHERE rank0 < 10""",
    "normalise_vectors": "SELECT vec_id, round(sqrt(list_sum([(x / l) * (x / l) for x in e])), 6) AS length, round(e[1] / l, 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, greatest(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])), 1e-12) AS l FROM embeddings)",
    "rrf_fusion": _with(*_to_short) + " SELECT query_id, org_id, round(fused, 9) AS fused FROM fused",
    "hybrid_shortlist": _with(*_to_short) + " SELECT query_id, org_id, round(fused, 9) AS fused, CAST(rank0 AS INT) AS rank0 FROM short",
    "adjudicate_batches": _with(*_to_short, JUDGED) + " SELECT query_id, org_id, CAST(rank0 // 8 AS INT) AS batch, CAST(rank0 % 8 + 1 AS INT) AS local_id, verdict, conf_pct FROM judged",
    "escalation_pick": _with(*_to_short, JUDGED) + " SELECT query_id, org_id, CAST(pick AS INT) AS pick FROM picked",
    "banded_rank": _with(*_to_short, JUDGED, RANKED, BANDED),
    "rank_all": _with(*_to_short, JUDGED, RANKED) + " SELECT query_id, org_id, verdict, round(score, 6) AS score FROM scored",
    "metrics_at_k": _with(SPEC_ROWS, RUNS, GRADES, _metrics()),
    "pool_union": _with(SPEC_ROWS, RUNS) + " SELECT query_id, org_id, CAST(min(pos) AS INT) AS first_pos, CAST(count(DISTINCT system) AS INT) AS systems FROM runs WHERE pos <= 20 GROUP BY query_id, org_id",
    "kappa": _with(RATERS, "t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM raters)", "x AS (SELECT sum(x * y) AS xy FROM (SELECT a AS label, count(*) AS x FROM raters GROUP BY a) JOIN (SELECT b AS label, count(*) AS y FROM raters GROUP BY b) USING (label))") + " SELECT n, round(same::DOUBLE / n, 9) AS observed, round(xy::DOUBLE / (n * n), 9) AS expected, round((same * n - xy)::DOUBLE / (n * n - xy), 9) AS kappa FROM t, x",
    "binary_scores": _with(RATERS, "c AS (SELECT count(*) FILTER (WHERE b >= 2 AND a >= 2) AS tp, count(*) FILTER (WHERE b >= 2 AND a < 2) AS fp, count(*) FILTER (WHERE b < 2 AND a >= 2) AS fn FROM raters)") + " SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM c",
    "rater_agreement": _with(RATERS) + " SELECT count(*) AS n, round(avg(CAST(a = b AS INT)), 9) AS exact, round(avg(CAST(abs(a - b) <= 1 AS INT)), 9) AS within_one, round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b FROM raters",
    "jaccard": _with(SPEC_ROWS, RUNS, "s AS (SELECT query_id, system, list(org_id) AS a, list(org_id) FILTER (WHERE pos <= 10) AS h FROM runs GROUP BY query_id, system)") + " SELECT x.query_id, x.system AS run_a, y.system AS run_b, round(len(list_intersect(x.a, y.a))::DOUBLE / len(list_distinct(list_concat(x.a, y.a))), 9) AS jaccard, round(len(list_intersect(x.h, y.h))::DOUBLE / greatest(1, least(len(x.h), len(y.h))), 9) AS head_overlap FROM s x JOIN s y ON x.query_id = y.query_id AND x.system < y.system",
    "verdict_flips": _with(SPEC_ROWS, RUNS, "v AS (SELECT query_id, org_id, count(DISTINCT pos <= 5) + CASE WHEN count(DISTINCT system) < 2 THEN 1 ELSE 0 END AS verdicts FROM runs GROUP BY query_id, org_id)") + " SELECT query_id, org_id, CAST(verdicts AS BIGINT) AS verdicts FROM v WHERE verdicts > 1",
    "stratified_sample": f"""
WITH g AS (SELECT doc_id, 2 * quality + 1 - toxic AS grade, {_SAMPLE} AS o FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY o, doc_id) AS n, CASE grade WHEN 3 THEN 5 WHEN 2 THEN 6 WHEN 1 THEN 6 ELSE 3 END AS want FROM g),
first AS (SELECT doc_id, grade FROM r WHERE n <= want),
rest AS (SELECT doc_id, grade, row_number() OVER (ORDER BY o, doc_id) AS m FROM r WHERE n > want AND n <= 20)
SELECT doc_id, grade FROM first UNION ALL SELECT doc_id, grade FROM rest WHERE m <= 20 - (SELECT count(*) FROM first)""",
    "usage_costs": """
WITH c AS (SELECT event_type AS model, event_id % 997 AS p, user_id % 97 AS o, CASE event_type WHEN 'click' THEN 0.10::DOUBLE WHEN 'view' THEN 0.15::DOUBLE ELSE 0.30::DOUBLE END AS i, CASE event_type WHEN 'click' THEN 0.40::DOUBLE WHEN 'view' THEN 0.0::DOUBLE ELSE 2.50::DOUBLE END AS u FROM events)
SELECT model, count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum((p * i + o * u) / 1e6), 9) AS cost FROM c GROUP BY model""",
    "cache_probe": "WITH k AS (SELECT doc_id, sha256('embed' || chr(31) || 'm' || chr(31) || text) AS key FROM documents) SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 2 = 0)",
    "embed_batches": "SELECT doc_id, CAST(least(length(text), 8000) AS BIGINT) AS chars, TRUE AS in_batch FROM documents",
}
