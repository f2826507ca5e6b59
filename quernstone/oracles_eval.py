"""DuckDB SQL for the queries of planning, adjudication, evaluation, embedding stores and reports."""

from __future__ import annotations

from quernstone.operators.prompts import UNKNOWN_RULE, VERDICT_RULES
from quernstone.oracles import (
    BANDED,
    CARD,
    CHECKS,
    COMPANIES,
    GRADES,
    JUDGED,
    RANKED,
    RUNS,
    SPEC_ROWS,
    _metrics,
    _SAMPLE,
    _text,
    _to_short,
    _tokens,
    _with,
)

SAID = """
said AS (
  SELECT k AS org_id, CASE WHEN b % 10 = 9 THEN 'error' WHEN k % 13 = 0 THEN 'missing' ELSE 'cheap' END AS tier,
    CASE WHEN b % 10 = 9 OR k % 13 = 0 THEN 'PARTIAL' WHEN k % 7 = 0 THEN 'REJECTED' WHEN k % 3 = 0 THEN 'QUALIFIED' WHEN k % 3 = 1 THEN 'PARTIAL' ELSE 'REJECTED' END AS verdict,
    CASE WHEN b % 10 = 9 OR k % 13 = 0 OR k % 11 = 0 THEN 0 ELSE least(1.0::DOUBLE, (k % 150) / 100.0::DOUBLE) END AS confidence,
    CASE WHEN b % 10 = 9 THEN 'not adjudicated' WHEN k % 13 = 0 THEN 'no verdict returned' ELSE 'seen ' || k END AS reason,
    CASE WHEN b % 10 <> 9 AND k % 13 <> 0 AND (k % 2 = 0 OR k % 3 = 0) THEN (CASE WHEN k % 2 = 0 THEN 0.75::DOUBLE ELSE 0 END) / (CASE WHEN k % 2 = 0 THEN 0.75::DOUBLE ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0.25::DOUBLE ELSE 0 END) END AS satisfaction
  FROM (SELECT c_custkey AS k, c_custkey // 8 AS b FROM customer)
)"""

JUDGED_LABELS = """
base AS (SELECT doc_id, max(2 * quality + 1 - toxic) AS g FROM labels GROUP BY doc_id),
lab AS (SELECT 'q' || (doc_id % 3) AS query_id, CASE WHEN doc_id % 11 = 0 THEN 'no ' ELSE '' END || 'n' || (doc_id // 6) AS name, arg_min(g, doc_id) AS a FROM base WHERE doc_id % 5 < 3 GROUP BY ALL),
jud AS (SELECT 'q' || (doc_id % 3) AS query_id, 'n' || (doc_id // 6) AS name, arg_min(CASE WHEN doc_id % 4 = 0 THEN 3 - g ELSE g END, doc_id) AS b FROM base GROUP BY ALL),
pairs AS (SELECT query_id, name, a, b FROM lab JOIN jud USING (query_id, name))"""


def _kappa(name: str, a: str, b: str) -> str:
    return f"""
{name} AS (
  SELECT (same * n - xy)::DOUBLE / (n * n - xy) AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {a} = {b}) AS same FROM pairs),
    (SELECT sum(x * y) AS xy FROM (SELECT {a} AS label, count(*) AS x FROM pairs GROUP BY 1) JOIN (SELECT {b} AS label, count(*) AS y FROM pairs GROUP BY 1) USING (label))
)"""


_header = "\n".join(
    (
        "REQUEST: the request",
        "REQUIREMENTS (filtered already; look again only where a field is unknown): employees <=2000; revenue USD >=100000; founded 1970-2015",
        "CRITERIA:\n- Scope [must-have, weight 0.75]: does it",
        "NOT TO BE TAKEN FOR A MATCH:\n- vendors",
    )
)
_show = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
_hash = "CAST('0x' || substring(md5(t), 1, 8) AS BIGINT) % 128"


def _cells(text: str) -> str:
    return f"list_transform({_tokens(text)}, lambda t: {_hash})"


def _vector(cells: str) -> str:
    return f"list_transform(range(64), lambda k: CAST(len(list_filter({cells}, lambda c: c = k)) - len(list_filter({cells}, lambda c: c = k + 64)) AS DOUBLE))"


def _filled(p: str, q: str) -> str:
    plain = ", ".join(f"{c} := coalesce({p}.{c}, {q}.{c})" for c in ("operational_name", "country_code", "year_founded", "employee_count", "revenue", "is_public"))
    return f"struct_pack(org_id := a.org_id, {plain}, description := CASE WHEN {p}.description = '' THEN {q}.description ELSE {p}.description END)"


def _present(p: str) -> str:
    return "(" + " + ".join(f"CAST({p}.{c} IS NOT NULL AS INT)" for c in ("year_founded", "country_code", "employee_count", "revenue", "is_public")) + f" + CAST({p}.description <> '' AS INT))"


def _summarised() -> str:
    """The body of the metrics query as a table."""
    return _metrics().rsplit("\nSELECT", 1)[0] + ",\nsummary AS (SELECT" + _metrics().rsplit("\nSELECT", 1)[1] + ")"


_marked = BANDED.rsplit("\nSELECT", 1)[0]
_rank = """
norm AS (
  SELECT *, 'g' || (org_id // 50) AS query_id, (org_id % 97) / 97.0::DOUBLE AS fused FROM said
),
place AS (
  SELECT *, CASE WHEN verdict = 'REJECTED' THEN 1 - confidence ELSE confidence END AS sure,
    (fused - min(fused) OVER w) / CASE WHEN max(fused) OVER w = min(fused) OVER w THEN 1 ELSE max(fused) OVER w - min(fused) OVER w END AS n FROM norm WINDOW w AS (PARTITION BY query_id)
),
scored AS (
  SELECT *, CASE verdict WHEN 'QUALIFIED' THEN 0.6::DOUBLE WHEN 'PARTIAL' THEN 0.25::DOUBLE ELSE 0 END + CASE verdict WHEN 'QUALIFIED' THEN 0.4::DOUBLE WHEN 'PARTIAL' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END
    * least(1, greatest(0, 0.55::DOUBLE * sure + 0.3::DOUBLE * n + 0.15::DOUBLE * coalesce(satisfaction, 0.5::DOUBLE) - CASE WHEN org_id % 5 = 0 THEN 0.06::DOUBLE ELSE 0 END)) AS score FROM place
),
marked AS (
  SELECT *, score >= 0.35::DOUBLE AND verdict <> 'REJECTED' AS keep, count(*) FILTER (WHERE score >= 0.35::DOUBLE AND verdict <> 'REJECTED') OVER (PARTITION BY query_id) AS kept_n,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'name ' || org_id, org_id) AS spot FROM scored
)
SELECT query_id, org_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY spot) AS INTEGER) AS place, CASE WHEN kept_n = 0 THEN 'PARTIAL' ELSE verdict END AS verdict,
  round(satisfaction, 9) AS satisfaction, round(score, 9) AS score, tier || CASE WHEN kept_n = 0 THEN '+fallback' ELSE '' END AS tier
FROM marked WHERE keep OR (kept_n = 0 AND spot <= 10)"""

ORACLES: dict[str, str] = {
    "parse_verdicts": _with(SAID) + " SELECT org_id, verdict, round(confidence, 4) AS confidence, reason, tier FROM said",
    "rank_with_criteria": _with(SAID, _rank.lstrip("\n")),
    "judge_grades": "SELECT k AS org_id, CAST(least(3, greatest(0, k % 7 - 1)) AS INTEGER) AS grade, 'as ' || k AS justification FROM (SELECT c_custkey AS k, c_custkey // 8 AS b FROM customer) WHERE b % 10 <> 9 AND k % 13 <> 0 AND k % 9 <> 0",
    "plan_from_json": """
SELECT query_id, planned_by, complexity, CAST(employees_min AS DOUBLE) AS employees_min, CAST(employees_max AS DOUBLE) AS employees_max, CAST(revenue_min AS DOUBLE) AS revenue_min, CAST(founded_min AS DOUBLE) AS founded_min, CAST(founded_max AS DOUBLE) AS founded_max,
  want_public, prefixes, countries, keywords, role_statement, criteria, disqualifiers
FROM (VALUES
  ('p1', 'model', 'STRUCTURED', 100, 250.5, NULL, NULL, NULL, TRUE, '52,522', 'dk,fi,is,no,se', 'bank', '', 'Lends:0.8:true:x', 'fintech'),
  ('p2', 'model', 'SEMANTIC', NULL, NULL, 1000000, NULL, NULL, NULL, '', 'fr', '', 'lends', '', ''),
  ('p3', 'model', 'REASONING', NULL, NULL, NULL, 1990, NULL, FALSE, '', 'de,gb', '', '', '', ''),
  ('p4', 'rules', 'SEMANTIC', 51, NULL, NULL, NULL, NULL, NULL, '', 'ro', 'employees,romania', 'more than 50 employees in Romania', '', ''),
  ('p5', 'rules', 'SEMANTIC', NULL, NULL, NULL, 2002, NULL, FALSE, '', '', 'private,mills,founded,after,2001', 'private mills founded after 2001', '', '')
) t(query_id, planned_by, complexity, employees_min, employees_max, revenue_min, founded_min, founded_max, want_public, prefixes, countries, keywords, role_statement, criteria, disqualifiers)""",
    "hard_constraints": _with(SPEC_ROWS) + """ SELECT query_id, len(countries) > 0 OR emp_min IS NOT NULL OR emp_max IS NOT NULL OR rev_min IS NOT NULL OR rev_max IS NOT NULL OR year_min IS NOT NULL OR year_max IS NOT NULL OR want_public IS NOT NULL AS hard FROM specs
UNION ALL SELECT 'p' || i, TRUE FROM range(1, 6) t(i)""",
    "query_probes": _with(SPEC_ROWS) + " SELECT query_id, coalesce(nullif(ideal_profile, ''), nullif(role_statement, ''), array_to_string(keywords, ' ')) AS probe FROM specs",
    "funnel_counts": _with(*_to_short, JUDGED, RANKED, _marked, """
ret AS (SELECT query_id, CASE WHEN kept_n = 0 THEN 'PARTIAL' ELSE verdict END AS verdict FROM marked WHERE keep OR (kept_n = 0 AND spot <= 10))""") + """
SELECT s.query_id, (SELECT count(*) FROM companies) AS database, (SELECT count(*) FROM kept x WHERE x.query_id = s.query_id) AS after_filter, CAST(coalesce((SELECT any_value(relaxed) FROM kept x WHERE x.query_id = s.query_id), FALSE) AS BIGINT) AS relaxed,
  (SELECT count(*) FROM short x WHERE x.query_id = s.query_id) AS shortlist, (SELECT count(*) FROM picked x WHERE x.query_id = s.query_id) AS escalated,
  (SELECT count(*) FROM ret x WHERE x.query_id = s.query_id) AS returned, (SELECT count(*) FROM ret x WHERE x.query_id = s.query_id AND verdict = 'QUALIFIED') AS qualified FROM specs s""",
    "prompt_batches": _with(COMPANIES) + f"""
SELECT org_id // 8 AS batch, sha256({_text(_header + chr(10) * 2 + VERDICT_RULES + chr(10) * 2 + UNKNOWN_RULE + chr(10) * 2 + "COMPANIES" + chr(10) * 2)}
  || string_agg('--- id ' || (org_id % 8 + 1) || ' ---' || chr(10) || {CARD} || CASE WHEN org_id % 4 = 0 THEN chr(10) || '[not in the data: revenue, year_founded]' ELSE '' END, chr(10) || chr(10) ORDER BY org_id)) AS prompt_sha256,
  {_text(_header)} AS header FROM companies GROUP BY org_id // 8""",
    "coerce_codes": """
SELECT c_custkey AS org_id, CASE c_custkey % 6 WHEN 0 THEN c_custkey || '/a' WHEN 1 THEN c_custkey || '//0.5' ELSE '' END AS one,
  CASE c_custkey % 5 WHEN 0 THEN c_custkey || '/x;7//0.25' WHEN 1 THEN '9/' WHEN 2 THEN 'z/' ELSE '' END AS many,
  CASE c_custkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'one' ELSE '' END AS texts, CASE c_custkey % 3 WHEN 0 THEN 'RO/' || c_custkey WHEN 1 THEN 'x' ELSE '' END AS place FROM customer""",
    "describe_ranges": f"""
SELECT p_partkey, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN {_show("lo")} || '-' || {_show("hi")} WHEN lo IS NOT NULL THEN '>=' || {_show("lo")} WHEN hi IS NOT NULL THEN '<=' || {_show("hi")} ELSE 'any' END AS described
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS lo, CASE WHEN p_partkey % 2 <> 0 THEN p_size * 2 + CASE WHEN p_partkey % 5 = 0 THEN 0.5::DOUBLE ELSE 0 END END AS hi FROM part)""",
    "cache_stats": "SELECT lang AS ns, count(DISTINCT text) AS entries FROM documents WHERE lang <> 'fr' GROUP BY lang",
    "usage_delta": """
SELECT event_type AS model, count(*) AS calls, CAST(sum(event_id % 997) AS BIGINT) AS prompt_tokens, CAST(sum(user_id % 97) AS BIGINT) AS output_tokens,
  round(sum(((event_id % 997) * CASE event_type WHEN 'click' THEN 0.10::DOUBLE ELSE 0.30::DOUBLE END + (user_id % 97) * CASE event_type WHEN 'click' THEN 0.40::DOUBLE ELSE 2.50::DOUBLE END) / 1e6), 6) AS cost
FROM events WHERE event_type <> 'view' AND event_id % 3 <> 0 GROUP BY event_type""",
    "project_costs": """
SELECT model, round(CASE WHEN calls > 0 THEN cost / calls * n END, 9) AS projected, CAST(1 + ceil((n % 80) / 8.0::DOUBLE) + ceil((n % 13) / 5.0::DOUBLE) AS BIGINT) AS run_calls
FROM (SELECT event_type AS model, count(*) FILTER (WHERE event_type <> 'view') AS calls, sum(event_id % 997) * 0.1::DOUBLE / 1e6 AS cost FROM events GROUP BY event_type), (SELECT count(*) AS n FROM customer)""",
    "label_pairs": _with(JUDGED_LABELS) + " SELECT query_id, name, CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM pairs",
    "grade_disagreements": _with(JUDGED_LABELS) + " SELECT query_id, name, CAST(abs(a - b) AS INT) AS apart FROM pairs WHERE a <> b",
    "calibration": _with(JUDGED_LABELS, _kappa("kg", "a", "b"), _kappa("kb", "CAST(a >= 2 AS INT)", "CAST(b >= 2 AS INT)"), """
c AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE b >= 2 AND a >= 2) AS tp, count(*) FILTER (WHERE b >= 2 AND a < 2) AS fp, count(*) FILTER (WHERE b < 2 AND a >= 2) AS fn,
  avg(CAST(a = b AS INT)) AS exact, avg(CAST(abs(a - b) <= 1 AS INT)) AS within_one, avg(a) AS label_mean, avg(b) AS judge_mean FROM pairs)""") + """
SELECT pairs, tp, fp, fn, round(exact, 9) AS exact, round(within_one, 9) AS within_one, round(kg.kappa, 9) AS kappa_graded, round(kb.kappa, 9) AS kappa_binary, round(tp::DOUBLE / (tp + fp), 9) AS precision,
  round(tp::DOUBLE / (tp + fn), 9) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f1, round(label_mean, 9) AS label_mean, round(judge_mean, 9) AS judge_mean FROM c, kg, kb""",
    "label_sheet": f"""
WITH base AS (SELECT doc_id, max(2 * quality + 1 - toxic) AS g FROM labels GROUP BY doc_id),
j AS (SELECT 'q' || (doc_id % 3) AS query_id, doc_id AS org_id, CASE WHEN doc_id % 4 = 0 THEN 3 - g ELSE g END AS grade, {_SAMPLE} AS o FROM base),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, grade ORDER BY o, org_id) AS n FROM j),
f AS (SELECT *, CAST(n <= CASE grade WHEN 3 THEN 5 WHEN 2 THEN 6 WHEN 1 THEN 6 WHEN 0 THEN 3 ELSE 0 END AS INT) AS first FROM r WHERE n <= 20),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, o, org_id) AS spot FROM f)
SELECT query_id, org_id, CAST(grade AS INT) AS grade, CAST(row_number() OVER (PARTITION BY query_id ORDER BY md5(CAST(org_id AS VARCHAR)), org_id) AS INT) AS place FROM p WHERE spot <= 20""",
    "eval_means": _with(SPEC_ROWS, RUNS, GRADES, _summarised()) + """
SELECT system, count(*) AS queries, round(avg(p_at_5), 4) AS p_at_5, round(avg(p_at_10), 4) AS p_at_10, round(avg(ndcg_at_10), 4) AS ndcg_at_10, round(avg(ndcg_at_20), 4) AS ndcg_at_20, round(avg(r_at_20), 4) AS r_at_20,
  round(avg(average_precision), 4) AS average_precision, round(avg(returned), 4) AS returned FROM summary GROUP BY system""",
    "query_allow_list": _with(SPEC_ROWS) + " SELECT query_id, 'some' AS asked FROM specs WHERE query_id IN ('s02', 's05') UNION ALL SELECT query_id, 'unknown' FROM specs",
    "stability_summary": _with(SPEC_ROWS, RUNS, "s AS (SELECT query_id, system, list(org_id) AS a, list(org_id) FILTER (WHERE pos <= 10) AS h FROM runs GROUP BY query_id, system)", "j AS (SELECT x.query_id, len(list_intersect(x.a, y.a))::DOUBLE / len(list_distinct(list_concat(x.a, y.a))) AS j, len(list_intersect(x.h, y.h))::DOUBLE / greatest(1, least(len(x.h), len(y.h))) AS o FROM s x JOIN s y ON x.query_id = y.query_id AND x.system < y.system)", "v AS (SELECT query_id, org_id, count(DISTINCT pos <= 5) + CASE WHEN count(DISTINCT system) < 2 THEN 1 ELSE 0 END AS verdicts FROM runs GROUP BY query_id, org_id)")
    + " SELECT query_id, round(any_value(j), 9) AS mean_jaccard, round(any_value(o), 9) AS mean_overlap, count(*) FILTER (WHERE verdicts > 1) AS unstable, count(*) FILTER (WHERE verdicts <= 1) AS stable FROM v JOIN j USING (query_id) GROUP BY query_id",
    "judge_pool": _with(COMPANIES, SPEC_ROWS, RUNS, "p AS (SELECT DISTINCT query_id, org_id FROM runs WHERE pos <= 20)", "l AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY md5('17:' || org_id), org_id) - 1) % 8 + 1 AS local_id FROM p)") + f" SELECT query_id, org_id, CAST(least(3, greatest(0, local_id - 3)) AS INT) AS grade, CAST(length({CARD}) AS VARCHAR) AS justification FROM l JOIN companies USING (org_id)",
    "result_rows": _with(*_to_short, JUDGED, RANKED, _marked) + """
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY spot) AS INTEGER) AS place, org_id, name, round(round(score, 9), 4) AS score, CASE WHEN kept_n = 0 THEN 'PARTIAL' ELSE verdict END AS verdict, round(round(confidence, 9), 3) AS confidence, round(round(fused, 9), 4) AS fused, escalated
FROM marked WHERE keep OR (kept_n = 0 AND spot <= 10)""",
    "hash_embedding": f"WITH c AS (SELECT doc_id, {_cells('substring(text, 1, 8000)')} AS c FROM documents) SELECT doc_id, CAST(len(list_filter(c, lambda x: x = 0)) - len(list_filter(c, lambda x: x = 64)) AS BIGINT) AS first, CAST(len(list_filter(c, lambda x: x = 63)) - len(list_filter(c, lambda x: x = 127)) AS BIGINT) AS last, CAST(2 * len(list_filter(c, lambda x: x < 64)) - len(c) AS BIGINT) AS total FROM c",
    "embed_ingest": "SELECT count(DISTINCT text) FILTER (WHERE doc_id % 2 = 1) AS hits, count(DISTINCT text) - count(DISTINCT text) FILTER (WHERE doc_id % 2 = 1) AS misses, count(*) AS rows, count(*) AS embedded FROM documents",
    "baseline_embedding": _with(SPEC_ROWS, f"q AS (SELECT query_id, {_cells('''array_to_string(keywords, ' ') || ' ' || role_statement''')} AS c FROM specs)", f"d AS (SELECT doc_id, {_cells('text')} AS c FROM documents)", f"qv AS (SELECT query_id, {_vector('c')} AS v FROM q)", f"dv AS (SELECT doc_id, {_vector('c')} AS v FROM d)", """
s AS (SELECT query_id, doc_id AS org_id, round(list_dot_product(qv.v, dv.v) / (greatest(sqrt(list_dot_product(qv.v, qv.v)), 1e-12) * greatest(sqrt(list_dot_product(dv.v, dv.v)), 1e-12)), 12) AS sim FROM qv, dv)""") + " SELECT query_id, org_id, pos FROM (SELECT query_id, org_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, org_id) AS INT) AS pos FROM s) WHERE pos <= 20",
    "exhaustive_baseline": _with(COMPANIES, SPEC_ROWS, "s AS (SELECT query_id, org_id, CASE WHEN org_id % 5 = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, (org_id % 120) / 100.0::DOUBLE) END AS score FROM companies, specs WHERE org_id % 3 = 0 AND org_id % 7 <> 0)") + " SELECT query_id, org_id, round(score, 9) AS score, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, org_id) AS INT) AS pos FROM s WHERE score > 0) WHERE pos <= 25",
    "dedupe_groups": _with(COMPANIES, f"""
g AS (
  SELECT org_id // 5 AS k, count(*) AS n, list_reduce(list(struct_pack(org_id := org_id, operational_name := operational_name, country_code := country_code, year_founded := year_founded, employee_count := employee_count, revenue := revenue, is_public := is_public, description := description) ORDER BY org_id),
    lambda a, x: CASE WHEN {_present("a")} >= {_present("x")} THEN {_filled("a", "x")} ELSE {_filled("x", "a")} END) AS m FROM companies GROUP BY org_id // 5
)""") + " SELECT m.org_id AS org_id, m.operational_name AS operational_name, m.country_code AS country_code, m.year_founded AS year_founded, m.employee_count AS employee_count, m.revenue AS revenue, m.is_public AS is_public, CAST(n - 1 AS INT) AS merged FROM g",
    "missing_verdicts": _with(SAID, """
m AS (SELECT 'g' || (org_id // 50) AS query_id, org_id, org_id % 50 AS rank0, tier, CASE WHEN tier = 'missing' THEN 'REJECTED' ELSE verdict END AS verdict, confidence, count(*) OVER (PARTITION BY org_id // 50) AS total FROM said)""") + """
SELECT query_id, org_id, CAST(pick AS INT) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(confidence - 0.5::DOUBLE), rank0) - 1 AS pick FROM m
  WHERE confidence BETWEEN 0.35::DOUBLE AND 0.72::DOUBLE OR verdict = 'PARTIAL' OR tier = 'error' OR (rank0 < greatest(1, total // 10) AND verdict = 'REJECTED') OR (rank0 > 0.6::DOUBLE * total AND verdict = 'QUALIFIED')
) WHERE pick < greatest(1, CAST(floor(total * 0.25::DOUBLE) AS BIGINT))""",
    "profile_scan": """
SELECT 'N' || c_custkey AS operational_name, 1900 + c_custkey % 100 AS year_founded, CASE WHEN c_custkey % 2 = 0 THEN 'ro' ELSE 'gb' END AS country_code, CASE WHEN c_custkey % 2 = 1 THEN 'T' END AS town,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS employee_count, CASE WHEN c_custkey % 4 <> 0 THEN 4500.0::DOUBLE END AS revenue, 'd' || c_custkey AS description,
  CASE WHEN c_custkey % 5 = 0 THEN 'solo' ELSE 'a|b' END AS business_model, CASE WHEN c_custkey % 6 = 0 THEN TRUE END AS is_public FROM customer""",
    "label_scan": "SELECT 'q' || (doc_id % 3) AS query_id, 'c' || doc_id AS company, quality AS grade, CAST(NULL AS VARCHAR) AS note FROM labels WHERE doc_id % 10 > 1",
    "json_sink": "SELECT 'q' || (p_partkey % 4) AS query_id, CAST(p_partkey // 4 AS INT) AS place, p_partkey AS org_id, p_name AS name, round(p_partkey / 7.0::DOUBLE, 4) AS score, 'PARTIAL' AS verdict, round(p_partkey / 11.0::DOUBLE, 3) AS confidence, round(p_partkey / 13.0::DOUBLE, 4) AS fused, CASE WHEN p_partkey % 2 = 0 THEN 'r' END AS reason, 'revenue' AS unknown FROM part",
    "stream_refresh": "SELECT count(DISTINCT text) AS texts, count(DISTINCT text) AS rows, CAST(0 AS BIGINT) AS added FROM documents",
}
