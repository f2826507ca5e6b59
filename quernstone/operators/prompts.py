"""Prompts of the two tiers, the judge and the planner, as columns: the part that all companies of a request share, and the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators.filters import RANGES, has_hard_constraints
from quernstone.operators.qualify import batches

#: What a verdict or a grade means; the model reads it, nothing parses it.
VERDICT_RULES = """VERDICTS
QUALIFIED: the record shows that the company plays the wanted role and meets every must-have.
PARTIAL: it may fit, but the record leaves the role or a must-have open.
REJECTED: it plays another role, or the record contradicts a must-have.
Judge each company by itself and by its record alone. Give id, verdict, confidence from 0 to 1, a reason of one sentence,
criteria_met and criteria_failed for every company, as JSON under "results"."""
OPEN_RULE = "If the record is too thin to tell, answer PARTIAL with a low confidence."
UNKNOWN_RULE = "A field that is unknown is no failure: infer it from the rest where that is possible, else answer PARTIAL."
GRADE_RULES = """GRADES
3: just what was asked for, every stated constraint holds. 2: fits, with one point that the record cannot prove.
1: near the topic only, or it contradicts a stated constraint. 0: something else.
Give id, grade and a justification of at most 20 words for every company, as JSON under "grades"."""

_OPTIONAL = {
    "text": "string",
    "intent_summary": "string",
    "country_phrase": "string",
    "criteria": "array<struct<name:string,weight:double,must_have:boolean,description:string>>",
    "disqualifiers": "array<string>",
}


def complete(specs: DataFrame) -> DataFrame:
    """specs with the columns that a plan without a model lacks, as nulls."""
    return specs.withColumns({c: F.lit(None).cast(kind) for c, kind in _OPTIONAL.items() if c not in specs.columns})


def _listed(title: str, rows: Column) -> Column:
    return F.when(F.size(rows) > 0, F.concat(F.lit(title + "\n"), F.array_join(rows, "\n")))


def header() -> Column:
    """On a row of ``complete`` specs: what all batches of a request share; absent parts vanish."""
    ranges = {"employee_count": "employees ", "revenue": "revenue USD ", "year_founded": "founded "}
    hard = [F.when(F.size("countries") > 0, F.concat(F.lit("located in "), F.coalesce(text.present(F.col("country_phrase")), F.array_join("countries", ", "))))]
    for name, label in ranges.items():
        low, high = (F.col(f"{RANGES[name]}_{end}") for end in ("min", "max"))
        hard.append(F.when(low.isNotNull() | high.isNotNull(), F.concat(F.lit(label), text.describe_range(low, high))))
    hard.append(F.when(F.col("want_public"), "publicly traded").when(~F.col("want_public"), "privately held"))
    must = F.array_join(F.array_compact(F.array(*hard)), "; ")
    criterion = lambda c: F.concat(F.lit("- "), c["name"], F.when(c["must_have"], " [must-have, weight ").otherwise(" [nice-to-have, weight "), F.format_number(c["weight"], 2), F.lit("]: "), F.coalesce(c["description"], F.lit("")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("REQUEST: "), F.coalesce("text", F.array_join("keywords", " "))),
        F.concat(F.lit("INTENT: "), text.present(F.col("intent_summary"))),
        F.concat(F.lit("WANTED ROLE: "), text.present(F.col("role_statement"))),
        F.when(must != "", F.concat(F.lit("REQUIREMENTS (filtered already; look again only where a field is unknown): "), must)),
        _listed("CRITERIA:", F.transform("criteria", criterion)),
        _listed("NOT TO BE TAKEN FOR A MATCH:", F.transform("disqualifiers", lambda d: F.concat(F.lit("- "), d))),
    )


def unknown_rule() -> Column:
    return F.when(has_hard_constraints(), UNKNOWN_RULE).otherwise(OPEN_RULE)


def _records(rows: DataFrame, size: int) -> DataFrame:
    """rows(query_id, rank0, org_id, card, unknown) as query_id, batch, records; a batch has size records at most."""
    note = F.when(F.size("unknown") > 0, F.concat(F.lit("\n[not in the data: "), F.array_join("unknown", ", "), F.lit("]"))).otherwise("")
    block = F.concat(F.lit("--- id "), F.col("local_id").cast("string"), F.lit(" ---\n"), F.col("card"), note)
    dealt = batches(rows, size).select("query_id", "batch", F.struct("local_id", block.alias("block")).alias("_b"))
    grouped = dealt.groupBy("query_id", "batch").agg(F.array_sort(F.collect_list("_b")).alias("_bs"))
    return grouped.select("query_id", "batch", F.array_join(F.transform("_bs", lambda b: b["block"]), "\n\n").alias("records"))


def verdict_prompts(rows: DataFrame, specs: DataFrame, size: int) -> DataFrame:
    """query_id, batch, prompt for shortlisted rows(query_id, rank0, org_id, card, unknown)."""
    shared = complete(specs).select("query_id", header().alias("_head"), unknown_rule().alias("_rule"))
    met = _records(rows, size).join(F.broadcast(shared), "query_id")
    return met.select("query_id", "batch", F.concat_ws("\n\n", "_head", F.lit(VERDICT_RULES), "_rule", F.lit("COMPANIES"), "records").alias("prompt"))


def grade_prompts(rows: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """query_id, batch, prompt of the judge, who sees the request and the records only: neither plan nor system nor verdict."""
    met = _records(rows.withColumn("unknown", F.array().cast("array<string>")), size).join(F.broadcast(queries.select("query_id", "text")), "query_id")
    return met.select("query_id", "batch", F.concat_ws("\n\n", F.concat(F.lit("REQUEST: "), F.col("text")), F.lit(GRADE_RULES), F.lit("COMPANIES"), "records").alias("prompt"))


def match_prompt(query: Column, card: Column) -> Column:
    """One company, one request."""
    return F.concat_ws("\n\n", F.lit("Does this company match the request? Answer with match, confidence from 0 to 1 and reason, as JSON."), F.concat(F.lit("REQUEST: "), query), card)


def plan_prompt(query: Column) -> Column:
    fields = "complexity, intent_summary, role_statement, ideal_profile, geography, employee_min, employee_max, revenue_min_usd, revenue_max_usd, founded_after, founded_before, is_public, naics_prefixes, keywords, disqualifiers, criteria (name, description, weight, must_have)"
    return F.concat(F.lit("Plan a search for companies. Answer as JSON with "), F.lit(fields), F.lit(".\nToday is "), F.current_date().cast("string"), F.lit(".\nREQUEST: "), query)
