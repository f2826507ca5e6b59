"""Query text to a structured plan, without a model: patterns for numbers, a table for places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import geo

#: Words that are no keywords (fixed values).
STOPWORDS = (
    "a an and are as at be by for in is of on or that the to with companies company business firms firm that which who "
    "providing provides provide more than over under fewer less least most using used use"
).split()
# How constraints are written.
EMPLOYEES_MIN = r"(?:more than|over|at least|above|>)\s*([\d,]+)\s*(?:\+)?\s*employees"
EMPLOYEES_MAX = r"(?:fewer than|less than|under|below|<)\s*([\d,]+)\s*employees"
REVENUE_MIN = (
    r"revenue[^.]{0,24}?(?:over|above|more than|exceeding|>)\s*\$?\s*([\d.,]+)\s*(billion|million|thousand|bn|m|k)?",
    r"(?:over|above|more than)\s*\$\s*([\d.,]+)\s*(billion|million|thousand|bn|m|k)?",
)
FOUNDED_AFTER = r"(?:founded|established|started)\s*(?:after|since|in or after)\s*(\d{4})"
FOUNDED_BEFORE = r"(?:founded|established)\s*(?:before|prior to)\s*(\d{4})"
PUBLIC, PRIVATE = r"\bpublic(?:ly)?(?:\straded)?\b", r"\bprivate(?:ly held)?\b"
# Classes of requests, and how many keywords a plan without a model has.
COMPLEXITIES = ("STRUCTURED", "SEMANTIC", "REASONING")
KEYWORDS = 15


def _number(low: Column, *patterns: str) -> Column:
    found = []
    for p in patterns:
        value = F.regexp_replace(F.regexp_extract(low, p, 1), ",", "").try_cast("double")
        if "billion" in p:
            unit = F.substring(F.regexp_extract(low, p, 2), 1, 1)
            value = value * F.when(unit == "b", 1e9).when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0)
        found.append(value)
    return F.coalesce(*found)


def heuristic_specs(queries: DataFrame) -> DataFrame:
    """queries(query_id, text) as specs, one projection and one join with the table of places.

    "At least N" and "since Y" read like "more than N" and "after Y", and "thousand" is not scaled: known quirks of the
    published rules, kept so that plans agree with them.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    places = geo.scan_text(queries, "query_id", "text")
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9-]{3,}"), F.lit(0)), lambda w: ~w.isin(STOPWORDS))
    none = F.lit(None).cast("double")
    specs = queries.select(
        "query_id",
        "text",
        F.lit("SEMANTIC").alias("complexity"),
        (_number(low, EMPLOYEES_MIN) + 1).alias("employees_min"),
        (_number(low, EMPLOYEES_MAX) - 1).alias("employees_max"),
        _number(low, *REVENUE_MIN).alias("revenue_min"),
        none.alias("revenue_max"),
        (_number(low, FOUNDED_AFTER) + 1).alias("founded_min"),
        (_number(low, FOUNDED_BEFORE) - 1).alias("founded_max"),
        F.when(low.rlike(PUBLIC), True).when(low.rlike(PRIVATE), False).alias("want_public"),
        F.slice(words, 1, KEYWORDS).alias("keywords"),
        F.col("text").alias("role_statement"),
        F.col("text").alias("ideal_profile"),
        F.array().cast("array<string>").alias("prefixes"),
    )
    return specs.join(places.select("query_id", F.col("phrase").alias("country_phrase"), F.col("codes").alias("countries")), "query_id")


PLAN = "complexity string, intent_summary string, role_statement string, ideal_profile string, geography array<string>, employee_min string, employee_max string, revenue_min_usd string, revenue_max_usd string, founded_after string, founded_before string, is_public string, naics_prefixes array<string>, keywords array<string>, disqualifiers array<string>, criteria array<struct<name: string, description: string, weight: string, must_have: boolean>>"


def build_specs(plans: DataFrame) -> DataFrame:
    """plans(query_id, text, plan as JSON) as specs: what does not parse is null, a place in the text rescues a missing one.

    Unknown complexities become SEMANTIC, prefixes that are no digits go, criteria without a readable weight go.
    """
    parsed = plans.select("query_id", "text", F.from_json("plan", PLAN).alias("p"))
    tokens = parsed.select("query_id", F.explode_outer("p.geography").alias("token"))
    named = geo.resolve(tokens).groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("resolved")))).alias("_named"))
    scanned = geo.scan_text(plans, "query_id", "text")
    met = parsed.join(named, "query_id").join(scanned.withColumnRenamed("codes", "_scanned"), "query_id")
    number = lambda c: F.col(f"p.{c}").try_cast("double")
    none = F.array().cast("array<string>")
    texts = lambda c: F.filter(F.transform(F.coalesce(c, none), lambda x: F.trim(x)), lambda x: x != "")
    complexity = F.upper("p.complexity")
    rescued = F.size("_named") == 0
    weighted = F.transform(F.filter("p.criteria", lambda c: c["weight"].isNull() | c["weight"].try_cast("double").isNotNull()), lambda c: F.struct(F.coalesce(F.nullif(F.trim(c["name"]), F.lit("")), F.lit("criterion")).alias("name"), F.coalesce(c["weight"].try_cast("double"), F.lit(1.0)).alias("weight"), F.coalesce(c["must_have"], F.lit(False)).alias("must_have"), F.trim(c["description"]).alias("description")))
    return met.select(
        "query_id",
        "text",
        F.when(complexity.isin(*COMPLEXITIES), complexity).otherwise("SEMANTIC").alias("complexity"),
        *[number(a).alias(b) for a, b in (("employee_min", "employees_min"), ("employee_max", "employees_max"), ("revenue_min_usd", "revenue_min"), ("revenue_max_usd", "revenue_max"), ("founded_after", "founded_min"), ("founded_before", "founded_max"))],
        F.when(F.col("p.is_public") == "true", True).when(F.col("p.is_public") == "false", False).alias("want_public"),
        texts(F.col("p.keywords")).alias("keywords"),
        F.trim(F.coalesce("p.role_statement", F.lit(""))).alias("role_statement"),
        F.trim(F.coalesce("p.ideal_profile", F.lit(""))).alias("ideal_profile"),
        F.filter(texts(F.col("p.naics_prefixes")), lambda x: x.rlike("^[0-9]+$")).alias("prefixes"),
        F.coalesce(weighted, F.array().cast("array<struct<name:string,weight:double,must_have:boolean,description:string>>")).alias("criteria"),
        texts(F.col("p.disqualifiers")).alias("disqualifiers"),
        F.when(rescued, F.col("phrase")).otherwise(F.array_join("p.geography", ", ")).alias("country_phrase"),
        F.when(rescued, F.col("_scanned")).otherwise(F.col("_named")).alias("countries"),
    )


def plan_queries(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Specs of queries(query_id, text) from a planner's answers(query_id, answer): a query whose answer is missing or holds no
    JSON object gets the plan that needs no model, so one failed call never costs a query. planned_by tells which."""
    from quernstone.operators.verdicts import salvaged

    plans = queries.select("query_id", "text").join(answers.select("query_id", salvaged(F.col("answer")).alias("plan")), "query_id", "left")
    built = build_specs(plans.where("plan IS NOT NULL")).withColumn("planned_by", F.lit("model"))
    rules = heuristic_specs(plans.where("plan IS NULL").select("query_id", "text")).withColumn("planned_by", F.lit("rules"))
    return built.unionByName(rules, allowMissingColumns=True)
