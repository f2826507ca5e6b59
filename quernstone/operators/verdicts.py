"""What a model answers, as text, to rows: verdicts, grades and matches. Nothing here raises on a malformed answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.qualify import VERDICTS


def salvaged(answer: Column) -> Column:
    """The JSON object of an answer: all of it, else what stands from its first to its last brace; null if neither parses."""
    whole = F.trim(answer)
    parsed = lambda c: F.when(c.startswith("{"), F.get_json_object(c, "$"))
    return F.coalesce(parsed(whole), parsed(F.regexp_extract(whole, r"(?s)\{.*\}", 0)))


def items(answers: DataFrame, name: str) -> DataFrame:
    """answers(query_id, batch, answer) as query_id, batch, local_id, item (JSON), one row per readable id; of equal ids the last counts."""
    listed = F.from_json(salvaged(F.col("answer")), f"{name} array<string>")[name]
    rows = answers.select("query_id", "batch", F.posexplode(listed).alias("_pos", "item"))
    rows = rows.withColumn("local_id", F.get_json_object("item", "$.id").try_cast("double").try_cast("int")).where("local_id IS NOT NULL")
    return rows.groupBy("query_id", "batch", "local_id").agg(F.max_by("item", "_pos").alias("item"))


def _field(name: str) -> Column:
    return F.get_json_object("item", f"$.{name}")


def _names(name: str) -> Column:
    texts = F.coalesce(F.from_json(_field(name), "array<string>"), F.array().cast("array<string>"))
    return F.array_compact(texts)


def criteria_map(met: Column, failed: Column, criteria: Column) -> Column:
    """name -> met; a name in both failed. Names that are no criterion of the request count only where it has none."""
    known = F.transform(criteria, lambda c: F.lower(c["name"]))
    counts = lambda n: F.coalesce(F.size(criteria) <= 0, F.lit(True)) | F.array_contains(known, F.lower(n))
    every = F.filter(F.array_union(met, failed), counts)
    return F.map_from_arrays(every, F.transform(every, lambda n: ~F.array_contains(failed, n)))


def parse_verdicts(answers: DataFrame, members: DataFrame, specs: DataFrame, tier: str) -> DataFrame:
    """members(query_id, batch, local_id, org_id) that got a verdict: query_id, org_id, verdict, confidence, reason, met, tier.

    answers(query_id, batch, answer): a batch without a readable answer makes its members PARTIAL with confidence 0 and the tier
    "error". Ids out of range vanish, unknown verdicts count as REJECTED, confidences are clamped, unreadable ones are 0.
    specs(query_id, criteria) are those of a run, stated by the caller.
    """
    asked = members.join(answers.select("query_id", "batch", salvaged(F.col("answer")).isNotNull().alias("_read")), ["query_id", "batch"])
    met = asked.join(items(answers, "results"), ["query_id", "batch", "local_id"], "left").join(F.broadcast(specs.select("query_id", "criteria")), "query_id", "left")
    verdict = F.upper(F.coalesce(_field("verdict"), F.lit("REJECTED")))
    confidence = F.coalesce(_field("confidence").try_cast("double"), F.lit(0.0))
    failed = ~F.col("_read")
    none = F.create_map().cast("map<string,boolean>")
    return met.where(failed | F.col("item").isNotNull()).select(
        "query_id",
        "org_id",
        F.when(failed, "PARTIAL").when(verdict.isin(*VERDICTS), verdict).otherwise("REJECTED").alias("verdict"),
        F.when(failed, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))).alias("confidence"),
        F.when(failed, "not adjudicated").otherwise(F.trim(F.coalesce(_field("reason"), F.lit("")))).alias("reason"),
        F.when(failed, none).otherwise(criteria_map(_names("criteria_met"), _names("criteria_failed"), F.col("criteria"))).alias("met"),
        F.when(failed, "error").otherwise(tier).alias("tier"),
    )


def parse_grades(answers: DataFrame, members: DataFrame) -> DataFrame:
    """query_id, org_id, grade (0 to 3), justification of the members that were graded; unreadable grades are left out."""
    grade = F.coalesce(_field("grade"), F.lit("0")).try_cast("double").try_cast("int")
    met = members.join(items(answers, "grades"), ["query_id", "batch", "local_id"]).withColumn("_grade", grade).where("_grade IS NOT NULL")
    return met.select("query_id", "org_id", F.least(F.lit(3), F.greatest(F.lit(0), F.col("_grade"))).alias("grade"), F.trim(F.coalesce(_field("justification"), F.lit(""))).alias("justification"))


def parse_matches(answers: DataFrame) -> DataFrame:
    """answers(query_id, org_id, answer) with score (match times confidence, 0.5 without one; 0 if unreadable) and reason."""
    item = salvaged(F.col("answer"))
    confidence = F.coalesce(F.get_json_object(item, "$.confidence").try_cast("double"), F.lit(0.5))
    match = F.coalesce(F.get_json_object(item, "$.match") == "true", F.lit(False))
    score = F.when(match, F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))).otherwise(0.0)
    return answers.select("query_id", "org_id", score.alias("score"), F.coalesce(F.get_json_object(item, "$.reason"), F.lit("")).alias("reason"))
