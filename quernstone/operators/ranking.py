"""Banded scores: the verdict sets the band, everything else orders within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.config import Config

#: Floor and span of each verdict's band, and the weights of a place within it (fixed values).
BANDS = {"QUALIFIED": (0.60, 0.40), "PARTIAL": (0.25, 0.30), "REJECTED": (0.00, 0.20)}
W_CONFIDENCE, W_RETRIEVAL, W_CRITERIA, ESCALATED_BONUS = 0.55, 0.30, 0.15, 0.03


def criteria_satisfaction(met: Column, criteria: Column) -> Column:
    """Share of the rubric's weight that was met; null without criteria, reports or weight.

    met is map<name, boolean>; criteria is array<struct<name, weight>>; names compare without case, an unknown one weighs 0.5.
    """
    by_name = F.map_from_entries(F.transform(criteria, lambda c: F.struct(F.lower(c["name"]), c["weight"])))
    weight = lambda name: F.coalesce(F.element_at(by_name, F.lower(name)), F.lit(0.5))
    sums = F.aggregate(
        F.map_entries(met),
        F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("met")),
        lambda acc, e: F.struct((acc["all"] + weight(e["key"])).alias("all"), (acc["met"] + F.when(e["value"], weight(e["key"])).otherwise(0.0)).alias("met")),
    )
    asked = (F.size(criteria) > 0) & (F.size(met) > 0)
    return F.when(asked & (sums["all"] > 0), sums["met"] / sums["all"])


def with_satisfaction(judged: DataFrame, specs: DataFrame) -> DataFrame:
    """judged with satisfaction from its met, by the criteria of specs (a stated set); null where either is lacking."""
    if "met" not in judged.columns or "criteria" not in specs.columns:
        return judged.withColumn("satisfaction", F.lit(None).cast("double"))
    rubric = specs.select("query_id", F.transform("criteria", lambda c: F.struct(c["name"].alias("name"), c["weight"].alias("weight"))).alias("_criteria"))
    met = judged.join(F.broadcast(rubric), "query_id", "left")
    return met.withColumn("satisfaction", criteria_satisfaction(F.col("met"), F.col("_criteria"))).drop("_criteria")


def score(norm: Column, satisfaction: Column, config: Config = Config()) -> Column:
    """On rows with verdict, confidence, unknown, escalated."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    rejected = F.col("verdict") == "REJECTED"
    sure = F.when(rejected, 1 - F.col("confidence")).otherwise(F.col("confidence"))
    place = W_CONFIDENCE * sure + W_RETRIEVAL * clamp(norm) + W_CRITERIA * F.coalesce(satisfaction, F.lit(0.5))
    place = place - config.unknown_penalty * F.size("unknown") + F.when(F.col("escalated") & ~rejected, ESCALATED_BONUS).otherwise(0.0)
    floor, span = (F.coalesce(*[F.when(F.col("verdict") == v, F.lit(b[k])) for v, b in BANDS.items()]) for k in (0, 1))
    return floor + span * clamp(place)


def with_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """candidates with verdict, confidence, reason, tier, escalated; one that got no verdict is PARTIAL at 0, tier "missing"."""
    more = ["met"] if "met" in verdicts.columns else []
    got = candidates.join(verdicts.select("query_id", "org_id", "verdict", "confidence", "reason", "tier", "escalated", *more), ["query_id", "org_id"], "left")
    missing = {"verdict": F.lit("PARTIAL"), "confidence": F.lit(0.0), "reason": F.lit("no verdict returned"), "tier": F.lit("missing"), "escalated": F.lit(False)}
    return got.withColumns({c: F.coalesce(F.col(c), default) for c, default in missing.items()})


def rank(judged: DataFrame, config: Config = Config(), include_rejected: bool = False) -> DataFrame:
    """judged(query_id, org_id, name, fused, verdict, confidence, unknown, escalated, tier, satisfaction) with score and place (from 1).

    Rows under config.min_score and rejected ones go, unless asked for. A query that would keep none gets its first
    config.fallback rows, relabelled PARTIAL, with their scores as they are. Windows are over shortlists only.
    """
    query = Window.partitionBy("query_id")
    spread = F.max("fused").over(query) - F.min("fused").over(query)
    norm = (F.col("fused") - F.min("fused").over(query)) / F.when(spread == 0, 1.0).otherwise(spread)
    scored = judged.withColumn("_norm", norm).withColumn("score", score(F.col("_norm"), F.col("satisfaction"), config)).drop("_norm")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.lower("name"), "rank0", "org_id")
    if include_rejected:
        return scored.withColumn("place", F.row_number().over(order))
    keep = (F.col("score") >= config.min_score) & (F.col("verdict") != "REJECTED")
    marked = scored.withColumn("_keep", keep).withColumn("_kept", F.count_if("_keep").over(query)).withColumn("_at", F.row_number().over(order))
    fallback = (F.col("_kept") == 0) & (F.col("_at") <= config.fallback)
    out = marked.where(F.col("_keep") | fallback).withColumn("fallback", F.col("_kept") == 0)
    out = out.withColumn("verdict", F.when(F.col("fallback"), "PARTIAL").otherwise(F.col("verdict"))).withColumn("tier", F.when(F.col("fallback"), F.concat("tier", F.lit("+fallback"))).otherwise(F.col("tier")))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_at"))).drop("_keep", "_kept", "_at")
