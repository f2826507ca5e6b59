"""Adjudication in batches through a pluggable function, and a capped second opinion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.config import Config

VERDICTS = ("QUALIFIED", "PARTIAL", "REJECTED")


def batches(shortlisted: DataFrame, size: int) -> DataFrame:
    """Consecutive chunks of a query's shortlist: batch and local_id (from 1)."""
    return shortlisted.withColumn("batch", F.floor(F.col("rank0") / size)).withColumn("local_id", (F.col("rank0") % size + 1).cast("int"))


def rule_verdict(hits: Column, need: Column, matched: Column, escalated: bool = False) -> tuple[Column, Column]:
    """Verdict and confidence (in hundredths) of the built-in adjudicator, in integers.

    hits of need distinct keywords occur; matched is the length of the longest code prefix. The second tier asks for more.
    """
    if escalated:
        full = (matched >= 5) | ((need > 0) & (3 * hits >= 2 * need))
    else:
        full = (matched >= 4) | ((need > 0) & (2 * hits >= need))
    verdict = F.when(full & (need > 0), "QUALIFIED").when((matched >= 2) | (hits >= 1), "PARTIAL").otherwise("REJECTED")
    sure = F.least(F.lit(100), 40 + 10 * matched + F.floor(40 * hits / F.greatest(need, F.lit(1)))).cast("int")
    return verdict, F.when(verdict == "REJECTED", 100 - sure).otherwise(sure)


def keyword_hits(shortlisted: DataFrame, index: DataFrame, specs: DataFrame) -> DataFrame:
    """shortlisted with hits and need: distinct keywords of the query found in the document, and asked for."""
    words = specs.select("query_id", F.explode(F.array_distinct("keywords")).alias("term"))
    asked = words.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    found = index.select("org_id", "term").join(F.broadcast(words), "term").join(shortlisted.select("query_id", "org_id"), ["query_id", "org_id"], "left_semi")
    hits = found.groupBy("query_id", "org_id").agg(F.count(F.lit(1)).alias("hits"))
    return shortlisted.join(F.broadcast(asked), "query_id", "left").join(hits, ["query_id", "org_id"], "left").fillna(0, ["need", "hits"])


def adjudicate_by_rules(candidates: DataFrame, config: Config = Config()) -> DataFrame:
    """candidates(hits, need, matched, rank0) with batch, local_id, verdict, confidence (0 to 1), tier."""
    verdict, sure = rule_verdict(F.col("hits"), F.col("need"), F.col("matched"))
    return batches(candidates, config.qualify_batch).withColumn("verdict", verdict).withColumn("confidence", sure / 100).withColumn("tier", F.lit("rules"))


def adjudicate(candidates: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], size: int, tier: str) -> DataFrame:
    """query_id, org_id, verdict, confidence, reason, tier, met by a function of one batch of rows.

    The function returns local_id, verdict, confidence, reason and, if it likes, met (a dict: criterion -> whether it is met). Ids out of range are dropped, unknown verdicts count as
    REJECTED, confidences are clamped, and a batch that fails becomes PARTIAL with confidence 0 and the tier "error".
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            got = judge(pdf).drop_duplicates("local_id", keep="last")
            out = pdf[["query_id", "org_id", "local_id"]].merge(got, on="local_id")
            verdict = out["verdict"].astype(str).str.upper()
            out["verdict"] = verdict.where(verdict.isin(VERDICTS), "REJECTED")
            out["confidence"] = pd.to_numeric(out["confidence"], errors="coerce").fillna(0.0).clip(0, 1)
            out["reason"], out["tier"] = out["reason"].astype(str).str.strip(), tier
            out["met"] = out["met"] if "met" in out else None
        except Exception as e:  # noqa: BLE001  one failed batch must not end the run
            out = pdf[["query_id", "org_id"]].assign(verdict="PARTIAL", confidence=0.0, reason=f"adjudication failed: {type(e).__name__}", tier="error", met=None)
        return out[["query_id", "org_id", "verdict", "confidence", "reason", "tier", "met"]]

    return batches(candidates, size).groupBy("query_id", "batch").applyInPandas(run, "query_id string, org_id long, verdict string, confidence double, reason string, tier string, met map<string,boolean>")


def first_opinion() -> tuple[Column, Column]:
    missing = F.col("tier") == "missing"
    return F.when(missing, "REJECTED").otherwise(F.col("verdict")), F.when(missing, 0.0).otherwise(F.col("confidence"))


def needs_escalation(config: Config = Config()) -> Column:
    """On rows with verdict, confidence, tier, unknown, rank0 and total (candidates of the query).

    A row that got no verdict counts as rejected with confidence 0 here.
    """
    verdict, confidence = first_opinion()
    rejected, qualified = verdict == "REJECTED", verdict == "QUALIFIED"
    unsure = confidence.between(config.escalate_low, config.escalate_high) | (verdict == "PARTIAL") | (F.col("tier") == "error")
    head = (F.col("rank0") < F.greatest(F.lit(1), F.floor(F.col("total") / 10))) & rejected
    tail = (F.col("rank0") > 0.6 * F.col("total")) & qualified
    return unsure | head | tail | ((F.size("unknown") > 0) & ~rejected)


def escalation_pick(judged: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of each query that get a second opinion: the least sure first, at most a share of its candidates (one at least).

    A shortlist has at most config.max_shortlist rows, so a query's window is small.
    """
    counted = judged.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    order = Window.partitionBy("query_id").orderBy(F.abs(first_opinion()[1] - 0.5), "rank0")
    flagged = counted.where(needs_escalation(config)).withColumn("pick", F.row_number().over(order) - 1)
    return flagged.where(F.col("pick") < F.greatest(F.lit(1), F.floor(F.col("total") * config.escalate_share)))


def escalate(judged: DataFrame, second: DataFrame) -> DataFrame:
    """judged with what second(query_id, org_id, verdict, confidence, tier, and reason and met if it has them) says in its place,
    errors aside; escalated tells. A second opinion is taken whole: a reason or criteria that it lacks are not those of the first."""
    said = ["verdict", "confidence", "tier", *(c for c in ("reason", "met") if c in second.columns and c in judged.columns)]
    new = second.where("tier <> 'error'").select("query_id", "org_id", F.struct(*said).alias("_new"))
    met = judged.join(new, ["query_id", "org_id"], "left").withColumn("escalated", F.col("_new").isNotNull())
    for c in ("reason", "met"):
        if c in said:
            met = met.withColumn(c, F.when(F.col("escalated"), F.col(f"_new.{c}")).otherwise(F.col(c)))
    for c in ("verdict", "confidence", "tier"):
        met = met.withColumn(c, F.coalesce(F.col(f"_new.{c}"), F.col(c)))
    return met.drop("_new")


def second_opinion_by_rules(picked: DataFrame) -> DataFrame:
    verdict, sure = rule_verdict(F.col("hits"), F.col("need"), F.col("matched"), escalated=True)
    return picked.select("query_id", "org_id", verdict.alias("verdict"), (sure / 100).alias("confidence"), F.lit("rules-2").alias("tier"), F.lit("rules-2").alias("reason"))


def remote(fetch: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], rows: DataFrame, schema: str) -> DataFrame:
    """Rows through an external service, in Arrow batches; the caller's function owns its rate limit and retries."""
    return rows.mapInPandas(fetch, schema)
