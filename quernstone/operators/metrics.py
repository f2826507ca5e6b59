"""Graded retrieval metrics, agreement and stability, as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.windows import top
from quernstone.plans.scratch import written

RELEVANT = 2


def gain(grade: Column, pos: Column) -> Column:
    """(2^grade - 1) / log2(pos + 1), pos from 1."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(pos + F.lit(1.0))


def graded(runs: DataFrame, grades: DataFrame) -> DataFrame:
    """runs(query_id, system, org_id, pos from 1) with grade; ungraded rows count as 0."""
    return runs.join(grades.select("query_id", "org_id", "grade"), ["query_id", "org_id"], "left").fillna(0, ["grade"])


def summarise(runs: DataFrame, grades: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Per query and system: P@k, R@k, nDCG@k, average precision, returned, found and relevant in the pool.

    P@k divides by min(k, returned); R@k by what the pool of the query holds; average precision by the hits found. A running
    window counts a system's hits along its own list, which is as long as a shortlist.
    """
    rows = graded(runs, grades).withColumn("rel", (F.col("grade") >= RELEVANT).cast("int"))
    along = Window.partitionBy("query_id", "system").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_hits", F.sum("rel").over(along))
    # Of a pool only the best max(ks) are ranked; how many are relevant is a plain count.
    best = top(grades.select("query_id", "org_id", "grade"), "query_id", [F.desc("grade"), F.col("org_id")], max(ks), "_i").withColumn("_i", F.col("_i") + 1)
    ideal = best.groupBy("query_id").agg(*[F.sum(F.when(F.col("_i") <= k, gain(F.col("grade"), F.col("_i")))).alias(f"_ideal_{k}") for k in ks])
    pool = grades.groupBy("query_id").agg(F.count_if(F.col("grade") >= RELEVANT).alias("in_pool")).join(ideal, "query_id")
    sums = [F.sum(F.when(F.col("pos") <= k, F.col("rel")).otherwise(0)).alias(f"_rel_{k}") for k in ks]
    sums += [F.sum(F.when(F.col("pos") <= k, gain(F.col("grade"), F.col("pos"))).otherwise(0.0)).alias(f"_dcg_{k}") for k in ks]
    per = rows.groupBy("query_id", "system").agg(F.count(F.lit(1)).alias("returned"), F.sum("rel").alias("found"), F.coalesce(F.avg(F.when(F.col("rel") == 1, F.col("_hits") / F.col("pos"))), F.lit(0.0)).alias("average_precision"), *sums)
    per = per.join(pool, "query_id", "left").fillna(0)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    columns = [c for k in ks for c in (safe(F.col(f"_rel_{k}"), F.least(F.lit(k), F.col("returned"))).alias(f"p_at_{k}"), safe(F.col(f"_rel_{k}"), F.col("in_pool")).alias(f"r_at_{k}"), safe(F.col(f"_dcg_{k}"), F.col(f"_ideal_{k}")).alias(f"ndcg_at_{k}"))]
    return per.select("query_id", "system", *columns, "average_precision", "returned", "found", "in_pool")


def means(summary: DataFrame) -> DataFrame:
    """Means over the queries of each system, rounded to 4 places; queries without a graded row are left out before."""
    figures = [c for c in summary.columns if c not in ("query_id", "system")]
    return summary.groupBy("system").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in figures])


def kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: n, observed, expected, kappa. (po - pe) / (1 - pe); where pe is 1, 1 if all agree and 0 else; null if empty."""
    totals = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    left = pairs.groupBy(F.col(a).alias("label")).agg(F.count(F.lit(1)).alias("x"))
    right = pairs.groupBy(F.col(b).alias("label")).agg(F.count(F.lit(1)).alias("y"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    n2 = F.col("n") * F.col("n")
    value = F.when(F.col("n") == 0, F.lit(None)).when(F.col("xy") >= n2, (F.col("same") == F.col("n")).cast("double")).otherwise((F.col("same") * F.col("n") - F.col("xy")) / (n2 - F.col("xy")))
    return totals.crossJoin(chance).select("n", (F.col("same") / F.when(F.col("n") > 0, F.col("n"))).alias("observed"), (F.col("xy") / F.when(n2 > 0, n2)).alias("expected"), value.alias("kappa"))


def binary_scores(pairs: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; a ratio without a denominator is 0."""
    counts = pairs.agg(F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def agreement(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """n, shares that agree exactly and within one, and both raters' means; 0 if empty."""
    apart = F.abs(F.col(a) - F.col(b))
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return pairs.agg(F.count(F.lit(1)).alias("n"), share((apart == 0).cast("int")).alias("exact"), share((apart <= 1).cast("int")).alias("within_one"), share(F.col(a)).alias("mean_a"), share(F.col(b)).alias("mean_b"))


def run_pairs(lists: DataFrame, depth: int = 10) -> DataFrame:
    """lists(query_id, run, org_id, pos from 1): for each pair of runs, jaccard of all and overlap of the first `depth`.

    Two empty lists have a jaccard of 1; overlap divides by the shorter head, at least 1. A run's list is a returned list.
    The sets are written: of a union of lists, Spark would plan the two sides of their join with unequal partitions, and fail.
    """
    sets = lists.groupBy("query_id", "run").agg(F.collect_set("org_id").alias("all"), F.collect_set(F.when(F.col("pos") <= depth, F.col("org_id"))).alias("head"))
    sets = written(sets, "sets")
    a, b = sets.alias("a"), sets.alias("b")
    met = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.run") < F.col("b.run")))
    both, either = F.size(F.array_intersect("a.all", "b.all")), F.size(F.array_union("a.all", "b.all"))
    heads = F.size(F.array_intersect("a.head", "b.head")) / F.greatest(F.lit(1), F.least(F.size("a.head"), F.size("b.head")))
    return met.select(F.col("a.query_id").alias("query_id"), F.col("a.run").alias("run_a"), F.col("b.run").alias("run_b"), F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"), heads.alias("head_overlap"))


def verdict_flips(verdicts: DataFrame, runs: int) -> DataFrame:
    """verdicts(query_id, run, org_id, verdict): rows that did not get one verdict in all runs; a missing one is ABSENT."""
    seen = verdicts.groupBy("query_id", "org_id").agg(F.countDistinct("verdict").alias("_d"), F.countDistinct("run").alias("_runs"))
    distinct = F.col("_d") + (F.col("_runs") < runs).cast("int")
    return seen.where(distinct > 1).select("query_id", "org_id", distinct.cast("long").alias("verdicts"))


def pool(runs: DataFrame, depth: int = 20) -> DataFrame:
    """Union of the systems' heads: query_id, org_id, the best place, and how many systems returned it."""
    return runs.where(F.col("pos") <= depth).groupBy("query_id", "org_id").agg(F.min("pos").alias("first_pos"), F.countDistinct("system").alias("systems"))


def labelled_pairs(labels: DataFrame, judged: DataFrame) -> DataFrame:
    """labels(query_id, name, grade) with the first judged(query_id, name, grade, pos) of the same name; unmatched labels go."""
    first = judged.groupBy("query_id", "name").agg(F.min_by("grade", "pos").alias("b"))
    return labels.select("query_id", "name", F.col("grade").alias("a")).join(first, ["query_id", "name"])


def disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").withColumn("apart", F.abs(F.col("a") - F.col("b"))).orderBy(F.desc("apart"), "query_id", "name")


def project_cost(measured: DataFrame, calls: Column) -> DataFrame:
    """measured(calls, cost) with the projected cost of so many calls; null if nothing was measured."""
    return measured.withColumn("projected", F.when(F.col("calls") > 0, F.col("cost") / F.col("calls") * calls))


def model_calls(shortlisted: Column, escalated: Column, batch: int = 8, second: int = 5) -> Column:
    """1 plan, and one call per batch of either tier."""
    return 1 + F.ceil(shortlisted / batch) + F.ceil(escalated / second)
