"""Evaluation of ranked lists: pooling, a judge's grades, reports, stability between runs, and calibration against labels.

Frames stay distributed; only bounded heads (pools of POOL_DEPTH, means, samples) reach the driver, for the reports.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.functions.windows import top
from quernstone.operators import metrics, sampling
from quernstone.plans.scratch import written

# Depth of the pool, records a judge grades at once, seed of their order, quotas of a labelling sheet by grade.
POOL_DEPTH, JUDGE_BATCH, JUDGE_SEED = 20, 8, 17
QUOTAS, PER_QUERY, SHEET_SEED = {3: 5, 2: 6, 1: 6, 0: 3}, 20, 11
FIGURES = ("p_at_5", "p_at_10", "p_at_20", "ndcg_at_10", "ndcg_at_20", "r_at_20", "average_precision", "returned")
LABELS = {"cascade": "**Cascade**", "exhaustive": "Exhaustive (one call per company, pooled)", "embedding": "Embedding only"}


class Ungraded(RuntimeError):
    """The judge graded nothing at all: no figure may come of that."""


def allowed(queries: DataFrame, ids: Sequence[str] | None) -> DataFrame:
    """The queries named by ids; all of them if none is named or none of the names is known."""
    if not ids:
        return queries
    wanted = queries.where(F.col("query_id").isin(list(ids)))
    return wanted if wanted.limit(1).count() else queries


def shuffled(pool: DataFrame, seed: int = JUDGE_SEED) -> DataFrame:
    """pool(query_id, org_id) with rank0: an order that does not tell how a system ranked a company; the same in every run."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("org_id").cast("string")))
    # A query's pool is a union of heads, so its window is small.
    return pool.withColumn("rank0", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "org_id")) - 1)


def judge_pool(pool: DataFrame, queries: DataFrame, companies: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], seed: int = JUDGE_SEED, size: int = JUDGE_BATCH) -> DataFrame:
    """query_id, org_id, grade (0 to 3), justification of pool(query_id, org_id).

    judge gets batches of (local_id, text, card) and returns local_id, grade, justification. A batch that fails grades nothing;
    the caller sees by the missing grades. companies has org_id and card.
    """
    from quernstone.operators.qualify import batches

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pdf.head(0)[["query_id", "org_id"]].assign(grade=pd.Series(dtype="int32"), justification=pd.Series(dtype=str))
        try:
            got = judge(pdf[["local_id", "text", "card"]].sort_values("local_id")).drop_duplicates("local_id", keep="last")
            out = pdf[["query_id", "org_id", "local_id"]].merge(got, on="local_id")
            grade = pd.to_numeric(out["grade"], errors="coerce")
            out = out[grade.notna()].assign(grade=grade.dropna().clip(0, 3).astype("int32"))
            out["justification"] = out["justification"].fillna("").astype(str).str.strip()
            return out[["query_id", "org_id", "grade", "justification"]]
        except Exception:  # noqa: BLE001  a failed batch must not end the evaluation
            return none

    rows = shuffled(pool, seed).join(F.broadcast(queries.select("query_id", "text")), "query_id").join(companies.select("org_id", "card"), "org_id")
    return batches(rows, size).groupBy("query_id", "batch").applyInPandas(run, "query_id string, org_id long, grade int, justification string")


def graded_detail(runs: DataFrame, grades: DataFrame, companies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per graded company of a query, the best grades first: name, location, grade, justification, its place in each
    system (null if absent), verdict and reason of the cascade."""
    places = runs.groupBy("query_id", "org_id").agg(F.min(F.when(F.col("system") == "cascade", F.col("pos"))).alias("cascade_rank"), F.min(F.when(F.col("system") == "embedding", F.col("pos"))).alias("embedding_rank"))
    named = companies.select("org_id", text.display_name(F.col("operational_name"), F.col("website"), F.col("org_id")).alias("name"), text.location(F.col("town"), F.col("region_name"), F.col("country_code")).alias("location"))
    out = grades.join(named, "org_id").join(places, ["query_id", "org_id"], "left").join(verdicts.select("query_id", "org_id", "verdict", "reason"), ["query_id", "org_id"], "left")
    return out.orderBy("query_id", F.desc("grade"), "org_id")


def evaluate(runs: DataFrame, queries: DataFrame, companies: DataFrame, verdicts: DataFrame, judge: Callable, classes: DataFrame | None = None, depth: int = POOL_DEPTH, judge_name: str = "rules") -> dict:
    """A report of runs(query_id, system, org_id, pos): means per system, figures per query, graded detail, ungraded queries.

    The pool of a query is the union of all systems' heads, so every system is measured by the same grades; a query that the
    judge could not grade is named and left out. classes(query_id, complexity) is what the planner made of the queries.
    """
    from quernstone.plans.scratch import written

    pool = metrics.pool(runs, depth)
    cards = companies.withColumn("card", text.company_card())
    grades = written(judge_pool(pool.select("query_id", "org_id"), queries, cards, judge), "grades")
    seen = {r.query_id for r in grades.select("query_id").distinct().collect()}
    asked = [r.query_id for r in queries.select("query_id").orderBy("query_id").collect()]
    if not seen and asked:
        raise Ungraded(f"the judge graded none of {len(asked)} queries")
    scored = metrics.summarise(runs.join(F.broadcast(grades.select("query_id").distinct()), "query_id"), grades)
    scored = written(scored, "scored")
    means = metrics.means(scored).collect()
    per: dict[str, dict] = {}
    sizes = {r.query_id: r.n for r in grades.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = {r.query_id: r for r in queries.collect()}
    plans = {r.query_id: r.complexity for r in classes.select("query_id", "complexity").collect()} if classes is not None else {}
    for r in scored.orderBy("query_id", "system").collect():
        q = known[r.query_id]
        row = per.setdefault(r.query_id, {"query": q.text, "kind": getattr(q, "kind", ""), "complexity": plans.get(r.query_id), "pool_size": sizes[r.query_id], "relevant_in_pool": r.in_pool, "systems": {}})
        row["systems"][r.system] = {c: round(r[c], 4) for c in FIGURES}
    for r in graded_detail(runs, grades, companies, verdicts).collect():
        per.get(r.query_id, {"detail": []}).setdefault("detail", []).append(r.asDict())
    return {
        "judge": judge_name,
        "pool_depth": depth,
        "relevant_at": metrics.RELEVANT,
        "ungraded_queries": [q for q in asked if q not in seen],
        "queries": per,
        "systems": {r.system: {"queries_scored": r.queries} | {c: r[c] for c in FIGURES} for r in means},
    }


def render_markdown(report: dict) -> str:
    """The report as tables."""
    table = lambda title, head, rows: ["", f"## {title}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head), *["| " + " | ".join(map(str, r)) + " |" for r in rows]]
    three = lambda x: f"{x:.3f}"
    systems = [s for s in LABELS if s in report["systems"]] + sorted(s for s in report["systems"] if s not in LABELS)
    lines = ["# Evaluation", "", f"Judge {report['judge']}, pools of the first {report['pool_depth']} of each system, relevant from grade {report['relevant_at']} on."]
    rows = [[LABELS.get(s, s), (m := report["systems"][s])["queries_scored"], *[three(m[c]) for c in FIGURES[:5]], three(m["average_precision"]), f"{m['returned']:.1f}"] for s in systems]
    lines += table("Systems, means over queries", ["System", "Queries", "P@5", "P@10", "P@20", "nDCG@10", "nDCG@20", "MAP", "Returned"], rows)
    if report.get("cost"):
        lines += table("Cost", ["System", "Queries", "Seconds", "Calls", "USD"], [[LABELS.get(s, s), c["queries"], c["seconds"], c["calls"], f"{c['cost']:.5f}"] for s, c in report["cost"].items()])
    rows = []
    for q, r in report["queries"].items():
        figures = [three(r["systems"][s][c]) if s in r["systems"] else "-" for c in ("p_at_10", "ndcg_at_10") for s in systems]
        rows.append([q, r["query"][:56].replace("|", "/"), r["kind"], r["complexity"] or "-", r["pool_size"], r["relevant_in_pool"], *figures])
    lines += table("Queries", ["Id", "Query", "Kind", "Class", "Pool", "Relevant", *[f"{c} {s}" for c in ("P@10", "nDCG@10") for s in systems]], rows)
    if report["ungraded_queries"]:
        lines += ["", f"Left out, as the judge could not grade them: {', '.join(report['ungraded_queries'])}."]
    return "\n".join([*lines, "", "Recall is measured against the pool: what no system returned is not in it.", ""])


def stability(lists: DataFrame, n_runs: int, depth: int = 10) -> DataFrame:
    """lists(query_id, run, org_id, pos, verdict) of n_runs runs: per query mean_jaccard, mean_overlap (of the first depth),
    unstable and stable companies. A query without pairs of runs has means of 1. lists is written, as its three uses are joined."""
    lists = written(lists, "lists")
    pairs = metrics.run_pairs(lists.select("query_id", "run", "org_id", "pos"), depth).groupBy("query_id").agg(F.avg("jaccard").alias("mean_jaccard"), F.avg("head_overlap").alias("mean_overlap"))
    flips = metrics.verdict_flips(lists.select("query_id", "run", "org_id", "verdict"), n_runs).groupBy("query_id").agg(F.count(F.lit(1)).alias("unstable"))
    every = lists.groupBy("query_id").agg(F.countDistinct("org_id").alias("companies"))
    out = every.join(pairs, "query_id", "left").join(flips, "query_id", "left").fillna(1.0, ["mean_jaccard", "mean_overlap"]).fillna(0, ["unstable"])
    return out.select("query_id", "mean_jaccard", "mean_overlap", "unstable", (F.col("companies") - F.col("unstable")).alias("stable"))


def sheet_rows(graded: DataFrame, quotas: dict[int, int] = QUOTAS, per_query: int = PER_QUERY, seed: int = SHEET_SEED) -> DataFrame:
    """graded(query_id, org_id, grade): a sample by grade for each query, topped up where a grade is rare, in an order of its own."""
    order = sampling.shuffled_by(F.col("org_id"), seed)
    by_grade = Window.partitionBy("query_id", "grade").orderBy(order, "org_id")
    want = F.lit(0)
    for grade, n in quotas.items():
        want = F.when(F.col("grade") == grade, n).otherwise(want)
    most = max(per_query, *quotas.values())
    # The literal most cuts each grade before the query's own windows see it.
    rows = graded.select("query_id", "org_id", "grade").withColumn("_n", F.row_number().over(by_grade)).where(F.col("_n") <= most)
    rows = rows.withColumn("_first", (F.col("_n") <= want).cast("int")).withColumn("_order", order)
    picked = Window.partitionBy("query_id").orderBy(F.desc("_first"), "_order", "org_id")
    return rows.withColumn("_at", F.row_number().over(picked)).where(F.col("_at") <= per_query).select("query_id", "org_id", "grade", F.row_number().over(Window.partitionBy("query_id").orderBy(F.md5(F.col("org_id").cast("string")), "org_id")).alias("place"))


def labelling_sheet(graded: DataFrame, queries: DataFrame, companies: DataFrame, **options) -> str:
    """Markdown of records to be labelled by hand; the judge's grades are not on it."""
    cards = companies.select("org_id", text.company_card().alias("card"), text.display_name(F.col("operational_name"), F.col("website"), F.col("org_id")).alias("name"))
    rows = sheet_rows(graded, **options).join(cards, "org_id").join(queries.select("query_id", "text"), "query_id").orderBy("query_id", "place").collect()
    out, last = ["# Sheet for labels", "", "Give each record a grade from 0 to 3 as JSON lines: query_id, company, grade, note.", ""], None
    for r in rows:
        if r.query_id != last:
            out += [f"## {r.query_id}: {r.text}", ""]
            last = r.query_id
        out += [f"### {r.name}", "", "```", r.card, "```", ""]
    return "\n".join(out)


def calibration(labels: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: how far a judge's grades agree with labels(query_id, name, grade); judged(query_id, name, grade, pos).

    pairs, exact, within_one, kappa_graded, kappa_binary, tp, fp, fn, precision, recall, f1 (labels are the truth), both means.
    """
    pairs = metrics.labelled_pairs(labels, judged)
    at = lambda c: F.col(c) >= metrics.RELEVANT
    binary = pairs.select(at("a").cast("int").alias("a"), at("b").cast("int").alias("b"))
    agree = metrics.agreement(pairs).withColumnsRenamed({"n": "pairs", "mean_a": "label_mean", "mean_b": "judge_mean"})
    graded = metrics.kappa(pairs).select(F.col("kappa").alias("kappa_graded"))
    two = metrics.kappa(binary).select(F.col("kappa").alias("kappa_binary"))
    return agree.crossJoin(graded).crossJoin(two).crossJoin(metrics.binary_scores(pairs, at("b"), at("a")))


def save(report: dict, folder: str, name: str, markdown: str | None = None) -> list[str]:
    """Report files: name.json, and name.md if there is Markdown."""
    os.makedirs(folder, exist_ok=True)
    paths = [os.path.join(folder, f"{name}.json")]
    with open(paths[0], "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, default=str)
    if markdown is not None:
        paths.append(os.path.join(folder, f"{name}.md"))
        with open(paths[1], "w", encoding="utf-8") as f:
            f.write(markdown)
    return paths


def head(ranked: DataFrame, k: int = POOL_DEPTH) -> DataFrame:
    """query_id, system, org_id, pos of a ranking's first k rows."""
    return top(ranked, "query_id", [F.col("place")], k).select("query_id", F.lit("cascade").alias("system"), "org_id", F.col("place").alias("pos"))
