"""python -m quernstone.evaluate: evaluation, calibration and stability of the engine over a file of profiles."""

from __future__ import annotations

import argparse
import json
import sys

import pandas as pd


def rule_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """Grades by the share of a request's longer words that stand in a record: exercises the plan, says nothing of a model."""
    rows = []
    for r in batch.itertuples():
        words = {w for w in r.text.lower().split() if len(w) > 3}
        share = sum(w in r.card.lower() for w in words) / max(1, len(words))
        rows.append((r.local_id, 3 if share > 0.6 else 2 if share > 0.4 else 1 if share > 0 else 0, f"{share:.2f} of the words"))
    return pd.DataFrame(rows, columns=["local_id", "grade", "justification"])


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quernstone.evaluate", description=__doc__)
    p.add_argument("task", choices=("eval", "calibration", "stability"))
    p.add_argument("--data", default="data/companies.jsonl")
    p.add_argument("--queries", help="ids, comma-separated; all if none is known")
    p.add_argument("--skip-exhaustive", action="store_true", help="leave out the system that asks about each company of the pool")
    p.add_argument("--exhaustive-queries", default="q01,q04,q07")
    p.add_argument("--parallel", type=int, default=2, help="kept for the sake of scripts: all queries are one plan")
    p.add_argument("--runs", type=int, default=3, help="runs that stability compares")
    p.add_argument("--labels", help="JSON lines of labels, for calibration")
    p.add_argument("--sample", action="store_true", help="write a sheet for labels instead of scoring them")
    p.add_argument("--out", default="results")
    a = p.parse_args(args)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quernstone.functions import text
    from quernstone.operators import metrics
    from quernstone.plans import benchmark, corpus, evaluation, planner
    from quernstone.sources import profiles

    spark = SparkSession.builder.appName("quernstone-evaluate").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        every = spark.createDataFrame([(q, t, k) for q, k, t in benchmark.QUERIES], "query_id string, text string, kind string")
        queries = evaluation.allowed(every, a.queries.split(",") if a.queries else None)
        engine = corpus.engine(corpus.load(spark, a.data))
        ranked = corpus.answer(engine, queries)
        if a.task == "stability":
            lists = None
            for k in range(a.runs):
                one = corpus.answer(engine, queries).select("query_id", F.lit(k).alias("run"), "org_id", F.col("place").alias("pos"), "verdict")
                lists = one if lists is None else lists.unionByName(one)
            rows = [r.asDict() for r in evaluation.stability(lists, a.runs).orderBy("query_id").collect()]
            report = {"runs": a.runs, "queries": rows, "mean_jaccard": sum(r["mean_jaccard"] for r in rows) / max(1, len(rows)), "mean_overlap": sum(r["mean_overlap"] for r in rows) / max(1, len(rows))}
            print(json.dumps({k: v for k, v in report.items() if k != "queries"}))
            print(*evaluation.save(report, a.out, "stability"))
            return 0
        runs = evaluation.head(ranked).unionByName(corpus.baseline_embedding(engine, queries).select("query_id", F.lit("embedding").alias("system"), "org_id", "pos"))
        if not a.skip_exhaustive and a.task == "eval":
            pool = metrics.pool(runs.where(F.col("query_id").isin(a.exhaustive_queries.split(",")))).select("query_id", "org_id")
            runs = runs.unionByName(corpus.baseline_exhaustive(engine, queries, corpus.rule_match, pool=pool).select("query_id", F.lit("exhaustive").alias("system"), "org_id", "pos"))
        report = evaluation.evaluate(runs, queries, engine.companies, ranked, rule_judge, planner.heuristic_specs(queries))
        if a.task == "eval":
            name = "eval_report" if not a.queries else "eval_report_subset"
            print(*evaluation.save(report, a.out, name, evaluation.render_markdown(report)))
            return 0
        detail = [(q, d["org_id"], d["name"], d["grade"], k) for q, r in report["queries"].items() for k, d in enumerate(r.get("detail", ()))]
        graded = spark.createDataFrame(detail, "query_id string, org_id long, name string, grade int, pos int")
        if a.sample or not a.labels:
            evaluation.save({}, a.out, "sheet", evaluation.labelling_sheet(graded, queries, engine.companies))
            return 0
        labels = profiles.read_labels(spark, a.labels).withColumnRenamed("company", "name")
        row = evaluation.calibration(labels, graded).first().asDict()
        row["disagreements"] = [r.asDict() for r in metrics.disagreements(metrics.labelled_pairs(labels, graded)).limit(50).collect()]
        print(json.dumps({k: v for k, v in row.items() if k != "disagreements"}))
        print(*evaluation.save(row, a.out, "calibration"))
        return 0
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
