"""Sinks: JSON files, and Markdown or console reports of a bounded head."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("query_id", "place", "org_id", "name", "score", "verdict", "confidence", "fused", "reason", "tier", "escalated", "unknown")


def result_rows(ranked: DataFrame) -> DataFrame:
    """The output columns, rounded as they are shown."""
    out = ranked.withColumn("score", F.round("score", 4)).withColumn("confidence", F.round("confidence", 3)).withColumn("fused", F.round("fused", 4))
    return out.select(*[c for c in COLUMNS if c in out.columns])


def write_json(ranked: DataFrame, path: str) -> None:
    result_rows(ranked).write.mode("overwrite").json(path)


def heads(ranked: DataFrame, limit: int) -> list:
    """At most limit rows of each query, with the number of all."""
    counted = result_rows(ranked).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    return counted.where(F.col("place") <= limit).orderBy("query_id", "place").collect()


def markdown(ranked: DataFrame, limit: int = 15) -> str:
    out, last = [], None
    for r in heads(ranked, limit):
        if r.query_id != last:
            out += [f"\n## {r.query_id} ({r.total} results)\n", "| # | company | score | verdict | reason |", "|-|-|-|-|-|"]
            last = r.query_id
        clean = lambda x: str(x or "").replace("|", "/")
        out.append(f"| {r.place} | {clean(r.name)} | {r.score:.4f} | {r.verdict} | {clean(r.reason)} |")
    return "\n".join(out).strip() + "\n"


def console(ranked: DataFrame, limit: int = 20) -> str:
    out, last, total = [], None, 0
    for r in heads(ranked, limit):
        if r.query_id != last:
            if last is not None and total > limit:
                out.append(f"  ... and {total - limit} more")
            out.append(f"{r.query_id}:")
            last, total = r.query_id, r.total
        out.append(f"  {r.place:3d}. {r.name}  {r.score:.4f}  {r.verdict}" + (f"  [unknown: {', '.join(r.unknown)}]" if r.unknown else ""))
    if last is not None and total > limit:
        out.append(f"  ... and {total - limit} more")
    return "\n".join(out)
