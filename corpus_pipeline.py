"""From raw documents to a training mix: every stage works on the rows and texts that its predecessor kept.

Stages accept documents with further columns of any name, repeated rows, null and empty texts, and empty tables. All but the
last return the columns they got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from quernstone.llm.common import free_name, join_rows, numbered, table, written

#: Columns that the last stage adds; such columns of its input are replaced.
MIX_COLUMNS = ("size", "source_size", "target", "taken")


def _beside(docs: DataFrame, added: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs, where columns named like the ones that stage adds step aside for it."""
    aside = {c: free_name(docs.columns, f"_own_{c}") for c in docs.columns if c.lower() in added}
    out = stage(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null and empty texts are scored like any other; repeated rows fare alike."""
    labels = table(spark, sf_dir, "labels")
    return _beside(docs, ("held_out", "score", "predicted"), lambda d: quality.classify(d, labels).where("predicted = 1"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document of which no word is left goes with them. Texts that had none before stay, null ones too."""
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _beside(docs, ("n_lines", "n_dropped"), lambda d: line_dedup.dedup_lines(d).where(left))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row of the smallest doc_id stays; texts without words all stay."""
    rows, row = numbered(docs)
    return join_rows(rows, near_dedup.representatives(rows, row), row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out of the texts; every row stays, a text may become empty."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document with its text and taken, how many of its words the mix takes (2 times its size at most), beside
    size, source_size and target. Documents without words are taken 0 times. ``mixing.mix_schedule`` gives the order."""
    rows, row = numbered(docs.drop(*[c for c in docs.columns if c.lower() in MIX_COLUMNS]))
    return join_rows(rows, mixing.mix(rows, keep=(row,)).select(row, *MIX_COLUMNS), row).drop(row)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: A trained classifier and a template tree have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
