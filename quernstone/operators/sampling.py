"""Seeded orders and stratified samples that any engine can repeat: the order is a product modulo a prime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = 2147483647


def shuffled_by(id_col: Column, seed: int) -> Column:
    """A fixed pseudo-random place of an id; sort by it and then by the id."""
    return ((id_col % PRIME) * 48271 + seed * 16807) % PRIME * 69621 % PRIME


def stratified(rows: DataFrame, stratum: str, id_col: str, quotas: dict[int, int], seed: int, top_up: int = 0) -> DataFrame:
    """Up to quotas[s] rows of each stratum; if they are fewer than top_up together, the next rows of any stratum fill up.

    The literal largest quota is cut first, so no more than a few rows of a stratum are sorted together beyond a task.
    """
    order = [shuffled_by(F.col(id_col), seed), F.col(id_col)]
    want = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(q)) for s, q in quotas.items()], F.lit(0))
    most = max([*quotas.values(), top_up])
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_n") <= most)
    first, rest = ranked.where(F.col("_n") <= want), ranked.where(F.col("_n") > want)
    if not top_up:
        return first.drop("_n")
    # Both parts are bounded by quotas and top_up.
    lacking = top_up - first.count()
    return (first.unionByName(rest.orderBy(*order).limit(lacking)) if lacking > 0 else first).drop("_n")
