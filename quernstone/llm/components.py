"""Connected components by alternating large-star and small-star steps, on DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import join_counted, written

#: Up to this many links (16 bytes each) one task finds the components; more take rounds of joins. The results are the same.
FEW_LINKS = 1 << 20


def _star(pairs: DataFrame, total: int, large: bool) -> DataFrame:
    """pairs(u, v): one step; the smallest neighbour is found by a partial aggregate and joined back, never by collecting a node's
    neighbours; the rows of a hub are not dealt by their node."""
    if large:
        around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    met = join_counted(around, least, "u", "n", 2 * total, "inner")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links a, b and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        # The label's own node learns of the smaller one too, so that whole trees move at once.
        for at in (label[x], label[y], x, y):
            np.minimum.at(label, at, least)
        label = label[label]
        if (label[x] == label[y]).all() and (label[label] == label).all():
            return nodes, nodes[label]


def _in_one_task(pairs: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, least = components_of(*(np.concatenate(x) for x in zip(*parts)))
            for k in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(least[k : k + (1 << 16)])], ["node", "component"])

    return pairs.select("u", "v").repartition(1).mapInArrow(run, "node long, component long")


def connected(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, component (the smallest reachable node) of every node of edges(a, b) that has an edge to another node."""
    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    total = pairs.count()
    if total <= FEW_LINKS:
        return _in_one_task(pairs)
    seen = None
    for _ in range(limit):
        pairs = written(_star(_star(pairs, total, True), total, False), "stars")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen, total = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
