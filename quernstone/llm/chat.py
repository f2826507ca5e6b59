"""Chat formatting with cumulative-snapshot collapse, with DataFrame functions only.

Logs hold snapshots of growing conversations. The hash of a prefix is the sum of its turns' hashes, each taken with the turn's
place, so prefix hashes are running sums; a conversation whose whole hash is a proper prefix hash of a longer one is dropped by
an anti-join, and of equal conversations the smallest id stays. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import join_counted, running_sum, written

#: Turns of one rendered part: no value holds an unbounded conversation.
PART_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    # Decimal sums neither overflow nor wrap. A null differs from every text.
    said = [x for c in ("role", "text") for x in (F.coalesce(c, F.lit("")), F.col(c).isNull())]
    return F.xxhash64(F.lit(seed), "_place", *said).cast("decimal(38,0)")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, _place (from 0, by turn; null first, ties by role and text); repeated rows count once."""
    rows = conversations.select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("_chunk", F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-(1 << 62)))).withColumn("_one", F.lit(1))
    return running_sum(rows.where("conv_id IS NOT NULL"), ["conv_id"], "_chunk", ["turn", "role", "text"], "_one", "_place").drop("_one", "_chunk")


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, snapshots (how many conversations of the same turns it stands for) of the conversations that stay."""
    return _maximal(written(turns(conversations), "turns"))


def _maximal(rows: DataFrame) -> DataFrame:
    hashed = rows.withColumn("_h1", _turn_hash(1)).withColumn("_h2", _turn_hash(2)).withColumn("_chunk", F.floor(F.col("_place") / PART_TURNS))
    sums = running_sum(hashed, ["conv_id"], "_chunk", ["_place"], "_h1", "_p1")
    sums = running_sum(sums, ["conv_id"], "_chunk", ["_place"], "_h2", "_p2")
    # A turn's exclusive running sum is the hash of the prefix before it: always a proper one.
    prefixes = sums.where("_place > 0").select(F.col("_place").alias("n_turns"), F.col("_p1").cast("decimal(38,0)").alias("h1"), F.col("_p2").cast("decimal(38,0)").alias("h2")).distinct()
    whole = hashed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("_h1").cast("decimal(38,0)").alias("h1"), F.sum("_h2").cast("decimal(38,0)").alias("h2"))
    first = whole.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("snapshots"))
    return first.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "snapshots")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per PART_TURNS turns of a conversation that stays: conv_id, part, n_turns (of the conversation), snapshots, rendered.

    Null roles and texts render as empty. Turns without a conv_id are left out: they belong to no conversation. Of several
    rows of one turn each counts, in order of role and text; repeated rows count once. Other columns are not read.
    """
    rows = written(turns(conversations), "turns")
    kept = _maximal(rows)
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    kept = written(kept, "kept")
    # A conversation has as many rows as turns; one of very many is not dealt by its id.
    parts = join_counted(rows, kept, "conv_id", "n_turns", rows.count(), "inner").withColumn("part", F.floor(F.col("_place") / PART_TURNS)).withColumn("_line", F.struct("_place", line.alias("line")))
    grouped = parts.groupBy("conv_id", "part").agg(F.first("n_turns").alias("n_turns"), F.first("snapshots").alias("snapshots"), F.array_sort(F.collect_list("_line")).alias("_lines"))
    return grouped.select("conv_id", "part", "n_turns", "snapshots", F.array_join(F.transform("_lines", lambda x: x["line"]), "").alias("rendered"))
