"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Slot i of the mix has the point frac(i * golden ratio), in 32-bit integers; cumulative shares of the targets turn points into
sources. A source's documents lie shuffled, end to end, on a line of words that is cut into blocks of equal length; the k-th
slot of a source takes its k-th block. The line is walked at most REPEATS times. Sources whose targets come to few blocks
have finer ones, and schedules of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import running_sum, word_count, written

#: Weights of the sources by their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a multiple of all words.
TOTAL = 1.5
#: A source's line of words is walked this often at most.
REPEATS = 2
#: Slots that a mix has at least (as far as it has words), and words of a block at most.
SLOTS, BLOCK_WORDS = 1 << 17, 4096
#: Blocks that a source's target comes to at least; below, its blocks are finer by FINER, down to one word.
SOURCE_BLOCKS, FINER = 512, 16
#: 2**32 divided by the golden ratio.
GOLDEN = 2654435769
#: Sources up to this number are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source, source_no (from 0, by code point, null last), source_size, target.

    Weights share total times all words; a target stops at repeats times the source's size, and the excess is shared again by
    weight. The level where that ends is found by order of cap / weight, without iterating.
    """
    sources = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    sources = sources.withColumn("source_no", number).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double"))
    sources = sources.withColumn("_cap", F.col("source_size") * F.lit(float(repeats))).withColumn("_level", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    by_level = Window.orderBy("_level", "source_no")
    sources = sources.withColumn("_all", F.sum("source_size").over(every) * F.lit(total))
    sources = sources.withColumn("_below", F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    sources = sources.withColumn("_rest", F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    sources = sources.withColumn("_try", (F.col("_all") - F.col("_below")) / F.col("_rest"))
    fits = F.when(F.col("_try") <= F.col("_level"), F.struct(F.col("_level").alias("a"), F.col("source_no").alias("b"), F.col("_try").alias("t")))
    sources = sources.withColumn("_share", F.min(fits).over(every)["t"])
    return sources.select(source_col, "source_no", "source_size", F.coalesce(F.least("_cap", F.col("_share") * F.col("_w")), F.lit(0.0)).alias("target"))


def schedule(sources: DataFrame, slots: int, wanted: Column | None = None) -> DataFrame:
    """slot, source_no, block: the source of each slot and the slot's rank within its source. Slots of sources that are not
    wanted are left out."""
    by_no = Window.orderBy("source_no")
    whole = F.floor("target")
    shares = sources.withColumn("_to", F.sum(whole).over(by_no)).withColumn("_from", F.col("_to") - whole).withColumn("_sum", F.sum(whole).over(Window.partitionBy()))
    point = lambda c: F.floor(F.col(c) / F.col("_sum") * F.lit(4294967296.0)).cast("long")
    if wanted is not None:
        shares = shares.where(wanted)  # after the sums
    shares = shares.where("_sum > 0").select("source_no", point("_from").alias("_lo"), point("_to").alias("_hi")).where("_hi > _lo")
    # A point meets its source by the upper 12 bits first: an equi-join with at most 4,096 rows more than there are sources.
    shares = shares.withColumn("_cell", F.explode(F.sequence(F.shiftright("_lo", 20), F.shiftright(F.col("_hi") - 1, 20))))
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), (F.col("id") % (1 << 31) * F.lit(GOLDEN) % (1 << 32)).alias("_u"))
    points = points.withColumn("_cell", F.shiftright("_u", 20))
    met = points.join(shares, "_cell").where("_u >= _lo AND _u < _hi").select("slot", "source_no", F.shiftright("slot", 14).alias("_chunk"), F.lit(1).alias("_one"))
    return running_sum(met, ["source_no"], "_chunk", ["slot"], "_one", "block").select("slot", "source_no", "block")


def in_blocks(sources: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """sources with _block, the words of a block of theirs, and all slots: source_no, block, position (from 0 to 1).

    The mix has blocks of one length, which grows with its words. A source of fewer than SOURCE_BLOCKS of them goes to the
    first finer length that gives it as many, or to one word; the sources of a finer length share a schedule, whose slots
    number at most FINER * SOURCE_BLOCKS a source.
    """
    lengths = [max(1, min(BLOCK_WORDS, words // SLOTS))]
    while lengths[-1] > 1:
        lengths.append(max(1, lengths[-1] // FINER))
    enough = [F.when(F.col("target") >= SOURCE_BLOCKS * n, n) for n in lengths[:-1]]
    sources = written(sources.withColumn("_block", F.coalesce(*enough, F.lit(lengths[-1]))), "sources")
    parts = dict(sources.groupBy("_block").agg(F.sum(F.floor("target"))).collect())
    def placed(own: DataFrame, n: int, wanted: Column | None = None) -> DataFrame:
        return schedule(own, n, wanted).select("source_no", "block", (F.col("slot") / F.lit(float(max(1, n)))).alias("position"))

    slots = placed(sources, -(-words // lengths[0]), F.col("_block") == lengths[0])
    for n in lengths[1:]:
        if n in parts:
            slots = slots.unionByName(placed(sources.where(F.col("_block") == n), -(-int(parts[n]) // n)))
    return sources, slots


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, repeats: int = REPEATS, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken (words, repeats counted), and the columns of keep.

    A null text has no words, a null source is a source of its own, the last. Documents of equal id are ordered by size too,
    so reruns agree. Without words every target and every taken is 0. Other columns are not read.
    """
    known, met = _scheduled(docs, id_col, text_col, source_col, weights, total, repeats, seed, keep)
    taken = met.groupBy("source_no", "_start", id_col, *keep, "size", "source_size", "target").agg(F.sum(F.when(F.col("_met") == 1, F.col("_len")).otherwise(0)).alias("taken"))
    columns = [id_col, "size", "source_size", "target", "taken", *keep]
    empty = known.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*columns).unionByName(empty.select(*columns))


def mix_schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, repeats: int = REPEATS, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """The mix in the order of its schedule: position (share of its schedule that lies before the slot), source_no, block,
    place (of the piece in its block), id_col, from_word, to_word (of the document), and the columns of keep.

    Ordered by (position, source_no, block, place) the pieces are the mix; a reader writes the words [from_word, to_word).
    """
    _, met = _scheduled(docs, id_col, text_col, source_col, weights, total, repeats, seed, keep)
    start = F.greatest("_a", F.col("block") * F.col("_block"))
    taken = met.where("_met = 1")
    return taken.select("position", "source_no", "block", (start - F.col("block") * F.col("_block")).alias("place"), id_col, (start - F.col("_a")).alias("from_word"), (start - F.col("_a") + F.col("_len")).alias("to_word"), *keep)


def _scheduled(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], total: float, repeats: int, seed: str, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Sizes with their source's target, and the pieces of documents by block, _met where a slot takes the block."""
    sizes = written(docs.select(id_col, *keep, F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size")), "sizes")
    sources = written(source_targets(sizes, "_source", weights, total, repeats), "sources")
    words, n_sources = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    sources, slots = in_blocks(sources, int(words))

    side = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    known = sizes.join(side.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_source")
    shuffled = known.where("size > 0").withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))))
    shuffled = shuffled.withColumn("_bucket", F.substring("_order", 1, 3))
    lines = running_sum(shuffled, ["source_no"], "_bucket", ["_order", id_col, "size", *keep], "size", "_start")
    pieces = lines.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    pieces = pieces.withColumn("_a", F.col("_start") + F.col("_turn") * F.col("source_size")).withColumn("_b", F.col("_a") + F.col("size"))
    at = lambda c: F.floor(c / F.col("_block")).cast("long")
    pieces = pieces.withColumn("block", F.explode(F.sequence(at(F.col("_a")), at(F.col("_b") - 1))))
    length = F.least(F.col("_b"), (F.col("block") + 1) * F.col("_block")) - F.greatest(F.col("_a"), F.col("block") * F.col("_block"))
    return known, pieces.withColumn("_len", length).join(slots.withColumn("_met", F.lit(1)), ["source_no", "block"], "left")
