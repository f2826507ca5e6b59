"""Exact deduplication with a log-structured merge index of text digests.

Every task fills a memtable of (digest, smallest id, copies) and flushes it as a sorted run, cut into one segment per shard
of the digest space with a filter of the cells it occupies. Compaction merges the segments of a shard and keeps the smallest
identifier; what no other run's filter can hold passes without a merge. Digests with several copies are hits, and the
normalised texts behind a hit are compared byte by byte; should one digest stand for different texts, its rows are grouped
anew by the texts themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import integer_ids, join_counted, written

#: Rows of a memtable before it is flushed.
MEMTABLE_ROWS = 1 << 17
#: Rows of a shard that compaction aims at; shards are prefixes of the digest.
SHARD_ROWS = 200_000
MAX_SHARD_BITS = 16
#: Up to this number of digests (32 bytes each) the hits are broadcast to the texts; more are joined by a shuffle.
BROADCAST_HITS = 200_000
NO_ID = np.iinfo(np.int64).max

RUNS = "shard int, digests binary, ids binary, copies binary, filter binary"
INDEX = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keep_id", T.LongType()), T.StructField("copies", T.LongType())])


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def merge(digests: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by digest (rows of four words), the smallest id and the sum of copies of each."""
    if not len(ids):
        return digests, ids, copies
    order = np.lexsort((ids, *digests.T[::-1]))
    digests, ids, copies = digests[order], ids[order], copies[order]
    new = np.concatenate(([True], (digests[1:] != digests[:-1]).any(axis=1)))
    starts = np.flatnonzero(new)
    return digests[starts], ids[starts], np.add.reduceat(copies, starts)


def cells(digests: np.ndarray) -> np.ndarray:
    """Filter cell of each digest: 24 bits beyond the shard's prefix."""
    return (digests[:, 0] >> np.uint64(24) & np.uint64(0xFFFFFF)).astype(np.uint32)


def flushed(digests: np.ndarray, ids: np.ndarray, copies: np.ndarray, shard_bits: int) -> pa.RecordBatch:
    digests, ids, copies = merge(digests, ids, copies)
    shard = (digests[:, 0] >> np.uint64(64 - shard_bits)).astype(np.int32) if shard_bits else np.zeros(len(ids), np.int32)
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(ids)] if len(ids) else [0]
    parts = list(zip(cuts, cuts[1:]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(shard[a]) for a, _ in parts], pa.int32()),
            pa.array([digests[a:b].tobytes() for a, b in parts], pa.binary()),
            pa.array([ids[a:b].tobytes() for a, b in parts], pa.binary()),
            pa.array([copies[a:b].tobytes() for a, b in parts], pa.binary()),
            pa.array([np.unique(cells(digests[a:b])).tobytes() for a, b in parts], pa.binary()),
        ],
        ["shard", "digests", "ids", "copies", "filter"],
    )


def flush_runs(digests: DataFrame, shard_bits: int, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """digests(id long, digest binary of 32 bytes) as sorted runs."""

    def run(batches):
        table: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            d, i = (np.concatenate(x) for x in zip(*table))
            return flushed(d, i, np.ones(len(i), np.int64), shard_bits)

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = b"".join(batch.column(1).to_pylist())
            d = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 4)
            table.append((d, batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)))
            rows += batch.num_rows
            if rows >= memtable_rows:
                yield flush()
                table, rows = [], 0
        if table:
            yield flush()

    return digests.mapInArrow(run, RUNS)


def compact_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges the segments of one shard; entries in cells that one run alone occupies have no copy elsewhere."""
    import pandas as pd  # by this function alone: workers of the others need not load it

    d = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 4) for x in pdf["digests"]])
    i = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
    c = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["copies"]])
    cell, runs = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["filter"]]), return_counts=True)
    shared = runs[np.searchsorted(cell, cells(d))] > 1
    md, mi, mc = merge(d[shared], i[shared], c[shared])
    d, i, c = np.concatenate((d[~shared], md)), np.concatenate((i[~shared], mi)), np.concatenate((c[~shared], mc))
    raw = d.astype(">u8").tobytes()
    return pd.DataFrame(
        {
            "digest": [raw[k : k + 32] for k in range(0, len(raw), 32)],
            "keep_id": pd.array([None if x == NO_ID else x for x in i.tolist()], dtype="Int64"),
            "copies": c,
        }
    )


def compact(runs: DataFrame) -> DataFrame:
    """The index: one row per digest with the smallest id and the number of copies."""
    return runs.groupBy("shard").applyInPandas(compact_shard, INDEX)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, digest (binary).

    Rows with equal normalised texts form a group; null counts as the empty text. The smallest id stays; a null id is larger
    than any other, so keep_id is null only where no row of the group has an id. Repeated rows each count, and those that
    carry the smallest id are all kept. No rows give no rows. Ids are integers (other types raise a TypeError). Other columns
    are not read.
    """
    integer_ids(docs, id_col)
    base = written(docs.select(F.col(id_col).cast("long").alias(id_col), digest(normalised(F.col(text_col))).alias("digest")), "digests")
    total = base.count()
    shard_bits = min(MAX_SHARD_BITS, max(3, (total // SHARD_ROWS).bit_length()))
    index = written(compact(flush_runs(base, shard_bits, memtable_rows)), "index")
    hits = index.where("copies > 1")
    # Byte verification of the hits: of a group whose texts are all the same, the least and the greatest are equal. Both are
    # combined before the shuffle, so a hot group sends one row per task; texts without a hit are not shuffled.
    keyed = docs.select(F.col(id_col).cast("long").alias(id_col), normalised(F.col(text_col)).alias("_text")).withColumn("digest", digest(F.col("_text")))
    if hits.count() <= BROADCAST_HITS:
        wanted = keyed.join(F.broadcast(hits.select("digest")), "digest", "left_semi")
    else:
        wanted = join_counted(keyed, hits.select("digest", "copies"), "digest", "copies", total, "inner")
    differing = wanted.groupBy("digest").agg(F.min("_text").alias("_least"), F.max("_text").alias("_most")).where(F.col("_least") != F.col("_most")).select("digest")
    differing = written(differing, "differing")
    good = hits.join(differing, "digest", "left_anti") if differing.limit(1).count() else hits
    rows = base
    repaired = None
    if good is not hits:
        rows = base.join(differing, "digest", "left_anti")
        own = keyed.join(differing, "digest", "left_semi")
        groups = own.groupBy("digest", "_text").agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("copies"))
        repaired = own.join(groups, ["digest", "_text"]).select(id_col, "digest", "keep_id", "copies")
    joined = join_counted(rows, good, "digest", "copies", total)
    single = F.col("copies").isNull()
    out = joined.select(id_col, "digest", F.when(single, F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).alias("copies"))
    if repaired is not None:
        out = out.unionByName(repaired)
    return out.select(id_col, "keep_id", F.col("copies").cast("long").alias("group_size"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
