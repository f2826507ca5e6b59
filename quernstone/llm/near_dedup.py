"""MinHash near-duplicates with sequential Bayesian verification.

Documents of equal shingle sets count as one. Bands of MinHash values pick candidates; of a candidate pair, signature batches
are compared one after another, and the pair is pruned as soon as the posterior probability that its similarity reaches the
threshold falls below MISS. Survivors are verified on full shingle sets.

A bucket never emits its pairs. In each round a document proposes one partner from another component that shares a bucket
with it; verified links merge components, and buckets that lie in one component drop out. The documents of each bucket that
still holds several components are dealt in blocks of bounded size, and each block meets each other block of its bucket in one
task. There pairs of different components are pruned by their signatures, in the first of the buckets that both share; only
documents that keep a partner fetch their sets, and only verified links come out. So no link between candidates is lost.
"""

from __future__ import annotations

import pickle
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import forget, integer_ids, join_counted, written
from quernstone.llm.components import connected
from quernstone.llm.words import NONSPACE, slices, word_parts

SHINGLE, PERCENT = 5, 80
#: A pair at similarity 0.8 shares none of 40 bands of 7 values with probability (1 - 0.8**7)**40 = 8e-5.
ROWS, BANDS = 7, 40
HASHES = ROWS * BANDS
#: Signature values of one batch, and the chosen probability of missing a pair by pruning.
STEP, MISS = 32, 1e-5
#: Rounds of proposals before the residual clusters, and documents of a block of these.
ROUNDS, BLOCK = 2, 1000
#: Up to this number of ids (8 bytes each) a list of ids is broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Word hashes that a worker keeps between texts.
CACHE_WORDS = 1 << 17

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles; word hashes are kept between texts."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        known, parts = self.known, []
        for tokens in word_parts(text, NONSPACE):
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in set(tokens):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            parts.append(np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens)))
        if not parts:
            return np.zeros(0, np.uint64)
        h = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if not len(h):
            return np.zeros(0, np.uint64)
        width = min(self.width, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = out * _FACTOR + h[k : k + n]
            out ^= out >> np.uint64(29)
        return np.unique(mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 1024):
        np.minimum(out, ((h[a : a + 1024][None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * _FACTOR + rows[:, k])
    return key.view(np.int64)


def least_matches(percent: int, step: int = STEP, hashes: int = HASHES, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, P(similarity >= percent) < miss under a uniform prior.

    Values are compared by their low byte, so unequal ones agree once in 256. The posterior that the rate of agreement
    reaches t, after m of n, is P(Binomial(n + 1, t) <= m).
    """
    s = percent / 100
    t, out = s + (1 - s) / 256, []
    for n in [*range(step, hashes, step), hashes]:
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                out.append((n, m))
                break
    return out


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, row_col: str | None = None) -> DataFrame:
    def run(batches):
        shingles = Shingler(width)
        for batch in slices(batches, 1):
            n, digest, bands, sketch = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                if not len(s):
                    digest.append(None), bands.append(None), sketch.append(None)
                    continue
                sig = signature(s)
                digest.append(xxhash.xxh3_128_digest(s.tobytes())), bands.append(band_keys(sig)), sketch.append(sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), batch.column(2)], ["id", "n", "digest", "bands", "sketch", "row"])

    row = F.lit(None).cast("long") if row_col is None else F.col(row_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"), row.alias("row"))
    return source.mapInArrow(run, "id long, n long, digest binary, bands array<long>, sketch binary, row long")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, shingles of the documents in ids (unique)."""

    def run(batches):
        shingles = Shingler(width)
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "shingles"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return source.join(side, "id", "left_semi").mapInArrow(run, "id long, shingles binary")


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs(a, b): pruned by signature batches, then verified on full sets."""
    needed = least_matches(percent)

    def prune(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            alive, matches, at = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in needed:
                matches[alive] += (x[alive, at:n] == y[alive, at:n]).sum(axis=1)
                alive, at = alive[matches[alive] >= least], n
            yield batch.select([0, 1]).take(pa.array(alive))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def with_both(p: DataFrame, side: DataFrame, column: str) -> DataFrame:
        one, two = (side.select(F.col("id").alias(k), F.col(column).alias(f"_{k}")) for k in "ab")
        return p.join(two, "b").join(one, "a").select("a", "b", "_a", "_b")

    survivors = with_both(pairs, sketches, "sketch").mapInArrow(prune, "a long, b long")
    return with_both(written(survivors, "survivors"), sets, "shingles").mapInArrow(check, "a long, b long")


def _links(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """node, component of the representatives that are linked with another; reps(id, bands, sketch), unique by id."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], "node long, component long")
    flat = reps.select("id", F.explode("bands").alias("key"))
    # Buckets of one document drop out.
    shared = written(flat.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    total = shared.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    if not total:
        return none
    buckets = written(join_counted(flat, shared, "key", "members", int(total), "inner").select("key", "id", "first"), "buckets")
    ids = written(buckets.select("id").distinct(), "ids")
    sketches = written(reps.select("id", "sketch").join(ids, "id", "left_semi"), "sketches")
    sets = written(_sets(docs, ids, id_col, text_col, width).dropDuplicates(["id"]), "sets")
    ordered = lambda p: p.select(F.least("id", "mate").alias("a"), F.greatest("id", "mate").alias("b"))

    def unresolved(found: DataFrame | None, k: int) -> tuple[DataFrame, DataFrame, int]:
        """Rows (key, id, component) of buckets; of each bucket whose documents are in several components a document of either of
        two and its members; the sum of these members."""
        rows = buckets.select("key", "id", F.col("id").alias("component"))
        if found is not None:
            rows = buckets.select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        rows = written(rows, "rows")
        one = F.struct(F.xxhash64("component", F.lit(k)).alias("h"), "component", "id")
        ends = rows.groupBy("key").agg(F.min(one).alias("x"), F.max(one).alias("y"), F.count(F.lit(1)).alias("members")).where("x.component <> y.component")
        ends = written(ends, "ends")
        return rows, ends, int(ends.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0])

    tested, links, found = None, None, None
    scratch = [shared, buckets, ids, sketches, sets]
    for k in range(ROUNDS):
        if k == 0:
            proposed = buckets.where("first <> id").groupBy("id").agg(F.min("first").alias("mate"))
        else:
            rows, ends, members = unresolved(found, k)
            scratch += [rows, ends]
            if not members:
                forget(*scratch)
                return found if found is not None else none
            met = join_counted(rows, ends, "key", "members", members, "inner")
            near = met.select("id", F.when(F.col("x.component") != F.col("component"), F.col("x.id")).otherwise(F.col("y.id")).alias("mate"))
            both_ways = tested.select(F.col("a").alias("id"), F.col("b").alias("mate")).unionByName(tested.select(F.col("b").alias("id"), F.col("a").alias("mate")))
            near = near.distinct().join(both_ways, ["id", "mate"], "left_anti")
            proposed = near.groupBy("id").agg(F.min_by("mate", F.xxhash64("id", "mate", F.lit(k))).alias("mate"))
        pairs = written(ordered(proposed).distinct(), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = written(_verified(pairs, sketches, sets, percent), "verified")
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            found = written(connected(links), "components")
    rows, ends, members = unresolved(found, ROUNDS)
    scratch += [rows, ends]
    if members:
        new = written(_residual(join_counted(rows, ends.select("key", "members"), "key", "members", members, "inner"), sketches, sets, percent), "residual")
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            found = written(connected(links), "components")
    forget(*scratch)
    return found if found is not None else none


def _candidates(rows: pa.Table, needed: list[tuple[int, int]]):
    """Row i and later rows j of its bucket, in another component (and another block), that the signatures do not rule out and
    that share no earlier bucket with it. rows are sorted by key and id."""
    key, component, block = (rows[c].to_numpy() for c in ("key", "component", "block"))
    keys, sketch = rows["keys"].to_pylist(), np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, HASHES)
    # A group is a pack of small buckets, or two blocks of one bucket; the same block alone when it meets itself.
    ends, two = np.searchsorted(key, key, "right"), key[0] == key[-1] and block.min() != block.max()
    for i in range(len(key)):
        js = np.arange(i + 1, ends[i])
        js = js[component[js] != component[i]]
        if two:
            js = js[block[js] != block[i]]
        matches, at = np.zeros(len(js), np.int64), 0
        for n, least in needed:
            if not len(js):
                break
            matches = matches + (sketch[js, at:n] == sketch[i, at:n]).sum(axis=1)
            alive = matches >= least
            js, matches, at = js[alive], matches[alive], n
        js = [j for j in js.tolist() if np.intersect1d(keys[i], keys[j])[0] == key[i]]
        if js:
            yield i, js


def _residual(rows: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between components of rows(key, id, component, members) that share a bucket."""
    keys = rows.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # BANDS of them at most
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    packs = max(1, rows.count() // BLOCK)
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.join(keys.join(sketches, "id"), "id").withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Buckets of one block share tasks; of larger ones each pair of blocks is a group.
    one = F.col("blocks") == 1
    dealt = dealt.select(
        F.when(~one, F.col("key")).alias("g"),
        F.when(one, F.pmod(F.xxhash64("key"), F.lit(packs)).cast("int")).otherwise(F.least("block", "_with")).alias("x"),
        F.when(one, F.lit(-1)).otherwise(F.greatest("block", "_with")).alias("y"),
        "key", "id", "component", "block", "keys", "sketch",
    )
    group = ["g", "x", "y"]
    dealt = written(dealt, "dealt")
    needed = least_matches(percent)

    by_key = [("key", "ascending"), ("id", "ascending")]

    def alive(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(by_key)
        kept = sorted({k for i, js in _candidates(rows, needed) for k in (i, *js)})
        return rows.select(["g", "x", "y", "key", "id"]).take(pa.array(kept, pa.int64()))

    def links(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(by_key)
        ids, component = rows["id"].to_numpy(), np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        shingles = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        root = list(range(int(component.max()) + 1))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i, js in _candidates(rows, needed):
            for j in js:
                one, other = find(component[i]), find(component[j])
                a, b = shingles[i], shingles[j]
                if one == other or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    root[one] = other
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    kept = written(dealt.groupBy(*group).applyInArrow(alive, "g long, x int, y int, key long, id long"), "alive")
    # x and y of a group are never null; its key may be.
    again = dealt.join(kept.withColumnRenamed("g", "_g"), (F.col("g").eqNullSafe(F.col("_g"))) & (dealt.x == kept.x) & (dealt.y == kept.y) & (dealt.key == kept.key) & (dealt.id == kept.id), "left_semi")
    return again.join(sets, "id").groupBy(*group).applyInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable over links), kept.

    Texts are linked when 100 * intersection >= percent * union of their sets of word shingles; a text of fewer words is one
    shingle as a whole. Texts without words have an empty set and no link. Equal sets are linked whatever their ids; rows
    without an id take part in that only, and a component of such rows alone is null. Repeated rows give repeated results,
    each kept if its id is the component's. Ids are integers (other types raise a TypeError). Other columns are not read.
    """
    out = _components(docs, id_col, text_col, width, percent, None)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """row_col of the rows that stay: of each component one row of the smallest id, the one of the smallest row number (row_col
    is unique). Should rows of that id have different sets, one of each stays. Of rows without an id that equal each other
    alone, and no row with an id, one stays; rows without words all stay."""
    out = _components(docs, id_col, text_col, width, percent, row_col)
    wordless = F.when(F.col("digest").isNull(), F.col("row"))
    kept = out.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_id", "digest", wordless.alias("_w"))
    return kept.agg(F.min("row").alias(row_col)).select(row_col)


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, row_col: str | None) -> DataFrame:
    """id, n, digest, row, component_id of every row."""
    integer_ids(docs, id_col)
    base = written(_sketches(docs, id_col, text_col, width, row_col), "signatures")
    narrow = base.select("id", "n", "digest", "row")
    groups = narrow.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = written(groups, "groups")
    # By digest and id together: a hot group's rows differ in their ids.
    reps = base.join(groups.select("digest", F.col("rep").alias("id")), ["digest", "id"]).dropDuplicates(["digest", "id"]).select("id", "bands", "sketch")
    found = _links(docs, reps, id_col, text_col, width, percent)
    known = groups.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"), "copies")
    out = join_counted(narrow, known, "digest", "copies", base.count())
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "n", "digest", "row", component.alias("component_id"))
