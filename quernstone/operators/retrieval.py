"""Hybrid retrieval for all queries of a run at once: BM25 over survivors, code prefixes, dense similarity, and their fusion."""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quernstone.config import Config
from quernstone.functions.text import tokenize
from quernstone.functions.vector import cosine_of, length
from quernstone.functions.windows import rank_desc, top
from quernstone.plans.scratch import written

#: Tokens of one part of the written index; it has fewer postings than those.
PART_TOKENS = 2_000_000
#: Up to this many query terms are named to the scan of the index, or counted without one; more are only joined.
PUSHED_TERMS = 2000
#: Query vectors of one block; the only block of a search is broadcast.
QUERY_BLOCK = 1024
#: Groups of rows in a search of several blocks at least, and rows of a group on larger tables.
GROUPS, GROUP_ROWS = 32, 65_536


def words(documents: DataFrame, id_col: str = "org_id", text_col: str = "document") -> DataFrame:
    """org_id, _words: the tokens of a document."""
    return documents.select(F.col(id_col).alias("org_id"), tokenize(F.col(text_col)).alias("_words"))


def counted(documents: DataFrame, id_col: str = "org_id", text_col: str = "document", named: Collection[str] | None = None) -> DataFrame:
    """org_id, length, _runs: a document's distinct terms with their tf. A table of this, written, gives postings and lengths.

    Tokens are counted within a row, as runs of its sorted tokens, so nothing is held for a task's documents together. Given named
    terms, only those are sorted and counted, in every document; length is the number of all its tokens.
    """
    once = lambda c, use: F.element_at(F.transform(F.array(c), use), 1)  # noqa: E731  a lambda's variable is worked out once
    starts = lambda own: F.filter(F.sequence(F.lit(0), F.size(own)), lambda i: (i < F.size(own)) & ((i == 0) | (F.get(own, i) != F.get(own, i - 1))))
    run = lambda own, at, j, i: F.struct(F.get(own, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(own)) - i).cast("long").alias("tf"))
    wanted = F.col("_words") if named is None else F.filter("_words", lambda t: t.isin(list(named)))
    runs = once(F.sort_array(wanted), lambda own: once(starts(own), lambda at: F.transform(at, lambda i, j: run(own, at, j, i))))
    return words(documents, id_col, text_col).select("org_id", F.size("_words").alias("length"), runs.alias("_runs"))


def postings(documents: DataFrame, id_col: str = "org_id", text_col: str = "document") -> DataFrame:
    """id, term, tf, length: one row per distinct term of a document. documents may be ``counted`` already.

    Only where an id stands twice, rows of one id and length are added up.
    """
    sized = documents if "_runs" in documents.columns else counted(documents, id_col, text_col)
    terms = sized.select("org_id", "length", F.explode("_runs").alias("r")).select("org_id", "r.term", "r.tf", "length")
    if sized.groupBy("org_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        terms = terms.groupBy("org_id", "length", "term").agg(F.sum("tf").alias("tf")).select("org_id", "term", "tf", "length")
    return terms


def lengths(documents: DataFrame, id_col: str = "org_id", text_col: str = "document") -> DataFrame:
    """Documents without a token are kept at 0. documents may be ``counted`` already."""
    if "_runs" in documents.columns:
        return documents.select("org_id", "length")
    return words(documents, id_col, text_col).select("org_id", F.size("_words").alias("length"))


def by_term(index: DataFrame, tokens: int) -> DataFrame:
    """postings in order of their terms, for writing: a run that names its terms reads the parts that hold them only.

    tokens is the number of all tokens, or more than there are postings. Parts are of bounded size, whatever the input: there are as
    many as it takes, and a frequent term is cut by ids.
    """
    return index.repartitionByRange(-(-tokens // PART_TOKENS) or 1, "term", "org_id").sortWithinPartitions("term")


def query_terms(specs: DataFrame) -> DataFrame:
    """query_id, term, times: keywords, role statement and ideal profile, tokenised; repeated terms count again."""
    parts = F.concat_ws(" ", F.array_join("keywords", " "), F.col("role_statement"), F.col("ideal_profile"))
    terms = specs.select("query_id", F.explode(tokenize(parts)).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def named_terms(terms: DataFrame) -> frozenset[str] | None:
    """The distinct terms of a run's stated queries; None if they are more than PUSHED_TERMS."""
    named = frozenset(r.term for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect())
    return named if len(named) <= PUSHED_TERMS else None


def bm25(kept: DataFrame, index: DataFrame, sizes: DataFrame, terms: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, org_id, bm25 of kept(query_id, org_id) that hold a query term; statistics are those of a query's survivors.

    Query terms cut the index first (those of a run's stated queries), by a filter that reaches the scan of a written index, so
    only postings of wanted terms are read and shuffled.
    """
    terms = written(terms, "terms")
    named = named_terms(terms)
    if named is not None:
        index = index.where(F.col("term").isin(list(named)))
    stats = kept.join(sizes, "org_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))
    wanted = index.join(F.broadcast(terms), "term").join(kept, ["query_id", "org_id"], "left_semi")
    frequency = wanted.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    joined = wanted.join(frequency, ["query_id", "term"]).join(stats, "query_id")
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * F.col("length") / F.col("avg_length"))
    part = F.col("times") * idf * F.col("tf") * (config.bm25_k1 + 1) / norm
    return joined.groupBy("query_id", "org_id").agg(F.sum(part).alias("bm25"))


def prefix_affinity(codes: DataFrame, specs: DataFrame) -> DataFrame:
    """query_id, org_id, code, matched: the best of min(1, 0.35 + 0.165 * (length - 2)) over code prefixes that a query names.

    codes(org_id, code). startswith becomes an equi-join on the prefixes of a code, of the lengths that queries name.
    """
    prefixes = specs.select("query_id", F.explode(F.array_distinct("prefixes")).alias("prefix"))
    sizes = sorted(r.n for r in prefixes.select(F.length("prefix").alias("n")).where("n > 0").distinct().collect())
    cut = F.array_compact(F.array(*[F.when(F.length("code") >= n, F.substring("code", 1, n)) for n in sizes]).cast("array<string>"))
    starts = codes.where("code <> ''").select("org_id", F.explode(cut).alias("prefix"))
    met = starts.join(F.broadcast(prefixes), "prefix").groupBy("query_id", "org_id").agg(F.max(F.length("prefix")).alias("matched"))
    return met.select("query_id", "org_id", F.least(F.lit(1.0), F.lit(0.35) + 0.165 * (F.col("matched") - 2)).alias("code_score"), "matched")


def dense(kept: DataFrame, embeddings: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, org_id, dense: cosine of a company's embedding with the query's vector (query_id, vector); stated queries are broadcast.

    Lengths are worked out below the joins, once a company and once a query.
    """
    rows = embeddings.withColumn("_length", length(F.col("embedding")))
    asked = vectors.withColumn("_asked", length(F.col("vector")))
    met = kept.select("query_id", "org_id").join(rows, "org_id").join(F.broadcast(asked), "query_id")
    return met.select("query_id", "org_id", cosine_of(F.col("embedding"), F.col("vector"), F.col("_length"), F.col("_asked")).alias("dense"))


def signals(kept: DataFrame, dense_scores: DataFrame, bm25_scores: DataFrame, codes: DataFrame) -> DataFrame:
    """kept(query_id, org_id, ...) with dense, bm25, code_score and matched; an absent signal is 0."""
    # The last bits of a sum depend on its order; they shall not decide between equal rows.
    dense_scores = dense_scores.withColumn("dense", F.round("dense", 12))
    bm25_scores = bm25_scores.withColumn("bm25", F.round("bm25", 12))
    out = kept
    for part, columns in ((dense_scores, ["dense"]), (bm25_scores, ["bm25"]), (codes, ["code_score", "matched"])):
        out = out.join(part.select("query_id", "org_id", *columns), ["query_id", "org_id"], "left").fillna(0, columns)
    return out


def fuse(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """scored(query_id, org_id, dense, bm25, code_score, has_prefixes) with fused: weighted reciprocal ranks.

    Ties get distinct ranks in order of id. Ranks are counted in two levels, so a query's survivors are never in one task;
    scored is read six times, so hand in a written table.
    A query without prefixes gives codes no weight.
    """
    part = lambda weight: F.lit(weight) / (F.lit(config.rrf_k) + F.col("_rank") + 1)
    lists = None
    for name, weight, cells in (("dense", config.weight_dense, 4096.0), ("bm25", config.weight_bm25, 256.0), ("code_score", config.weight_code, None)):
        own = scored.where("has_prefixes") if name == "code_score" else scored
        ranked = rank_desc(own.select("query_id", "org_id", name), "query_id", name, "org_id", "_rank", cells)
        one = ranked.select("query_id", "org_id", F.lit(name).alias("signal"), part(weight).alias("part"))
        lists = one if lists is None else lists.unionByName(one)
    of = lambda name: F.coalesce(F.max(F.when(F.col("signal") == name, F.col("part"))), F.lit(0.0))
    sums = lists.groupBy("query_id", "org_id").agg((of("dense") + of("bm25") + of("code_score")).alias("fused"))
    return scored.join(sums, ["query_id", "org_id"])


def shortlist(fused: DataFrame, config: Config = Config()) -> DataFrame:
    """The first rows of each query by fused score, as many as its complexity class allows, with rank0.

    The literal largest budget is cut first, since only a literal is pushed below the window; then each query's own.
    """
    budget = F.lit(config.default_shortlist)
    for name, k in config.shortlist.items():
        budget = F.when(F.col("complexity") == name, F.lit(k)).otherwise(budget)
    return top(fused, "query_id", [F.desc("fused"), F.col("org_id")], config.max_shortlist).where(F.col("rank0") < budget)


def nearest(embeddings: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, org_id, similarity (to 12 places), rank0 of the k nearest of each stated query, over the whole table.

    Queries are multiplied with rows in blocks of `block`, and the k best of each query are kept, so k rows a query and batch (or
    group of rows) are all that is shuffled. One block of queries is broadcast. More never come to the driver: rows are dealt to
    groups, each of which gets all queries. Rows and queries without a vector are not found.
    """
    spark, kind = embeddings.sparkSession, vectors.schema["query_id"].dataType
    rows, asked = embeddings.select("org_id", "embedding"), vectors.select("query_id", "vector").where("vector IS NOT NULL")
    schema = T.StructType([T.StructField("query_id", kind), embeddings.schema["org_id"], T.StructField("similarity", T.DoubleType())])

    def best_of(names: pa.Array, queries: np.ndarray, ids: pa.Array, flat: np.ndarray) -> pa.RecordBatch:
        """The k best rows of each query; of equal ones those of the least id."""
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        score = np.round(queries @ flat[order].T, 12)
        if k < len(order):
            # All rows that reach a query's k-th score, in order of id; the sort by query and score is stable.
            q, at = np.nonzero(score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k])
        else:
            q, at = (x.ravel() for x in np.indices(score.shape))
        turn = np.lexsort((-score[q, at], q))
        q, at = q[turn], at[turn]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, at = q[first], at[first]
        return pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(order[at])), pa.array(score[q, at])], schema.names)

    def scan(held: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in held], unit(np.array([r[1] for r in held], float))))

        def run(batches):
            names, queries = shared.value
            for batch in batches:
                batch = batch.filter(pc.is_valid(batch.column(1)))
                if batch.num_rows and len(names):
                    yield best_of(pa.array(names, to_arrow_type(kind)), queries, batch.column(0), dense_rows(batch.column(1)))

        return rows.mapInArrow(run, schema)

    def grid() -> DataFrame:
        groups = max(GROUPS, rows.count() // GROUP_ROWS)

        def run(own, queries):
            ids, names = own.column(0).combine_chunks(), queries.column(0).combine_chunks()
            flat, wanted = dense_rows(own.column(1).combine_chunks()), dense_rows(queries.column(1).combine_chunks())
            found = [best_of(names[a : a + block], wanted[a : a + block], ids, flat) for a in range(0, len(names), block)] if len(ids) else []
            return pa.Table.from_batches(found) if found else pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in schema})

        dealt = rows.where("embedding IS NOT NULL").withColumn("_g", F.pmod(F.xxhash64("org_id"), F.lit(groups)).cast("int"))
        met = asked.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return dealt.groupBy("_g").cogroup(met.groupBy("_g")).applyInArrow(run, schema)

    held = asked.limit(block + 1).collect()
    found = scan(held) if len(held) <= block else grid()
    return top(found, "query_id", [F.desc("similarity"), F.col("org_id")], k)


def dense_rows(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of length 1."""
    flat = pc.cast(column, pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False)
    return unit(flat.reshape(len(column), -1 if len(column) else 0))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=-1, keepdims=True)), 1e-12) if rows.size else rows


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, item, fused of lists(query_id, item, rank0, weight); weights of 0 or less are skipped."""
    part = F.col("weight") / (F.lit(k) + F.col("rank0") + 1)
    return lists.where("weight > 0").groupBy("query_id", "item").agg(F.sum(part).alias("fused"))
