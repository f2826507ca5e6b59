"""Line dedup with a log-template tree.

A line's leaf is given by its number of tokens and its LEAD leading tokens; tokens that hold a digit are variable fields from
the start. A template of a leaf leaves one more field open, a run of up to 1 - SIMILAR of its tokens at one of the places that
``fields`` names, so lines of one template equal each other in all other tokens. In a line of fewer than LEAST_VARIED tokens
no position may vary: all its tokens, digits too, are its leaf and its template.

A template recurs if lines of at least two different texts follow it. A line that follows several takes the one with most
lines; of equal ones that with no open field, then that whose field comes first. The line stays in the text of the template's
smallest id and is dropped everywhere else. Exact copies of a text fare alike, so copies stay copies.

Templates are grouped by equal tokens, so neither a leaf nor a template is ever gathered in one task, whatever its size.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import forget, free_name, integer_ids, join_counted, written
from quernstone.llm.words import slices

#: Leading tokens of a leaf, share of equal positions.
LEAD, SIMILAR = 3, 0.8
#: Tokens from which on a position may differ, so that 1 - SIMILAR of them is one at least.
LEAST_VARIED = math.ceil(1 / (1 - SIMILAR) - 1e-9)
#: Distinct lines that a task combines before it sends them on.
COMBINED_LINES = 50_000
#: Up to this number of hashes of lines a list of them is broadcast; a longer one is joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Up to these numbers of documents and of lines the lists of dropped lines are broadcast; more are joined by a shuffle.
BROADCAST_DOCS, BROADCAST_LINES = 200_000, 1_000_000
VARIABLE, DIGIT = re.compile(rb"\S*\d\S*"), re.compile(rb"\d")
NO_ID = (1 << 63) - 1

_LINES = "key binary, head long, tail long, id long, hash long, low long, high long, n long"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parsed(text: bytes):
    """Position, key, tokens of the lines that have a token."""
    digits = DIGIT.search(text) is not None
    for pos, line in enumerate(text.split(b"\n")):
        tokens = line.split()
        # Looking for variable fields is slow, and few lines have any.
        if digits and len(tokens) >= LEAST_VARIED and DIGIT.search(line):
            tokens = VARIABLE.sub(b"<*>", line).split()
        if tokens:
            yield pos, xxhash.xxh3_128_digest(b" ".join(tokens)), tokens


def text_hash(text: bytes) -> int:
    return signed(xxhash.xxh3_64_intdigest(text))


def halves(tokens: list[bytes]) -> tuple[int | None, int | None]:
    """Hashes of a leaf and of the tokens before, and after, any place where a field may start: lines of one template share one
    of the two at least. Lines without a field have none."""
    n = len(tokens)
    if n < LEAST_VARIED:
        return None, None
    width = int(n * (1 - SIMILAR) + 1e-9)
    first = max(LEAD, (n - width) // 2)  # a field starts here or behind: these tokens are equal
    last = n - width - first + 1  # it starts before: these are
    lead = b" ".join(tokens[:LEAD])
    return signed(xxhash.xxh3_64_intdigest(b" ".join(tokens[:first]), 2 * n)), signed(xxhash.xxh3_64_intdigest(lead + b"\n" + b" ".join(tokens[n - last :]), 2 * n + 1))


def _distinct_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct lines of each task with the smallest (id, text hash), the least and greatest text hash and the number of lines."""

    def run(batches):
        seen: dict[bytes, list] = {}

        def flush():
            keys, columns = list(seen), list(zip(*seen.values()))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], ["key", "head", "tail", "id", "hash", "low", "high", "n"])

        for batch in slices(batches, 1):
            for i, text in zip(batch.column(0).fill_null(NO_ID).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                h = text_hash(text)
                for _, key, tokens in parsed(text):
                    if (e := seen.get(key)) is not None:
                        if (i, h) < (e[2], e[3]):
                            e[2], e[3] = i, h
                        e[4], e[5], e[6] = min(e[4], h), max(e[5], h), e[6] + 1
                        continue
                    seen[key] = [*halves(tokens), i, h, h, h, 1]
                    if len(seen) >= COMBINED_LINES:
                        yield flush()
        if seen:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, _LINES)


def _line_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """key, tokens of the lines that may follow a template with a field; a task sends a line once as long as it remembers it."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in slices(batches, 0):
            keys, lines = [], []
            for text in batch.column(0).to_pylist():
                for _, key, tokens in parsed(text) if text else ():
                    if len(tokens) >= LEAST_VARIED and key not in seen:
                        if len(seen) >= COMBINED_LINES:
                            seen.clear()
                        seen.add(key)
                        keys.append(key), lines.append(b" ".join(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lines, pa.binary())], ["key", "tokens"])

    return docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "key binary, tokens binary")


def fields(n: Column) -> Column:
    """Where the open field of a template of n tokens may start: it has n * (1 - SIMILAR) tokens, and every other half of it
    starts one, as does the last place that leaves it whole."""
    width = F.floor(n * (1 - SIMILAR) + 1e-9).cast("int")
    last = n - width
    return F.array_distinct(F.concat(F.sequence(F.lit(LEAD), last, F.greatest(F.lit(1), F.floor(width / 2).cast("int"))), F.array(last)))


def _templates(lines: DataFrame) -> DataFrame:
    """key, field (where the open field starts), template: one row for each template that a line of lines(key, tokens) follows."""
    tokens, n = F.split(F.col("tokens").cast("string"), " ", -1), F.size("_tokens")
    at = lines.withColumn("_tokens", tokens).select("*", F.explode(fields(n)).alias("field"))
    width = F.floor(n * (1 - SIMILAR) + 1e-9).cast("int")
    shape = F.concat_ws(" ", n.cast("string"), F.col("field").cast("string"), F.array_join(F.slice("_tokens", F.lit(1), F.col("field")), " "), F.lit("\n"), F.array_join(F.slice("_tokens", F.col("field") + width + 1, n), " "))
    return at.select("key", "field", F.unhex(F.md5(shape)).alias("template"))


def _few(rows: DataFrame, side: DataFrame, key: str, count: str) -> DataFrame:
    """rows whose key is in side(key, count), by a broadcast where side is short."""
    n, total = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(count), F.lit(0))).first()
    if n <= BROADCAST_KEYS:
        return rows.join(F.broadcast(side.select(key)), key, "left_semi")
    return join_counted(rows, side, key, count, int(total), "inner").select(*rows.columns)


def _line_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in slices(batches, 1):
            out = [(i, h, pos, key) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for h in (text_hash(t),) for pos, key, _ in parsed(t)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["id", "hash", "pos", "key"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, hash long, pos int, key binary")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, keep_hash (hash of the text that keeps it), n (lines) of every line that follows a recurring template."""
    first, low, high = F.min(F.struct("id", "hash")).alias("first"), F.min("low").alias("low"), F.max("high").alias("high")
    head, tail = F.first("head").alias("head"), F.first("tail").alias("tail")
    lines = written(_distinct_lines(docs, id_col, text_col).groupBy("key").agg(first, low, high, F.sum("n").alias("n"), head, tail), "lines")
    # A line that shares neither half with another follows no template but itself, and is left out before any text is sent.
    half = lines.where("head IS NOT NULL").select("key", F.explode(F.array("head", "tail")).alias("half"))
    shared = written(half.groupBy("half").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    able = written(_few(half, shared, "half", "members").select("key").distinct().withColumn("once", F.lit(1)), "able")
    open_ = _few(_line_tokens(docs, text_col), able, "key", "once").dropDuplicates(["key"])
    open_ = written(_templates(open_), "open")
    groups = written(open_.groupBy("template").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "groups")
    follows = _few(open_, groups, "template", "members").join(lines.select("key", "first", "low", "high", "n"), "key")
    follows = written(follows, "follows")
    recurs = follows.groupBy("template").agg(F.min("first").alias("_first"), F.min("low").alias("_low"), F.max("high").alias("_high"), F.sum("n").alias("lines"), F.count(F.lit(1)).alias("members"))
    recurs = written(recurs.where("_low <> _high").select("template", F.col("_first.hash").alias("keep_hash"), "lines", "members"), "recurs")
    total = recurs.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    follows_one = join_counted(follows.select("key", "n", "field", "template"), recurs, "template", "members", int(total), "inner")
    whole = lines.where("low <> high").select("key", "n", F.lit(-1).alias("field"), F.col("first.hash").alias("keep_hash"), F.col("n").alias("lines"))
    every = follows_one.select("key", "n", "field", "keep_hash", "lines").unionByName(whole)
    best = F.max(F.struct("lines", (-F.col("field")).alias("before"), "keep_hash"))
    found = written(every.groupBy("key").agg(best.alias("_best"), F.first("n").alias("n")).select("key", F.col("_best.keep_hash").alias("keep_hash"), "n"), "recurring")
    forget(lines, shared, able, open_, groups, follows, recurs)
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col stripped of recurring lines, n_lines and n_dropped (long) added (such columns are replaced).

    Every row stays; a text may become empty. Lines end at a line feed; lines without a token always stay.
    A null text stays null and has no lines; an empty text has one. Ids are integers (other types raise a TypeError); a null id
    is larger than any other. Rows of equal id and text fare alike. n_chars, if there, follows the text.
    """
    integer_ids(docs, id_col)
    docs = docs.drop("n_lines", "n_dropped")
    found = recurring_lines(docs, id_col, text_col)
    total = found.agg(F.sum("n")).first()[0] or 0
    hits = join_counted(_line_keys(docs, id_col, text_col), found, "key", "n", int(total), "inner").where(F.col("hash") != F.col("keep_hash"))
    own_hash, side_id, side_hash, side_dropped = (free_name(docs.columns, c) for c in ("_hash", "_side_id", "_side_hash", "_side_dropped"))
    dropped = written(hits.groupBy("id", "hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped")), "dropped")
    forget(found)
    n_docs, n_lines = dropped.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("dropped")), F.lit(0))).first()
    side = F.broadcast(dropped) if n_docs <= BROADCAST_DOCS and n_lines <= BROADCAST_LINES else dropped
    side = side.select(F.col("id").alias(side_id), F.col("hash").alias(side_hash), F.col("dropped").alias(side_dropped))

    def hashed(batches):
        for batch in slices(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            yield batch.append_column(own_hash, pa.array([text_hash(t) if t else None for t in texts], pa.int64()))

    rows = docs.mapInArrow(hashed, T.StructType([*docs.schema.fields, T.StructField(own_hash, T.LongType())]))
    met = rows.join(side, F.col(id_col).cast("long").eqNullSafe(F.col(side_id)) & (F.col(own_hash) == F.col(side_hash)), "left")
    lines, gone = F.split(F.col(text_col), "\n", -1), F.col(side_dropped)
    kept = F.array_join(F.filter(lines, lambda _, k: ~F.array_contains(gone, k)), "\n")
    new = F.when(gone.isNull(), F.col(text_col)).otherwise(kept)
    changed = {text_col: new}
    if "n_chars" in docs.columns and text_col != "n_chars":
        changed["n_chars"] = F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return met.select(
        *[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )
