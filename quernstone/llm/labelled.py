"""Bounded samples of labelled rows, and statistics of a text's structure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import written
from quernstone.llm.words import NONSPACE, words

#: Rows that a model is fitted on at most, and bytes of their texts; what its driver holds is bounded by both.
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 32 << 20

STATS = ("words", "letters_per_word", "short_words", "distinct_words", "symbols", "marked_words", "upper", "digits", "pipes", "shouts", "lines", "words_per_line", "short_lines", "repeated_lines")
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{|}~"


def remainder(id_col, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded(rows: DataFrame, limit: int, size: int | None = None) -> DataFrame:
    """rows(_id, text, ...) with one row per _id (that of the least text), the first `limit` by a hash of the id, of those as many
    as have `size` bytes of texts together; a text that does not fit is passed over."""
    others = [c for c in rows.columns if c not in ("_id", "text")]
    h = F.xxhash64("_id").alias("h")
    # Ids and sizes are all that the driver sees of the texts it may choose from.
    sizes = rows.groupBy("_id").agg(F.max(F.octet_length("text")).alias("n")).select("_id", h, "n").orderBy("h", "_id").limit(limit).collect()
    kept, total, size = [], 0, SAMPLE_BYTES if size is None else size
    for r in sizes:
        if total + r.n <= size:
            kept.append(r._id)
            total += r.n
    ids = rows.sparkSession.createDataFrame([(i,) for i in kept], T.StructType([rows.schema["_id"]]))
    chosen = rows.join(F.broadcast(ids), "_id", "left_semi")
    return written(chosen.groupBy("_id").agg(F.min(F.struct("text", *others)).alias("_r")).select("_id", "_r.*"), "sample")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """_id, text, y of at most rows labelled documents that are not held out, the first by a hash of their id (``bounded``).

    Labels without a value or an id are left out; of several labels of a document the largest counts, of several rows of one
    id that of the least text.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(F.col(id_col), modulus) != held_out))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # At most `rows` pairs of numbers: small enough to broadcast by construction.
    return bounded(texts_of(docs, id_col, text_col).join(F.broadcast(known), "_id"), rows).select("_id", "text", "y")


def structure(text: bytes | None, tokens: list[bytes] | None = None) -> np.ndarray:
    """STATS of a text; zeros for an empty one."""
    if tokens is None:
        tokens = words(text, NONSPACE)
    if not tokens:
        return np.zeros(len(STATS))
    n, size = len(tokens), len(text)
    count = lambda kind: size - len(text.translate(None, kind))
    lines = [x for x in text.split(b"\n") if x.strip()]
    by_line = [len(x.split()) for x in lines]
    return np.array(
        [
            np.log1p(n),
            np.log1p(size / n),
            sum(len(w) <= 3 for w in tokens) / n,
            len(set(tokens)) / n,
            count(_SYMBOL) / size,
            sum(w[-1] in _SYMBOL for w in tokens) / n,
            count(_UPPER) / size,
            count(_DIGIT) / size,
            tokens.count(b"|") / n,
            sum(w.endswith(b"!!") for w in tokens) / n,
            np.log1p(len(lines)),
            np.log1p(n / max(1, len(lines))),
            sum(k <= 2 for k in by_line) / max(1, len(lines)),
            1 - len(set(lines)) / max(1, len(lines)),
        ]
    )
