"""Token counts of sections by offset-mapped attribution.

A text is encoded once as a whole. Byte-level tokens tile its bytes, so their lengths give their character spans; spans and
sections are both sorted, and their interval join is a binary search. A token that crosses a boundary is allocated by RULES.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.words import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer cuts a text before merging (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The vocabulary is broadcast; a file beyond this size is refused.
MAX_VOCABULARY = 64 << 20
#: first / last: the section of the token's first or last character; majority: the one that holds most of its characters, the
#: earlier at a tie; split: each section gets its share of the characters.
RULES = ("first", "last", "majority", "split")
_encoders: dict[str, tuple] = {}


def encoder(raw: bytes, name: str):
    """The encoding and the byte lengths of its tokens; built once per Python worker."""
    import tiktoken

    if name not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[name]


def token_spans(text: str, encoding, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of the tokens; a token that holds part of a character spans it."""
    ends = np.cumsum(lengths[np.array(encoding.encode_ordinary(text), np.int64)])
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    begun = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return begun[starts + 1] - 1, begun[ends]


def line_sections(text: str) -> np.ndarray:
    """Starts of the lines; a line feed belongs to the line it ends, and nothing follows a last one."""
    starts, at = [0], text.find("\n")
    while at != -1 and at + 1 < len(text):
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, size: int, rule: str) -> np.ndarray:
    """Tokens of each section; sections are given by their starts and tile the text."""
    n = len(sections)
    a, b = np.searchsorted(sections, starts, "right") - 1, np.searchsorted(sections, ends - 1, "right") - 1
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float)
    if rule == "last":
        return np.bincount(b, minlength=n).astype(float)
    out = np.bincount(a[a == b], minlength=n).astype(float)
    bounds = np.append(sections, size)
    for k in np.flatnonzero(a != b):
        own = np.arange(a[k], b[k] + 1)
        part = np.minimum(bounds[own + 1], ends[k]) - np.maximum(bounds[own], starts[k])
        if rule == "majority":
            out[own[np.argmax(part)]] += 1
        else:
            out[own] += part / part.sum()
    return out


def _shared(docs: DataFrame, rule: str, vocabulary: str):
    """The vocabulary as a broadcast."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        raw = f.read(MAX_VOCABULARY + 1)
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY} bytes")
    return docs.sparkSession.sparkContext.broadcast(raw)


def field_tokens(docs: DataFrame, fields: tuple[tuple[str, str], ...] = (("source", "source: "), ("lang", "\nlang: "), ("text", "\n\n")), id_col: str = "doc_id", rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per field of each row that has one: id_col, field, start, end (characters), n_tokens (double).

    A row is rendered as a whole, each field (column, what stands before it) after the other, and encoded once; what stands
    before a field belongs to it. Null fields are left out; a row without a field gives no row. Repeated rows give repeated
    results. The counts of a row's fields add up to its tokens.
    """
    shared = _shared(docs, rule, vocabulary)
    parts = F.filter(F.array(*[F.struct(F.lit(c).alias("name"), F.concat(F.lit(before), F.col(c).cast("string")).alias("part")) for c, before in fields]), lambda p: p["part"].isNotNull())
    rows = docs.select(F.col(id_col), F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("_text"), F.transform(parts, lambda p: p["name"]).alias("_names"), F.transform(parts, lambda p: F.length(p["part"])).alias("_sizes"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("field", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_tokens", T.DoubleType())])

    def run(batches):
        encoding, lengths = encoder(shared.value, vocabulary)
        for batch in slices(batches, 1):
            take, names, starts, ends, counts = [], [], [], [], []
            for k, (text, own, sizes) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                if own:
                    to = np.cumsum(np.array(sizes, np.int64))
                    at = to - sizes
                    take += [k] * len(own)
                    names += own
                    starts.append(at), ends.append(to), counts.append(allocate(*token_spans(text, encoding, lengths), at, len(text), rule))
            if take:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), pa.array(names, pa.string()), *(pa.array(np.concatenate(x)) for x in (starts, ends, counts))], schema.names)

    return rows.mapInArrow(run, schema)


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", sections=line_sections, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per section of each row's text: id_col, section (from 0), start, end (characters), n_tokens (double).

    The counts of a text's sections add up to its tokens. An empty text has one empty section without tokens, and so has a
    null one. Repeated rows give repeated results. Other columns are not read. The vocabulary is read on the driver.
    """
    shared = _shared(docs, rule, vocabulary)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("section", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_tokens", T.DoubleType())])

    def run(batches):
        encoding, lengths = encoder(shared.value, vocabulary)
        for batch in slices(batches, 1):
            rows, starts, ends, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                at = sections(text)
                rows.append(len(at)), starts.append(at), ends.append(np.append(at[1:], len(text)))
                counts.append(allocate(*token_spans(text, encoding, lengths), at, len(text), rule))
            if not rows:
                continue
            take = np.repeat(np.arange(len(rows)), rows)
            number = np.arange(len(take)) - np.repeat(np.cumsum(rows) - rows, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), pa.array(number, pa.int64()), *(pa.array(np.concatenate(x)) for x in (starts, ends, counts))], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
