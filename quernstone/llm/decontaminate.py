"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one task. Words outside the vocabulary of the phrases cannot be part of an occurrence, so
they end a stretch; stretches shorter than the shortest phrase are left out, and the index holds the rest. Phrases are
searched backwards through wavelet-matrix ranks, all at once; occurrences are located through sampled suffix positions.

Items are cut into blocks of bounded size. A block is broadcast as the numbers of its words; its phrases are places in that
sequence. Each block takes one pass over the documents, which are numbered once and for all before the first of several.
"""

from __future__ import annotations

import pickle
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import written
from quernstone.llm.words import ALNUM_WORD, slices, word_parts

#: Words of a window.
WINDOW = 10
#: Bytes of one broadcast block of items; larger item sets take several passes over the documents.
BLOCK_BYTES = 8 << 20
#: Symbols of one shard's index, and phrases searched at once.
SHARD_SYMBOLS, PHRASES = 1 << 17, 1 << 16
END, SEPARATOR, FIRST = 0, 1, 2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class FMIndex:
    """Of a sequence of non-negative symbols; END (0) is appended and must not occur in it."""

    def __init__(self, sequence: np.ndarray, sample: int = 16) -> None:
        seq = np.append(np.asarray(sequence, np.int64), END)
        self.n = n = len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.sigma = int(seq.max()) + 1
        counts = np.bincount(seq, minlength=self.sigma)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.bits = max(1, int(self.sigma - 1).bit_length())
        self.levels = []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            ones = (level >> b & 1).astype(bool)
            self.levels.append((RankBits(ones), int(n - ones.sum())))
            level = np.concatenate((level[~ones], level[ones]))
        marked = sa % sample == 0
        self.marked, self.samples = RankBits(marked), sa[marked]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in the first i rows of the transform."""
        lo, hi = np.zeros_like(i), i
        for b, (ranks, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            one = (symbol >> b & 1).astype(bool)
            lo1, hi1 = ranks(lo), ranks(hi)
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def step(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one symbol earlier."""
        symbol, at = np.zeros_like(i), i
        start = np.zeros_like(i)
        for _, (ranks, zeros) in zip(range(self.bits), self.levels):
            one = ranks.get(at)
            r, s = ranks(at), ranks(start)
            symbol = symbol << 1 | one
            at, start = np.where(one, zeros + r, at - r), np.where(one, zeros + s, start - s)
        return self.first[symbol] + at - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases, a matrix of one phrase a row; those that cannot occur any more are not searched on."""
        m = len(phrases)
        lo, hi, open_ = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.arange(m)
        for column in phrases.T[::-1]:
            c = column[open_].astype(np.int64)
            known = c < self.sigma
            hi[open_[~known]] = lo[open_[~known]]
            open_, c = open_[known], c[known]
            lo[open_], hi[open_] = self.first[c] + self.rank(c, lo[open_]), self.first[c] + self.rank(c, hi[open_])
            open_ = open_[lo[open_] < hi[open_]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in rows."""
        out, at, open_ = np.zeros(len(rows), np.int64), np.asarray(rows, np.int64).copy(), np.arange(len(rows))
        walked = 0
        while len(open_):
            done = self.marked.get(at).astype(bool)
            out[open_[done]] = self.samples[self.marked(at[done])] + walked
            open_, at = open_[~done], self.step(at[~done])
            walked += 1
        return out


class RankBits:
    """Bits with the number of ones before any place: packed words and a running count."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))

    def __call__(self, i: np.ndarray) -> np.ndarray:
        w, rest = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; each round sorts only the suffixes that still share their rank with another."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    key = seq[order]
    starts = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    width = 1
    while True:
        tied = ~starts
        tied[:-1] |= ~starts[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        suffixes = order[places]
        after = suffixes + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        group = rank[suffixes]
        resort = np.argsort(group * (n + 1) + second + 1, kind="stable")
        suffixes, group, second = suffixes[resort], group[resort], second[resort]
        order[places] = suffixes
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        starts[places] = new
        rank[suffixes] = np.maximum.accumulate(np.where(new, places, 0))
        width *= 2


class Block(NamedTuple):
    """Items' words by number, end to end in pieces, the words of these numbers, and the item of each piece."""

    vocabulary: bytes
    sequence: bytes
    ends: bytes
    names: list[str | None]


def blocks_of(items: Iterable[tuple[str | None, bytes | None]], window: int = WINDOW, size: int | None = None) -> Iterator[Block]:
    """Blocks of about size bytes. An item that does not fit goes on in the next one, overlapping so that each window lies in one."""
    size = size or BLOCK_BYTES
    vocabulary: dict[bytes, int] = {}
    sequence, ends, names, taken = array("i"), array("q"), [], 0

    def closed() -> Block:
        nonlocal sequence, ends, names, taken
        block = Block(b" ".join(vocabulary), sequence.tobytes(), ends.tobytes(), names)
        vocabulary.clear()
        sequence, ends, names, taken = array("i"), array("q"), [], 0
        return block

    for item, text in items:
        tail: list[bytes] = []  # words that the next piece of this item starts with
        begun = len(sequence)
        for part in word_parts(text):
            for w in part:
                if taken >= size and len(sequence) - begun >= window:
                    ends.append(len(sequence)), names.append(item)
                    yield closed()
                    begun = 0
                    for x in tail:
                        sequence.append(vocabulary.setdefault(x, FIRST + len(vocabulary)))
                if (k := vocabulary.get(w)) is None:
                    k = vocabulary[w] = FIRST + len(vocabulary)
                    taken += len(w) + 1
                sequence.append(k)
                taken += 4
                tail = [*tail[-(window - 2) :], w] if window > 1 else []
        if len(sequence) > begun:
            ends.append(len(sequence)), names.append(item)
            taken += 16 + len(item or "")
            if taken >= size:
                yield closed()
    if names:
        yield closed()


class Phrases:
    """Windows of one block: for each width the places in the sequence where a different window starts, and its items."""

    def __init__(self, block: Block, window: int = WINDOW) -> None:
        names = sorted({n for n in block.names if n is not None})
        number = {n: k for k, n in enumerate(names)}
        self.names = np.array(names, object)
        self.vocabulary = {w: FIRST + k for k, w in enumerate(block.vocabulary.split())}
        self.sequence = seq = np.frombuffer(block.sequence, np.int32)
        ends = np.frombuffer(block.ends, np.int64)
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        owner = np.array([number.get(n, -1) for n in block.names], np.int64)
        widths = np.minimum(window, ends - begins)
        #: width, starts, offsets into items (one more than starts), items
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            n = ends[own] - begins[own] - width + 1
            starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[own], n)
            items = np.repeat(owner[own], n)
            h = np.zeros(len(starts), np.uint64)
            for k in range(width):
                h = (h + seq[starts + k].astype(np.uint64) + np.uint64(1)) * _FACTOR
                h ^= h >> np.uint64(31)
            order = np.lexsort((items, h))
            starts, items, h = starts[order], items[order], h[order]
            same = h[1:] == h[:-1]
            for k in range(width):
                same &= seq[starts[1:] + k] == seq[starts[:-1] + k]
            new = np.flatnonzero(np.concatenate(([True], ~same)))
            self.groups.append((width, starts[new], np.append(new, len(starts)), items))
        self.least = int(widths.min()) if len(widths) else 0
        self.most = int(widths.max()) if len(widths) else 0


def phrases_of(items: Iterable[tuple[str | None, bytes | None]], window: int = WINDOW) -> Phrases:
    """All of items as one block."""
    return Phrases(next(blocks_of(items, window, 1 << 62), Block(b"", b"", b"", [])), window)


_loaded: dict[str, Phrases] = {}


def loaded(key: str, raw: bytes) -> Phrases:
    """The phrases of a broadcast block, built once per Python worker; only the last block is held."""
    if key not in _loaded:
        _loaded.clear()
        block, window = pickle.loads(raw)
        _loaded[key] = Phrases(block, window)
    return _loaded[key]


class Hits(NamedTuple):
    """Words of each text; merged spans (text, start, end) and items (text, name), both sorted."""

    n_words: np.ndarray
    spans: np.ndarray
    items: np.ndarray


def hits_in(texts: list[bytes | None], phrases: Phrases, sample: int = 16) -> Hits:
    n_words = np.zeros(len(texts), np.int64)
    get = phrases.vocabulary.get
    parts, where, total = [], [], 0
    spans, items = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)]

    def flush() -> None:
        nonlocal parts, where, total
        if parts:
            _search_shard(np.concatenate(parts), np.array(where, np.int64), phrases, spans, items, sample)
        parts, where, total = [], [], 0

    for d, text in enumerate(texts):
        numbers = [np.fromiter(map(get, part, repeat(0)), np.int32, len(part)) for part in word_parts(text)]
        ids = numbers[0] if len(numbers) == 1 else np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        n_words[d] = len(ids)
        if not phrases.groups or len(ids) < phrases.least:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8))).reshape(-1, 2)
        for start, end in edge[edge[:, 1] - edge[:, 0] >= phrases.least].tolist():
            # Parts of a long stretch overlap, so that each window lies in one.
            for a in range(start, max(start + 1, end - phrases.most + 1), SHARD_SYMBOLS):
                b = min(end, a + SHARD_SYMBOLS + phrases.most - 1)
                where.append((total, d, a))
                parts += [ids[a:b], np.array([SEPARATOR], np.int32)]
                total += b - a + 1
                if total >= SHARD_SYMBOLS:
                    flush()
    flush()
    s = np.concatenate(spans)
    s = s[np.lexsort((s[:, 2], s[:, 1], s[:, 0]))]
    if len(s):
        # Ends so far, made to grow with the text so that one running maximum serves all texts.
        shift = s[:, 0] * (int(s[:, 2].max()) + 1)
        far = np.maximum.accumulate(s[:, 2] + shift)
        new = np.concatenate(([True], (s[1:, 0] != s[:-1, 0]) | (s[1:, 1] + shift[1:] > far[:-1])))
        last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
        s = np.column_stack((s[new, 0], s[new, 1], far[last] - shift[last]))
    return Hits(n_words, s, np.unique(np.concatenate(items), axis=0))


def _search_shard(sequence, where, phrases, spans, items, sample) -> None:
    index = FMIndex(sequence, sample)
    present = np.zeros(FIRST + len(phrases.vocabulary), bool)
    present[sequence] = True
    for width, starts, offsets, owners in phrases.groups:
        able = np.arange(len(starts))
        for k in range(width):
            able = able[present[phrases.sequence[starts[able] + k]]]
        for a in range(0, len(able), PHRASES):
            some = able[a : a + PHRASES]
            lo, hi = index.search(phrases.sequence[starts[some][:, None] + np.arange(width)])
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            at = index.locate(_ranges(lo[hit], hi[hit]))
            counts = (hi - lo)[hit]
            stretch = np.searchsorted(where[:, 0], at, "right") - 1
            doc, begin = where[stretch, 1], where[stretch, 2] + at - where[stretch, 0]
            spans.append(np.column_stack((doc, begin, begin + width)))
            pairs = np.unique(np.column_stack((doc, np.repeat(some[hit], counts))), axis=0)
            n = offsets[pairs[:, 1] + 1] - offsets[pairs[:, 1]]
            names = owners[_ranges(offsets[pairs[:, 1]], offsets[pairs[:, 1] + 1])]
            both = np.column_stack((np.repeat(pairs[:, 0], n), names))
            items.append(np.unique(both[names >= 0], axis=0))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), end to end."""
    n = hi - lo
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def cut(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """text without the words of spans (sorted, apart); what stands between two cut words goes as well."""
    kept, last, todo = [], 0, iter(spans)
    span = next(todo, None)
    for k, m in enumerate(ALNUM_WORD.finditer(text)):
        if span is None:
            break
        if k == span[0]:
            kept.append(text[last : m.start()])
        if k == span[1] - 1:
            last, span = m.end(), next(todo, None)
    return "".join([*kept, text[last:]])


def clean_texts(texts: list[bytes | None], phrases: Phrases) -> dict[int, str]:
    """By their number, texts that had an occurrence, without any; what comes together by a cut is searched again."""
    out: dict[int, str] = {}
    open_, now = list(range(len(texts))), texts
    while open_:
        spans = hits_in(now, phrases).spans
        hit, first = np.unique(spans[:, 0], return_index=True)
        for k, own in zip(hit.tolist(), np.split(spans[:, 1:], first[1:])):
            out[open_[k]] = cut(now[k].decode(), own.tolist())
        open_ = [open_[k] for k in hit.tolist()]
        now = [out[k].encode() for k in open_]
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Block]:
    """Items by blocks of bounded size: the driver holds one block at a time."""
    rows = items.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator()
    return blocks_of(((r[0], bytes(r[1]) if r[1] is not None else None) for r in rows), window)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _lists(values: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
    """One list a row of the values whose (sorted) row numbers are rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id_col, n_words, spans (merged word spans inside an occurrence), items (their ids, sorted as strings).

    A null text has no words. Repeated rows give repeated results; items of equal id count once, an item without an id marks
    words but is not listed; an empty item or an empty table of items marks nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    result = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))

    def scan(source: DataFrame, block: Block, every: bool) -> DataFrame:
        """Rows of source without its text, with what the block finds; rows without a find only if every."""
        shared, key = spark.sparkContext.broadcast(pickle.dumps((block, window))), uuid.uuid4().hex

        def run(batches):
            own = loaded(key, shared.value)
            for batch in slices(batches, 1):
                n = batch.num_rows
                n_words, spans, found = hits_in(batch.column(1).to_pylist(), own)
                starts_ends = pa.StructArray.from_arrays([pa.array(spans[:, 1]), pa.array(spans[:, 2])], fields=list(_SPAN))
                names = pa.array(own.names[found[:, 1]].tolist(), pa.string())
                columns = [*(c for k, c in enumerate(batch.columns) if k != 1), pa.array(n_words), _lists(starts_ends, spans[:, 0], n), _lists(names, found[:, 0], n)]
                out = pa.RecordBatch.from_arrays(columns, [*(c for c in batch.schema.names if c != "_text"), "n_words", "spans", "items"])
                yield out if every else out.take(pa.array(np.unique(spans[:, 0])))

        return source.mapInArrow(run, T.StructType([f for f in source.schema.fields if f.name != "_text"] + result))

    named = [F.col("_id").alias(id_col), "n_words", "spans", "items"]
    blocks = _blocks(items, item_col, item_text_col, window)
    first, second = next(blocks, Block(b"", b"", b"", [])), next(blocks, None)
    if second is None:
        return scan(source, first, True).select(*named)
    # Rows get their numbers once, in a table: a pass or a task that runs again sees the same ones.
    source = written(source.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    passes = [written(scan(source, first, True), "pass")]
    while second is not None:
        passes.append(written(scan(source, second, False), "pass"))
        second = next(blocks, None)
    merged = passes[0]
    for other in passes[1:]:
        merged = merged.unionByName(other)
    rows = merged.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        "spans",
        F.array().cast(SPANS),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return rows.withColumn("spans", joined).select(*named)


def remove_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the spans cut out of text_col; every row stays, with its other columns. n_chars, if there, follows the text.

    Null texts stay null; without items nothing changes. Several blocks of items take turns, each on the texts that the one
    before left, until none finds an occurrence that another's cut has joined.
    """
    spark = docs.sparkSession
    schema, flag = docs.schema, "_cut"
    while flag in docs.columns:
        flag += "_"

    def passed(source: DataFrame, block: Block, flagged: bool) -> DataFrame:
        shared, key = spark.sparkContext.broadcast(pickle.dumps((block, window))), uuid.uuid4().hex

        def run(batches):
            own = loaded(key, shared.value)
            for batch in slices(batches, text_col):
                k = batch.schema.get_field_index(text_col)
                column = batch.column(k)
                cleaned = clean_texts(column.cast(pa.binary()).to_pylist(), own)
                if cleaned:
                    at = np.zeros(batch.num_rows, bool)
                    at[list(cleaned)] = True
                    new = pa.array([cleaned[i] for i in sorted(cleaned)], column.type)
                    batch = batch.set_column(k, batch.schema.field(k), pc.replace_with_mask(column, pa.array(at), new))
                if flagged:
                    batch = batch.append_column(flag, pa.array([k in cleaned for k in range(batch.num_rows)], pa.bool_()))
                yield batch

        return source.mapInArrow(run, T.StructType([*schema.fields, T.StructField(flag, T.BooleanType())]) if flagged else schema)

    blocks = _blocks(items, item_col, item_text_col, window)
    first, second = next(blocks, None), next(blocks, None)
    blocks.close()
    if first is None:
        return docs
    if second is None:
        out = passed(docs, first, False)
    else:
        out, changed = docs, True
        while changed:
            changed = False
            for block in _blocks(items, item_col, item_text_col, window):
                step = written(passed(out, block, True), "cleaned")
                changed = bool(step.where(F.col(flag)).limit(1).count()) or changed
                out = step.drop(flag)
    if "n_chars" in docs.columns and text_col != "n_chars":
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col).cast(schema["n_chars"].dataType), F.col("n_chars")))
    return out
