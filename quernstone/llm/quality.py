"""Quality classifier: a factorisation machine over hashed words and structure statistics of the text; metadata is not read.

Pairwise interactions have rank RANK and are scored in time linear in a row's features, by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import tidy
from quernstone.llm.labelled import SAMPLE_ROWS, STATS, remainder, structure, training_rows
from quernstone.llm.words import NONSPACE, release, slices, words

RANK, BUCKETS, EPOCHS, BATCH, RATE, DECAY = 8, 1 << 14, 12, 256, 0.05, 1e-4
MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.5


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: the text's statistics first, then its distinct words, hashed, of length 1 together."""
    tokens = words(text, NONSPACE)
    stats = structure(text, tokens)
    hashed = np.fromiter((zlib.crc32(w) for w in set(tokens)), np.uint32)
    buckets = np.unique(hashed % BUCKETS).astype(np.int32)
    value = np.full(len(buckets), 1 / np.sqrt(max(1, len(buckets))))
    return np.concatenate((np.arange(len(STATS), dtype=np.int32), len(STATS) + buckets)), np.concatenate((stats, value))


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        stat = index < len(STATS)
        return np.where(stat, (value - self.mean[np.minimum(index, len(STATS) - 1)]) / self.scale[np.minimum(index, len(STATS) - 1)], value)

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of rows that lie end to end, and the sums the gradient needs."""
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        rows = [features(t) for t in texts]
        index, value = (np.concatenate(x) for x in zip(*rows))
        starts = np.concatenate(([0], np.cumsum([len(i) for i, _ in rows])[:-1]))
        out = []
        # A few rows at a time, so that long texts do not add up.
        for a in range(0, len(rows), 512):
            b = starts[a + 512] if a + 512 < len(rows) else len(index)
            part = slice(starts[a], b)
            out.append(self.raw(index[part], self.scaled(index[part], value[part]), starts[a : a + 512] - starts[a])[0])
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """By AdaGrad on the logistic loss; without rows of both labels the smoothed prior remains."""
    size, rng = len(STATS) + BUCKETS, np.random.default_rng(seed)
    prior = (y.sum() + 1) / (len(y) + 2)
    stats = np.array([v[: len(STATS)] for _, v in rows]) if rows else np.zeros((1, len(STATS)))
    model = FactorisationMachine(float(np.log(prior / (1 - prior))), np.zeros(size), np.zeros((size, RANK)), stats.mean(axis=0), stats.std(axis=0) + 1e-3)
    if len(set(y.tolist())) < 2:
        return model
    model.factors = rng.normal(0, 0.01, (size, RANK))
    g_bias, g_linear, g_factors = 1e-8, np.full(size, 1e-8), np.full((size, RANK), 1e-8)
    scaled = [(i, model.scaled(i, v)) for i, v in rows]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            picked = order[a : a + BATCH]
            index, value = (np.concatenate(x) for x in zip(*[scaled[k] for k in picked]))
            lengths = np.array([len(scaled[k][0]) for k in picked])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            raw, sums = model.raw(index, value, starts)
            error = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - y[picked]) / len(picked)
            e = np.repeat(error, lengths) * value
            used, where = np.unique(index, return_inverse=True)
            d_linear = np.bincount(where, e, len(used)) + DECAY * model.linear[used]
            each = e[:, None] * (np.repeat(sums, lengths, axis=0) - model.factors[index] * value[:, None])
            d_factors = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(RANK)], axis=1) + DECAY * model.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            g_bias += error.sum() ** 2
            model.linear[used] -= RATE * d_linear / np.sqrt(g_linear[used])
            model.factors[used] -= RATE * 0.2 * d_factors / np.sqrt(g_factors[used])
            model.bias -= RATE * error.sum() / np.sqrt(g_bias)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    sample = training_rows(docs, labels, label_col, MODULUS, HELD_OUT, id_col, text_col, rows)

    def extract(batches):
        for batch in slices(batches, 1):
            got = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["id", "y", "index", "value"])

    rows_of = sample.mapInArrow(extract, "id string, y int, index binary, value binary").toLocalIterator()
    got = sorted(((r[0], r[1], np.frombuffer(r[2], np.int32), np.frombuffer(r[3])) for r in rows_of), key=lambda r: r[:2])
    model = fit([(i, v) for _, _, i, v in got], np.array([float(y) for _, y, _, _ in got]))
    got.clear()
    release()
    tidy(docs.sparkSession)
    return model


def score(docs: DataFrame, model, id_col: str, text_col: str, modulus: int, held_out: int, threshold: float) -> DataFrame:
    """Every row of docs with held_out, score and predicted added (such columns are replaced)."""
    docs = docs.drop("held_out", "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        own = pickle.loads(shared.value)
        for batch in slices(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.score(texts), pa.float64())], [*batch.schema.names, "score"])

    scored = docs.mapInArrow(run, schema)
    return scored.withColumn("held_out", remainder(F.col(id_col), modulus) == held_out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    The model is fitted on at most `rows` labelled rows that are not held out (``labelled.bounded``); only the text enters a score. Null and empty
    texts are scored like any other, by zero statistics. Without labels the score is 0.5 for every row.
    """
    return score(docs, train(docs, labels, id_col, text_col, label_col, rows), id_col, text_col, MODULUS, HELD_OUT, THRESHOLD)
