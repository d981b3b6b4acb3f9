"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 48 words. Every passage is encoded (character classes, shouting, signs, repeats at
several lags, distinct words), and gated attention, ``w . (tanh(V h) * sigmoid(U h))``, learns from document labels alone
which passages decide. The attention-weighted passage representation is scored by a logistic output.

Fitting takes at most ``FIT_ROWS`` labelled documents of the training folds to the driver; scoring streams whole texts.

Cases: null, empty and wordless texts are one empty passage and get a score; repeated rows are scored each; with no
labelled rows every score is 0.5; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.labelled import held_out, sample
from quarry.llm.passages import FEATURES, passages
from quarry.llm.store import small_batches

#: Labelled documents that the model is fitted on at most.
FIT_ROWS = 6000
HIDDEN = 16
EPOCHS = 60
REJECT = 0.3


@dataclass
class Attention:
    """Weights of the gated-attention network; ``encode`` is the passage encoder."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    out: np.ndarray
    bias: float

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each bag; ``first`` are the bags' first passages."""
        h = np.tanh(_with_one((x - self.mean) / self.scale) @ self.encode)
        gate = np.tanh(h @ self.v) * _sigmoid(h @ self.u)
        e = gate @ self.w
        a = np.exp(np.clip(e, -30, 30))
        starts = first[:-1]
        whole = np.add.reduceat(a, starts)
        z = np.add.reduceat(a[:, None] * h, starts) / whole[:, None]
        return _sigmoid(z @ self.out + self.bias)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def fit_attention(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, hidden: int = HIDDEN) -> Attention:
    """Adam on the log-loss of the bags; classes are not weighted, so scores stay near the labels' odds."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = _with_one((x - mean) / scale)
    names = ("encode", "v", "u", "w", "out")
    shapes = ((x.shape[1], hidden), (hidden, hidden), (hidden, hidden), (hidden,), (hidden,))
    p = {n: rng.normal(0, 1 / np.sqrt(s[0]), s) for n, s in zip(names, shapes, strict=True)}
    p["bias"] = np.zeros(1)
    m1 = {n: np.zeros_like(a) for n, a in p.items()}
    m2 = {n: np.zeros_like(a) for n, a in p.items()}
    counts = np.diff(first)
    step, batch = 0, 256
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            bags = order[k : k + batch]
            rows = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
            sizes = counts[bags]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bag = np.repeat(np.arange(len(bags)), sizes)
            xb, yb = x[rows], y[bags]
            h = np.tanh(xb @ p["encode"])
            t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
            e = np.clip((t * s) @ p["w"], -30, 30)
            a = np.exp(e)
            a = a / np.add.reduceat(a, starts)[bag]
            z = np.add.reduceat(a[:, None] * h, starts)
            d = (_sigmoid(z @ p["out"] + p["bias"][0]) - yb) / len(bags)
            dz = d[:, None] * p["out"]
            da = (h * dz[bag]).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, starts)[bag])
            dg = de[:, None] * p["w"]
            dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
            dh = a[:, None] * dz[bag] + dt @ p["v"].T + ds @ p["u"].T
            grad = {
                "encode": xb.T @ (dh * (1 - h * h)), "v": h.T @ dt, "u": h.T @ ds, "w": (t * s).T @ de,
                "out": z.T @ d, "bias": np.array([d.sum()]),
            }
            step += 1
            for n, g in grad.items():
                g = g + 1e-5 * p[n]
                m1[n] = 0.9 * m1[n] + 0.1 * g
                m2[n] = 0.999 * m2[n] + 0.001 * g * g
                p[n] = p[n] - 0.005 * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)
    return Attention(mean, scale, p["encode"], p["v"], p["u"], p["w"], p["out"], float(p["bias"][0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Attention | None:
    """Fit on a bounded sample of labelled training rows; None without any."""
    small_batches(docs.sparkSession)
    found = sample(docs, labels, "quality", rows, id_col, text_col)
    encoded = found.mapInArrow(_encode, "y int, n int, x binary").toPandas()
    if not len(encoded):
        return None
    x = np.concatenate([np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES) for b in encoded["x"]]).astype(np.float64)
    first = np.concatenate([[0], np.cumsum(encoded["n"].to_numpy())])
    return fit_attention(x, first, encoded["y"].to_numpy().astype(float))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, y) to (y, passages, features): only numbers go to the driver."""
    for batch in batches:
        counts, blobs = [], []
        for _, _, data, at in W.steps(batch.column(1)):
            x, first = passages(data, at)
            x = x.astype(np.float32)
            for a, b in zip(first[:-1], first[1:], strict=True):
                counts.append(int(b - a))
                blobs.append(x[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(counts, pa.int32()), pa.array(blobs, pa.binary())], ["y", "n", "x"])


def _scorer(model: Attention | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for row, end, data, at in W.steps(batch.column(1)):
                parts.append(np.full(end - row, 0.5) if model is None else model.scores(*passages(data, at)))
            scores = np.round(np.concatenate(parts), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    return score


def score(docs: DataFrame, model: Attention | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["id"]
    return texts.mapInArrow(_scorer(model), f"id {kind}, score double").withColumnRenamed("id", "doc_id")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    scored = score(docs, fit(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; columns unchanged. Texts go to Python, only scores come back."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [np.zeros(0)]
        for row, end, data, at in W.steps(texts):
            parts.append(np.full(end - row, 0.5) if model is None else model.scores(*passages(data, at)))
        return pa.array(np.round(np.concatenate(parts), 6))

    return docs.where(scored(F.col(text_col)) >= reject)
