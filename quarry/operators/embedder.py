"""Static embedder: payload codec, mean pooling, word weights, and the linear algebra that prepares one.

Payload: ``AIDE``, u32 header length, JSON header, zeros up to a multiple of 4, an int8 matrix, a float16 scale per row.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.wordpiece import WordPiece

# Fixed values of the payload format.
MAGIC = b"AIDE"
FORMAT = "quarry-embedder-v1"
MAX_DIMS, MAX_VOCAB, MAX_HEADER = 1024, 100_000, 4 << 20


@dataclass
class Payload:
    header: dict
    matrix: np.ndarray  # int8, rows x dims
    scales: np.ndarray  # float32


def encode(p: Payload) -> bytes:
    header = json.dumps(p.header, ensure_ascii=False, separators=(",", ":")).encode()
    start = MAGIC + struct.pack("<I", len(header)) + header
    return start + b"\0" * (-len(start) % 4) + p.matrix.astype(np.int8).tobytes() + p.scales.astype("<f2").tobytes()


def decode(data: bytes) -> Payload:
    """Inverse of ``encode``; raises ValueError on anything that is out of form or limits."""
    if len(data) < 8 or data[:4] != MAGIC:
        raise ValueError("embedder: bad magic")
    (size,) = struct.unpack_from("<I", data, 4)
    if size > MAX_HEADER or 8 + size > len(data):
        raise ValueError("embedder: bad header length")
    header = json.loads(data[8 : 8 + size])
    # payloads of other tools have another first part
    if not re.fullmatch(r"\w+-embedder-v1", header.get("format") or ""):
        raise ValueError("embedder: unknown format")
    rows, dims = header["rows"], header["dims"]
    vocab = len((header.get("tokenizer") or {}).get("vocab") or ())
    if not (0 < dims <= MAX_DIMS and 0 < vocab <= MAX_VOCAB and 0 < rows <= vocab):
        raise ValueError("embedder: header out of limits")
    row_map = header.get("rowMap")
    if (len(row_map) if row_map else rows) != vocab:
        raise ValueError("embedder: rowMap mismatch")
    at = 8 + size + (-(8 + size) % 4)
    if len(data) != at + rows * dims + 2 * rows:
        raise ValueError("embedder: payload length mismatch")
    matrix = np.frombuffer(data, np.int8, rows * dims, at).reshape(rows, dims)
    return Payload(header, matrix, np.frombuffer(data, "<f2", rows, at + rows * dims).astype(np.float32))


def quantize_rows(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 rows and float16-exact scales; halves go up."""
    most = np.abs(e).max(axis=1)
    scales = (most / 127).astype(np.float16).astype(np.float32)
    scales = np.where(scales == 0, np.float32(1e-8), scales)
    q = np.clip(np.floor(e.astype(np.float64) / scales[:, None] + 0.5), -127, 127).astype(np.int8)
    return q, scales.astype(np.float16).astype(np.float32)


class StaticEmbedder:
    """Mean of token rows, scaled to length 1."""

    def __init__(self, payload: Payload):
        self.payload = payload
        t = payload.header["tokenizer"]
        self.tokenizer = WordPiece(t["vocab"], t["unkToken"], t["continuingSubwordPrefix"], t["maxInputCharsPerWord"], t["lowercase"], t["stripAccents"], t["handleChineseChars"], t["cleanText"])
        self.most = payload.header["pooling"]["maxTokens"]
        self.row_map = payload.header.get("rowMap")
        self.norms = np.sqrt((payload.matrix.astype(np.float64) ** 2).sum(axis=1)) * payload.scales

    def rows(self, ids: list[int]) -> list[int]:
        known = [self.row_map[i] if self.row_map else i for i in ids if i != self.tokenizer.unk]
        return [r for r in known if r >= 0]

    def embed(self, text: str) -> np.ndarray:
        rows = self.rows(self.tokenizer.encode(text or ""))[: self.most]
        out = (self.payload.matrix[rows].astype(np.float64) * self.payload.scales[rows][:, None]).sum(axis=0) if rows else np.zeros(self.payload.matrix.shape[1])
        length = np.linalg.norm(out)
        return out / length if length > 0 else out

    def word_weight(self, word: str) -> float:
        rows = self.rows(self.tokenizer.encode(word))
        return float(max((self.norms[r] for r in rows), default=0.0))


def embed(df: DataFrame, text: str, embedder: StaticEmbedder, out: str = "vector") -> DataFrame:
    """``df`` with the unit vector of a text column; texts go to Python in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([embedder.embed(t).tolist() for t in texts])

    return df.withColumn(out, run(F.col(text)))


def word_weights(words: DataFrame, embedder: StaticEmbedder) -> DataFrame:
    """(word, weight) of a column ``word``."""

    @F.pandas_udf("double")
    def run(w: pd.Series) -> pd.Series:
        return w.map(embedder.word_weight)

    return words.select("word").distinct().withColumn("weight", run(F.col("word")))


def gram(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """(i, j, g) of the uncentered Gram matrix: one partial product per Arrow batch, then a sum per cell."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "g"])

    return rows.select(vector).mapInArrow(part, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def principal_axes(rows: DataFrame, k: int, vector: str = "vector") -> np.ndarray:
    """dims x k leading eigenvectors of the Gram matrix, which has at most MAX_DIMS squared cells."""
    cells = gram(rows, vector).toPandas()
    dims = int(cells["i"].max()) + 1
    g = np.zeros((dims, dims))
    g[cells["i"], cells["j"]] = cells["g"]
    values, axes = np.linalg.eigh((g + g.T) / 2)
    return axes[:, np.argsort(-values)[:k]]


def project(rows: DataFrame, axes: np.ndarray, vector: str = "vector") -> DataFrame:
    """``rows`` with their vectors multiplied by ``axes``."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()) @ axes).tolist())) if len(v) else pd.Series([], dtype=object)

    return rows.withColumn(vector, run(F.col(vector)))
