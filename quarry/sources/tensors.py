"""Binary model files as DataFrames: safetensors and embedder payloads, read with Spark's binary reader."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarry.operators import embedder as E


def tensor(data: bytes, name: str) -> np.ndarray:
    """A float32 tensor of a safetensors file; ValueError if it is missing or of another type."""
    (size,) = struct.unpack_from("<Q", data, 0)
    header = json.loads(data[8 : 8 + size])
    if name not in header:
        raise ValueError(f"tensor {name} not found")
    if header[name]["dtype"] != "F32":
        raise ValueError(f"tensor {name} is {header[name]['dtype']}, not F32")
    start, end = header[name]["data_offsets"]
    return np.frombuffer(data[8 + size + start : 8 + size + end], "<f4").reshape(header[name]["shape"])


def write_tensor(name: str, x: np.ndarray) -> bytes:
    header = json.dumps({name: {"dtype": "F32", "shape": list(x.shape), "data_offsets": [0, x.size * 4]}}).encode()
    return struct.pack("<Q", len(header)) + header + x.astype("<f4").tobytes()


def scan_safetensors(files: DataFrame, name: str) -> DataFrame:
    """(path, row_id, vector) of a matrix, from rows (path, content) as the ``binaryFile`` source gives them."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                x = tensor(bytes(content), name)
                yield pd.DataFrame({"path": path, "row_id": np.arange(len(x)), "vector": list(x)})

    return files.select("path", "content").mapInPandas(rows, "path string, row_id long, vector array<float>")


def scan_embedder(files: DataFrame) -> DataFrame:
    """(path, row_id, q, scale) of embedder payloads."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                p = E.decode(bytes(content))
                yield pd.DataFrame({"path": path, "row_id": np.arange(len(p.matrix)), "q": [r.tolist() for r in p.matrix], "scale": p.scales})

    return files.select("path", "content").mapInPandas(rows, "path string, row_id long, q array<tinyint>, scale float")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def check_tokenizer(directory: str) -> list[str]:
    """Vocabulary of a tokenizer.json that has the supported form; ValueError otherwise."""
    t = json.loads((Path(directory) / "tokenizer.json").read_text(encoding="utf-8"))
    for part, kind in (("model", "WordPiece"), ("normalizer", "BertNormalizer"), ("pre_tokenizer", "BertPreTokenizer")):
        if (t.get(part) or {}).get("type") != kind:
            raise ValueError(f"unsupported {part}: {(t.get(part) or {}).get('type')}")
    ids = t["model"]["vocab"]
    if sorted(ids.values()) != list(range(len(ids))):
        raise ValueError("vocabulary ids are not contiguous")
    return sorted(ids, key=ids.get)
