"""Inert data blocks of packaged pages: scan, decode, verify."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

BLOCK = r'<script\s+([^>]*type="application/[^"]*"[^>]*)>([\s\S]*?)</script>'
#: Decoded bytes of one block at most.
LIMIT = 20 * 1024 * 1024


def attribute(attributes: Column, name: str) -> Column:
    return F.regexp_extract(attributes, rf'(?:^|\s){name}="([^"]*)"', 1)


def scan(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, id, type, compression, text) of every block; of blocks that share an id the last one counts."""
    found = pages.select(
        F.col(key), F.posexplode(F.arrays_zip(F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1)).alias("a"), F.regexp_extract_all(html, F.lit(BLOCK), F.lit(2)).alias("t"))).alias("pos", "b")
    )
    a = F.col("b.a")
    rows = found.select(key, "pos", attribute(a, "id").alias("id"), attribute(a, "type").alias("type"), F.nullif(attribute(a, "data-compression"), F.lit("")).alias("compression"), F.col("b.t").alias("text"))
    return rows.groupBy(key, "id").agg(F.max(F.struct("pos", "type", "compression", "text")).alias("b")).select(key, "b.pos", "id", "b.type", "b.compression", "b.text")


def bounded_gunzip(data: bytes, limit: int = LIMIT) -> bytes | None:
    """Decompressed bytes, or None as soon as they exceed the limit or are damaged."""
    unzip = zlib.decompressobj(31)
    try:
        out = unzip.decompress(data, limit + 1)
    except zlib.error:
        return None
    return out if len(out) <= limit and unzip.eof else None


def decode(rows: DataFrame, text: str = "text", compression: str = "compression", out: str = "bytes", limit: int = LIMIT) -> DataFrame:
    """Bytes of base64 text, gunzipped where so marked; null if damaged or over the limit."""

    @F.pandas_udf("binary")
    def gunzip(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else bounded_gunzip(b, limit))

    raw = F.try_to_binary(F.col(text), F.lit("base64"))
    zipped = F.when(F.col(compression) == "gzip", raw)
    return rows.withColumn("_gz", gunzip(zipped)).withColumn(out, F.when(F.col(compression) == "gzip", F.col("_gz")).otherwise(raw)).drop("_gz")


def verify(rows: DataFrame, expected: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, issue): blocks that are missing, not listed, or whose text has another SHA-256 than (id, sha256)."""
    have = rows.select(F.col(key).alias("id"), T.sha256_base64(F.col(text)).alias("have"))
    joined = have.join(expected.select(F.col("id").alias("want_id"), "sha256"), F.col("id") == F.col("want_id"), "full_outer")
    issue = F.when(F.col("id").isNull(), "missing block").when(F.col("want_id").isNull(), "unlisted block").when(F.col("have") != F.col("sha256"), "sha256 mismatch")
    return joined.select(F.coalesce("id", "want_id").alias("id"), issue.alias("issue")).where("issue is not null")


def encode_gzip(data: bytes, least_saving: float = 0.05) -> tuple[str, str]:
    """(compression, base64 text): gzip only if it saves enough."""
    packed = zlib.compressobj(9, zlib.DEFLATED, 31)
    gz = packed.compress(data) + packed.flush()
    return ("gzip", base64.b64encode(gz).decode()) if len(gz) <= len(data) * (1 - least_saving) else ("none", base64.b64encode(data).decode())


def encode(rows: DataFrame, data: str, least_saving: float = 0.05, out: str = "block") -> DataFrame:
    """``rows`` with a struct (compression, text) of a binary column, in Arrow batches."""

    @F.pandas_udf("compression string, text string")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([encode_gzip(bytes(v), least_saving) for v in values], columns=["compression", "text"])

    return rows.withColumn(out, run(F.col(data)))
