"""Labelled rows for fitting, and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves no rest by 5; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` (text, y) of the training folds, the least ones by a hash of the id, so reruns agree.

    Only ids are ranked; a bounded number of texts follows. Ids with labels that contradict each other count once, by
    the greatest label; ids with several texts count once, by the text with the least hash.
    """
    labels, docs = labels.select(id_col, label), docs.select(id_col, text_col)
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("known_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("known_id"), "known_id").limit(rows)
    found = docs.join(F.broadcast(chosen), docs[id_col] == chosen["known_id"]).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "y")
    return found.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id")
