"""What the operators of this package share: stored tables, batch sizes, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.tables import clear, release, shared_dir, stored

__all__ = ["clear", "content_key", "integer_id", "parallelism", "release", "shared_dir", "small_batches", "stored"]


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit keyed repartitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of an Arrow batch of texts at most.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, on both sides of the pipe, for the rest of the session.

    Results are lazy, so the setting has to stay; a session that asks for less keeps its value.
    """
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, BATCH_ROWS)


def integer_id(df: DataFrame, name: str) -> Column:
    """The id column as long. These operators order and pack ids, so other types are refused."""
    kind = dict(df.dtypes)[name]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{name} is {kind}; this operator takes integer ids")
    return F.col(name).cast("long")


def content_key(*columns: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for the content of ``columns`` in joins; null differs from empty."""
    known = F.concat(*[F.coalesce(c.isNull().cast("string"), F.lit("")) for c in columns])
    return F.xxhash64(F.lit(1), known, *columns), F.xxhash64(F.lit(2), known, *columns)
