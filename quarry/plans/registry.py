"""All queries of the engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import answer_queries, document_queries, graph_queries, package_queries, retrieval_queries, text_queries

MODULES = (text_queries, document_queries, retrieval_queries, graph_queries, answer_queries, package_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: BM25 and cosine rankings fused, first eight hits per question."""
    return retrieval_queries.search_hybrid(spark, sf_dir)
