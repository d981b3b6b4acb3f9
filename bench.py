"""Headline queries, timed: one JSON line on stdout.

Each query runs once to warm up and once for its time, into a sink that reads every column. The batch of questions over
the whole corpus is one plan, so throughput is questions times chunks per second.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "search_hybrid", "search_bm25", "bm25_score", "cosine_top", "postings", "analyze_text", "split_sentences", "chunk_rows", "heading_path", "extract_answer",
    "answer_question", "faq_match", "graph_shortest_path", "route_intent", "check_references", "sanitize_pages",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from quarry.plans import registry

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    chunks = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    asked = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "questions_times_chunks_per_sec": round(chunks * asked / times["search_hybrid"]), "search_ms_per_question": round(times["search_hybrid"] * 1000 / asked, 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
