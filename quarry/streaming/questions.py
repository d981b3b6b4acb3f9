"""Questions as a stream against a static index: every micro-batch is one batch search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import retrieval as R
from quarry.operators import router

#: What a stream of questions has to look like.
SCHEMA = "query long, text string, lang string, asked timestamp"


def search(stream: DataFrame, index: R.Index, sink: Callable[[DataFrame, int], None], checkpoint: str, limit: int = 8) -> StreamingQuery:
    """Keyword search for each micro-batch of (query, text, lang); hits go to ``sink(hits, batch_id)``.

    The sink should overwrite by ``batch_id``: a batch is run again after a failure.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        asked = batch.select("query", "text", "lang").persist()
        try:
            sink(R.search(R.hybrid(index.bm25(asked), None), limit), batch_id)
        finally:
            asked.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def intents(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Questions per intent and window of time (without concept names): (window, intent, n)."""
    q = router.normalized(F.col("text"))
    routed = stream.withWatermark("asked", late).select("asked", router.intent(q, F.lit(0)).alias("intent"))
    return routed.groupBy(F.window("asked", window), "intent").agg(F.count("*").alias("n"))
