"""Inverted index, BM25, cosine search and rank fusion, for batches of queries.

Chunks are (chunk, lang, text); queries are (query, lang, text); vectors are (key, vector). Statistics are corpus-wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.tables import stored

K1, B = 1.2, 0.75
RRF_K = 60
COSINE_DEPTH = 50
#: Chunks above which a term is common: ``Index.first`` scores it once for all queries with the same common terms.
COMMON = 256
#: Queries that one pass over the vectors scores; more go in several passes.
QUERY_BLOCK = 4096


def term_frequency(chunks: DataFrame) -> DataFrame:
    """(chunk, term, tf)."""
    return T.terms(chunks, "chunk", "text", F.col("lang")).groupBy("chunk", "term").agg(F.count("*").alias("tf"))


def doc_lengths(tf: DataFrame) -> DataFrame:
    """(chunk, dl) of the chunks that have terms."""
    return tf.groupBy("chunk").agg(F.sum("tf").alias("dl"))


def with_lengths(tf: DataFrame) -> DataFrame:
    """``tf`` with each chunk's length ``dl``."""
    return tf.withColumn("dl", F.sum("tf").over(Window.partitionBy("chunk")))


def corpus_stats(chunks: DataFrame, tf: DataFrame) -> DataFrame:
    """One row (n, avgdl); chunks without terms count."""
    total = tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    count = chunks.agg(F.count("*").alias("n"))
    return count.crossJoin(total).select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("avgdl"))


def idf_value(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    return tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", "df", idf_value(F.col("n"), F.col("df")).alias("idf"))


def postings(tf: DataFrame) -> DataFrame:
    """Wire form of the index: (term, postings) with (chunk, tf) ascending. The long form is the physical table."""
    return tf.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("chunk", "tf"))).alias("postings"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term), distinct."""
    return T.terms(queries, "query", "text", F.col("lang")).select("query", "term").distinct()


class Index:
    """The index of a corpus: the long table ``postings`` (chunk, term, tf, dl) and what follows from it.

    Each posting carries its chunk's length, so scoring joins no second table.

    A search reads it for hits, frequencies, lengths and statistics: build it once and ``keep`` it in the session, or
    ``write`` it as tables and ``load`` them.
    """

    def __init__(self, chunks: DataFrame, postings: DataFrame | None = None):
        self.chunks = chunks
        self._use(with_lengths(term_frequency(chunks)) if postings is None else postings)

    def _use(self, postings: DataFrame) -> None:
        self.postings = postings
        self.tf = postings.select("chunk", "term", "tf")
        self.stats = corpus_stats(self.chunks, self.tf)

    def keep(self) -> Index:
        """Keep the postings in memory, and on disk beyond it; equal plans of later queries find them."""
        self._use(self.postings.persist(StorageLevel.MEMORY_AND_DISK))
        return self

    def write(self, path: str) -> None:
        """Two tables; postings are sorted by term within files, so a search prunes row groups by its terms."""
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "chunk").write.mode("overwrite").parquet(f"{path}/postings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/postings"))

    def weighted(self, wanted: DataFrame) -> DataFrame:
        """(term, df, idf) of the wanted terms; unseen ones have df 0 and a positive idf."""
        df = self.tf.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        known = wanted.select("term").distinct().join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
        return known.crossJoin(F.broadcast(self.stats)).select("term", "df", idf_value(F.col("n"), F.col("df")).alias("idf"))

    def bm25(self, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
        """(query, chunk, score), score > 0. Only postings of query terms are scored."""
        wanted = query_terms(queries)
        return self._scored(self.postings.join(wanted.join(self.weighted(wanted), "term"), "term"), "query", k1, b)

    def _scored(self, found: DataFrame, by: str, k1: float = K1, b: float = B) -> DataFrame:
        """(by, chunk, score), score > 0, of postings with their term's idf."""
        scored = found.crossJoin(F.broadcast(self.stats.select("avgdl")))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        # whole and rest of each part in fixed point: sums of integers, so no order of rows shows in the last bits
        units = part * float(1 << 40)
        whole = F.floor(units)
        rest = F.floor((units - whole) * float(1 << 44))
        sums = scored.select(by, "chunk", whole.alias("whole"), rest.alias("rest")).groupBy(by, "chunk").agg(F.sum("whole").alias("whole"), F.sum("rest").alias("rest"))
        return sums.select(by, "chunk", (F.col("whole") / float(1 << 40) + F.col("rest") / float(1 << 84)).alias("score")).where("score > 0")

    def first(self, queries: DataFrame, most: int) -> DataFrame:
        """``bm25`` of some chunks of each query, among them its first ``most`` by ``rank``; without scoring all hits of common terms.

        Parts of a score are positive. So a chunk that has none of a query's rare terms is among the first only if it is
        among the first by the common terms, which are scored once for all queries that share them. Chunks with a rare term
        are all scored.
        """
        wanted = query_terms(queries)
        asked = stored(wanted.join(self.weighted(wanted), "term"), "index-asked")
        common = F.col("df") > COMMON
        shared = stored(asked.where(common).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms")), "index-shared")
        sets = shared.select("terms").distinct().select(F.array_join("terms.term", " ").alias("query"), F.inline("terms"))
        top = rank(self._scored(self.postings.join(sets, "term"), "query"), most=most).select(F.col("query").alias("set"), "chunk")
        near = shared.select("query", F.array_join("terms.term", " ").alias("set")).join(top, "set").select("query", "chunk")
        rare = self.postings.join(asked.where(~common).select("query", "term"), "term").select("query", "chunk")
        candidates = near.unionByName(rare).distinct()
        return self._scored(candidates.join(asked, "query").join(self.postings, ["chunk", "term"]), "query")


def rounded(value: Column | str, digits: int = 9) -> Column:
    """A double to so many digits, as SQL engines round: the scaled value to the nearest integer, not its decimal digits."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value * 10.0**digits) / 10.0**digits


def rank(scores: DataFrame, key: str = "chunk", value: str = "score", most: int | None = None) -> DataFrame:
    """``rn`` from 1 by score, ties by key; ``most`` keeps the first ranks (pruned before the shuffle)."""
    order = Window.partitionBy("query").orderBy(rounded(value).desc(), F.col(key))
    out = scores.withColumn("rn", F.row_number().over(order))
    return out if most is None else out.where(F.col("rn") <= most)


def cosines(queries: DataFrame, vectors: DataFrame, most: int | None = None) -> DataFrame:
    """(query, key, cos) of unit query vectors with stored int8 vectors: one matrix product per Arrow batch and query block.

    ``queries`` is (query, vector), the stated query set; it visits all vectors in blocks. With ``most`` a batch passes on
    only each query's best rows, so what is shuffled does not grow with the product.
    """
    rows = queries.select("query", "vector").orderBy("query").toPandas()
    out = None
    for k in range(0, max(1, len(rows)), QUERY_BLOCK):
        block = rows.iloc[k : k + QUERY_BLOCK]
        part = _scored(vectors, queries.schema["query"].dataType.simpleString(), block["query"].tolist(), [np.asarray(v, dtype=np.float64) for v in block["vector"]], most)
        out = part if out is None else out.unionByName(part)
    return out


def _scored(vectors: DataFrame, query_type: str, names: list, unit: list, most: int | None) -> DataFrame:
    matrix = np.stack(unit) if unit else np.zeros((0, 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(names) or not batch.num_rows:
                continue
            stored = batch.column(1)
            x = stored.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            # a matrix product finds the rows; its last bits depend on its blocks, so what is kept is summed again in order
            cos = matrix @ x.T / 127
            if most is not None and batch.num_rows > 4 * most:
                least = np.partition(cos, -most, axis=1)[:, -most][:, None]
                q, k = np.nonzero(cos >= least - 1e-9)
            else:
                q, k = (a.ravel() for a in np.indices(cos.shape))
            exact = np.zeros(len(q))
            for dim in range(x.shape[1]):
                exact += matrix[q, dim] * x[k, dim]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in q], type=pa.int64() if query_type == "bigint" else None), batch.column(0).take(pa.array(k)), pa.array(exact / 127)], ["query", "key", "cos"]
            )

    kind = vectors.schema["key"].dataType.simpleString()
    return vectors.select("key", "vector").mapInArrow(score, f"query {query_type}, key {kind}, cos double")


def fuse(first: DataFrame, second: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query, chunk, rn): (query, chunk, fused)."""
    both = first.select("query", "chunk", "rn").unionByName(second.select("query", "chunk", "rn"))
    return both.groupBy("query", "chunk").agg(F.sum(1.0 / (k + F.col("rn"))).alias("fused"))


def hybrid(bm25: DataFrame, cos: DataFrame | None, depth: int = COSINE_DEPTH) -> DataFrame:
    """Order of chunks per query: (query, chunk, fused, rn). Only the cosine list is cut; without one BM25 decides."""
    by_terms = rank(bm25)
    if cos is None:
        return by_terms.select("query", "chunk", (1.0 / (RRF_K + F.col("rn"))).alias("fused"), "rn")
    by_vector = rank(cos.select("query", F.col("key").alias("chunk"), F.col("cos").alias("score")), most=depth)
    return rank(fuse(by_terms, by_vector), value="fused")


def search(order: DataFrame, limit: int = 8) -> DataFrame:
    """The first hits: (query, chunk, rank, score); the score follows the final place, not the fused value."""
    return order.where(F.col("rn") <= limit).select("query", "chunk", F.col("rn").alias("rank"), (1.0 / (RRF_K + F.col("rn"))).alias("score"))
