"""Index, BM25, vectors, fusion and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import answers as A
from quarry.operators import embedder as E
from quarry.operators import retrieval as R
from quarry.plans import base as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"WITH {X.BM25_CTE} SELECT chunk, term, tf FROM tf")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return X.index(spark, d).tf


@query(f"WITH {X.BM25_CTE} SELECT chunk, dl::BIGINT AS dl FROM dl")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return R.doc_lengths(X.index(spark, d).tf)


@query(f"WITH {X.BM25_CTE} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return X.index(spark, d).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {X.BM25_CTE} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, stats")
def idf(spark: SparkSession, d: str) -> DataFrame:
    i = X.index(spark, d)
    return R.idf(i.tf, i.stats).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {X.BM25_CTE} SELECT term, count(*) AS n_chunks, string_agg(chunk || ':' || tf, ',' ORDER BY chunk) AS postings FROM tf GROUP BY term")
def postings(spark: SparkSession, d: str) -> DataFrame:
    p = R.postings(X.index(spark, d).tf)
    pair = lambda x: F.concat_ws(":", x["chunk"].cast("string"), x["tf"].cast("string"))
    return p.select("term", F.size("postings").cast("long").alias("n_chunks"), F.array_join(F.transform("postings", pair), ",").alias("postings"))


@query(f"WITH {X.BM25_CTE} SELECT 0::BIGINT AS only_stored, 0::BIGINT AS only_rebuilt, count(*) AS terms FROM dfs")
def postings_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The long form rebuilt from the wire form equals the index."""
    tf = X.index(spark, d).tf
    rebuilt = R.postings(tf).select("term", F.inline("postings")).select("chunk", "term", "tf")
    both = tf.select("chunk", "term", "tf", F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(rebuilt.select("*", F.lit(0).alias("s"), F.lit(1).alias("r")))
    diff = both.groupBy("chunk", "term", "tf").agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
    return diff.agg(
        F.sum(F.when(F.col("s") > F.col("r"), 1).otherwise(0)).alias("only_stored"), F.sum(F.when(F.col("r") > F.col("s"), 1).otherwise(0)).alias("only_rebuilt"), F.count_distinct("term").alias("terms")
    )


@query(f"WITH {X.BM25_CTE} SELECT query, chunk, round(score, 6) AS score FROM bm")
def bm25_score(spark: SparkSession, d: str) -> DataFrame:
    return X.index(spark, d).bm25(X.queries(spark, d)).select("query", "chunk", F.round("score", 6).alias("score"))


@query(f"WITH {X.BM25_CTE} SELECT query, chunk, rn, round(score, 6) AS score FROM bm_rank")
def bm25_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.rank(X.index(spark, d).bm25(X.queries(spark, d))).select("query", "chunk", F.col("rn").cast("long").alias("rn"), R.rounded("score", 6).alias("score"))


@query(f"WITH {X.BM25_CTE} SELECT query, chunk, rn AS rank, round(1.0 / (60 + rn), 9) AS score FROM bm_rank WHERE rn <= 8")
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Keyword-only search, as without vectors."""
    return _hits(R.search(R.hybrid(X.index(spark, d).bm25(X.queries(spark, d)), None)))


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query", "chunk", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


def _order(spark: SparkSession, d: str, index: R.Index | None = None) -> DataFrame:
    index = index or X.index(spark, d)
    return R.hybrid(index.bm25(X.queries(spark, d)), R.cosines(X.query_vectors(spark, d), X.chunk_vectors(spark, d), R.COSINE_DEPTH))


@query(f"WITH {X.COSINE_CTE} SELECT query, chunk, round(cos, 6) AS cos FROM cos")
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    return R.cosines(X.query_vectors(spark, d), X.chunk_vectors(spark, d)).select("query", F.col("key").alias("chunk"), F.round("cos", 6).alias("cos"))


@query(f"WITH {X.COSINE_CTE} SELECT query, chunk, rn, round(cos, 6) AS cos FROM cos_rank WHERE rn <= 50")
def cosine_top(spark: SparkSession, d: str) -> DataFrame:
    cos = R.cosines(X.query_vectors(spark, d), X.chunk_vectors(spark, d), R.COSINE_DEPTH).select("query", F.col("key").alias("chunk"), F.col("cos").alias("score"))
    return R.rank(cos, most=R.COSINE_DEPTH).select("query", "chunk", F.col("rn").cast("long").alias("rn"), F.round("score", 6).alias("cos"))


@query(f"WITH {X.COSINE_CTE} SELECT query, round(greatest(-1, max(cos)), 6) AS best FROM cos GROUP BY query")
def best_cos(spark: SparkSession, d: str) -> DataFrame:
    return A.best_cosine(R.cosines(X.query_vectors(spark, d), X.chunk_vectors(spark, d), 1)).select("query", F.round("best", 6).alias("best"))


@query(f"WITH {X.HYBRID_CTE} SELECT query, chunk, rn, round(fused, 9) AS fused FROM ordered")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _order(spark, d).select("query", "chunk", F.col("rn").cast("long").alias("rn"), R.rounded("fused").alias("fused"))


@query(f"WITH {X.HYBRID_CTE} SELECT query, chunk, rn AS rank, round(1.0 / (60 + rn), 9) AS score FROM ordered WHERE rn <= 8")
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _hits(R.search(_order(spark, d)))


COVERAGE_CTE = f"""
cover_words AS (SELECT item_id AS query, unnest(list_filter({X.words_sql('text')}, lambda x: x NOT IN {X.STOP_SQL})) AS w FROM benchmark),
cover AS (SELECT b.item_id AS query, coalesce(avg(CASE WHEN w IS NULL THEN NULL WHEN {X.stem_sql('w')} IN (SELECT term FROM dfs) THEN 1.0 ELSE 0.0 END), 0) AS coverage
          FROM benchmark b LEFT JOIN cover_words ON query = b.item_id GROUP BY b.item_id)
"""


@query(f"WITH {X.BM25_CTE}, {COVERAGE_CTE} SELECT query, round(coverage, 6) AS coverage FROM cover")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage(X.queries(spark, d), X.index(spark, d)).select("query", F.round("coverage", 6).alias("coverage"))


SCOPE_CTE = f"""{X.HYBRID_CTE}, {COVERAGE_CTE}, best AS (SELECT query, greatest(-1, max(cos)) AS best FROM cos GROUP BY query),
scope AS (SELECT query, coverage * CASE WHEN best IS NULL THEN 1 ELSE least(1, greatest(0, best) / 0.3) END AS score FROM cover LEFT JOIN best USING (query))"""


def scope(spark: SparkSession, d: str, index: R.Index) -> DataFrame:
    best = A.best_cosine(R.cosines(X.query_vectors(spark, d), X.chunk_vectors(spark, d), 1))
    return A.scope_score(A.coverage(X.queries(spark, d), index), best)


@query(f"WITH {SCOPE_CTE} SELECT query, round(score, 6) AS score FROM scope")
def scope_score(spark: SparkSession, d: str) -> DataFrame:
    return scope(spark, d, X.index(spark, d)).select("query", F.round("score", 6).alias("score"))


@query(f"WITH {SCOPE_CTE} SELECT query FROM scope WHERE score < 0.55")
def out_of_scope(spark: SparkSession, d: str) -> DataFrame:
    return scope(spark, d, X.index(spark, d)).where(F.col("score") < A.OUT_OF_SCOPE).select("query")


# --- vectors --------------------------------------------------------------------------------------------------------


@query(
    f"SELECT vec_id, array_to_string(list_transform({X.QUANTIZE_SQL.replace('{v}', 'embedding')}, lambda x: x::INTEGER::VARCHAR), ',') AS q FROM embeddings")
def quantize_vectors(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(V.quantize(F.col("embedding")), lambda x: x.cast("string")), ",").alias("q"))


@query(
    "SELECT vec_id, round(s, 9) AS scale, array_to_string(list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::DOUBLE / s + 0.5)))::INTEGER::VARCHAR), ',') AS q "
    "FROM (SELECT *, CASE WHEN m > 0 THEN m / 127 ELSE 1e-8 END AS s FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings))"
)
def quantize_rows(spark: SparkSession, d: str) -> DataFrame:
    s = V.row_scale(F.col("embedding"))
    return X.table(spark, d, "embeddings").withColumn("s", s).select(
        "vec_id", F.round("s", 9).alias("scale"), F.array_join(F.transform(V.quantize_row(F.col("embedding"), F.col("s")), lambda x: x.cast("string")), ",").alias("q")
    )


@query(f"SELECT a.vec_id, round({X.dot_sql('a.embedding', 'b.embedding')}, 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_dot(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


@query(f"SELECT vec_id, round(sqrt({X.dot_sql('embedding', 'embedding')}), 6) AS norm FROM embeddings")
def row_norms(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(
    "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), "
    "s AS (SELECT label, i, sum(v) AS v FROM x GROUP BY label, i), n AS (SELECT label, sqrt(sum(v * v)) AS norm FROM s GROUP BY label) "
    "SELECT label, i::BIGINT - 1 AS dim, round(v / norm, 6) AS v FROM s JOIN n USING (label)"
)
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Unit mean vector of each label's rows."""
    x = X.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    s = x.groupBy("label", "dim").agg(F.sum(F.col("v").cast("double")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("label")))
    return s.select("label", F.col("dim").cast("long").alias("dim"), F.round(F.col("v") / norm, 6).alias("v"))


@query(
    "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) "
    "SELECT a.i::BIGINT - 1 AS i, b.i::BIGINT - 1 AS j, round(sum(a.v * b.v), 6) AS g FROM x a JOIN x b USING (vec_id) WHERE a.i <= b.i GROUP BY a.i, b.i"
)
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return E.gram(X.table(spark, d, "embeddings").select(F.col("embedding").alias("vector"))).where("i <= j").select("i", "j", F.round("g", 6).alias("g"))


@query()
def pca_inner_products(spark: SparkSession, d: str) -> DataFrame:
    """Inner products of neighbours after uncentered projection to 16 dimensions; signs of axes cancel."""
    rows = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    p = E.project(rows, E.principal_axes(rows, 16))
    after = p.select((F.col("key") - 1).alias("key"), F.col("vector").alias("other"))
    return p.join(after, "key").select(F.col("key").alias("vec_id"), F.round(V.dot(F.col("vector"), F.col("other")), 6).alias("dot"))


F16_SQL = (
    "SELECT bits, round(CASE WHEN e = 0 THEN s * f * pow(2.0, -24) ELSE s * (1 + f / 1024.0) * pow(2.0, e - 15) END, 9) AS value FROM ("
    "SELECT bits, CASE WHEN bits & 32768 <> 0 THEN -1.0 ELSE 1.0 END AS s, (bits >> 10) & 31 AS e, bits & 1023 AS f FROM (SELECT DISTINCT event_id % 65536 AS bits FROM events)) WHERE e <> 31"
)


@query(F16_SQL)
def f16_decode(spark: SparkSession, d: str) -> DataFrame:
    bits = X.table(spark, d, "events").select((F.col("event_id") % 65536).alias("bits")).distinct()
    finite = bits.where(F.shiftright("bits", 10).bitwiseAND(F.lit(31)) != 31)
    return finite.select("bits", F.round(V.f16_value(F.col("bits")), 9).alias("value"))


# --- a synthetic static embedder over the corpus vocabulary: words map to rows of the vector table -------------------

TOKEN_SQL = f"""
n_rows AS (SELECT count(*) AS n FROM embeddings),
vocab AS (SELECT DISTINCT unnest({X.words_sql('text')}) AS word FROM benchmark),
rows AS (SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % n AS vec_id FROM vocab, n_rows)
"""


def vocab_rows(spark: SparkSession, d: str) -> DataFrame:
    """(word, vec_id): every word of the questions has the vector row that its hash names."""
    v = X.table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    n = X.table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    return v.crossJoin(F.broadcast(n)).select("word", (F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % F.col("n")).alias("vec_id"))


@query(f"WITH {TOKEN_SQL} SELECT word, vec_id, round(embedding[1]::DOUBLE, 6) AS first_value FROM rows LEFT JOIN embeddings USING (vec_id)")
def token_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vocab_rows(spark, d).join(X.table(spark, d, "embeddings"), "vec_id", "left").select("word", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@query(
    f"WITH {TOKEN_SQL}, t AS (SELECT item_id AS query, unnest({X.words_sql('text')}) AS word FROM benchmark) "
    f"SELECT t.word, round(max(sqrt({X.dot_sql('embedding', 'embedding')})), 6) AS weight FROM t JOIN rows USING (word) JOIN embeddings USING (vec_id) GROUP BY t.word"
)
def word_weight(spark: SparkSession, d: str) -> DataFrame:
    joined = vocab_rows(spark, d).join(X.table(spark, d, "embeddings"), "vec_id")
    return joined.groupBy("word").agg(F.round(F.max(V.norm(F.col("embedding"))), 6).alias("weight"))


EVAL_SQL = f"""WITH {SCOPE_CTE},
truth AS (SELECT item_id AS query, doc_id AS chunk FROM benchmark b JOIN documents x ON contains(x.text, b.text)),
judged AS (SELECT b.item_id AS query,
  coalesce((SELECT bool_or(o.rn <= 1) FROM ordered o JOIN truth t USING (query, chunk) WHERE o.query = b.item_id), false) AS hyb1,
  coalesce((SELECT bool_or(o.rn <= 3) FROM ordered o JOIN truth t USING (query, chunk) WHERE o.query = b.item_id), false) AS hyb3,
  coalesce((SELECT bool_or(o.rn <= 1) FROM bm_rank o JOIN truth t USING (query, chunk) WHERE o.query = b.item_id), false) AS bm1,
  coalesce((SELECT bool_or(o.rn <= 3) FROM bm_rank o JOIN truth t USING (query, chunk) WHERE o.query = b.item_id), false) AS bm3
  FROM benchmark b WHERE b.item_id IN (SELECT query FROM truth)),
sorted AS (SELECT list_sort(list(round(score, 6))) AS s FROM scope JOIN judged USING (query))
SELECT count(*) AS n, sum(hyb1::INT)::BIGINT AS hybrid_1, sum(hyb3::INT)::BIGINT AS hybrid_3, sum(bm1::INT)::BIGINT AS bm25_1, sum(bm3::INT)::BIGINT AS bm25_3,
  sum((s.score >= 0.55)::INT)::BIGINT AS kept, max(sorted.s[floor(0.1 * len(sorted.s))::INT + 1]) AS score_p10 FROM judged JOIN scope s USING (query), sorted"""


@query(EVAL_SQL)
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    """hit@1 and hit@3 of hybrid and keyword search, and what the scope rule keeps; a chunk is right if it holds the item."""
    index = X.index(spark, d)
    asked = X.queries(spark, d)
    bm = R.rank(index.bm25(asked))
    order = _order(spark, d, index)
    # the chunk of a right answer has all of the question's terms, so candidates come from the ranking, not a cross join
    cand = order.select("query", "chunk", "rn").join(asked.select("query", F.col("text").alias("item")), "query").join(index.chunks.select("chunk", "text"), "chunk")
    truth = cand.where(F.contains("text", "item")).select("query", "chunk", "rn")
    first = truth.join(bm.select("query", "chunk", F.col("rn").alias("bm")), ["query", "chunk"], "left").groupBy("query").agg(F.min("rn").alias("h"), F.min("bm").alias("b"))
    judged = first.join(scope(spark, d, index), "query")
    hit = lambda c, k: F.sum(F.when(F.col(c) <= k, 1).otherwise(0)).alias
    return judged.agg(
        F.count("*").alias("n"), hit("h", 1)("hybrid_1"), hit("h", 3)("hybrid_3"), hit("b", 1)("bm25_1"), hit("b", 3)("bm25_3"),
        F.sum(F.when(F.col("score") >= A.OUT_OF_SCOPE, 1).otherwise(0)).alias("kept"),
        F.sort_array(F.collect_list(F.round("score", 6))).alias("s"),
    ).select("n", "hybrid_1", "hybrid_3", "bm25_1", "bm25_3", "kept", F.get("s", F.floor(F.size("s") * 0.1).cast("int")).alias("score_p10"))

