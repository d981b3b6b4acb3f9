"""Tables in the engine's roles, and the SQL fragments that say the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators.retrieval import Index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a chunk; its source is its section."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), "text", "lang", F.col("source").alias("section_id"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "lang", "source")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a question, in English."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text", F.lit("en").alias("lang"))


def index(spark: SparkSession, sf_dir: str) -> Index:
    return Index(chunks(spark, sf_dir)).keep()


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """int8 vectors of the documents whose id a vector has."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), V.quantize(F.col("embedding")).alias("vector"))
    return v.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), "key", "left_semi")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float vectors of the questions whose id a vector has."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query")), "query", "left_semi")


# --- the same for DuckDB -------------------------------------------------------------------------------------------

STOP_SQL = "(" + ",".join(f"'{w}'" for w in T.STOPWORDS) + ")"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(strip_accents({text})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def stem_sql(t: str) -> str:
    return (
        f"CASE WHEN length({t}) <= 3 THEN {t} "
        f"WHEN {t} LIKE '%ies' AND {t} NOT LIKE '%eies' AND {t} NOT LIKE '%aies' THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN {t} LIKE '%es' AND {t} NOT LIKE '%aes' AND {t} NOT LIKE '%ees' AND {t} NOT LIKE '%oes' THEN left({t}, length({t}) - 1) "
        f"WHEN {t} LIKE '%s' AND {t} NOT LIKE '%us' AND {t} NOT LIKE '%ss' THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def analyze_sql(text: str, english: str = "true") -> str:
    kept = f"list_filter({words_sql(text)}, lambda x: x NOT IN {STOP_SQL})"
    return f"CASE WHEN {english} THEN list_transform({kept}, lambda t: {stem_sql('t')}) ELSE {words_sql(text)} END"


SENTENCE_SQL = (
    "list_filter(list_transform(string_split(regexp_replace(regexp_replace({line}, "
    "'\\b((?i:e\\.g|i\\.e|etc|vs|cf|fig|al|approx|no|dr|mr|mrs|ms)\\.)(\\s)', '\\1' || chr(2) || '\\2', 'g'), "
    "'([.!?])\\s+([A-Z0-9\"“(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), "
    "lambda s: trim(replace(s, chr(2), ''), ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"
)


def sentences_sql(line: str) -> str:
    return SENTENCE_SQL.replace("{line}", line)


TOKENS_SQL = "len(regexp_extract_all({t}, '[\\p{P}!-/:-@\\[-`{-~]|[^\\p{P}!-/:-@\\[-`{-~\\s]+'))"


def tokens_sql(t: str) -> str:
    return TOKENS_SQL.replace("{t}", t)


#: tf, stats, q (query terms) and bm (BM25 scores), as common table expressions.
BM25_CTE = f"""
chunk_terms AS (SELECT doc_id AS chunk, unnest({analyze_sql('text', "lang = 'en'")}) AS term FROM documents),
tf AS (SELECT chunk, term, count(*) AS tf FROM chunk_terms GROUP BY ALL),
dl AS (SELECT chunk, sum(tf) AS dl FROM tf GROUP BY chunk),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM tf) / (SELECT count(*) FROM documents) AS avgdl),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT query, term FROM (SELECT item_id AS query, unnest({analyze_sql('text')}) AS term FROM benchmark)),
qidf AS (SELECT t.term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM (SELECT DISTINCT term FROM q) t LEFT JOIN dfs USING (term), stats),
bm AS (SELECT query, chunk, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM q JOIN tf USING (term) JOIN qidf USING (term) JOIN dl USING (chunk), stats GROUP BY query, chunk HAVING score > 0),
bm_rank AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk) AS rn FROM bm)
"""

QUANTIZE_SQL = "list_transform({v}, lambda x: greatest(-127, least(127, round(x::DOUBLE * 127))))"
DOT_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def dot_sql(a: str, b: str) -> str:
    return DOT_SQL.replace("{a}", a).replace("{b}", b)


COSINE_CTE = f"""
stored AS (SELECT vec_id AS chunk, {QUANTIZE_SQL.replace('{v}', 'embedding')} AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
asked AS (SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
cos AS (SELECT query, chunk, {dot_sql('asked.v', 'stored.v')} / 127 AS cos FROM asked, stored),
cos_rank AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cos, 9) DESC, chunk) AS rn FROM cos)
"""

HYBRID_CTE = f"""{BM25_CTE}, {COSINE_CTE},
fused AS (SELECT query, chunk, sum(1.0 / (60 + rn)) AS fused FROM (
  SELECT query, chunk, rn FROM bm_rank UNION ALL SELECT query, chunk, rn FROM cos_rank WHERE rn <= 50) GROUP BY query, chunk),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(fused, 9) DESC, chunk) AS rn FROM fused)
"""
