"""Document model: sections, ids, paths, chunks, sentences. Lines are blocks; short lines are headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import document as D
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


#: A line of one to three words is a heading of that level.
BLOCKS_CTE = r"""
cut AS (SELECT doc_id AS doc, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
blocks AS (SELECT *, CASE WHEN n BETWEEN 1 AND 3 THEN n END AS level FROM (SELECT *, len(regexp_extract_all(text, '\S+')) AS n FROM cut)),
sectioned AS (SELECT *, 'b' || (row_number() OVER (PARTITION BY doc ORDER BY pos) - 1) AS block_id,
  (sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos))::BIGINT AS section_no FROM blocks)
"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = D.lines(X.docs(spark, d), "source")
    n = F.regexp_count("text", F.lit(r"\S+"))
    return D.block_ids(D.sections(lines.withColumn("level", F.when(n.between(1, 3), n))))


@query(f"WITH {BLOCKS_CTE} SELECT doc, pos::BIGINT AS pos, block_id, md5(text) AS text_md5 FROM sectioned")
def scan_document_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("doc", F.col("pos").cast("long").alias("pos"), "block_id", F.md5("text").alias("text_md5"))


@query(f"WITH {BLOCKS_CTE} SELECT doc, section_no, min(pos)::BIGINT AS first_pos, count(*) AS n_blocks, CASE WHEN section_no = 0 THEN 'frontmatter' ELSE 'section' END AS type FROM sectioned GROUP BY doc, section_no")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    per = blocks(spark, d).groupBy("doc", "section_no").agg(F.min("pos").cast("long").alias("first_pos"), F.count("*").alias("n_blocks"))
    return per.withColumn("type", F.when(F.col("section_no") == 0, "frontmatter").otherwise("section"))


@query(f"WITH {BLOCKS_CTE} SELECT doc, section_no, count(*) AS n_blocks, max(block_id) AS last_id FROM sectioned GROUP BY doc, section_no")
def block_ids(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).groupBy("doc", "section_no").agg(F.count("*").alias("n_blocks"), F.max("block_id").alias("last_id"))


PATHS_CTE = f"""{BLOCKS_CTE},
heads AS (SELECT doc, section_no, pos, level, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title FROM sectioned WHERE level IS NOT NULL),
paths AS (SELECT h.doc, h.section_no, h.pos, h.level, list(o.title ORDER BY o.level) AS path FROM heads h JOIN heads o ON o.doc = h.doc AND o.pos <= h.pos
  AND o.level <= h.level AND NOT EXISTS (SELECT 1 FROM heads x WHERE x.doc = h.doc AND x.pos > o.pos AND x.pos <= h.pos AND x.level <= o.level)
  GROUP BY h.doc, h.section_no, h.pos, h.level)
"""


def headings(spark: SparkSession, d: str) -> DataFrame:
    h = blocks(spark, d).where("level is not null").select("doc", "section_no", "pos", "level", T.collapse(F.col("text")).alias("title"))
    return D.heading_paths(h)


@query(f"WITH {PATHS_CTE} SELECT doc, section_no, level::BIGINT AS level, array_to_string(path, ' > ') AS path FROM paths")
def heading_path(spark: SparkSession, d: str) -> DataFrame:
    return headings(spark, d).select("doc", "section_no", F.col("level").cast("long").alias("level"), F.array_join("heading_path", " > ").alias("path"))


@query(
    f"WITH {BLOCKS_CTE}, s AS (SELECT doc, pos, 'h' || level AS id FROM sectioned WHERE level IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY doc, id ORDER BY pos) AS k FROM s) "
    "SELECT doc, pos::BIGINT AS pos, CASE WHEN k = 1 THEN id ELSE id || '-' || k END AS unique_id FROM n"
)
def dedup_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = blocks(spark, d).where("level is not null").select("doc", "pos", F.concat(F.lit("h"), F.col("level").cast("string")).alias("id"))
    return D.unique_ids(ids).select("doc", F.col("pos").cast("long").alias("pos"), "unique_id")


CHUNKS_CTE = f"""{PATHS_CTE},
sized AS (SELECT *, {X.tokens_sql('text')} AS tokens FROM sectioned WHERE text <> ''),
runs AS (SELECT *, tokens > 300 AS piece, coalesce(sum((tokens > 300)::INT) OVER (PARTITION BY doc, section_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sized),
parts AS (SELECT doc, section_no, pos, block_id, piece, 2 * b + piece::INT AS run, unnest(l) AS text, generate_subscripts(l, 1) AS part
  FROM (SELECT *, CASE WHEN piece THEN {X.sentences_sql('text')} ELSE [text] END AS l FROM runs)),
units AS (SELECT *, {X.tokens_sql('text')} AS t, row_number() OVER (PARTITION BY doc, section_no ORDER BY pos, part) AS i FROM parts),
packed AS (
  SELECT doc, section_no, i, run, t AS total, 0 AS grp FROM units WHERE i = 1
  UNION ALL
  SELECT u.doc, u.section_no, u.i, u.run, CASE WHEN u.run <> p.run OR p.total + u.t > 300 THEN u.t ELSE p.total + u.t END,
         p.grp + CASE WHEN u.run <> p.run OR p.total + u.t > 300 THEN 1 ELSE 0 END
  FROM packed p JOIN units u ON u.doc = p.doc AND u.section_no = p.section_no AND u.i = p.i + 1),
grouped AS (SELECT u.*, p.grp FROM units u JOIN packed p USING (doc, section_no, i)),
per AS (SELECT doc, section_no, grp, sum(t) AS total, arg_min(block_id, i) AS first_block, arg_max(block_id, i) AS last_block FROM grouped GROUP BY ALL),
looked AS (SELECT *, lag(total) OVER w AS prev, lag(last_block) OVER w AS prev_block, lead(grp) OVER w AS nxt FROM per WINDOW w AS (PARTITION BY doc, section_no ORDER BY grp)),
moved AS (SELECT doc, section_no, grp, CASE WHEN nxt IS NULL AND prev IS NOT NULL AND total * 2 < 150 AND total + prev <= 375 AND first_block <> prev_block THEN grp - 1 ELSE grp END AS to_grp FROM looked),
merged AS (SELECT g.*, m.to_grp FROM grouped g JOIN moved m USING (doc, section_no, grp)),
glued AS (SELECT *, lag(block_id) OVER (PARTITION BY doc, section_no, to_grp ORDER BY i) AS before FROM merged),
chunks AS (SELECT doc, section_no, to_grp, string_agg(CASE WHEN before IS NULL THEN '' WHEN piece AND before = block_id THEN ' ' ELSE chr(10) END || text, '' ORDER BY i) AS text,
  list(block_id ORDER BY i) FILTER (before IS NULL OR before <> block_id) AS blocks FROM glued GROUP BY ALL),
numbered AS (SELECT *, 'c' || (row_number() OVER (PARTITION BY doc ORDER BY section_no, to_grp) - 1) AS chunk_id FROM chunks)
"""
CHUNKS = f"WITH RECURSIVE {CHUNKS_CTE}"


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return D.groups(D.units(blocks(spark, d)))


def chunked(spark: SparkSession, d: str) -> DataFrame:
    return D.chunks(D.merge_tails(grouped(spark, d)))


@query(f"{CHUNKS} SELECT doc, section_no, i::BIGINT AS i, grp::BIGINT AS grp, block_id FROM grouped")
def chunk_greedy(spark: SparkSession, d: str) -> DataFrame:
    return grouped(spark, d).select("doc", "section_no", F.col("i").cast("long").alias("i"), F.col("grp").cast("long").alias("grp"), "block_id")


@query(f"{CHUNKS} SELECT doc, section_no, to_grp::BIGINT AS grp, count(*) AS n_units, sum(t)::BIGINT AS tokens FROM merged GROUP BY doc, section_no, to_grp")
def chunk_tail_merge(spark: SparkSession, d: str) -> DataFrame:
    per = D.merge_tails(grouped(spark, d)).groupBy("doc", "section_no", F.col("grp").cast("long").alias("grp"))
    return per.agg(F.count("*").alias("n_units"), F.sum("tokens").cast("long").alias("tokens"))


@query(f"{CHUNKS} SELECT doc, section_no, chunk_id, md5(text) AS text_md5, array_to_string(blocks, ',') AS blocks, {X.tokens_sql('text')}::BIGINT AS tokens FROM numbered")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return chunked(spark, d).select("doc", "section_no", "chunk_id", F.md5("text").alias("text_md5"), F.array_join("blocks", ",").alias("blocks"), F.col("tokens").cast("long").alias("tokens"))


def with_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = headings(spark, d).select("doc", "section_no", "heading_path")
    empty = F.array().cast("array<string>")
    return chunked(spark, d).join(paths, ["doc", "section_no"], "left").withColumn("heading_path", F.coalesce("heading_path", empty))


@query(f"{CHUNKS} SELECT doc, chunk_id, md5(coalesce(array_to_string(path, chr(10)), '') || chr(10) || chr(10) || text) AS index_md5 FROM numbered LEFT JOIN paths USING (doc, section_no)")
def index_text(spark: SparkSession, d: str) -> DataFrame:
    return with_paths(spark, d).select("doc", "chunk_id", F.md5(D.index_text(F.col("heading_path"), F.col("text"))).alias("index_md5"))


@query(f"{CHUNKS} SELECT doc, chunk_id, coalesce(array_to_string(CASE WHEN len(path) > 1 THEN path[2:] ELSE path END, ' › '), '') AS breadcrumb FROM numbered LEFT JOIN paths USING (doc, section_no)")
def hit_breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    """The path without its first title, or all of it if there is no other."""
    rest = F.when(F.size("heading_path") > 1, F.slice("heading_path", 2, 99)).otherwise(F.col("heading_path"))
    return with_paths(spark, d).select("doc", "chunk_id", F.array_join(rest, " › ").alias("breadcrumb"))


SENTENCES_CTE = f"""{CHUNKS_CTE},
chunk_lines AS (SELECT doc, chunk_id, blocks, coalesce(path, []) AS path, string_split(text, chr(10)) AS l FROM numbered LEFT JOIN paths USING (doc, section_no)),
flat AS (SELECT doc, chunk_id, blocks, path, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM chunk_lines),
cut_lines AS (SELECT doc, chunk_id, k, CASE WHEN n = len(blocks) THEN blocks[k] ELSE blocks[1] END AS block_id, {X.sentences_sql('line')} AS s FROM flat WHERE NOT list_contains(path, trim(line))),
chunk_sents AS (SELECT * FROM (SELECT doc, chunk_id, k - 1 AS line_no, block_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sentence_no FROM cut_lines) WHERE len(regexp_split_to_array(sentence, '\\s+')) >= 4)
"""


@query(f"WITH RECURSIVE {SENTENCES_CTE} SELECT doc, chunk_id, line_no::BIGINT AS line_no, sentence_no::BIGINT AS sentence_no, block_id, md5(sentence) AS sentence_md5 FROM chunk_sents")
def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = with_paths(spark, d).select("doc", "chunk_id", "text", "blocks", "heading_path")
    return D.chunk_sentences(rows).select("doc", "chunk_id", F.col("line_no").cast("long").alias("line_no"), F.col("sentence_no").cast("long").alias("sentence_no"), "block_id", F.md5("sentence").alias("sentence_md5"))


@query(
    "WITH v AS (SELECT event_id, user_id, ts, event_type FROM events), t AS (SELECT user_id, ts AS at FROM events WHERE event_type = (SELECT min(event_type) FROM events)) "
    "SELECT t.user_id, t.at, arg_max(v.event_id, struct_pack(a := v.ts, b := v.event_id)) AS section FROM (SELECT DISTINCT * FROM t) t JOIN v ON v.user_id = t.user_id AND v.ts <= t.at GROUP BY t.user_id, t.at"
)
def section_in_view(spark: SparkSession, d: str) -> DataFrame:
    """As-of lookup: the last section top at or before a place; tops and places are a user's events by time.

    One sort by (user, time) and a running last value, instead of an inequality join.
    """
    from quarry.operators.asof import latest

    e = X.table(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("k"))
    places = e.join(F.broadcast(kind), e["event_type"] == F.col("k")).select("user_id", F.col("ts").alias("at")).distinct()
    return latest(places, e.select("user_id", "ts", "event_id"), "user_id", "at", "ts", "event_id").select("user_id", "at", F.col("event_id").alias("section"))


@query(
    f"WITH {BLOCKS_CTE} SELECT doc, sum(len(regexp_extract_all(text, 'data:image/[^\"''\\s)]+')))::BIGINT AS n_images, sum(strlen(text))::BIGINT AS bytes FROM sectioned GROUP BY doc"
)
def content_sizes(spark: SparkSession, d: str) -> DataFrame:
    images = F.size(F.regexp_extract_all("text", F.lit(r"data:image/[^\"'\s)]+"), F.lit(0)))
    return blocks(spark, d).groupBy("doc").agg(F.sum(images).cast("long").alias("n_images"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))
