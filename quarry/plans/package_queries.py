"""Sources, sinks, sanitizer and validation over the driver's tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import embedder as E
from quarry.operators import package as P
from quarry.operators import sanitize as Z
from quarry.operators import validate as V
from quarry.plans import answer_queries as N
from quarry.plans import base as X
from quarry.plans import graph_queries as Q
from quarry.sources import blocks as B
from quarry.sources import markdown, tensors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- data blocks: each page carries its events and its url as blocks ------------------------------------------------

PACKED = (
    "packed AS (SELECT page_id, html || '<script type=\"application/url+json\" id=\"u\">{\"page\":' || page_id || '}</script>' || "
    "'<script type=\"application/data\" id=\"d\" data-encoding=\"base64\">' || to_base64(encode(url)) || '</script>' || '<script type=\"application/data\" id=\"u\">last</script>' AS html FROM pages)"
)
BLOCK_SQL = r"""'<script\s+([^>]*type="application/[^"]*"[^>]*)>([\s\S]*?)</script>'"""
BLOCKS_CTE = f"""{PACKED},
raw AS (SELECT page_id, regexp_extract_all(html, {BLOCK_SQL}, 1) AS a, regexp_extract_all(html, {BLOCK_SQL}, 2) AS t FROM packed),
flat AS (SELECT page_id, unnest(a) AS a, unnest(t) AS t, generate_subscripts(a, 1) - 1 AS pos FROM raw),
named AS (SELECT page_id, pos, regexp_extract(a, '(?:^|\\s)id="([^"]*)"', 1) AS id, regexp_extract(a, '(?:^|\\s)type="([^"]*)"', 1) AS type, t AS text FROM flat),
last AS (SELECT page_id, id, max(pos) AS pos, arg_max(type, pos) AS type, arg_max(text, pos) AS text FROM named GROUP BY page_id, id)
"""


def packed(spark: SparkSession, d: str) -> DataFrame:
    tail = F.concat(
        F.lit('<script type="application/url+json" id="u">{"page":'), F.col("page_id").cast("string"), F.lit("}</script>"),
        F.lit('<script type="application/data" id="d" data-encoding="base64">'), T.base64(F.encode("url", "UTF-8")), F.lit("</script>"),
        F.lit('<script type="application/data" id="u">last</script>'),
    )
    return X.table(spark, d, "pages").select("page_id", F.concat("html", tail).alias("html"))


@query(f"WITH {BLOCKS_CTE} SELECT page_id, pos::BIGINT AS pos, id, type, text FROM last")
def scan_inert_blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.scan(packed(spark, d), "page_id", "html").select("page_id", F.col("pos").cast("long").alias("pos"), "id", "type", "text")


@query(f"WITH {BLOCKS_CTE} SELECT page_id, decode(from_base64(text)) AS decoded FROM last WHERE id = 'd'")
def decode_block_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = B.scan(packed(spark, d), "page_id", "html").where("id = 'd'")
    return B.decode(rows).select("page_id", F.decode("bytes", "UTF-8").alias("decoded"))


@query("SELECT event_id, json_type(props) IS NOT NULL AS valid, list_sort(json_keys(props))[1] AS first_key FROM events")
def decode_json_block(spark: SparkSession, d: str) -> DataFrame:
    keys = F.sort_array(F.json_object_keys("props"))
    return X.table(spark, d, "events").select("event_id", keys.isNotNull().alias("valid"), F.get(keys, F.lit(0)).alias("first_key"))


@query("SELECT page_id AS id, 'sha256 mismatch' AS issue FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT page_id, 'unlisted block' FROM pages WHERE page_id % 7 = 1 UNION ALL SELECT -page_id - 1, 'missing block' FROM pages WHERE page_id % 7 = 2")
def verify_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Expected digests that are wrong for every seventh page, absent for others, and of pages that do not exist."""
    p = X.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    good = p.where("id % 7 <> 1").select("id", F.when(F.col("id") % 7 == 0, F.lit("wrong")).otherwise(T.sha256_base64(F.col("text"))).alias("sha256"))
    absent = p.where("id % 7 = 2").select((-F.col("id") - 1).alias("id"), F.lit("wrong").alias("sha256"))
    return B.verify(p, good.unionByName(absent))


@query("SELECT page_id AS id, 'sha256 mismatch' AS issue FROM pages WHERE page_id % 5 = 0")
def inspect_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose stored url digest in the manifest is not that of the url."""
    p = X.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text"))
    manifest = p.select("id", T.sha256_base64(F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))).alias("sha256"))
    return B.verify(p, manifest)


@query()
def bounded_gunzip(spark: SparkSession, d: str) -> DataFrame:
    """Pages gzipped, then decoded under a limit that longer ones exceed."""
    rows = B.encode(X.table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("raw")), "raw", -10.0)
    back = B.decode(rows.select("page_id", "raw", "block.text", "block.compression"), limit=4000)
    return back.select("page_id", F.octet_length("raw").cast("long").alias("n_raw"), (F.col("bytes") == F.col("raw")).alias("same"))


@query()
def binary_block_compress(spark: SparkSession, d: str) -> DataFrame:
    rows = B.encode(X.table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("raw")), "raw")
    return rows.select("page_id", "block.compression", F.octet_length("block.text").cast("long").alias("n_text"))


@query()
def scan_embedder(spark: SparkSession, d: str) -> DataFrame:
    """The vector table as an embedder payload per label, encoded and scanned back."""
    e = X.table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    files = e.groupBy(F.col("label").cast("string").alias("path")).applyInPandas(_payload, "path string, content binary")
    return tensors.scan_embedder(files).select("path", "row_id", F.round(F.col("scale").cast("double"), 9).alias("scale"), F.get("q", F.lit(0)).cast("long").alias("first"))


def _payload(key, pdf):
    x = np.stack(pdf.sort_values("vec_id")["embedding"].to_numpy())
    q, s = E.quantize_rows(x)
    header = {"format": E.FORMAT, "model": "rows", "dims": x.shape[1], "rows": len(x), "tokenizer": {"vocab": [str(i) for i in range(len(x))]}}
    return pd.DataFrame({"path": [key[0]], "content": [E.encode(E.Payload(header, q, s))]})


@query()
def scan_safetensors(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    files = e.groupBy(F.col("label").cast("string").alias("path")).applyInPandas(_tensor_file, "path string, content binary")
    return tensors.scan_safetensors(files, "embeddings").select("path", "row_id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


def _tensor_file(key, pdf):
    return pd.DataFrame({"path": [key[0]], "content": [tensors.write_tensor("embeddings", np.stack(pdf.sort_values("vec_id")["embedding"].to_numpy()))]})


# --- packaging ------------------------------------------------------------------------------------------------------


@query()
def package_html(spark: SparkSession, d: str) -> DataFrame:
    """One page per source with its documents as sections; only its digest and size are shown."""
    built = P.packages(X.docs(spark, d).select("source", "doc", "text"), "source", "doc", "text")
    return built.select("source", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("sha256"))


@query(
    "WITH s AS (SELECT 'documents' AS part, sum(strlen(text))::BIGINT AS bytes FROM documents UNION ALL SELECT 'pages', sum(strlen(html))::BIGINT FROM pages "
    "UNION ALL SELECT 'conversations', sum(strlen(text))::BIGINT FROM conversations) SELECT part, bytes, round(bytes * 100.0 / sum(bytes) OVER (), 3) AS share FROM s"
)
def size_report(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, c: X.table(spark, d, t).agg(F.sum(F.octet_length(c)).cast("long").alias("bytes")).select(F.lit(t).alias("part"), "bytes")
    sizes = part("documents", "text").unionByName(part("pages", "html")).unionByName(part("conversations", "text"))
    return P.size_report(sizes)


@query(
    f"WITH {Q.GRAPH_CTE} SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(DISTINCT conv_id) FROM conversations) AS faq, (SELECT count(*) FROM part) AS quiz, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges"
)
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    rows = one(X.table(spark, d, "documents"), "chunks")
    faq = X.table(spark, d, "conversations").agg(F.count_distinct("conv_id").alias("faq"))
    for other in (faq, one(N.quiz(spark, d), "quiz"), one(Q.nodes(spark, d), "nodes"), one(Q.edges(spark, d), "edges")):
        rows = rows.crossJoin(other)  # single rows
    return rows


@query()
def inline_images(spark: SparkSession, d: str) -> DataFrame:
    """Image sources of pages resolved against the vector table as a stand-in for image files; every seventh page names none."""
    stem = F.when(F.col("page_id") % 7 == 0, F.lit("none")).otherwise((F.col("page_id") % 50).cast("string"))
    wanted = X.table(spark, d, "pages").select("page_id", F.concat(F.lit("img/"), stem, F.element_at(F.array(*[F.lit(x) for x in (".png", ".jpg", ".bmp")]), (F.col("page_id") % 3 + 1).cast("int"))).alias("src"))
    files = X.table(spark, d, "embeddings").select(F.concat(F.lit("img/"), F.col("vec_id").cast("string")).alias("stem"), F.encode(F.col("vec_id").cast("string"), "UTF-8").alias("content"))
    return P.inline_images(wanted, files).select("page_id", "src", "data", "warning")


def _figures(h: pd.Series) -> pd.Series:
    return h.map(markdown.figure_text)


@query()
def figure_text(spark: SparkSession, d: str) -> DataFrame:
    """Figures made from page urls: a caption, an alternative text, or a drawing's title."""
    run = F.pandas_udf(_figures, "string")
    u = F.col("url")
    k = F.col("page_id") % 3
    fig = (
        F.when(k == 0, F.concat(F.lit("<figure><img alt='x'><figcaption>"), u, F.lit("</figcaption></figure>")))
        .when(k == 1, F.concat(F.lit("<figure><img alt='"), u, F.lit("'></figure>")))
        .otherwise(F.concat(F.lit("<figure><svg><title>"), u, F.lit("</title></svg></figure>")))
    )
    return X.table(spark, d, "pages").select("page_id", run(fig).alias("text"))


# --- sanitizer ------------------------------------------------------------------------------------------------------


@query()
def sanitize_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = Z.sanitize(X.table(spark, d, "pages").select("page_id", "html"), "html")
    return rows.select("page_id", F.md5("clean.html").alias("clean_md5"), F.size("clean.warnings").cast("long").alias("n_warnings"))


LINKS = "(SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"
TARGETS = f"(SELECT page_id, href FROM {LINKS} UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT page_id, ' java' || chr(9) || 'script:x' FROM pages UNION ALL SELECT page_id, '#a' FROM pages)"
CLEAN_SQL = r"regexp_replace(regexp_replace(href, '^[\x00- ]+|[\x00- ]+$', '', 'g'), '[\t\n\r]', '', 'g')"


@query(f"SELECT href, count(*) AS n FROM {TARGETS} WHERE NOT regexp_matches({CLEAN_SQL}, '(?i)^\\s*(javascript|vbscript|file):') AND ({CLEAN_SQL} LIKE '#%' OR regexp_matches({CLEAN_SQL}, '(?i)^(https?|mailto):')) GROUP BY href")
def link_filter(spark: SparkSession, d: str) -> DataFrame:
    p = X.table(spark, d, "pages")
    more = F.array(F.col("url"), F.lit(" java\tscript:x"), F.lit("#a"))
    links = p.select(F.explode(F.concat(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), more)).alias("href"))
    return links.where(Z.link_allowed(F.col("href"))).groupBy("href").agg(F.count("*").alias("n"))


IMAGES = "(SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'data:image/png;base64,' || to_base64(encode(url)) WHEN 1 THEN 'data:image/bmp;base64,AAAA' WHEN 2 THEN url ELSE 'DATA:image/SVG+xml;base64,AA==' END AS src FROM pages)"


@query(f"SELECT page_id, regexp_matches(src, '(?i)^data:image/(png|jpeg|gif|webp|avif|svg\\+xml);base64,[A-Za-z0-9+/=\\s]+$') AS kept FROM {IMAGES}")
def image_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    src = F.when(k == 0, F.concat(F.lit("data:image/png;base64,"), T.base64(F.encode("url", "UTF-8")))).when(k == 1, "data:image/bmp;base64,AAAA").when(k == 2, F.col("url")).otherwise("DATA:image/SVG+xml;base64,AA==")
    return X.table(spark, d, "pages").select("page_id", Z.image_allowed(src).alias("kept"))


ATTRIBUTES = "(SELECT page_id, ['a', 'img', 'td', 'p'][page_id % 4 + 1] AS tag, unnest(['href', 'src', 'class', 'onclick', 'style', 'data-x', 'aria-label', 'colspan', 'rel', 'id']) AS name FROM pages)"
ATTRIBUTE_RULE = "name IN ('id','class','title','lang','dir','role','hidden','translate') OR name LIKE 'aria-%' OR " + " OR ".join(
    f"(tag = '{t}' AND name IN ({','.join(repr(n) for n in names.split())}))" for t, names in Z.ELEMENT_ATTRIBUTES.items()
)


@query(f"SELECT tag, name, count(*) AS n FROM {ATTRIBUTES} WHERE NOT (name LIKE 'on%' OR name = 'style' OR name LIKE 'data-%') AND ({ATTRIBUTE_RULE}) GROUP BY tag, name")
def attr_filter(spark: SparkSession, d: str) -> DataFrame:
    tag = F.element_at(F.array(*[F.lit(t) for t in ("a", "img", "td", "p")]), (F.col("page_id") % 4 + 1).cast("int"))
    names = F.array(*[F.lit(n) for n in ("href", "src", "class", "onclick", "style", "data-x", "aria-label", "colspan", "rel", "id")])
    rows = X.table(spark, d, "pages").select(tag.alias("tag"), F.explode(names).alias("name"))
    return rows.where(Z.attribute_allowed(F.col("tag"), F.col("name"))).groupBy("tag", "name").agg(F.count("*").alias("n"))


# --- validation -----------------------------------------------------------------------------------------------------


@query("SELECT 'unknown document of label' AS message, doc_id::VARCHAR AS key FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 > 0) UNION ALL SELECT 'unknown customer of order', o_custkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0)")
def check_references(spark: SparkSession, d: str) -> DataFrame:
    """Labels and orders whose parents are missing, after every third document and fifth customer is taken away."""
    docs = X.table(spark, d, "documents").where("doc_id % 3 > 0")
    customers = X.table(spark, d, "customer").where("c_custkey % 5 > 0")
    labels = V.unknown(X.table(spark, d, "labels"), "doc_id", docs, "doc_id", "unknown document of label")
    return labels.unionByName(V.unknown(X.table(spark, d, "orders"), "o_custkey", customers, "c_custkey", "unknown customer of order"))


@query()
def check_content(spark: SparkSession, d: str) -> DataFrame:
    """All reference rules over quiz, stored questions and graph; every seventh part has a wrong answer index."""
    quiz = N.quiz(spark, d).select("quiz_id", "section_id", F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("c")).alias("options"), F.when(F.col("quiz_id") % 7 == 0, 9).otherwise(F.col("answer_index")).alias("answer_index"))
    sections = X.table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_brand").alias("section_id")).unionByName(X.table(spark, d, "region").select(F.col("r_name").alias("section_id")))
    faq = X.table(spark, d, "conversations").select(F.col("conv_id").alias("faq_id"), F.array(F.concat(F.lit("src"), (F.col("conv_id") % 30).cast("string"))).alias("sources"))
    return V.check_references(sections, quiz, faq, Q.nodes(spark, d), Q.edges(spark, d)).groupBy("message").agg(F.count("*").alias("n"))


@query("SELECT 'line of an order' AS message, l_orderkey || '|' || l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return V.duplicates(X.table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], "line of an order")


@query("SELECT event_id, member FROM (SELECT event_id, unnest(json_keys(props)) AS member FROM events) WHERE member NOT IN ('a') AND member NOT LIKE 'x-%'")
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    return V.unknown_members(X.table(spark, d, "events"), "event_id", "props", ["a"])


@query("SELECT 'chunk_characters' AS item, doc_id::VARCHAR AS key, length(text) AS value FROM documents WHERE length(text) > 10000 UNION ALL SELECT 'blocks_per_chunk', doc_id::VARCHAR, len(string_split(text, chr(10))) FROM documents WHERE len(string_split(text, chr(10))) > 1000")
def limit_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents")
    return V.over(docs, "doc_id", F.length("text"), "chunk_characters").unionByName(V.over(docs, "doc_id", F.size(F.split("text", "\n")), "blocks_per_chunk"))
