"""Text functions over the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import wordpiece
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


ANALYZED = X.analyze_sql("text", "lang = 'en'")


@query(f"SELECT doc_id, len(t)::BIGINT AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, {ANALYZED} AS t FROM documents)")
def analyze_text(spark: SparkSession, d: str) -> DataFrame:
    t = X.table(spark, d, "documents").select("doc_id", T.analyze(F.col("text"), F.col("lang")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


WORDS = f"(SELECT DISTINCT unnest({X.words_sql('text')}) AS w FROM documents)"


@query(f"SELECT w, {X.stem_sql('w')} AS stem FROM {WORDS}")
def s_stem(spark: SparkSession, d: str) -> DataFrame:
    w = X.table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    return w.select("w", T.s_stem(F.col("w")).alias("stem"))


@query(f"SELECT item_id, array_to_string(list_filter({X.words_sql('text')}, lambda x: x NOT IN {X.STOP_SQL}), ' ') AS kept FROM benchmark")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(T.words(F.col("text")), lambda w: ~T.is_stopword(w))
    return X.table(spark, d, "benchmark").select("item_id", F.array_join(kept, " ").alias("kept"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed_md5 FROM documents")
def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("collapsed_md5"))


TITLE = "string_split(text, chr(10))[1]"


def _title():
    return F.element_at(F.split("text", "\n"), 1)


@query(
    f"SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT doc_id, left(regexp_replace(regexp_replace(strip_accents(lower(trim(regexp_replace({TITLE}, '\\s+', ' ', 'g')))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64) AS s FROM documents)"
)
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", T.slug(_title()).alias("slug"))


@query(
    f"SELECT doc_id, 's-' || doc_id AS heading_id, trim(regexp_replace({TITLE}, '\\s+', ' ', 'g')) AS title FROM documents WHERE doc_id % 2 = 1 "
    f"UNION ALL SELECT doc_id, NULL, trim(regexp_replace({TITLE}, '\\s+', ' ', 'g')) FROM documents WHERE doc_id % 2 = 0"
)
def heading_ids(spark: SparkSession, d: str) -> DataFrame:
    """Titles of odd documents carry an explicit id."""
    explicit = F.when(F.col("doc_id") % 2 == 1, F.concat(_title(), F.lit(" {#s-"), F.col("doc_id").cast("string"), F.lit("}"))).otherwise(_title())
    rows = X.table(spark, d, "documents").select("doc_id", explicit.alias("h"))
    return rows.select("doc_id", T.heading_id(F.col("h")).alias("heading_id"), T.heading_title(F.col("h")).alias("title"))


@query(f"SELECT doc_id, {X.tokens_sql('text')}::BIGINT AS n_tokens FROM documents")
def pre_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", F.size(T.pre_tokenize(F.col("text"))).cast("long").alias("n_tokens"))


LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@query(f"SELECT doc_id, pos::BIGINT AS pos, i::BIGINT - 1 AS i, s AS sentence FROM (SELECT doc_id, pos, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, pos, {X.sentences_sql('line')} AS s FROM {LINES}))")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    lines = X.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    cut = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.posexplode(T.sentences(F.col("line"))).alias("i", "sentence"))
    return cut.withColumn("i", F.col("i").cast("long"))


@query(r"SELECT conv_id, turn, i::BIGINT - 1 AS i, p AS paragraph FROM (SELECT conv_id, turn, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM conversations))")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    out = X.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.paragraphs(F.col("text"))).alias("i", "paragraph"))
    return out.withColumn("i", F.col("i").cast("long"))


@query("SELECT doc_id, nullif(CASE WHEN w IN ('explain', 'describe', 'define') THEN 'what' ELSE w END, '') AS wh FROM (SELECT doc_id, lower(regexp_extract(text, '(?i)\\b(what|where|why|how|when|who|which|explain|describe|define)\\b', 1)) AS w FROM documents)")
def question_word(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", T.question_word(F.col("text")).alias("wh"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_md5 FROM pages")
def escape_html(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "pages").select("page_id", F.md5(T.escape_html(F.col("html"), quotes=True)).alias("escaped_md5"))


@query("SELECT page_id, contains(j, '<') AS has_bracket, j->>'$.url' = url AS round_trip FROM (SELECT page_id, url, replace(json_object('url', url, 'html', html)::VARCHAR, '<', '\\u003c') AS j FROM pages)")
def json_block_escape(spark: SparkSession, d: str) -> DataFrame:
    j = T.escape_json(F.to_json(F.struct("url", "html")))
    return X.table(spark, d, "pages").withColumn("j", j).select("page_id", F.contains("j", F.lit("<")).alias("has_bracket"), (F.get_json_object("j", "$.url") == F.col("url")).alias("round_trip"))


@query("SELECT page_id, to_base64(unhex(sha256(html))) AS sha FROM pages")
def sha256_b64(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "pages").select("page_id", T.sha256_base64(F.col("html")).alias("sha"))


@query(
    "SELECT page_id, 'default-src ''none''; script-src ''sha256-' || to_base64(unhex(sha256(html))) || '''; style-src ''sha256-' || to_base64(unhex(sha256(url))) || '''; img-src data:; connect-src ''none''; form-action ''none''; base-uri ''none''' AS csp FROM pages"
)
def csp_string(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "pages").select("page_id", T.csp(T.sha256_base64(F.col("html")), T.sha256_base64(F.col("url"))).alias("csp"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '2000-01-01' ELSE strftime(ts, '%Y-%m-%d') END AS created FROM events")
def created_date(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh date is unreadable and falls back."""
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("no date")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return X.table(spark, d, "events").select("event_id", T.iso_date(raw, F.lit("2000-01-01").cast("date")).alias("created"))


@query(
    r"SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE instr(t, s) END::BIGINT AS place FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, trim(regexp_replace(string_split(text, chr(10))[-1], '\s+', ' ', 'g')) AS s FROM documents)"
)
def locate_sentence(spark: SparkSession, d: str) -> DataFrame:
    """Where each document's last line stands."""
    return X.table(spark, d, "documents").select("doc_id", T.locate(F.col("text"), F.element_at(F.split("text", "\n"), -1)).cast("long").alias("place"))


def _tokenizer(spark: SparkSession, d: str) -> wordpiece.WordPiece:
    """A vocabulary by rule: the characters of all texts and the most frequent words, whole and as continuations."""
    words = X.table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").count()
    common = [r["w"] for r in words.orderBy(F.desc("count"), "w").limit(2000).collect()]
    letters = sorted({r["c"] for r in words.select(F.explode(F.split("w", "")).alias("c")).distinct().collect() if r["c"]})
    vocab = dict.fromkeys(["[UNK]", *letters, *("##" + c for c in letters), *common, *("##" + w for w in common[:500])])
    return wordpiece.WordPiece(list(vocab))


@query()
def wordpiece_ids(spark: SparkSession, d: str) -> DataFrame:
    out = wordpiece.encode(X.table(spark, d, "benchmark"), "text", _tokenizer(spark, d))
    return out.select("item_id", F.size("ids").cast("long").alias("n_tokens"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query()
def bert_normalize(spark: SparkSession, d: str) -> DataFrame:
    plain = wordpiece.WordPiece(["[UNK]"])
    return wordpiece.normalize(X.table(spark, d, "documents"), "text", plain).select("doc_id", F.md5("normalized").alias("normalized_md5"))


@query("SELECT i.item_id, doc_id FROM benchmark i JOIN documents x ON contains(x.text, i.text)")
def exact_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that quote an item whole: candidates share its longest inner word, then the text is compared.

    Signs may be glued to an item's first and last word; the inner ones are whole wherever it stands. Items without an
    inner word are compared with every text.
    """
    cut = F.split("text", r"\s+")
    inner = F.array_distinct(F.slice(cut, 2, F.greatest(F.size(cut) - 2, F.lit(0))))
    longest = F.try_element_at(F.sort_array(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), F.lit(1))["w"]
    stated = X.table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"), longest.alias("w"))
    items, short = stated.where("w is not null"), stated.where("w is null and item is not null").select("item_id", "item")
    words = X.table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w"))
    pairs = words.join(items, "w").select("doc_id", "item_id", "item").distinct()
    texts = X.table(spark, d, "documents").select("doc_id", "text")
    found = pairs.join(texts, "doc_id").where(F.contains("text", "item")).select("item_id", "doc_id")
    return found.unionByName(texts.join(short, F.contains("text", "item")).select("item_id", "doc_id"))


def _html_text(htmls: pd.Series) -> pd.Series:
    from quarry.sources.html import text_of

    return htmls.map(lambda h: None if h is None else text_of(h))


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.pandas_udf(_html_text, "string")
    return X.table(spark, d, "pages").select("page_id", T.collapse(text(F.col("html"))).alias("text"))
