"""Answers over the driver's tables. Sources are sections; conversations are stored questions and section content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import answers as A
from quarry.operators import document as D
from quarry.operators import graph as G
from quarry.operators import retrieval as R
from quarry.operators.tables import stored
from quarry.plans import base as X
from quarry.plans import graph_queries as Q
from quarry.plans import retrieval_queries as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- sentences of chunks (documents) --------------------------------------------------------------------------------

SENTS_CTE = f"""
dlines AS (SELECT doc_id AS chunk, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
dsents AS (SELECT chunk, lang, source, line_no, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS k FROM (SELECT *, {X.sentences_sql('line')} AS s FROM dlines)),
sents AS (SELECT chunk, lang, source, 'b' || line_no AS block_id, sentence, line_no * 100000 + k AS sentence_pos FROM dsents WHERE len(regexp_split_to_array(sentence, '\\s+')) >= 4)
"""


def sentences(chunks: DataFrame) -> DataFrame:
    """(chunk, lang, section_id, sentence_pos, block_id, sentence); lines are blocks and there are no heading lines."""
    n = F.size(F.split("text", "\n"))
    rows = chunks.select("chunk", "lang", "section_id", "text", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("b"), i.cast("string"))).alias("blocks"), F.array().cast("array<string>").alias("heading_path"))
    cut = D.chunk_sentences(rows)
    return cut.select("chunk", "lang", "section_id", (F.col("line_no") * 100000 + F.col("sentence_no")).alias("sentence_pos"), "block_id", "sentence")


SCORES_CTE = f"""{X.HYBRID_CTE}, {SENTS_CTE},
idf_sum AS (SELECT query, sum(idf) AS idf_sum FROM q JOIN qidf USING (term) GROUP BY query),
top AS (SELECT query, chunk, rn FROM ordered WHERE rn <= 3),
terms_of AS (SELECT s.chunk, s.sentence_pos, list_distinct({X.analyze_sql('sentence', "lang = 'en'")}) AS terms FROM sents s WHERE chunk IN (SELECT chunk FROM top)),
lex AS (SELECT t.query, t.chunk, s.sentence_pos, coalesce(sum(CASE WHEN list_contains(s.terms, q.term) THEN idf END), 0) AS lex FROM top t JOIN terms_of s USING (chunk) LEFT JOIN q ON q.query = t.query LEFT JOIN qidf USING (term) GROUP BY ALL),
scored AS (SELECT l.query, l.chunk, t.rn, l.sentence_pos, s.block_id, s.sentence, s.source, 0.6 * CASE WHEN idf_sum > 0 THEN lex / idf_sum ELSE lex END + 0.04 * greatest(0, 3 - t.rn) AS score
  FROM lex l JOIN top t USING (query, chunk) JOIN sents s USING (chunk, sentence_pos) LEFT JOIN idf_sum i ON i.query = l.query),
ranked AS (SELECT *, row_number() OVER w AS k, first_value(score) OVER w AS top_score, first_value(chunk) OVER w AS top_chunk FROM scored WINDOW w AS (PARTITION BY query ORDER BY round(score, 9) DESC, rn, sentence_pos)),
near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY k) AS n FROM ranked WHERE chunk = top_chunk AND (k = 1 OR round(score, 9) >= round(top_score * 0.85, 9))),
picked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY chunk, sentence_pos) AS place FROM near WHERE n <= 3)
"""


class Plan:
    """What several answers share: one index, one order, the scored sentences."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.index = X.index(spark, d)
        self.asked = X.queries(spark, d)
        # no answer looks past the first eight chunks; only those are cut into sentences
        self.order = S._order(spark, d, self.index).where("rn <= 8").persist()
        wanted = self.order.select("chunk").distinct()
        self.sentences = sentences(self.index.chunks.join(wanted, "chunk", "left_semi"))

    def scored(self, window: int = A.CHUNK_WINDOW, restrict: DataFrame | None = None) -> DataFrame:
        return A.sentence_scores(self.sentences, self.order, self.asked, self.index, window, restrict)

    def picked(self) -> DataFrame:
        return A.extract(self.scored())


@query(f"WITH {SCORES_CTE} SELECT query, place, chunk, block_id, md5(sentence) AS sentence_md5, round(score, 6) AS score FROM picked")
def extract_answer(spark: SparkSession, d: str) -> DataFrame:
    return Plan(spark, d).picked().select("query", F.col("place").cast("long").alias("place"), "chunk", "block_id", F.md5("sentence").alias("sentence_md5"), F.round("score", 6).alias("score"))


RESTRICT = "w AS (SELECT query, term FROM (SELECT query, term, row_number() OVER (PARTITION BY query ORDER BY term) AS k FROM q) WHERE k <= 2)"


@query(
    f"WITH {SCORES_CTE.replace('WHERE rn <= 3)', 'WHERE rn <= 5)', 1)}, {RESTRICT}, "
    "kept AS (SELECT s.* FROM scored s JOIN terms_of t USING (chunk, sentence_pos) WHERE EXISTS (SELECT 1 FROM w WHERE w.query = s.query AND list_contains(t.terms, w.term))), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, rn, sentence_pos) AS place FROM kept) SELECT query, place, chunk, round(score, 6) AS score FROM r WHERE place <= 30"
)
def extract_restricted(spark: SparkSession, d: str) -> DataFrame:
    """The best 30 sentences of five chunks that have one of the question's first two terms."""
    p = Plan(spark, d)
    first = R.query_terms(p.asked).withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("term"))).where("k <= 2")
    out = A.extract(p.scored(5, first.select("query", "term")), 30)
    return out.select("query", F.col("place").cast("long").alias("place"), "chunk", F.round("score", 6).alias("score"))


@query(f"WITH {SCORES_CTE} SELECT query, source AS section_id, 'Section ' || source AS title, arg_min(block_id, place) AS block_id FROM picked GROUP BY query, source")
def citations(spark: SparkSession, d: str) -> DataFrame:
    p = Plan(spark, d)
    cited = p.picked().join(p.index.chunks.select("chunk", "section_id"), "chunk")
    return A.citations(cited, sections(spark, d)).select("query", "section_id", "title", "block_id")


def sections(spark: SparkSession, d: str) -> DataFrame:
    s = X.table(spark, d, "documents").select(F.col("source").alias("section_id")).distinct()
    return s.withColumn("title", F.concat(F.lit("Section "), F.col("section_id")))


@query(f"WITH {SCORES_CTE}, m AS (SELECT query, chunk, rn, row_number() OVER (PARTITION BY query ORDER BY rn) AS k FROM ordered WHERE rn <= 5 AND (query, chunk) NOT IN (SELECT (query, chunk) FROM picked)) SELECT query, chunk, rn FROM m WHERE k <= 3")
def more_hits(spark: SparkSession, d: str) -> DataFrame:
    p = Plan(spark, d)
    return A.more_hits(p.order, p.picked()).withColumn("rn", F.col("rn").cast("long"))


SNIPPET_CTE = f"""{X.HYBRID_CTE}, {SENTS_CTE},
hits AS (SELECT query, chunk, rn FROM ordered WHERE rn <= 8),
st AS (SELECT chunk, sentence_pos, sentence, list_distinct({X.analyze_sql('sentence', "lang = 'en'")}) AS terms FROM sents WHERE chunk IN (SELECT chunk FROM hits)),
sw AS (SELECT h.query, h.chunk, s.sentence_pos, any_value(s.sentence) AS sentence, coalesce(sum(CASE WHEN list_contains(s.terms, q.term) THEN idf END), 0) AS w FROM hits h JOIN st s USING (chunk) LEFT JOIN q ON q.query = h.query LEFT JOIN qidf USING (term) GROUP BY ALL),
bs AS (SELECT query, chunk, arg_max(sentence, (round(w, 9), -sentence_pos)) AS sentence FROM sw GROUP BY query, chunk),
sn AS (SELECT h.query, h.chunk, h.rn, coalesce(b.sentence, left(x.text, 200)) AS s FROM hits h LEFT JOIN bs b USING (query, chunk) JOIN documents x ON x.doc_id = h.chunk)
"""


@query(f"WITH {SNIPPET_CTE} SELECT query, chunk, CASE WHEN length(s) > 220 THEN left(s, 217) || '…' ELSE s END AS snippet FROM sn")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    p = Plan(spark, d)
    hits = R.search(p.order).select("query", "chunk")
    return A.snippets(hits, p.sentences.select("chunk", "lang", "sentence_pos", "sentence"), p.index.chunks, p.asked.select("query", F.col("text"), F.col("lang")), p.index)


# --- stored questions -----------------------------------------------------------------------------------------------

FAQ_CTE = f"""
users AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
faq AS (SELECT u.conv_id AS faq, u.text AS question, (SELECT arg_min(a.text, a.turn) FROM conversations a WHERE a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn) AS answer FROM users u WHERE k = 1),
variants AS (SELECT conv_id AS faq, k, text, nullif(CASE WHEN w IN ('explain', 'describe', 'define') THEN 'what' ELSE w END, '') AS wh FROM
  (SELECT *, lower(regexp_extract(text, '(?i)\\b(what|where|why|how|when|who|which|explain|describe|define)\\b', 1)) AS w FROM users)),
qwh AS (SELECT item_id AS query, nullif(CASE WHEN w IN ('explain', 'describe', 'define') THEN 'what' ELSE w END, '') AS wh FROM
  (SELECT *, lower(regexp_extract(text, '(?i)\\b(what|where|why|how|when|who|which|explain|describe|define)\\b', 1)) AS w FROM benchmark)),
fq AS (SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
fcos AS (SELECT query, faq, CASE WHEN k = 1 THEN {X.dot_sql('fq.v', X.QUANTIZE_SQL.replace('{v}', 'e.embedding'))} / 127 ELSE {X.dot_sql('fq.v', 'e.embedding')} END
    - CASE WHEN qwh.wh IS NOT NULL AND variants.wh IS NOT NULL AND qwh.wh <> variants.wh THEN 0.1 ELSE 0 END AS s
  FROM fq JOIN qwh USING (query), variants JOIN embeddings e ON e.vec_id = faq + 100 * (k - 1)),
fbest AS (SELECT query, faq, max(s) AS s FROM fcos GROUP BY query, faq),
fmatch AS (SELECT query, arg_max(faq, (round(s, 9), -faq)) AS faq, max(s) AS score FROM fbest GROUP BY query),
fterms AS (SELECT conv_id AS faq, list_distinct(flatten(list({X.analyze_sql('text')}))) AS terms FROM users GROUP BY conv_id),
fcover AS (SELECT query, faq, score, CASE WHEN len(t) > 0 THEN len(list_intersect(t, terms)) / len(t) ELSE 0 END AS coverage
  FROM fmatch JOIN fterms USING (faq) JOIN (SELECT item_id AS query, list_distinct({X.analyze_sql('text')}) AS t FROM benchmark) USING (query))
"""


def faq_variants(spark: SparkSession, d: str) -> DataFrame:
    """(faq, k, text): a conversation's user turns; the first is the stored question, the others are alternates."""
    c = X.table(spark, d, "conversations").where("role = 'user'")
    return c.select(F.col("conv_id").alias("faq"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("k"), "text")


@query(f"WITH {FAQ_CTE} SELECT faq, question, answer FROM faq")
def scan_generated_faq(spark: SparkSession, d: str) -> DataFrame:
    c = X.table(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    answer = F.first(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(later)
    turns = c.select("conv_id", "turn", "role", F.col("text").alias("question"), answer.alias("answer"))
    first = turns.where("role = 'user'").withColumn("k", F.row_number().over(order)).where("k = 1")
    return first.select(F.col("conv_id").alias("faq"), "question", "answer")


def matched(spark: SparkSession, d: str) -> DataFrame:
    """(query, faq, score); stored questions are int8, alternates float vectors."""
    v = faq_variants(spark, d).select("faq", "k", T.question_word(F.col("text")).alias("variant_wh"), (F.col("faq") + 100 * (F.col("k") - 1)).alias("vec_id"))
    e = X.table(spark, d, "embeddings").select("vec_id", "embedding")
    rows = v.join(e, "vec_id")
    stored = rows.where("k = 1").select(F.struct("faq", "k", "variant_wh").alias("key"), V.quantize(F.col("embedding")).alias("vector"))
    # alternates are scaled as if they were int8, so one kernel scores both
    other = rows.where("k > 1").select(F.struct("faq", "k", "variant_wh").alias("key"), F.transform("embedding", lambda x: x.cast("double") * 127).alias("vector"))
    asked = X.query_vectors(spark, d)
    cos = R.cosines(asked, stored).unionByName(R.cosines(asked, other))
    wh = X.queries(spark, d).select("query", T.question_word(F.col("text")).alias("asked_wh"))
    return A.match_faq(cos.join(wh, "query").select("query", "key.faq", "cos", "asked_wh", "key.variant_wh"))


@query(f"WITH {FAQ_CTE} SELECT query, faq, round(score, 6) AS score FROM fmatch")
def faq_match(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).select("query", "faq", F.round("score", 6).alias("score"))


def covered(spark: SparkSession, d: str) -> DataFrame:
    terms = faq_variants(spark, d).groupBy("faq").agg(F.array_distinct(F.flatten(F.collect_list(T.analyze(F.col("text"))))).alias("f_terms"))
    asked = X.queries(spark, d).select("query", T.analyze(F.col("text")).alias("q_terms"))
    joined = matched(spark, d).join(terms, "faq").join(asked, "query")
    return joined.select("query", "faq", "score", A.faq_coverage(F.col("q_terms"), F.col("f_terms")).alias("coverage"))


@query(f"WITH {FAQ_CTE} SELECT query, faq, round(coverage, 6) AS coverage FROM fcover")
def faq_coverage(spark: SparkSession, d: str) -> DataFrame:
    return covered(spark, d).select("query", "faq", F.round("coverage", 6).alias("coverage"))


# --- composites -----------------------------------------------------------------------------------------------------

KIND_CTE = f"""{SCORES_CTE}, {S.COVERAGE_CTE}, best AS (SELECT query, greatest(-1, max(cos)) AS best FROM cos GROUP BY query),
scope AS (SELECT query, coverage * CASE WHEN best IS NULL THEN 1 ELSE least(1, greatest(0, best) / 0.3) END AS score FROM cover LEFT JOIN best USING (query)), {FAQ_CTE},
np AS (SELECT query, count(*) AS n FROM picked GROUP BY query),
kinds AS (SELECT s.query, CASE WHEN s.score < 0.55 THEN 'notCovered' WHEN f.score >= 0.75 AND f.coverage >= 0.5 THEN 'faq' WHEN coalesce(n, 0) > 0 THEN 'extract' ELSE 'notCovered' END AS kind, f.faq
  FROM scope s LEFT JOIN fcover f USING (query) LEFT JOIN np USING (query))
"""


def kinds(spark: SparkSession, d: str, p: Plan, picked: DataFrame) -> DataFrame:
    """(query, kind, faq)."""
    n = picked.groupBy("query").agg(F.count("*").alias("n"))
    f = covered(spark, d).select("query", "faq", F.col("score").alias("faq_score"), F.col("coverage").alias("faq_cover"))
    s = S.scope(spark, d, p.index).join(f, "query", "left").join(n, "query", "left")
    return s.select("query", A.question_kind(F.col("score"), F.col("faq_score"), F.col("faq_cover"), F.col("n")).alias("kind"), "faq")


@query(f"WITH {KIND_CTE} SELECT k.query, kind, CASE WHEN kind = 'faq' THEN k.faq END AS faq, CASE WHEN kind = 'extract' THEN md5(t) END AS text_md5 FROM kinds k LEFT JOIN (SELECT query, string_agg(sentence, ' ' ORDER BY place) AS t FROM picked GROUP BY query) p USING (query)")
def answer_question(spark: SparkSession, d: str) -> DataFrame:
    p = Plan(spark, d)
    picked = p.picked()
    text = picked.groupBy("query").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sentence"))), lambda s: s["sentence"]), " ").alias("t"))
    return kinds(spark, d, p, picked).join(text, "query", "left").select(
        "query", "kind", F.when(F.col("kind") == "faq", F.col("faq")).alias("faq"), F.when(F.col("kind") == "extract", F.md5("t")).alias("text_md5")
    )


@query(f"WITH {S.SCOPE_CTE} SELECT o.query, CASE WHEN s.score < 0.55 THEN 'notCovered' ELSE 'search' END AS kind, o.rn AS rank, o.chunk FROM ordered o JOIN scope s USING (query) WHERE o.rn <= CASE WHEN s.score < 0.55 THEN 3 ELSE 8 END")
def answer_find(spark: SparkSession, d: str) -> DataFrame:
    """Search hits; out of scope only the first three, as closest passages."""
    index = X.index(spark, d)
    hits = R.search(S._order(spark, d, index)).join(S.scope(spark, d, index).withColumnRenamed("score", "scope"), "query")
    out = F.col("scope") < A.OUT_OF_SCOPE
    kept = hits.where(F.col("rank") <= F.when(out, 3).otherwise(8))
    return kept.select("query", F.when(out, "notCovered").otherwise("search").alias("kind"), F.col("rank").cast("long").alias("rank"), "chunk")


# stored content: a section's (source's) summary is the first line of its first document, and so on
CONTENT_CTE = """
firsts AS (SELECT source AS section_id, arg_min(text, doc_id) AS text, count(*) AS n FROM documents GROUP BY source),
content AS (SELECT section_id, string_split(text, chr(10))[1] AS summary, CASE WHEN n % 2 = 0 THEN string_split(text, chr(10))[-1] END AS simple,
  CASE WHEN len(string_split(text, chr(10))) > 1 THEN string_split(text, chr(10))[1:3] ELSE [] END AS key_points FROM firsts),
modes AS (SELECT doc_id AS query, CASE doc_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'simple' ELSE 'keyPoints' END AS mode,
  CASE WHEN doc_id % 10 = 9 THEN NULL WHEN doc_id % 10 = 8 THEN 'nowhere' ELSE source END AS section_id FROM documents)
"""


def content(spark: SparkSession, d: str) -> DataFrame:
    first = X.table(spark, d, "documents").groupBy(F.col("source").alias("section_id")).agg(F.min_by("text", "doc_id").alias("text"), F.count("*").alias("n"))
    lines = F.split("text", "\n")
    points = F.when(F.size(lines) > 1, F.slice(lines, 1, 3)).otherwise(F.array().cast("array<string>"))
    return first.select("section_id", F.element_at(lines, 1).alias("summary"), F.when(F.col("n") % 2 == 0, F.element_at(lines, -1)).alias("simple"), points.alias("key_points"))


def modes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    mode = F.when(k % 3 == 0, "summary").when(k % 3 == 1, "simple").otherwise("keyPoints")
    section = F.when(k % 10 == 9, F.lit(None)).when(k % 10 == 8, F.lit("nowhere")).otherwise(F.col("source"))
    return X.table(spark, d, "documents").select(k.alias("query"), mode.alias("mode"), section.alias("section_id"))


NO_SECTION = 'Scroll to a section or name one, for example "summarize attention".'


@query(
    f"WITH {CONTENT_CTE}, j AS (SELECT m.*, CASE mode WHEN 'simple' THEN simple WHEN 'keyPoints' THEN array_to_string(key_points, chr(10)) ELSE summary END AS t FROM modes m LEFT JOIN content USING (section_id)) "
    "SELECT query, CASE WHEN section_id IS NOT NULL AND coalesce(t, '') <> '' THEN 'generated' ELSE 'message' END AS kind, "
    "CASE WHEN section_id IS NOT NULL AND coalesce(t, '') <> '' THEN t WHEN section_id IS NULL THEN '" + NO_SECTION + "' ELSE "
    "'The author didn''t prepare a ' || CASE mode WHEN 'simple' THEN 'simple explanation' WHEN 'keyPoints' THEN 'list of key points' ELSE 'summary' END || ' for \"' || CASE WHEN section_id = 'nowhere' THEN section_id ELSE 'Section ' || section_id END || '\".' END AS text FROM j"
)
def section_summary(spark: SparkSession, d: str) -> DataFrame:
    asked = modes(spark, d).join(sections(spark, d), "section_id", "left")
    return A.stored_content(asked, content(spark, d))


@query(f"WITH {CONTENT_CTE} SELECT section_id, 'Section ' || section_id AS title, ({X.sentences_sql('summary')})[1] AS text FROM content WHERE coalesce(summary, '') <> ''")
def doc_summary(spark: SparkSession, d: str) -> DataFrame:
    c = content(spark, d).where(F.coalesce("summary", F.lit("")) != "")
    return c.join(sections(spark, d), "section_id").select("section_id", "title", F.get(T.sentences(F.col("summary")), F.lit(0)).alias("text"))


QUIZ_CTE = "quiz AS (SELECT p_partkey AS quiz_id, p_brand AS section_id, 'What type is ' || p_name || '?' AS question, p_partkey % 4 AS answer_index FROM part)"


def quiz(spark: SparkSession, d: str) -> DataFrame:
    """Parts ask for their type; brands are sections."""
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("quiz_id"), F.col("p_brand").alias("section_id"), F.concat(F.lit("What type is "), F.col("p_name"), F.lit("?")).alias("question"), (F.col("p_partkey") % 4).alias("answer_index"))


@query(f"WITH {QUIZ_CTE} SELECT section_id, quiz_id, question FROM quiz")
def quiz_section(spark: SparkSession, d: str) -> DataFrame:
    return quiz(spark, d).select("section_id", "quiz_id", "question")


@query(f"WITH {QUIZ_CTE}, o AS (SELECT section_id, arg_max(quiz_id, (md5('7:' || quiz_id), quiz_id)) AS quiz_id FROM quiz GROUP BY section_id) SELECT section_id, quiz_id FROM o ORDER BY section_id LIMIT 10")
def quiz_document(spark: SparkSession, d: str) -> DataFrame:
    """One item per section, picked by a seeded hash; a document's quiz has ten at most."""
    key = F.struct(F.md5(F.concat(F.lit("7:"), F.col("quiz_id").cast("string"))), F.col("quiz_id"))
    return quiz(spark, d).groupBy("section_id").agg(F.max_by("quiz_id", key).alias("quiz_id")).orderBy("section_id").limit(10)


@query("SELECT user_id, count(*) AS answered, sum((event_id % 4 = hash_pick)::INT)::BIGINT AS score FROM (SELECT *, user_id % 4 AS hash_pick FROM events) GROUP BY user_id")
def quiz_score(spark: SparkSession, d: str) -> DataFrame:
    """A user's events are choices; the right one is the user's number modulo 4."""
    e = X.table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("answered"), F.sum((F.col("event_id") % 4 == F.col("user_id") % 4).cast("int")).cast("long").alias("score"))


@query(
    "WITH f AS (SELECT conv_id AS faq, text AS question, (SELECT source FROM documents WHERE doc_id = conv_id) AS section_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') WHERE k = 1), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY faq) AS k FROM f WHERE section_id IS NOT NULL) SELECT faq, section_id, question FROM r WHERE k = 1 ORDER BY faq LIMIT 4"
)
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Four stored questions, each the first of its section."""
    f = faq_variants(spark, d).where("k = 1").select("faq", F.col("text").alias("question"))
    sourced = f.join(X.table(spark, d, "documents").select(F.col("doc_id").alias("faq"), F.col("source").alias("section_id")), "faq").where("section_id is not null")
    first = sourced.groupBy("section_id").agg(F.min(F.struct("faq", "question")).alias("f"))
    return first.select("f.faq", "section_id", "f.question").orderBy("faq").limit(4)


LABEL_SQL = "CASE WHEN k = 'faq' THEN 'Prepared by the author' || CASE WHEN reviewed THEN '' ELSE ', not reviewed' END WHEN k IN ('extract', 'search') THEN 'Found in the document' ELSE '' END"


@query(f"SELECT event_id, {LABEL_SQL} AS label FROM (SELECT event_id, ['faq', 'extract', 'search', 'notCovered'][event_id % 4 + 1] AS k, user_id % 2 = 0 AS reviewed FROM events)")
def answer_labels(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("faq", "extract", "search", "notCovered")]), (F.col("event_id") % 4 + 1).cast("int"))
    reviewed = F.col("user_id") % 2 == 0
    label = F.when(kind == "faq", F.concat(F.lit("Prepared by the author"), F.when(reviewed, "").otherwise(", not reviewed"))).when(kind.isin("extract", "search"), "Found in the document").otherwise("")
    return X.table(spark, d, "events").select("event_id", label.alias("label"))


# --- relations ------------------------------------------------------------------------------------------------------

# every nation's section text: a sentence per supplier and per customer, by name
EVIDENCE_CTE = f"""{Q.GRAPH_CTE},
esents AS (
  SELECT 'nation:' || n_nationkey AS node, s_suppkey::BIGINT AS pos, s_name || ' of ' || n_name || ' in ' || r_name || ' sells here.' AS sentence FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'nation:' || n_nationkey, c_custkey::BIGINT + 1000000000, c_name || ' of ' || n_name || ' in ' || r_name || ' buys here.' FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
et AS (SELECT *, ' ' || array_to_string({X.analyze_sql('sentence')}, ' ') || ' ' AS t FROM esents),
ep AS (SELECT id, ' ' || array_to_string({X.analyze_sql('label')}, ' ') || ' ' AS p FROM nodes)
"""


def evidence(spark: SparkSession, d: str, steps: DataFrame, sents: DataFrame) -> DataFrame:
    """Per step (edge_idx, src, dst): the first of the sentences (node, pos, sentence) of either end that names the other end.

    A sentence names an end if its terms hold the label's in a row. All such runs of a node's sentences, of the lengths
    that labels have, are reduced to their first place, so a label meets one row and not every sentence of the node.
    """
    named = Q.nodes(spark, d).select("id", T.analyze(F.col("label")).alias("p")).where(F.size("p") > 0)
    named = named.select("id", F.size("p").alias("n"), F.array_join("p", " ").alias("run"))
    lengths = named.agg(F.collect_set("n").alias("lengths"))  # one row
    cut = sents.select("node", "pos", "sentence", T.analyze(F.col("sentence")).alias("t")).crossJoin(F.broadcast(lengths))
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))
    fitting = F.filter("lengths", lambda n: n <= F.size("t"))
    runs = cut.select("node", "pos", F.explode(F.array_distinct(F.flatten(F.transform(fitting, of_length)))).alias("run"))
    first = runs.groupBy("node", "run").agg(F.min("pos").alias("pos"))
    ends = steps.select("edge_idx", F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(steps.select("edge_idx", F.col("dst").alias("node"), F.col("src").alias("other")))
    wanted = ends.join(named.select(F.col("id").alias("other"), "run"), "other").select("edge_idx", "node", "run")
    best = first.join(wanted, ["node", "run"]).groupBy("edge_idx").agg(F.min(F.struct("pos", "node", "run")).alias("b")).select("edge_idx", "b.*")
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    said = cut.select("node", "pos", "sentence", F.array_join("t", " ").alias("t")).join(best, ["node", "pos"]).where(spaced(F.col("t")).contains(spaced(F.col("run"))))
    return said.groupBy("edge_idx").agg(F.min("sentence").alias("sentence"))


@query(f"WITH {EVIDENCE_CTE} SELECT edge_idx, arg_min(sentence, pos) AS sentence FROM (SELECT edge_idx, et.* FROM edges e JOIN et ON et.node = e.src JOIN ep ON ep.id = e.dst AND contains(et.t, ep.p) UNION ALL SELECT edge_idx, et.* FROM edges e JOIN et ON et.node = e.dst JOIN ep ON ep.id = e.src AND contains(et.t, ep.p)) GROUP BY edge_idx")
def step_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every edge's first sentence that names its other end, out of all sentences."""
    return evidence(spark, d, Q.edges(spark, d), trade_sentences(spark, d))


def trade_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every nation's section text, whole: a sentence per supplier and per customer, by name."""
    region = F.broadcast(X.table(spark, d, "region"))
    nation = F.broadcast(X.table(spark, d, "nation").join(region, F.col("r_regionkey") == F.col("n_regionkey")))

    def part(table: str, base: int, prefix: str, does: str) -> DataFrame:
        rows = X.table(spark, d, table).join(nation, F.col(f"{prefix}_nationkey") == F.col("n_nationkey"))
        s = F.concat(F.col(f"{prefix}_name"), F.lit(" of "), F.col("n_name"), F.lit(" in "), F.col("r_name"), F.lit(f" {does} here."))
        key = F.col("s_suppkey" if prefix == "s" else "c_custkey").cast("long")
        return rows.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"), (key + base).alias("pos"), s.alias("sentence"), F.col("r_name").alias("section_id"))

    return part("supplier", 0, "s", "sells").unionByName(part("customer", 1_000_000_000, "c", "buys"))


@query()
def relation_answer(spark: SparkSession, d: str) -> DataFrame:
    """How a supplier and a customer connect: path length, evidence for the first three steps, cited sections.

    Each sentence is a chunk; pairs without a path or a stated link get the best sentences that name them.
    """
    from quarry.operators.engine import Engine

    e, p, nodes = Q.edges(spark, d), Q.pairs(spark, d), Q.nodes(spark, d)
    sents = trade_sentences(spark, d)
    paths = stored(G.shortest_paths(e, p), "relation-paths")
    steps = paths.select("pair", F.posexplode("path").alias("step", "edge_idx")).join(e, "edge_idx")
    proof = evidence(spark, d, steps.where("step < 3").select("edge_idx", "src", "dst").distinct(), sents)
    said = steps.where("step < 3").join(proof, "edge_idx").groupBy("pair").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("step", "sentence"))), lambda s: s["sentence"])).alias("sentences"))
    said = stored(said, "relation-said")
    label = lambda end: nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    text = F.concat(F.lit("How is "), F.col("a_label"), F.lit(" related to "), F.col("b_label"), F.lit("?"))
    lost = p.join(said, "pair", "left_anti").join(label("a"), "a").join(label("b"), "b").select(F.col("pair").alias("query"), text.alias("text"), F.lit("en").alias("lang"), "a", "b")
    empty = F.array().cast("array<string>")
    chunks = sents.select(F.col("pos").alias("chunk"), "section_id", F.lit("en").alias("lang"), empty.alias("heading_path"), F.col("sentence").alias("text"), F.array(F.lit("b0")).alias("blocks"))
    named_nodes = nodes.withColumn("aliases", empty)
    engine = Engine(chunks, chunks.select("section_id", F.col("section_id").alias("title")).distinct(), nodes=named_nodes, edges=e)
    named = stored(engine.naming(stored(lost, "relation-lost"), nodes.select("id", T.analyze(F.col("label")).alias("p"))), "relation-named")
    cited = steps.join(nodes, (F.col("src") == F.col("id")) | (F.col("dst") == F.col("id"))).where("section_id is not null").select("pair", "section_id")
    cited = cited.unionByName(named.select(F.col("query").alias("pair"), F.explode("sections").alias("section_id")))
    cited = cited.groupBy("pair").agg(F.sort_array(F.collect_set("section_id")).alias("sections"))
    said = said.unionByName(named.select(F.col("query").alias("pair"), "sentences"))
    out = p.select("pair").join(paths, "pair", "left").join(said, "pair", "left").join(cited, "pair", "left")
    steps_n = F.size(F.coalesce("path", F.array().cast("array<long>"))).cast("long")
    return out.select("pair", steps_n.alias("steps"), F.array_join("sentences", " | ").alias("sentences"), F.array_join("sections", ",").alias("sections"))


@query()
def ask_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every routed question with its answer, by keywords: documents are chunks, regions are sections of content."""
    from quarry.operators.engine import Engine

    n = F.size(F.split("text", "\n"))
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("b"), i.cast("string")))
    chunks = X.chunks(spark, d).withColumns({"blocks": blocks, "heading_path": F.array().cast("array<string>")})
    about = F.concat(F.lit("About "), F.col("r_name"), F.lit("."))
    region = X.table(spark, d, "region").select(F.col("r_name").alias("section_id"), F.col("r_name").alias("title"), about.alias("summary"))
    stored = region.select("section_id", "summary", F.lit(None).cast("string").alias("simple"), F.array("summary").alias("key_points"))
    items = X.table(spark, d, "nation").join(F.broadcast(X.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("section_id"), F.col("n_nationkey").alias("quiz_id"), F.concat(F.lit("Where is "), F.col("n_name"), F.lit("?")).alias("question")
    )
    nodes = Q.nodes(spark, d).withColumn("aliases", F.array().cast("array<string>"))
    known = nodes.where(F.col("id").rlike("^(region|nation):"))
    engine = Engine(chunks, region.select("section_id", "title"), content=stored, quiz=items, nodes=known, edges=Q.edges(spark, d).where("relation = 'is part of'"))
    return engine.ask(Q.questions(spark, d)).select("query", "intent", "scope", "section_id", "kind", F.md5("text").alias("text_md5"), F.array_join("sections", ",").alias("sections"))
