"""Answers: coverage and scope, stored questions, extracted sentences, citations, stored section content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.retrieval import Index

OUT_OF_SCOPE = 0.55
COS_REF = 0.3
FAQ_MATCH = 0.75
FAQ_COVERAGE = 0.5
WH_PENALTY = 0.1
KEEP_SHARE = 0.85
LEXICAL_WEIGHT = 0.6
RANK_BONUS = 0.04
CHUNK_WINDOW = 3
MORE_HITS = 3


def coverage(queries: DataFrame, index: Index, weights: DataFrame | None = None) -> DataFrame:
    """(query, coverage): weighted share of a question's content words that the corpus knows; words count as often as used.

    ``weights`` is (word, weight), e.g. from an embedder's row norms; without it every word weighs 1.
    """
    english = T.is_english(F.col("lang"))
    cut = queries.select("query", english.alias("en"), F.explode(T.words(F.col("text"))).alias("word")).where(~(F.col("en") & T.is_stopword(F.col("word"))))
    stems = cut.withColumn("term", F.when(F.col("en"), T.s_stem(F.col("word"))).otherwise(F.col("word")))
    if weights is None:
        stems = stems.withColumn("weight", F.lit(1.0))
    else:
        stems = stems.join(weights, "word", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    # the few words of the questions look for their terms, not the corpus for the questions
    known = index.tf.select("term").join(stems.select("term").distinct(), "term", "left_semi").distinct().withColumn("known", F.lit(True))
    sums = stems.join(known, "term", "left").groupBy("query").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("known"), F.col("weight")).otherwise(0.0)).alias("found"))
    share = F.when(F.col("total") > 0, F.col("found") / F.col("total")).otherwise(0.0)
    return queries.select("query").join(sums, "query", "left").select("query", F.coalesce(share, F.lit(0.0)).alias("coverage"))


def best_cosine(cos: DataFrame) -> DataFrame:
    """(query, best); -1 at least."""
    return cos.groupBy("query").agg(F.greatest(F.lit(-1.0), F.max("cos")).alias("best"))


def scope_score(cover: DataFrame, best: DataFrame | None, cos_ref: float = COS_REF) -> DataFrame:
    """(query, score) = coverage * min(1, max(0, best) / cos_ref); coverage alone without vectors."""
    if best is None:
        return cover.select("query", F.col("coverage").alias("score"))
    factor = F.when(F.col("best").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("best")) / cos_ref))
    return cover.join(best, "query", "left").select("query", (F.col("coverage") * factor).alias("score"))


def penalty(asked: Column, stored: Column) -> Column:
    """Two different question words cost a little."""
    return F.when(asked.isNotNull() & stored.isNotNull() & (asked != stored), WH_PENALTY).otherwise(0.0)


def match_faq(variants: DataFrame) -> DataFrame:
    """(query, faq, score) of each question's best entry, from (query, faq, cos, asked_wh, variant_wh); ties to the least."""
    scored = variants.withColumn("s", F.col("cos") - penalty(F.col("asked_wh"), F.col("variant_wh")))
    per = scored.groupBy("query", "faq").agg(F.max("s").alias("s"))
    best = per.groupBy("query").agg(F.max_by(F.struct("faq", "s"), F.struct(F.round("s", 9), -F.col("faq"))).alias("best"))
    return best.select("query", "best.faq", F.col("best.s").alias("score"))


def faq_coverage(asked: Column, stored: Column) -> Column:
    """Share of a question's distinct terms that an entry's variants have."""
    terms = F.array_distinct(asked)
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, stored)) / F.size(terms)).otherwise(0.0)


def sentence_scores(sentences: DataFrame, order: DataFrame, queries: DataFrame, index: Index, window: int = CHUNK_WINDOW, restrict: DataFrame | None = None) -> DataFrame:
    """(query, chunk, rn, sentence_pos, block_id, sentence, score) of the sentences in each question's first chunks.

    ``sentences`` is (chunk, lang, sentence_pos, block_id, sentence[, query, cos]); ``restrict`` (query, term) keeps
    sentences that have one of the terms.
    """
    top = order.where(F.col("rn") <= window).select("query", "chunk", "rn")
    asked = queries.select("query", F.array_distinct(T.analyze(F.col("text"), F.col("lang"))).alias("q_terms"))
    weights = index.weighted(asked.select(F.explode("q_terms").alias("term")))
    per = asked.select("query", F.explode("q_terms").alias("term")).join(weights, "term").groupBy("query").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf"), F.sum("idf").alias("idf_sum")
    )
    cand = sentences.join(top, "chunk").withColumn("terms", F.array_distinct(T.analyze(F.col("sentence"), F.col("lang"))))
    if restrict is not None:
        wanted = restrict.groupBy("query").agg(F.collect_set("term").alias("wanted"))
        cand = cand.join(wanted, "query").where(F.arrays_overlap("terms", "wanted"))
    joined = cand.join(per, "query", "left")
    lexical = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at(F.col("idf"), t), F.lit(0.0)))
    share = F.when(F.coalesce("idf_sum", F.lit(0.0)) > 0, F.coalesce(lexical, F.lit(0.0)) / F.col("idf_sum")).otherwise(F.coalesce(lexical, F.lit(0.0)))
    cos = F.coalesce("cos", F.lit(0.0)) if "cos" in sentences.columns else F.lit(0.0)
    score = cos + LEXICAL_WEIGHT * share + RANK_BONUS * F.greatest(F.lit(0), 2 - (F.col("rn") - 1))
    return joined.select("query", "chunk", "rn", "sentence_pos", "block_id", "sentence", score.alias("score"))


def extract(scored: DataFrame, most: int = 3) -> DataFrame:
    """The sentences that answer: the best and others of its chunk with 85 % of its score, in document order (``place``).

    With more than three allowed it is a plain best-of list in score order.
    """
    by_score = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "rn", "sentence_pos")
    if most > 3:
        return scored.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= most)
    whole = by_score.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = scored.select("*", F.row_number().over(by_score).alias("k"), F.first("score").over(whole).alias("top"), F.first("chunk").over(whole).alias("top_chunk"))
    near = ranked.where((F.col("chunk") == F.col("top_chunk")) & ((F.col("k") == 1) | (F.round("score", 9) >= F.round(F.col("top") * KEEP_SHARE, 9))))
    kept = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("k"))).where(F.col("n") <= most)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("chunk", "sentence_pos"))).drop("k", "top", "top_chunk", "n")


def snippets(hits: DataFrame, sentences: DataFrame, texts: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """(query, chunk, snippet): the sentence with most weight of the question's terms, else the chunk's beginning."""
    asked = queries.select("query", F.array_distinct(T.analyze(F.col("text"), F.col("lang"))).alias("q_terms"))
    weights = index.weighted(asked.select(F.explode("q_terms").alias("term")))
    per = asked.select("query", F.explode("q_terms").alias("term")).join(weights, "term").groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf"))
    cand = hits.join(sentences, "chunk").join(per, "query", "left")
    w = F.aggregate(F.array_distinct(T.analyze(F.col("sentence"), F.col("lang"))), F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at(F.col("idf"), t), F.lit(0.0)))
    best = cand.groupBy("query", "chunk").agg(F.max_by("sentence", F.struct(F.round(F.coalesce(w, F.lit(0.0)), 9), -F.col("sentence_pos"))).alias("sentence"))
    found = hits.join(texts.select("chunk", F.col("text").alias("whole")), "chunk").join(best, ["query", "chunk"], "left")
    return found.select("query", "chunk", T.shortened(F.coalesce("sentence", F.substr("whole", F.lit(1), F.lit(200)))).alias("snippet"))


def citations(picked: DataFrame, sections: DataFrame) -> DataFrame:
    """(query, section_id, title, block_id): one per section, at its first sentence; a missing title is the id."""
    first = picked.groupBy("query", "section_id").agg(F.min_by("block_id", "place").alias("block_id"), F.min("place").alias("place"))
    return first.join(sections.select("section_id", "title"), "section_id", "left").select("query", "section_id", F.coalesce("title", "section_id").alias("title"), "block_id", "place")


def more_hits(order: DataFrame, shown: DataFrame, most: int = MORE_HITS, depth: int = 5) -> DataFrame:
    """Up to three of the first five hits whose chunk is not quoted already: (query, chunk, rn)."""
    rest = order.where(F.col("rn") <= depth).join(shown.select("query", "chunk").distinct(), ["query", "chunk"], "left_anti")
    return rest.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("rn"))).where(F.col("k") <= most).select("query", "chunk", "rn")


def stored_content(asked: DataFrame, content: DataFrame) -> DataFrame:
    """(query, kind, text) for (query, mode, section_id, title): the author's summary, explanation or key points, or why not."""
    joined = asked.join(content, "section_id", "left")
    text = F.when(F.col("mode") == "simple", F.col("simple")).when(F.col("mode") == "keyPoints", F.array_join("key_points", "\n")).otherwise(F.col("summary"))
    what = F.when(F.col("mode") == "simple", "simple explanation").when(F.col("mode") == "keyPoints", "list of key points").otherwise("summary")
    message = F.when(F.col("section_id").isNull(), F.lit('Scroll to a section or name one, for example "summarize attention".')).otherwise(
        F.concat(F.lit("The author didn't prepare a "), what, F.lit(' for "'), F.coalesce("title", "section_id"), F.lit('".'))
    )
    has = F.col("section_id").isNotNull() & (F.coalesce(text, F.lit("")) != "")
    return joined.select("query", F.when(has, "generated").otherwise("message").alias("kind"), F.when(has, text).otherwise(message).alias("text"))


def question_kind(score: Column, faq_score: Column, faq_cover: Column, n_sentences: Column) -> Column:
    """How a question is answered: out of scope first, stored questions second, then extraction."""
    return (
        F.when(score < OUT_OF_SCOPE, "notCovered")
        .when((faq_score >= FAQ_MATCH) & (faq_cover >= FAQ_COVERAGE), "faq")
        .when(F.coalesce(n_sentences, F.lit(0)) > 0, "extract")
        .otherwise("notCovered")
    )


