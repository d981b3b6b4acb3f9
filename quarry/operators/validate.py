"""Validation: references, duplicates, schema and limits, all as rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unknown(child: DataFrame, key: str, parent: DataFrame, parent_key: str, message: str) -> DataFrame:
    """(message, key) of child rows whose reference has no parent."""
    keys = parent.select(F.col(parent_key).alias("_p")).distinct()
    rows = child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_p"), "left_anti")
    return rows.select(F.lit(message).alias("message"), F.col(key).cast("string").alias("key"))


def duplicates(rows: DataFrame, keys: list[str], message: str) -> DataFrame:
    """(message, key, n) of keys that occur more than once."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return found.select(F.lit(message).alias("message"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n")


def check_references(sections: DataFrame, quiz: DataFrame, faq: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(message, key) of every broken rule among author-prepared content.

    quiz is (quiz_id, section_id, options, answer_index); faq is (faq_id, sources); nodes is (id, section_id); edges is
    (src, dst, relation).
    """
    pair = lambda df: df.select("message", "key")
    key = lambda c: F.col(c).cast("string").alias("key")
    say = lambda m: F.lit(m).alias("message")
    source = faq.select("faq_id", F.explode("sources").alias("section_id"))
    rules = [
        unknown(quiz, "section_id", sections, "section_id", "unknown section of content"),
        pair(duplicates(quiz, ["quiz_id"], "quiz id is not unique")),
        quiz.where(F.col("answer_index").isNull() | (F.col("answer_index") < 0) | (F.col("answer_index") >= F.size("options"))).select(say("answer index out of range"), key("quiz_id")),
        quiz.where(F.size(F.array_distinct("options")) != F.size("options")).select(say("duplicate options"), key("quiz_id")),
        pair(duplicates(faq, ["faq_id"], "faq id is not unique")),
        faq.where(F.coalesce(F.size("sources"), F.lit(0)) < 1).select(say("no sources"), key("faq_id")),
        unknown(source, "section_id", sections, "section_id", "unknown section of faq"),
        pair(duplicates(nodes, ["id"], "node is not unique")),
        unknown(nodes, "section_id", sections, "section_id", "unknown section of node"),
        unknown(edges, "src", nodes, "id", "unknown node of edge"),
        unknown(edges, "dst", nodes, "id", "unknown node of edge"),
        pair(duplicates(edges, ["src", "dst", "relation"], "edge duplicated")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def unknown_members(rows: DataFrame, key: str, json: str, known: list[str]) -> DataFrame:
    """(key, member) of JSON object members that the schema does not name; names that begin with ``x-`` are extensions."""
    member = rows.select(F.col(key), F.explode(F.json_object_keys(json)).alias("member"))
    return member.where(~F.col("member").isin(*known) & ~F.col("member").startswith("x-"))


# Limits of a document's parts.
LIMITS = {"chunk_characters": 10_000, "blocks_per_chunk": 1_000, "term_characters": 100, "question_characters": 1_000, "sections": 5_000, "chunks": 20_000}


def over(rows: DataFrame, key: str, value, item: str, limit: int | None = None) -> DataFrame:
    """(item, key, value) where a value is over its limit."""
    most = LIMITS[item] if limit is None else limit
    return rows.select(F.lit(item).alias("item"), F.col(key).cast("string").alias("key"), value.cast("long").alias("value")).where(F.col("value") > most)
