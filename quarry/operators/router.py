"""Rule-based routing of questions: names, scope and intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# Patterns of the routing cascade, over the lower-case trimmed question.
PATTERNS = {
    "quiz": r"\b(quiz|test me|test my|practice questions?|examine me|flashcards?)\b",
    "simple": r"\b(eli5|explain (it |this |that |this section |them )?(simply|like i'?m|in simple|in plain|to a (child|kid|beginner))|simple (terms|words|explanation|version|language)|plain (english|language|words)|simplif(y|ied)|for (a )?(beginner|child|kid|five year old|5 year old)s?|dumb (it )?down)\b",
    "keyPoints": r"\b(key points|main points|key takeaways|takeaways|bullet points|main ideas)\b",
    "summary": r"\b(summari[sz]e|summary|sum up|sum it up|tl;?dr|recap|gist|overview of|in brief)\b",
    "relation": r"\b(relat(e|es|ed|ion|ions|ionship|ionships)|connect(ed|ion|s)?|linked|link between|interact(s|ion)?|depend(s)? on)\b",
    "concepts": r"\b(key concepts|main concepts|concepts|concept map|related (concepts|topics|ideas))\b",
    "find": r"^(where\b|find\b|locate\b|search\b|show me where\b|which (section|part|chapter)\b)|\bwhere (does|do|is|are) (it|this|the) (document|text|article|guide|section)?\b",
    "thisSection": r"\b(this|current|the current) (section|part|chapter|page)\b|\bhere\b",
    "wholeDoc": r"\b(whole|entire|full) (document|doc|text|article|guide|thing)\b|\beverything\b|\ball (sections|of it|topics)\b|\bthe (document|doc)\b|\bthis (document|doc|article|guide)\b",
    "related": r"\brelated\b",
}
#: Characters of a question that are looked at.
QUESTION_LENGTH = 1000


def normalized(question: Column) -> Column:
    return F.trim(F.lower(F.substr(question, F.lit(1), F.lit(QUESTION_LENGTH))))


def intent(question: Column, n_concepts: Column) -> Column:
    """The first pattern that fits; relations need two concepts."""
    is_ = lambda name: question.rlike(PATTERNS[name])
    return (
        F.when(is_("quiz"), "quiz")
        .when(is_("simple"), "simple")
        .when(is_("keyPoints"), "keyPoints")
        .when(is_("summary"), "summary")
        .when(is_("relation") & (n_concepts >= 2), "relation")
        .when(is_("concepts") | (is_("relation") & (n_concepts == 1) & is_("related")), "concepts")
        .when(is_("find"), "find")
        .otherwise("question")
    )


def scope(question: Column, named_section: Column) -> Column:
    """Whole-document wording wins; without a name, or with "this section", it is the current section."""
    return (
        F.when(question.rlike(PATTERNS["wholeDoc"]), "document")
        .when(question.rlike(PATTERNS["thisSection"]) | named_section.isNull(), "current")
        .otherwise("named")
    )


def match_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, pos, name_id, node, section_id): longest names first, no overlaps, in the order of the question.

    ``queries`` is (query, text, lang); ``names`` is (name_id, terms, node, section_id), in dictionary order.
    """
    asked = queries.select("query", T.analyze(F.col("text"), F.col("lang")).alias("q"))
    spots = asked.select("query", "q", F.posexplode("q").alias("pos", "term"))
    known = names.where(F.size("terms") > 0).select("name_id", "terms", "node", "section_id", F.col("terms")[0].alias("term"))
    fits = spots.join(known, "term").where(F.slice("q", F.col("pos") + 1, F.size("terms")) == F.col("terms"))
    candidate = F.struct((-F.size("terms")).alias("rank"), "name_id", "pos", F.size("terms").alias("n"), "node", "section_id")
    folded = fits.groupBy("query").agg(F.sort_array(F.collect_list(candidate)).alias("c"))
    taken = lambda c: F.sequence(c["pos"], c["pos"] + c["n"] - 1)
    kind = folded.schema["c"].dataType.simpleString()
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(kind).alias("hits"))
    resolved = F.aggregate(
        "c",
        start,
        lambda acc, c: F.when(F.arrays_overlap(acc["used"], taken(c)), acc).otherwise(F.struct(F.concat(acc["used"], taken(c)).alias("used"), F.concat(acc["hits"], F.array(c)).alias("hits"))),
        lambda acc: acc["hits"],
    )
    return folded.select("query", F.inline(resolved)).select("query", "pos", "name_id", "node", "section_id")


def route(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, intent, scope, section_id, concepts) for queries (query, text, lang, current_section)."""
    short = queries.withColumn("text", F.substr("text", F.lit(1), F.lit(QUESTION_LENGTH)))
    hits = match_names(short, names)
    per = hits.groupBy("query").agg(
        F.min(F.when(F.col("section_id").isNotNull(), F.struct("pos", "section_id"))).alias("named"),
        F.sort_array(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("pos", "node")))).alias("nodes"),
    )
    asked = short.join(per, "query", "left")
    concepts = F.array_distinct(F.transform(F.coalesce("nodes", F.array().cast("array<struct<pos:int,node:string>>")), lambda n: n["node"]))
    q = normalized(F.col("text"))
    looked = asked.select("query", "current_section", concepts.alias("concepts"), q.alias("q"), F.col("named.section_id").alias("named"))
    scoped = looked.withColumn("scope", scope(F.col("q"), F.col("named")))
    section = F.when(F.col("scope") == "named", F.col("named")).when(F.col("scope") == "current", F.col("current_section"))
    return scoped.select("query", intent(F.col("q"), F.size("concepts")).alias("intent"), "scope", section.alias("section_id"), "concepts")
