"""The engine: builds the tables of a corpus and answers batches of questions over them.

Questions are (query, text, lang, current_section). Optional parts (content, quiz, faq, graph, embedder) may be missing;
what depends on them then answers with a message, or by keywords only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import answers as A
from quarry.operators import document as D
from quarry.operators import embedder as E
from quarry.operators import graph as G
from quarry.operators import retrieval as R
from quarry.operators import router
from quarry.operators.tables import stored
from quarry.sources import markdown

#: Items of a document's quiz at most.
QUIZ_ITEMS = 10


def build(files: DataFrame, key: str = "path", text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(sections, chunks) of whole Markdown texts.

    sections is (doc, section_no, section_id, title, level, type, heading_path); chunks is (chunk, doc, section_id, lang,
    heading_path, text, blocks, tokens), where ``chunk`` numbers the corpus by document and place.
    """
    blocks = markdown.scan(files, key, text).withColumnRenamed(key, "doc")
    numbered = D.block_ids(D.sections(blocks))
    titled = numbered.where("level is not null").select("doc", "section_no", "pos", "level", F.col("id").alias("explicit"), F.col("text").alias("title"), F.lit("section").alias("type"))
    title = F.coalesce(F.try_element_at(F.col("meta"), F.lit("title")), F.lit("Untitled"))
    front = numbered.where("section_no = 0").groupBy("doc").agg(F.min("pos").alias("pos"), F.first(title).alias("title")).select(
        "doc", F.lit(0).cast("long").alias("section_no"), "pos", F.lit(1).alias("level"), F.lit("frontmatter").alias("explicit"), "title", F.lit("frontmatter").alias("type")
    )
    heads = front.unionByName(titled).withColumn("id", F.coalesce("explicit", T.slug(F.col("title"))))
    sections = D.heading_paths(D.unique_ids(heads)).select("doc", "section_no", F.col("unique_id").alias("section_id"), "title", "level", "type", "heading_path")
    languages = blocks.groupBy("doc").agg(F.coalesce(F.first(F.try_element_at(F.col("meta"), F.lit("language"))), F.lit("en")).alias("lang"))
    chunked = D.chunks(D.merge_tails(D.groups(D.units(numbered))))
    joined = chunked.join(sections, ["doc", "section_no"]).join(languages, "doc")
    # corpus-wide numbers without one global sort: a hash of the document, then the place in it
    number = F.xxhash64("doc").bitwiseAND(F.lit((1 << 42) - 1)) * F.lit(1 << 20) + F.col("chunk_no")
    return sections, joined.select(number.alias("chunk"), "doc", "section_id", "lang", "heading_path", "text", "blocks", "tokens")


@dataclass
class Thresholds:
    out_of_scope: float = A.OUT_OF_SCOPE
    cos_ref: float = A.COS_REF
    faq_match: float = A.FAQ_MATCH


class Engine:
    """Answers over chunks (chunk, section_id, lang, heading_path, text, blocks) and sections (section_id, title).

    content is (section_id, summary, simple, key_points); quiz is (section_id, quiz_id, question); faq is (faq, question,
    alternates, answer, sources); nodes is (id, label, aliases, section_id); edges is (edge_idx, src, dst, relation).
    """

    def __init__(self, chunks: DataFrame, sections: DataFrame, content: DataFrame | None = None, quiz: DataFrame | None = None, faq: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, embedder: E.StaticEmbedder | None = None, thresholds: Thresholds | None = None):
        self.chunks, self.sections, self.content, self.quiz, self.faq, self.nodes, self.edges, self.embedder = chunks, sections, content, quiz, faq, nodes, edges, embedder
        self.limits = thresholds or Thresholds()
        body = chunks.select("chunk", "lang", D.index_text(F.col("heading_path"), F.col("text")).alias("text"))
        self.index = R.Index(body).keep()
        self.vectors = None
        if embedder is not None:
            self.vectors = E.embed(body, "text", embedder).select(F.col("chunk").alias("key"), V.quantize(F.col("vector")).alias("vector"))

    # --- retrieval ---------------------------------------------------------------------------------------------------

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        return E.embed(queries.select("query", "text"), "text", self.embedder).select("query", "vector")

    def order(self, queries: DataFrame, wide: DataFrame | None = None, most: int | None = None) -> DataFrame:
        """(query, chunk, fused, rn); ``wide`` has the texts to look up words of, where they are not the questions' own.

        With ``most`` only the first places are sure to be there; keywords alone then need not score every hit.
        """
        asked = queries if wide is None else wide
        bm25 = self.index.bm25(asked) if most is None or self.vectors is not None else self.index.first(asked, most)
        return R.hybrid(bm25, None if self.vectors is None else R.cosines(self.query_vectors(queries), self.vectors, R.COSINE_DEPTH))

    def sentences(self, order: DataFrame) -> DataFrame:
        """Sentences of the chunks of an order."""
        wanted = self.chunks.join(order.select("chunk").distinct(), "chunk", "left_semi")
        cut = D.chunk_sentences(wanted.select("chunk", "lang", "section_id", "text", "blocks", "heading_path"))
        return cut.select("chunk", "lang", "section_id", (F.col("line_no") * 100_000 + F.col("sentence_no")).alias("sentence_pos"), "block_id", "sentence")

    def search(self, queries: DataFrame, limit: int = 8) -> DataFrame:
        """(query, rank, chunk, section_id, heading_path, snippet, score)."""
        order = stored(self.order(queries, most=limit).where(F.col("rn") <= limit), "ask-order")
        hits = R.search(order, limit)
        cut = self.sentences(order).select("chunk", "lang", "sentence_pos", "sentence")
        snippets = A.snippets(hits.select("query", "chunk"), cut, self.chunks.select("chunk", "text"), queries.select("query", "text", "lang"), self.index)
        return hits.join(snippets, ["query", "chunk"]).join(self.chunks.select("chunk", "section_id", "heading_path"), "chunk")

    def scope(self, queries: DataFrame) -> DataFrame:
        """(query, score): coverage, weighted by the embedder, times the saturated best cosine."""
        if self.vectors is None:
            return A.scope_score(A.coverage(queries, self.index), None)
        words = queries.select(F.explode(T.words(F.col("text"))).alias("word"))
        cover = A.coverage(queries, self.index, E.word_weights(words, self.embedder))
        return A.scope_score(cover, A.best_cosine(R.cosines(self.query_vectors(queries), self.vectors, 1)), self.limits.cos_ref)

    # --- answers -----------------------------------------------------------------------------------------------------

    def match_faq(self, queries: DataFrame) -> DataFrame | None:
        """(query, faq, score, coverage) of each question's best entry."""
        if self.faq is None or self.vectors is None:
            return None
        variants = self.faq.select("faq", F.posexplode(F.concat(F.array("question"), F.coalesce("alternates", F.array().cast("array<string>")))).alias("k", "text"))
        embedded = E.embed(variants, "text", self.embedder).withColumn("key", F.struct("faq", "k", T.question_word(F.col("text")).alias("wh")))
        # stored questions are int8; alternates keep their floats, scaled so that one kernel serves both
        vector = F.when(F.col("k") == 0, F.transform(V.quantize(F.col("vector")), lambda x: x.cast("double"))).otherwise(F.transform("vector", lambda x: x * 127))
        cos = R.cosines(self.query_vectors(queries), embedded.select("key", vector.alias("vector")))
        asked = queries.select("query", T.question_word(F.col("text")).alias("asked_wh"), T.analyze(F.col("text"), F.col("lang")).alias("q_terms"))
        best = A.match_faq(cos.join(asked, "query").select("query", "key.faq", "cos", "asked_wh", F.col("key.wh").alias("variant_wh")))
        terms = variants.groupBy("faq").agg(F.array_distinct(F.flatten(F.collect_list(T.analyze(F.col("text"))))).alias("f_terms"))
        return best.join(terms, "faq").join(asked, "query").select("query", "faq", "score", A.faq_coverage(F.col("q_terms"), F.col("f_terms")).alias("coverage"))

    def extract(self, queries: DataFrame, wide: DataFrame | None = None, window: int = A.CHUNK_WINDOW, restrict: DataFrame | None = None, most: int = 3) -> DataFrame:
        """(query, place, chunk, lang, section_id, block_id, sentence, score)."""
        order = stored(self.order(queries, wide, window).where(F.col("rn") <= window), "ask-order")
        cut = self.sentences(order)
        if self.vectors is not None:
            cut = E.embed(cut, "sentence", self.embedder)
        scored = A.sentence_scores(cut, order, queries, self.index, window, restrict)
        if self.vectors is not None:
            v = cut.select("chunk", "sentence_pos", "vector")
            q = self.query_vectors(queries).withColumnRenamed("vector", "q_vector")
            scored = scored.join(v, ["chunk", "sentence_pos"]).join(q, "query").withColumn("score", F.col("score") + V.dot(F.col("vector"), F.col("q_vector"))).drop("vector", "q_vector")
        return A.extract(scored, most).join(self.chunks.select("chunk", "lang", "section_id"), "chunk")

    def question(self, queries: DataFrame) -> DataFrame:
        """(query, kind, text, sections): not covered, a stored answer, or extracted sentences."""
        picked = stored(self.extract(queries), "ask-picked")
        said = picked.groupBy("query").agg(
            F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("place", "sentence", "section_id"))).alias("s")
        )
        joined = self.scope(queries).join(said, "query", "left")
        faq = self.match_faq(queries)
        if faq is None:
            kind = A.question_kind(F.col("score"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("n"))
            answered = joined.withColumn("kind", kind).withColumns({"answer": F.lit(None).cast("string"), "sources": F.lit(None).cast("array<string>")})
        else:
            entry = faq.join(self.faq.select("faq", "answer", "sources"), "faq").select("query", F.col("score").alias("f_score"), "coverage", "answer", "sources")
            answered = joined.join(entry, "query", "left").withColumn("kind", A.question_kind(F.col("score"), F.col("f_score"), F.col("coverage"), F.col("n")))
        text = F.when(F.col("kind") == "faq", F.col("answer")).when(F.col("kind") == "extract", F.array_join(F.transform("s", lambda s: s["sentence"]), " "))
        sections = F.when(F.col("kind") == "faq", F.col("sources")).when(F.col("kind") == "extract", F.array_distinct(F.transform("s", lambda s: s["section_id"])))
        return answered.select("query", "kind", text.alias("text"), sections.alias("sections"))

    def names(self) -> DataFrame:
        """Dictionary of the router: labels and aliases in order, then section titles."""
        titles = self.sections.select(F.xxhash64("section_id").bitwiseAND(F.lit((1 << 61) - 1)).alias("k"), F.lit(1).alias("part"), F.col("title").alias("name"), F.lit(None).cast("string").alias("node"), "section_id")
        if self.nodes is not None:
            each = F.posexplode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("i", "name")
            labels = self.nodes.select("id", "section_id", each)
            titles = labels.select((F.xxhash64("id").bitwiseAND(F.lit((1 << 56) - 1)) * 16 + F.col("i")).alias("k"), F.lit(0).alias("part"), "name", F.col("id").alias("node"), "section_id").unionByName(titles)
        return titles.select(F.struct("part", "k").alias("name_id"), T.analyze(F.col("name")).alias("terms"), "node", "section_id")

    def route(self, queries: DataFrame) -> DataFrame:
        return router.route(queries, self.names())

    def titles(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.sections.select("section_id", "title"), "section_id", "left")

    def doc_summary(self) -> DataFrame:
        """(section_id, title, text): the first sentence of every section's summary."""
        has = self.content.where(F.coalesce("summary", F.lit("")) != "")
        return self.titles(has).select("section_id", "title", F.coalesce(F.get(T.sentences(F.col("summary")), F.lit(0)), F.col("summary")).alias("text"))

    def quiz_items(self, rows: DataFrame) -> DataFrame:
        """(query, quiz_id, section_id, question): a section's items; for a document one per section, ten at most."""
        seeded = F.struct(F.md5(F.concat(F.lit("7:"), F.col("quiz_id").cast("string"))), "quiz_id", "question")
        one = self.quiz.groupBy("section_id").agg(F.max(seeded).alias("q")).orderBy("section_id").limit(QUIZ_ITEMS).select("section_id", "q.quiz_id", "q.question")
        whole = rows.where("scope = 'document' or section_id is null").select("query").crossJoin(F.broadcast(one))  # ten rows at most
        section = rows.where("scope <> 'document' and section_id is not null").select("query", "section_id").join(self.quiz.select("section_id", "quiz_id", "question"), "section_id")
        return whole.select("query", "quiz_id", "section_id", "question").unionByName(section.select("query", "quiz_id", "section_id", "question"))

    def relation(self, rows: DataFrame) -> DataFrame:
        """(query, steps, sentences, sections) for rows (query, text, lang, a, b): the path, and what the text says of its first steps.

        Where there is no path or no stated link, the best sentence naming both concepts, else one per concept.
        """
        pairs = rows.select(F.col("query").alias("pair"), "a", "b")
        paths = stored(G.shortest_paths(self.edges, pairs), "relation-paths")
        steps = G.path_steps(paths, pairs, self.edges)
        ends = steps.select("pair", "step", F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(steps.select("pair", "step", F.col("dst").alias("x"), F.col("src").alias("y")))
        home = self.nodes.select(F.col("id").alias("x"), "section_id")
        names = self.nodes.select("id", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).select("id", T.analyze(F.col("name")).alias("p"))
        wanted = ends.where("step < 3").join(home, "x").join(names.withColumnRenamed("id", "y"), "y")
        inside = self.chunks.join(wanted.select("section_id").distinct(), "section_id", "left_semi")
        cut = self.sentences(inside).withColumn("t", T.analyze(F.col("sentence"), F.col("lang")))
        linked = cut.join(wanted, "section_id").where(T.contains_phrase(F.col("t"), F.col("p"))).select("pair", "step", "chunk", "sentence_pos", "sentence")
        if self.vectors is None:
            linked = linked.withColumn("cos", F.lit(0.0))
        else:  # the sentence that is nearest to "from relation to"
            label = lambda end: self.nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
            stated = steps.where("step < 3").join(label("src"), "src").join(label("dst"), "dst")
            about = E.embed(stated.select("pair", "step", F.concat_ws(" ", "src_label", "relation", "dst_label").alias("about")), "about", self.embedder, "about_vector")
            said_so = E.embed(linked.distinct(), "sentence", self.embedder)
            linked = said_so.join(about, ["pair", "step"]).withColumn("cos", V.dot(F.col("vector"), F.col("about_vector")))
        proof = linked.groupBy("pair", "step").agg(F.min(F.struct((-F.round("cos", 9)).alias("far"), "chunk", "sentence_pos", "sentence")).alias("s"))
        said = proof.groupBy("pair").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("step", "s.sentence"))), lambda s: s["sentence"])).alias("sentences"))
        said = stored(said, "relation-said")
        lost = rows.join(said.select(F.col("pair").alias("query")), "query", "left_anti")
        named = self.naming(stored(lost.select("query", "text", "lang", "a", "b"), "relation-lost"), names)
        cited = ends.join(home, "x").where("section_id is not null").select("pair", "section_id")
        cited = cited.unionByName(named.select(F.col("query").alias("pair"), F.explode("sections").alias("section_id")))
        cited = cited.groupBy("pair").agg(F.sort_array(F.collect_set("section_id")).alias("sections"))
        said = said.unionByName(named.select(F.col("query").alias("pair"), "sentences"))
        out = pairs.select("pair").join(paths, "pair", "left").join(said, "pair", "left").join(cited, "pair", "left")
        return out.select(F.col("pair").alias("query"), F.size(F.coalesce("path", F.array().cast("array<long>"))).alias("steps"), "sentences", "sections")

    def naming(self, rows: DataFrame, names: DataFrame) -> DataFrame:
        """(query, sentences, sections) for rows (query, text, lang, a, b): the best sentence naming both concepts, else one per concept.

        ``names`` is (id, p), the terms of every label and alias.
        """
        label = lambda end: self.nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        wide = rows.join(label("a"), "a").join(label("b"), "b").select("query", F.concat_ws(" ", "text", "a_label", "b_label").alias("text"), "lang")
        sides = rows.select("query", F.posexplode(F.array("a", "b")).alias("side", "id")).join(names, "id")
        picked = self.extract(rows.select("query", "text", "lang"), wide, 5, sides.select("query", F.explode("p").alias("term")).distinct(), 30)
        cut = picked.withColumn("t", T.analyze(F.col("sentence"), F.col("lang")))
        found = cut.join(sides, "query").where(T.contains_phrase(F.col("t"), F.col("p")))
        found = found.groupBy("query", "place", "sentence", "section_id").agg(F.collect_set("side").alias("sides"))
        one = F.struct("place", "sentence", "section_id")
        best = lambda ok: F.min(F.when(ok, one))
        per = found.groupBy("query").agg(
            best(F.size("sides") == 2).alias("both"), best(F.array_contains("sides", 0)).alias("first"), best(F.array_contains("sides", 1)).alias("second")
        )
        said = F.when(F.col("both").isNotNull(), F.array("both")).otherwise(F.array_compact(F.array("first", "second")))
        return per.select("query", F.transform(said, lambda s: s["sentence"]).alias("sentences"), F.array_compact(F.transform(said, lambda s: s["section_id"])).alias("sections"))

    def ask(self, queries: DataFrame) -> DataFrame:
        """(query, intent, scope, section_id, kind, text, sections): every question answered, one plan per intent."""
        short = queries.withColumn("text", F.substr("text", F.lit(1), F.lit(router.QUESTION_LENGTH)))
        routed = stored(self.route(short), "ask-routes")
        of = lambda *intents: routed.where(F.col("intent").isin(*intents))
        asked = lambda *intents: short.join(of(*intents).select("query"), "query", "left_semi")
        none = F.lit(None).cast("string")

        def message(rows: DataFrame, text: Column | str) -> DataFrame:
            return rows.select("query", F.lit("message").alias("kind"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.array_compact(F.array("section_id")).alias("sections"))

        parts = [self.question(stored(asked("question"), "ask-questions"))]
        finding = stored(asked("find"), "ask-find")
        hits = self.search(finding).join(self.scope(finding).withColumnRenamed("score", "scope_score"), "query")
        out_of = F.col("scope_score") < self.limits.out_of_scope
        kept = hits.where(F.col("rank") <= F.when(out_of, 3).otherwise(8)).groupBy("query").agg(F.first(out_of).alias("o"), F.sort_array(F.collect_list(F.struct("rank", "snippet", "section_id"))).alias("h"))
        found = of("find").select("query").join(kept, "query", "left")
        parts.append(
            found.select("query", F.when(F.coalesce("o", F.lit(True)), "notCovered").otherwise("search").alias("kind"), F.array_join(F.transform("h", lambda x: x["snippet"]), "\n").alias("text"), F.array_distinct(F.transform("h", lambda x: x["section_id"])).alias("sections"))
        )
        prepared = of("summary", "simple", "keyPoints")
        whole = prepared.where("intent = 'summary' and scope = 'document'")
        single = self.titles(prepared.where("intent <> 'summary' or scope <> 'document'").withColumnRenamed("intent", "mode").join(short.select("query", "current_section"), "query").withColumn("section_id", F.coalesce("section_id", "current_section")))
        if self.content is None:
            parts.append(message(prepared, "The author didn't prepare content for this document."))
        else:
            cited = single.select("query", F.array_compact(F.array("section_id")).alias("sections"))
            parts.append(A.stored_content(single, self.content).join(cited, "query").select("query", "kind", "text", "sections"))
            total = self.doc_summary().agg(F.sort_array(F.collect_list(F.struct("section_id", "text"))).alias("d"))  # one row
            parts.append(whole.select("query").crossJoin(F.broadcast(total)).select("query", F.lit("docSummary").alias("kind"), F.array_join(F.transform("d", lambda x: x["text"]), "\n").alias("text"), F.transform("d", lambda x: x["section_id"]).alias("sections")))
        if self.quiz is None:
            parts.append(message(of("quiz"), "The author didn't prepare quiz questions for this document."))
        else:
            items = self.quiz_items(of("quiz")).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("section_id", "quiz_id", "question"))).alias("i"))
            quiz = of("quiz").select("query").join(items, "query", "left")
            text = F.when(F.col("i").isNull(), F.lit("The author didn't prepare quiz questions for this section.")).otherwise(F.array_join(F.transform("i", lambda x: x["question"]), "\n"))
            parts.append(quiz.select("query", F.when(F.col("i").isNull(), "message").otherwise("quiz").alias("kind"), text.alias("text"), F.array_distinct(F.transform("i", lambda x: x["section_id"])).alias("sections")))
        if self.nodes is None or self.edges is None:
            parts.append(message(of("relation", "concepts"), "This document doesn't include a concept map."))
        else:
            two = of("relation").join(short.select("query", "text", "lang"), "query").select("query", "text", "lang", F.get("concepts", F.lit(0)).alias("a"), F.get("concepts", F.lit(1)).alias("b"))
            parts.append(self.relation(two).select("query", F.lit("relation").alias("kind"), F.array_join("sentences", " ").alias("text"), "sections"))
            focus = of("concepts").join(short.select("query", "current_section"), "query").select("query", F.get("concepts", F.lit(0)).alias("node"), F.coalesce("section_id", "current_section").alias("section_id"))
            near = G.neighbors(self.edges, focus.where("node is not null").select("node").distinct()).select("node", "edge_idx", "relation", "other")
            mapped = G.section_map(self.nodes, self.edges).select(F.col("section_id").alias("map_section"), "edge_idx", "relation", F.col("dst").alias("other"))
            by_node = focus.where("node is not null").join(near, "node").select("query", "edge_idx", "relation", "other")
            by_section = focus.where("node is null").join(mapped, F.col("section_id") == F.col("map_section")).select("query", "edge_idx", "relation", "other")
            edges_of = F.sort_array(F.collect_list(F.struct("edge_idx", "relation", "other"))).alias("e")
            listed = by_node.unionByName(by_section).groupBy("query").agg(edges_of)
            every = self.edges.withColumnRenamed("dst", "other").agg(edges_of)  # one row: the whole map, where nothing narrows it
            listed = listed.unionByName(focus.where("node is null and section_id is null").select("query").crossJoin(F.broadcast(every)))
            parts.append(
                focus.join(listed, "query", "left").select("query", F.lit("concepts").alias("kind"), F.array_join(F.transform("e", lambda x: F.concat_ws(" ", x["relation"], x["other"])), "\n").alias("text"), F.array_compact(F.array("section_id")).alias("sections"))
            )
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p.withColumn("text", F.coalesce("text", none)))
        return routed.select("query", "intent", "scope", "section_id").join(out, "query", "left")

    def suggestions(self, n: int = 4) -> DataFrame:
        """First stored questions of different sections."""
        first = self.faq.withColumn("s", F.get("sources", F.lit(0))).withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("faq")))
        return first.where("k = 1").orderBy("faq").limit(n).select("faq", "question")
