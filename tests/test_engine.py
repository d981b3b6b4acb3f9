"""The whole engine on a small document: build, then every intent."""

import numpy as np
import pytest

from quarry.operators import embedder as E
from quarry.operators.engine import Engine, build

DOC = """---
title: Cats and dogs
language: en
---
# Cats {#cats}
Cats sleep all day long. They hunt mice at night, quietly and alone. A cat purrs when it is content.

## Food
Cats eat fish and small birds. Fish is rich in protein for them.

# Dogs
Dogs guard the house from strangers. A dog chases cats across the yard. Dogs fetch sticks in the park.
"""


@pytest.fixture(scope="module")
def parts(spark):
    c = spark.createDataFrame
    sections, chunks = build(c([("d", DOC)], "path string, value string"))
    content = c([("cats", "Cats are calm. They sleep.", "Cats nap.", ["sleep", "hunt"]), ("dogs", "Dogs are loyal. They bark.", None, [])], "section_id string, summary string, simple string, key_points array<string>")
    quiz = c([("cats", "q1", "What do cats eat?"), ("cats", "q2", "When do cats hunt?"), ("dogs", "q3", "What do dogs guard?")], "section_id string, quiz_id string, question string")
    faq = c([(0, "Why do cats purr?", ["What makes a cat purr?"], "Because they are content.", ["cats"])], "faq long, question string, alternates array<string>, answer string, sources array<string>")
    nodes = c([("cat", "cat", ["feline"], "cats"), ("dog", "dog", [], "dogs"), ("fish", "fish", [], "food")], "id string, label string, aliases array<string>, section_id string")
    edges = c([(0, "dog", "cat", "chases"), (1, "cat", "fish", "eats")], "edge_idx long, src string, dst string, relation string")
    return sections, chunks, content, quiz, faq, nodes, edges


def embedder():
    words = "cat cats dog dogs sleep hunt mice purr purrs eat fish birds guard house fetch sticks park why what do does where night content is".split()
    q, s = E.quantize_rows(np.random.default_rng(3).normal(size=(len(words) + 1, 32)).astype(np.float32))
    t = {"type": "bert-wordpiece", "vocab": ["[UNK]", *words], "unkToken": "[UNK]", "continuingSubwordPrefix": "##", "maxInputCharsPerWord": 100, "lowercase": True, "stripAccents": True, "handleChineseChars": True, "cleanText": True}
    return E.StaticEmbedder(E.Payload({"format": E.FORMAT, "model": "m", "dims": 32, "rows": len(words) + 1, "tokenizer": t, "pooling": {"maxTokens": 512}}, q, s))


def test_build(parts):
    sections, chunks = parts[0].orderBy("section_no").collect(), parts[1].collect()
    assert [(s["section_id"], s["level"], s["heading_path"]) for s in sections] == [("cats", 1, ["Cats"]), ("food", 2, ["Cats", "Food"]), ("dogs", 1, ["Dogs"])]
    assert {c["section_id"] for c in chunks} == {"cats", "food", "dogs"} and all(c["lang"] == "en" for c in chunks)


QUESTIONS = {
    1: ("When do cats hunt mice?", None, "question"), 2: ("Quiz me on cats", None, "quiz"), 3: ("Summarize the whole document", None, "summary"), 4: ("Summarize this section", "dogs", "summary"),
    5: ("Explain this simply", "dogs", "simple"), 6: ("How are dogs related to fish?", None, "relation"), 7: ("What are the main concepts of the cat?", None, "concepts"), 8: ("Where is fish?", None, "find"),
    9: ("Who won the lottery yesterday in Paris?", None, "question"), 10: ("Why do cats purr?", None, "question"), 11: ("key points of this section", "cats", "keyPoints"),
}


@pytest.mark.parametrize("vectors", [False, True])
def test_ask(spark, parts, vectors):
    sections, chunks, *rest = parts
    engine = Engine(chunks, sections, *rest, embedder=embedder() if vectors else None)
    asked = spark.createDataFrame([(k, t, "en", s) for k, (t, s, _) in QUESTIONS.items()], "query long, text string, lang string, current_section string")
    got = {r["query"]: r for r in engine.ask(asked).collect()}
    assert {k: r["intent"] for k, r in got.items()} == {k: i for k, (_, _, i) in QUESTIONS.items()}
    assert got[1]["kind"] == "extract" and "hunt mice" in got[1]["text"] and got[1]["sections"] == ["cats"]
    assert got[2]["kind"] == "quiz" and got[2]["text"] == "What do cats eat?\nWhen do cats hunt?"
    assert got[3]["kind"] == "docSummary" and got[3]["text"] == "Cats are calm.\nDogs are loyal."
    assert got[4]["text"] == "Dogs are loyal. They bark." and got[4]["kind"] == "generated"
    assert got[5]["kind"] == "message" and "simple explanation" in got[5]["text"]
    assert got[6]["kind"] == "relation" and "dog chases cats" in got[6]["text"] and got[6]["sections"] == ["cats", "dogs", "food"]
    assert got[7]["text"] == "chases dog\neats fish"
    assert got[8]["kind"] == "search" and got[8]["sections"][0] == "food"
    assert got[9]["kind"] == "notCovered"
    assert got[10]["kind"] == ("faq" if vectors else "extract")
    assert got[11]["text"] == "sleep\nhunt"


def test_missing_parts(spark, parts):
    engine = Engine(parts[1], parts[0])
    asked = spark.createDataFrame([(k, t, "en", s) for k, (t, s, _) in QUESTIONS.items()], "query long, text string, lang string, current_section string")
    got = {r["query"]: r for r in engine.ask(asked).collect()}
    assert {got[k]["kind"] for k in (2, 3, 4, 5, 11)} == {"message"} and got[1]["kind"] == "extract"


def test_search_and_suggestions(spark, parts):
    engine = Engine(parts[1], parts[0], faq=parts[4])
    asked = spark.createDataFrame([(1, "fish protein", "en", None)], "query long, text string, lang string, current_section string")
    hit = engine.search(asked).orderBy("rank").first()
    assert hit["section_id"] == "food" and "protein" in hit["snippet"]
    assert [r["question"] for r in engine.suggestions().collect()] == ["Why do cats purr?"]


@pytest.mark.parametrize("vectors", [False, True])
def test_relation_without_a_path_or_a_stated_link(spark, parts, vectors):
    sections, chunks = parts[:2]
    c = spark.createDataFrame
    nodes = c([("mouse", "mouse", ["mice"], None), ("night", "night", [], None), ("fish", "fish", [], None), ("stick", "stick", [], None), ("moon", "moon", [], None)], "id string, label string, aliases array<string>, section_id string")
    edges = c([(0, "fish", "stick", "is unlike")], "edge_idx long, src string, dst string, relation string")
    engine = Engine(chunks, sections, nodes=nodes, edges=edges, embedder=embedder() if vectors else None)
    asked = [(1, "mouse", "night"), (2, "fish", "stick"), (3, "fish", "moon"), (4, "moon", "moon")]
    rows = c([(q, f"How is {a} related to {b}?", "en", a, b) for q, a, b in asked], "query long, text string, lang string, a string, b string")
    got = {r["query"]: r for r in engine.relation(rows).collect()}
    assert got[1]["sentences"] == ["They hunt mice at night, quietly and alone."] and got[1]["steps"] == 0 and got[1]["sections"] == ["cats"]
    assert got[2]["steps"] == 1 and len(got[2]["sentences"]) == 2 and "ish" in got[2]["sentences"][0] and "sticks" in got[2]["sentences"][1]
    assert len(got[3]["sentences"]) == 1 and "ish" in got[3]["sentences"][0] and not got[4]["sentences"]


def test_relation_answer_keeps_every_pair(spark, tmp_path):
    from quarry.plans import answer_queries

    c = spark.createDataFrame
    tables = {
        "region": c([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": c([(0, "KENYA", 0), (1, "JAPAN", 1), (2, "EGYPT", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": c([(1, "Supplier#1", 0), (2, "Supplier#2", 0)], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": c([(1, "Customer#1", 1), (2, "Customer#2", 2), (3, "Customer#3", 1)], "c_custkey long, c_name string, c_nationkey int"),
    }
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["pair"]: r for r in answer_queries.relation_answer(spark, str(tmp_path)).collect()}
    assert got[1]["steps"] == 0 and got[1]["sentences"] == "Supplier#1 of KENYA in AFRICA sells here. | Customer#1 of JAPAN in ASIA buys here."
    assert got[1]["sections"] == "AFRICA,ASIA"
    assert got[2]["steps"] == 4 and got[2]["sentences"].startswith("Supplier#2 of KENYA in AFRICA sells here.") and got[2]["sections"] == "AFRICA"


def most_rows(df):
    """Rows that the plan node with most of them made."""
    df.collect()
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        made = p.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_evidence_does_not_compare_all_ends_with_all_sentences(spark, tmp_path):
    from quarry.plans import answer_queries

    n = 300
    tables = {
        "region": spark.createDataFrame([(0, "MIDDLE EAST")], "r_regionkey int, r_name string"),
        "nation": spark.createDataFrame([(0, "SAUDI ARABIA", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": spark.createDataFrame([(k, f"Supplier#{k % 250}", 0) for k in range(n)], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": spark.createDataFrame([(k, f"Customer#{k}", 0) for k in range(n)], "c_custkey long, c_name string, c_nationkey int"),
    }
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    out = answer_queries.step_evidence(spark, str(tmp_path))
    got = {r["edge_idx"]: r["sentence"] for r in out.collect()}
    place = "of SAUDI ARABIA in MIDDLE EAST"
    assert got[0] == f"Supplier#0 {place} sells here." and len(got) == 2 * n + 1
    # of namesakes the first one's sentence; Customer#1 is not Customer#10
    assert got[1_000_000_299] == f"Supplier#49 {place} sells here." and got[2_000_000_001] == f"Customer#1 {place} buys here."
    assert most_rows(out) < 40 * n  # 600 ends times 600 sentences are 360 000


def test_first_chunks_without_scoring_all_hits_of_common_terms(spark, monkeypatch):
    from quarry.operators import retrieval as R

    r = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", *(f"rare{k}" for k in range(60))]
    texts = [" ".join(["alpha"] * int(r.integers(1, 4)) + list(r.choice(words, int(r.integers(1, 9))))) for _ in range(300)]
    chunks = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "chunk long, text string, lang string")
    asked = [f"alpha beta rare{k % 60} rare{k % 7}" for k in range(80)] + ["alpha", "rare3", "unknown", "beta gamma", "alpha unknown"]
    queries = spark.createDataFrame([(k, t, "en") for k, t in enumerate(asked)], "query long, text string, lang string")
    index = R.Index(chunks)
    ranked = lambda scores: sorted(map(tuple, R.rank(scores, most=5).select("query", "rn", "chunk").collect()))
    want, hits = ranked(index.bm25(queries)), index.bm25(queries).count()
    for common in (0, 20, 1000):
        monkeypatch.setattr(R, "COMMON", common)
        assert ranked(index.first(queries, 5)) == want
    monkeypatch.setattr(R, "COMMON", 20)
    assert index.first(queries, 5).count() < hits / 5


def test_paths_do_not_walk_fans_of_leaves(spark, monkeypatch):
    from quarry.operators import graph as G

    n = 400
    edges = [(0, "n1", "r"), (1, "n2", "r"), *((10 + k, f"s{k}", "n1") for k in range(n)), *((10_000 + k, f"c{k}", "n2") for k in range(n))]
    e = spark.createDataFrame([(k, a, b, "in") for k, a, b in edges], "edge_idx long, src string, dst string, relation string")
    pairs = spark.createDataFrame([(k, f"s{k}", f"c{k}") for k in range(n)], "pair long, a string, b string")
    made, stored = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, name: (made.append(most_rows(df)), stored(df, name))[1])
    got = {r["pair"]: r["path"] for r in G.shortest_paths(e, pairs).collect()}
    assert got == {k: [10 + k, 0, 1, 10_000 + k] for k in range(n)}
    assert max(made) < 20 * n  # 400 pairs times the 401 edges at a node are 160 400


def test_long_base64_has_no_line_breaks(spark):
    import base64

    from quarry.functions import text as T

    rows = spark.createDataFrame([(bytes(range(n)),) for n in (0, 57, 58, 200)], "b binary")
    assert [r[0] for r in rows.select(T.base64("b")).collect()] == [base64.b64encode(bytes(range(n))).decode() for n in (0, 57, 58, 200)]


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    import math

    from quarry.operators import retrieval as R

    r = np.random.default_rng(11)
    rows = [(c, f"w{t}", int(r.integers(1, 6))) for c in range(200) for t in r.choice(24, 16, replace=False)]
    length = {c: sum(tf for d, _, tf in rows if d == c) for c in range(200)}
    chunks = spark.createDataFrame([(c, "", "en") for c in range(200)], "chunk long, text string, lang string")
    postings = spark.createDataFrame([(c, t, tf, length[c]) for c, t, tf in rows], "chunk long, term string, tf long, dl long").repartition(7)
    index = R.Index(chunks, postings)
    query = spark.createDataFrame([(0, " ".join(f"w{t}" for t in range(24)), "en")], "query long, text string, lang string")
    idf = {x["term"]: x["idf"] for x in index.weighted(R.query_terms(query)).collect()}
    mean = sum(length.values()) / 200
    part = lambda t, tf, dl: idf[t] * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * dl / mean))
    got = {x["chunk"]: x["score"] for x in index.bm25(query).collect()}
    assert got == {c: math.fsum(part(t, tf, length[c]) for d, t, tf in rows if d == c) for c in range(200)}


def test_cosines_are_summed_in_order(spark):
    from quarry.operators import retrieval as R

    r = np.random.default_rng(12)
    unit, stored = r.normal(size=(30, 37)), r.integers(-127, 128, size=(200, 37)).astype(float)
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(unit)], "query long, vector array<double>")
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(stored)], "key long, vector array<double>")
    got = {(x["query"], x["key"]): x["cos"] for x in R.cosines(q, v).collect()}
    assert got == {(a, b): _in_order(unit[a], stored[b]) / 127 for a in range(30) for b in range(200)}


def _in_order(a, b):
    """A plain loop: Python's own sum is compensated."""
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        total += x * y
    return total
