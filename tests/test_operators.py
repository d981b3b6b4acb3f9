import datetime
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import answers as A
from quarry.operators import document as D
from quarry.operators import embedder as E
from quarry.operators import graph as G
from quarry.operators import package as P
from quarry.operators import retrieval as R
from quarry.operators import router
from quarry.operators import sanitize as Z
from quarry.operators import validate
from quarry.sources import blocks as B
from quarry.sources import markdown, tensors


def test_bm25_micro_corpus(spark):
    chunks = spark.createDataFrame([(0, "en", "the cat sat on the mat"), (1, "en", "dogs chase cats"), (2, "en", "attention is all you need")], "chunk long, lang string, text string")
    asked = spark.createDataFrame([(7, "en", "attention needs")], "query long, lang string, text string")
    assert [(r["query"], r["chunk"]) for r in R.Index(chunks).bm25(asked).collect()] == [(7, 2)]


def test_empty_corpus(spark):
    chunks = spark.createDataFrame([], "chunk long, lang string, text string")
    asked = spark.createDataFrame([(7, "en", "attention needs")], "query long, lang string, text string")
    index = R.Index(chunks)
    assert index.bm25(asked).count() == 0
    assert A.coverage(asked, index).collect()[0]["coverage"] == 0.0


def test_index_tables(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "en", "cats sit"), (1, "en", "dogs run")], "chunk long, lang string, text string")
    asked = spark.createDataFrame([(5, "en", "running dogs")], "query long, lang string, text string")
    R.Index(chunks).write(str(tmp_path))
    loaded = R.Index.load(spark, str(tmp_path))
    assert loaded.bm25(asked).collect() == R.Index(chunks).keep().bm25(asked).collect()


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "query long, chunk long, rn int")
    b = spark.createDataFrame([(1, 1, 1), (1, 0, 2)], "query long, chunk long, rn int")
    x, y = (r["fused"] for r in R.fuse(a, b).collect())
    assert math.isclose(x, y)


def test_cosine_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(9)], "query long, vector array<double>")
    v = spark.createDataFrame([(i, [int(x) for x in rng.integers(-127, 128, 8)]) for i in range(300)], "key long, vector array<int>")
    whole = {(r["query"], r["key"]): round(r["cos"], 9) for r in R.cosines(q, v).collect()}
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    assert {(r["query"], r["key"]): round(r["cos"], 9) for r in R.cosines(q, v).collect()} == whole
    top = R.cosines(q, v, 3).collect()
    for k in range(9):
        best = sorted((c for (a, _), c in whole.items() if a == k), reverse=True)[:3]
        assert set(best) <= {round(r["cos"], 9) for r in top if r["query"] == k}


def test_rounding_modes(spark):
    row = spark.range(1).select(
        V.quantize(F.array(F.lit(0.5 / 127), F.lit(-0.5 / 127), F.lit(2.0))).alias("a"), V.quantize_row(F.array(F.lit(0.5), F.lit(-0.5)), F.lit(1.0)).alias("b")
    ).first()
    assert list(row["a"]) == [1, -1, 127]
    assert list(row["b"]) == [1, 0]


def test_half_floats(spark):
    values = [0.0, 1.0, -1.0, 0.5, 65504.0, 6.1035e-5, 5.96e-8, 0.0078125, 3.14159]
    bits = np.array(values, np.float16).view(np.uint16)
    rows = spark.createDataFrame([(int(b), v) for b, v in zip(bits, values, strict=True)], "b int, v double").select("v", V.f16_value(F.col("b")).alias("x")).collect()
    assert all(abs(r["x"] - r["v"]) <= abs(r["v"]) * 1e-3 + 6e-8 for r in rows)


def test_heading_stack_and_ids(spark):
    h = [(1, 0, 1, "A"), (1, 1, 3, "C"), (1, 2, 2, "B"), (1, 3, 3, "D"), (1, 4, 1, "E")]
    rows = spark.createDataFrame(h, "doc long, pos int, level int, title string")
    assert [r["heading_path"] for r in D.heading_paths(rows).orderBy("pos").collect()] == [["A"], ["A", "C"], ["A", "B"], ["A", "B", "D"], ["E"]]
    ids = spark.createDataFrame([(1, i, x) for i, x in enumerate(["x", "x-2", "x", "x"])], "doc long, pos int, id string")
    assert [r["unique_id"] for r in D.unique_ids(ids).orderBy("pos").collect()] == ["x", "x-2", "x-3", "x-4"]


def greedy(tokens, most, least):
    groups, current, total = [], [], 0
    for i, t in enumerate(tokens):
        if current and total + t > most:
            groups.append(current)
            current, total = [], 0
        current.append(i)
        total += t
    groups.append(current)
    if len(groups) > 1:
        a, b = (sum(tokens[i] for i in g) for g in groups[-2:])
        if b * 2 < least and a + b <= most + least / 2:
            groups[-2:] = [groups[-2] + groups[-1]]
    return groups


def test_chunks_match_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    docs = {d: [int(x) for x in rng.integers(1, 40, rng.integers(1, 30))] for d in range(12)}
    rows = [(d, i, f"b{i}", 0, " ".join(["w"] * t)) for d, ts in docs.items() for i, t in enumerate(ts)]
    blocks = spark.createDataFrame(rows, "doc long, pos int, block_id string, section_no long, text string")
    got = D.chunks(D.merge_tails(D.groups(D.units(blocks, 60), 60), 60, 30)).orderBy("doc", "chunk_no").collect()
    for d, ts in docs.items():
        want = [[f"b{i}" for i in g] for g in greedy(ts, 60, 30)]
        assert [r["blocks"] for r in got if r["doc"] == d] == want


def test_large_block_is_cut_at_sentences(spark):
    text = " ".join("One two three four." for _ in range(10))
    blocks = spark.createDataFrame([(1, 0, "b0", 0, text), (1, 1, "b1", 0, "Tail here.")], "doc long, pos int, block_id string, section_no long, text string")
    got = D.chunks(D.merge_tails(D.groups(D.units(blocks, 20), 20), 20, 0)).orderBy("chunk_no").collect()
    assert [r["tokens"] for r in got] == [20, 20, 10, 3]
    assert got[0]["text"].count("\n") == 0 and got[0]["blocks"] == ["b0"]


def test_shortest_path_takes_the_first_edges(spark):
    edges = spark.createDataFrame([(0, "a", "b", "x"), (1, "c", "b", "x"), (2, "a", "d", "x"), (3, "d", "c", "x"), (4, "e", "e", "x")], "edge_idx long, src string, dst string, relation string")
    pairs = spark.createDataFrame([(1, "a", "c"), (2, "a", "a"), (3, "a", "e")], "pair long, a string, b string")
    paths = {r["pair"]: r["path"] for r in G.shortest_paths(edges, pairs).collect()}
    assert paths == {1: [0, 1], 2: []}
    steps = G.path_steps(G.shortest_paths(edges, pairs), pairs, edges).orderBy("step").collect()
    assert [(r["src"], r["dst"], r["forward"]) for r in steps] == [("a", "b", True), ("b", "c", False)]
    loops = G.neighbors(edges, spark.createDataFrame([("e",)], "node string")).collect()
    assert len(loops) == 1


def test_shortest_path_of_ten_edges(spark):
    edges = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}", "x") for i in range(10)], "edge_idx long, src string, dst string, relation string")
    pairs = spark.createDataFrame([(1, "n0", "n10"), (2, "n0", "far")], "pair long, a string, b string")
    assert {r["pair"]: r["path"] for r in G.shortest_paths(edges, pairs).collect()} == {1: list(range(10))}


# Routing vectors.
ROUTES = {
    "Quiz me on attention": "quiz", "Explain this simply": "simple", "key points of this section": "keyPoints", "Summarize this section": "summary",
    "Where is softmax discussed?": "find", "What is softmax?": "question", "Show the concept map": "concepts",
}


def test_intents(spark):
    rows = spark.createDataFrame(list(ROUTES.items()), "q string, want string")
    got = rows.select("q", "want", router.intent(router.normalized(F.col("q")), F.lit(0)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got


def test_names_are_longest_first_without_overlap(spark):
    names = spark.createDataFrame([(0, ["kingdom"], "k", "s1"), (1, ["united", "kingdom"], "uk", None)], "name_id int, terms array<string>, node string, section_id string")
    asked = spark.createDataFrame([(1, "The united kingdom and a kingdom", "en")], "query long, text string, lang string")
    assert [(r["pos"], r["node"]) for r in router.match_names(asked, names).orderBy("pos").collect()] == [(0, "uk"), (2, "k")]


HOSTILE = """<p onclick=x style=y>Hi <script>alert(1)</script><a href=" java\tscript:alert(1)">x</a><a href="https://e.org" rel=z>y</a>
<img src="http://e.org/a.png"><img src="data:image/png;base64,AAAA"><svg><use href="http://e"/><use href="#ok"/><circle fill="url(http://e)" r=1 /></svg>
<iframe src=x>in</iframe><blink id="quarry-x">b</blink><!-- c --><form><input></form><a href="vbscript:x">v</a><p id="1bad">w</p>"""


def test_sanitizer_leaves_nothing_forbidden():
    clean, warnings = Z.sanitized(HOSTILE)
    low = clean.lower()
    for bad in ("script", "onclick", "style=", "http://e", "iframe", "<form", "<input", "blink", "quarry-", "<!--", "1bad", "alert"):
        assert bad not in low, (bad, clean)
    assert 'rel="noopener noreferrer"' in clean and 'href="#ok"' in clean and "data:image/png" in clean
    assert warnings
    assert Z.sanitized(clean)[0] == clean


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="<>/=\"' abscriptonmg:#&;", max_size=60))
def test_sanitizer_is_closed(text):
    clean = Z.sanitized(text)[0]
    assert "<script" not in clean and Z.sanitized(clean)[0] == clean


def payload():
    rng = np.random.default_rng(0)
    vocab = ["[UNK]", "cat", "dog", "##s"]
    q, s = E.quantize_rows(rng.normal(size=(4, 6)).astype(np.float32))
    tokenizer = {"type": "bert-wordpiece", "vocab": vocab, "unkToken": "[UNK]", "continuingSubwordPrefix": "##", "maxInputCharsPerWord": 100, "lowercase": True, "stripAccents": True, "handleChineseChars": True, "cleanText": True}
    return E.Payload({"format": E.FORMAT, "model": "m", "dims": 6, "rows": 4, "tokenizer": tokenizer, "pooling": {"maxTokens": 512}}, q, s)


def test_embedder_payload_round_trip(spark):
    p = payload()
    data = E.encode(p)
    back = E.decode(data)
    assert (back.matrix == p.matrix).all() and np.allclose(back.scales, p.scales) and back.header == p.header
    for bad in (b"XXXX" + data[4:], data[:-1], data + b"\0", data[:6]):
        with pytest.raises(ValueError):
            E.decode(bad)
    e = E.StaticEmbedder(back)
    assert math.isclose(np.linalg.norm(e.embed("cats dog")), 1.0)
    assert not e.embed("zebra").any()
    assert e.word_weight("zebra") == 0 and e.word_weight("cats") == max(e.norms[1], e.norms[3])
    df = spark.createDataFrame([("cats dog",), (None,)], "t string")
    got = E.embed(df, "t", e).collect()
    assert np.allclose(got[0]["vector"], e.embed("cats dog")) and not any(got[1]["vector"])
    files = spark.createDataFrame([("p", data)], "path string, content binary")
    assert tensors.scan_embedder(files).count() == 4


def test_principal_axes(spark):
    a = np.array([[4, 1, 2], [1, 3, 0], [2, 0, 1]], float)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.linalg.cholesky(a + 2 * np.eye(3)).T)], "key long, vector array<double>")
    g = np.zeros((3, 3))
    for r in E.gram(rows).collect():
        g[r["i"], r["j"]] = r["g"]
    assert np.allclose(g, a + 2 * np.eye(3))
    axes = E.principal_axes(rows, 3)
    values = np.diag(axes.T @ g @ axes)
    assert np.allclose(g @ axes, axes * values) and values[0] >= values[1] >= values[2]


def test_safetensors(tmp_path, spark):
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    data = tensors.write_tensor("e", x)
    assert (tensors.tensor(data, "e") == x).all()
    with pytest.raises(ValueError):
        tensors.tensor(data, "f")
    (tmp_path / "m.safetensors").write_bytes(data)
    assert tensors.scan_safetensors(tensors.read_files(spark, str(tmp_path)), "e").count() == 2


def test_blocks(spark):
    html = '<script type="application/a" id="x" data-compression="gzip">{}</script>'
    kind, text = B.encode_gzip(b"a" * 1000)
    assert kind == "gzip" and B.encode_gzip(bytes(range(40)))[0] == "none"
    pages = spark.createDataFrame([(1, html.replace("{}", text)), (2, "none"), (3, html.replace("{}", "!!"))], "k long, h string")
    got = {r["k"]: r["bytes"] for r in B.decode(B.scan(pages, "k", "h")).collect()}
    assert bytes(got[1]) == b"a" * 1000 and got[3] is None and 2 not in got
    assert B.bounded_gunzip(__import__("gzip").compress(b"a" * 100), 99) is None
    assert B.bounded_gunzip(b"junk") is None


MD = """---
title: "My doc"
language: en
---
Intro text.

# First {#one}
A **bold** [link](http://x) and `code`.

- item one
- item *two*

> quoted

| a | b |
|---|---|
| 1 | 2 |

```
code | here
```
<figure><img alt="An image"></figure>

## Second
"""


def test_markdown(spark):
    meta, blocks = markdown.parse(MD)
    assert meta == {"title": "My doc", "language": "en"}
    assert [(b[0], b[3]) for b in blocks] == [
        ("p", "Intro text."), ("h1", "First"), ("p", "A bold link and code."), ("li", "item one"), ("li", "item two"), ("blockquote", "quoted"),
        ("tr", "a b"), ("tr", "1 2"), ("pre", "code | here"), ("figure", "An image"), ("h2", "Second"),
    ]
    assert blocks[1][2] == "one"
    with pytest.raises(ValueError):
        markdown.parse("# T {#bad id}")
    rows = markdown.scan(spark.createDataFrame([("a", MD)], "path string, value string"), "path").collect()
    assert len(rows) == 11 and rows[0]["meta"]["title"] == "My doc"


def test_check_references_finds_each_rule(spark):
    c = spark.createDataFrame
    found = validate.check_references(
        c([("s",)], "section_id string"),
        c([("q1", "s", ["a", "a"], 0), ("q1", "t", ["a", "b"], 5)], "quiz_id string, section_id string, options array<string>, answer_index int"),
        c([("f1", []), ("f1", ["u"])], "faq_id string, sources array<string>"),
        c([("n", "s"), ("n", "v")], "id string, section_id string"),
        c([("n", "m", "r"), ("n", "m", "r"), ("o", "n", "r")], "src string, dst string, relation string"),
    )
    assert {r["message"] for r in found.collect()} == {
        "unknown section of content", "quiz id is not unique", "answer index out of range", "duplicate options", "faq id is not unique", "no sources",
        "unknown section of faq", "node is not unique", "unknown section of node", "unknown node of edge", "edge duplicated",
    }


def test_size_settles():
    page, total = P.settle_size(lambda n, pad: f"size={n}{pad};" + "x" * 90)
    assert len(page) == total and f"size={total}" in page


def test_streamed_questions(spark, tmp_path):
    from quarry.streaming import questions

    chunks = spark.createDataFrame([(0, "en", "cats sit"), (1, "en", "dogs run")], "chunk long, lang string, text string")
    index = R.Index(chunks)
    spark.createDataFrame([(5, "where do dogs run", "en", datetime.datetime(2024, 1, 1))], questions.SCHEMA).write.parquet(str(tmp_path / "in"))
    seen = []
    q = questions.search(spark.readStream.schema(questions.SCHEMA).parquet(str(tmp_path / "in")), index, lambda hits, _: seen.extend(hits.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert [(r["query"], r["chunk"]) for r in seen] == [(5, 1)]
    out = questions.intents(spark.readStream.schema(questions.SCHEMA).parquet(str(tmp_path / "in")))
    assert out.isStreaming and set(out.columns) == {"window", "intent", "n"}
