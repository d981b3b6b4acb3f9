import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.wordpiece import WordPiece


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Vectors of the analyzer's specification.
STEMS = {"queries": "query", "studies": "study", "horses": "horse", "embeddings": "embedding", "class": "class", "status": "status", "bus": "bus", "goes": "goe", "agrees": "agree"}


def test_stems(spark):
    rows = spark.createDataFrame(list(STEMS.items()), "w string, want string").select("want", T.s_stem(F.col("w")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


@pytest.mark.parametrize(
    ("text", "lang", "want"),
    [("What are the Queries, Keys and Values?", "en", ["query", "key", "value"]), ("Café Naïve", "fr", ["cafe", "naive"]), ("the queries", "de", ["the", "queries"]), ("ﬁne ½", "de", ["fine", "1", "2"]), ("", "en", [])],
)
def test_analyze(spark, text, lang, want):
    assert one(spark, T.analyze(F.lit(text), lang)) == want


def test_sentences(spark):
    got = one(spark, T.sentences(F.lit("Models use attention. For example, e.g. GPT uses it. Done!")))
    assert got == ["Models use attention.", "For example, e.g. GPT uses it.", "Done!"]


def test_small_functions(spark):
    assert one(spark, T.collapse(F.lit(" a\u00a0\n b "))) == "a b"
    assert one(spark, T.slug(F.lit("  Über — Größe! "))) == "uber-gro-e"
    assert one(spark, T.slug(F.lit("…"))) == "section"
    assert one(spark, T.heading_id(F.lit("Title {#my-id} "))) == "my-id"
    assert one(spark, T.heading_title(F.lit("Title {#my-id} "))) == "Title"
    assert one(spark, T.question_word(F.lit("Please describe where"))) == "what"
    assert one(spark, T.question_word(F.lit("nothing"))) is None
    assert one(spark, T.contains_phrase(F.array(F.lit("a"), F.lit("bc")), F.array(F.lit("b")))) is False
    assert one(spark, T.escape_html(F.lit('<a b="c">&'), quotes=True)) == "&lt;a b=&quot;c&quot;&gt;&amp;"
    assert one(spark, T.escape_json(F.lit("</script>"))) == "\\u003c/script>"
    assert one(spark, T.shortened(F.lit("x" * 300))) == "x" * 217 + "…"
    assert one(spark, T.locate(F.lit("a  b\nc"), F.lit("b c"))) == 3
    assert one(spark, T.iso_date(F.lit("2024-02-30"), F.lit("2000-01-01").cast("date"))) == "2000-01-01"
    assert one(spark, T.paragraphs(F.lit("a\n \n\n b \nc"))) == ["a", "b \nc"]


def test_wordpiece():
    t = WordPiece(["[UNK]", "un", "##aff", "##able", "σ", ",", "中"])
    assert t.encode("Unaffable, 中x") == [1, 2, 3, 5, 6, 0]
    assert t.normalize("ΑΣ") == "ας".replace("ς", "σ")
    assert t.encode("u" * 101) == [0]
    assert t.tokens("UN\u0301aff") == ["un", "##aff"]
    assert t.pre_tokenize("a-b $c\u2003d") == ["a", "-", "b", "$", "c", "d"]
    with pytest.raises(ValueError, match="unk"):
        WordPiece(["a"])


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_wordpiece_has_no_spaces_or_marks(text):
    t = WordPiece(["[UNK]"])
    words = t.pre_tokenize(t.normalize(text))
    assert all(w and not any(c.isspace() for c in w) for w in words)
    assert t.encode(text) == [0] * len(words)


def test_quotes_with_signs_glued_to_them(spark, tmp_path):
    from quarry.plans import text_queries

    items = [(1, "extraordinary things happen"), (2, "we met yesterday"), (3, "word"), (4, "two words"), (5, "not there")]
    docs = [(1, 'It says "extraordinary things happen" here.'), (2, "Then (we met yesterday), he said."), (3, "A last word. And two words."), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["item_id"], r["doc_id"]) for r in text_queries.exact_quotes(spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 3)}
