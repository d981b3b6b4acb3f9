import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import boosting, dom, extract, training_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li>
<li><a href="/c">Menu three</a></li></ul></nav><!-- c --><div class="ad">Buy this now, it is cheap.</div><article><h1>The title &amp; more</h1><p><b>First words of the text, which go on.<br><p>Second
 part, with&nbsp;spaces   and <i>inl</i>ine marks.</p><p>Third part.</article><div class="comments"><div class="comment"><p>Nice post, thanks a lot for it.</p></div></div><footer>&copy; somebody &middot; all rights reserved.</footer>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "just text"), (1, "u", PAGE), (None, None, "<p>x")]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), fit_pages=400).withColumn("n", F.length("text")).collect()
    want = "The title & more First words of the text, which go on. Second part, with spaces and inline marks. Third part."
    assert len(got) == 6 and [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    by = {r["page_id"]: r["text"] for r in got}
    assert by[2] == "" and by[3] == "" and by[4] == "just text" and by[None] is not None
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), fit_pages=400).collect() == []


def test_fresh_pages_are_judged_well():
    trees = extract.fitted(400)
    wrong = total = 0
    for _, html in training_pages.pages(120, seed=77):
        nodes = dom.parse(html)
        truth = extract._labels(html, nodes) > 0
        odds = trees.odds(extract.features(nodes))
        odds[0] = 0
        kept = np.array(extract.decode(nodes, odds))
        wrong += int((kept != truth).sum())
        total += len(nodes)
        for node, k in zip(nodes, kept, strict=True):  # no kept node under a dropped one
            assert not k or node.parent is None or kept[nodes.index(node.parent)]
    assert wrong <= 0.04 * total


def test_decoding_drops_whole_subtrees():
    nodes = dom.parse("<div><p>a</p><p>b</p></div><p>c</p>")
    assert extract.decode(nodes, np.array([0.0, -1.0, 3.0, 3.0, -2.0])) == [True, True, True, True, False]
    assert extract.decode(nodes, np.array([0.0, -9.0, 3.0, 3.0, 2.0])) == [True, False, False, False, True]


def test_tree_of_untidy_html():
    nodes = dom.parse('<p>a<b>b<p>c<li>x<li>y</ul><a href="x>y">z</a><script>if (a<b) "</p>"</script>t<table><tr><td>1<td>2<tr><td>3</table><p')
    assert [n.tag for n in nodes].count("li") == 2 and [n.tag for n in nodes].count("td") == 3
    assert dom.clean([t[1] for n in nodes for t in n.texts if "if" in t[1]]) == ""
    dom.parse("<" * 20000)
    dom.parse('<a "' * 5000)
    dom.parse("<div>" * 5000 + "x")


WORDS = "The council met on Monday evening to discuss the new plan for the river park, and many residents came to speak about it. "


def test_text_in_the_body_itself_is_kept():
    trees = extract.fitted()
    page = f"<body>Loose opening text that begins the article. <p>{WORDS * 3}</p> And closing loose text, as one does.</body>"
    assert extract.texts([page], trees) == [" ".join(f"Loose opening text that begins the article. {WORDS * 3} And closing loose text, as one does.".split())]


def test_names_of_another_language():
    trees = extract.fitted()
    menu = "<div class='navigation'><ul><li><a href=/a>Eins</a></li><li><a href=/b>Zwei</a></li></ul></div>"
    page = f"<body>{menu}<div class='inhalt'><h1>Titel</h1><p>{WORDS * 3}</p><p>{WORDS}</p></div><div class='kommentar'><div class='eintrag'><p>Toll!</p></div></div></body>"
    text = extract.texts([page], trees)[0]
    assert text.startswith(" ".join(f"Titel {WORDS * 4}".split())) and "Eins" not in text


def test_decoding_is_the_best_consistent_choice():
    """Against all choices in which no kept node has a dropped parent; the gain of a choice is the sum of signed odds."""
    rng = np.random.default_rng(5)
    pages = ["<div><p>a</p><div><p>b</p><p>c</p></div></div><p>d</p>", "<div><div><div><p>a</p></div><p>b</p></div></div><ul><li>c<li>d</ul>", "a<p>b</p>c"]
    for page in pages:
        nodes = dom.parse(page)
        parents = [0] + [nodes.index(n.parent) for n in nodes[1:]]
        for _ in range(40):
            odds = np.concatenate([[0.0], rng.normal(size=len(nodes) - 1)])
            best = max(
                sum(o if k else -o for o, k in zip(odds, choice, strict=True))
                for bits in itertools.product((False, True), repeat=len(nodes) - 1)
                if all(not k or choice[p] for choice in [(True, *bits)] for k, p in zip(choice, parents, strict=True))
                for choice in [(True, *bits)]
            )
            kept = extract.decode(nodes, odds)
            assert all(not k or kept[p] for k, p in zip(kept, parents, strict=True))
            assert sum(o if k else -o for o, k in zip(odds, kept, strict=True)) == pytest.approx(best)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = boosting.fit(x[:3000], y[:3000])
    assert ((trees.odds(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.95


def test_text_after_an_open_head_or_control_is_read():
    read = lambda html: dom.clean([x for _, x, _ in sorted(t for n in dom.parse(html) for t in n.texts)])
    assert read("<html><head><title>T</title><meta charset=x><body class=c><p>Some text.</p></body></html>") == "Some text."
    assert read("<html><head><title>T</title><p>Some text.") == "Some text." == read("<head><title>T</title>Some text.")
    assert read("<head><script>x</script>Some <b>text.") == "Some text."
    for tag in ("button", "select", "object"):
        assert read(f"<div><{tag}>no<p>Some text.</p></div>") == "Some text.", tag
    assert read("<div><button>no<p>Some</p><button>no</button> text.</div>") == "Some text."
    assert read("<div><button><div>no</div></button>Some text.</div>") == "Some text."
