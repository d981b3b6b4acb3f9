import random

import numpy as np
import pytest

from quarry.llm import automaton

from .helpers import SPACE_WORD, prose

SCHEMA = "doc_id long, text string, spans string"


def brute(text, reference, span):
    w = SPACE_WORD.findall(text or "")
    hit = [False] * len(w)
    known = set()
    for t in reference:
        r = SPACE_WORD.findall(t or "")
        known |= {tuple(r[i : i + span]) for i in range(len(r) - span + 1)}
    for i in range(len(w) - span + 1):
        if tuple(w[i : i + span]) in known:
            hit[i : i + span] = [True] * span
    return sum(hit)


def test_statistics_match_brute_force():
    r = random.Random(0)
    for _ in range(60):
        a = automaton.SuffixAutomaton()
        texts = [[r.randrange(3) for _ in range(r.randint(0, 25))] for _ in range(4)]
        for t in texts:
            a.add(t)
        q = [r.randrange(4) for _ in range(30)]
        known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max((k for k in range(1, e + 2) if tuple(q[e + 1 - k : e + 1]) in known), default=0) for e in range(len(q))]
        assert a.statistics(q) == want


def test_shared_spans(spark):
    r = random.Random(2)
    reference = [prose(r, r.randint(0, 80)) for _ in range(12)] + [None, ""]
    rows = []
    for i in range(60):
        w = (r.choice(reference) or "").split(" ")
        a = r.randrange(len(w))
        rows.append((i, prose(r, 30) + " " + " ".join(w[a : a + r.randint(1, 40)]) + " " + prose(r, 5), "x"))
    rows += [(100, None, "x"), (101, "", "x")]
    ref = spark.createDataFrame([(t,) for t in reference], "text string")
    got = automaton.shared_spans(spark.createDataFrame(rows, SCHEMA), ref, span=6, shard_words=100).collect()
    assert {x["doc_id"]: x["n_hit"] for x in got} == {i: brute(t, reference, 6) for i, t, _ in rows}
    assert all(s["end"] - s["start"] >= 6 for x in got for s in x["spans"])
    with pytest.raises(ValueError, match="words"):
        automaton.shards(ref, most_words=10)
    assert automaton.shared_spans(spark.createDataFrame(rows, SCHEMA), ref.limit(0)).where("n_hit > 0").count() == 0


def test_covered():
    assert automaton.covered([1, 2, 3, 0, 1], 3).tolist() == [True, True, True, False, False]
    assert automaton.covered(np.zeros(0), 3).tolist() == []
