import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import neardup, substrings, vectors
from quarry.llm.graph import connected_components

from .helpers import LOWER, SPACE_WORD, components, corpus, prose, sha

DOCS = "doc_id long, text string, id string, n long"  # two extra columns with clashing names


def shingles(text, n):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_near(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(s), c, c == i) for (i, s), c in zip(sets.items(), components(links, sets).values(), strict=True)}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_match_brute_force(spark, n):
    rows = corpus(n, 150)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, ngram=n).collect()}
    assert got == brute_near(rows, n)


def test_large_group_of_near_copies_is_complete(spark, monkeypatch):
    """A family in which many pairs stay under the threshold, cut into small blocks."""
    monkeypatch.setattr(neardup, "STAR_BLOCK", 8)
    monkeypatch.setattr(neardup, "REST_BLOCK", 8)
    r = random.Random(4)
    base = prose(r, 90).split(" ")
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(r.randint(0, 12)):
            words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, ngram=2).collect()}
    assert got == brute_near(rows, 2)


@pytest.mark.parametrize("together", [True, False])
def test_rest_round_by_component_and_by_bucket(spark, monkeypatch, together):
    """Families whose members are far from each other's leads, with the two ways of grouping the rest."""
    monkeypatch.setattr(neardup, "REST_BLOCK", 4)
    if not together:  # a bucket's pairs cost nothing, so each stands alone
        real = neardup._rest
        monkeypatch.setattr(neardup, "_rest", lambda split, main, *a: real(split, main.withColumn("work", F.lit(-1)), *a))
    r = random.Random(14)
    rows = []
    for _ in range(4):
        base = prose(r, 60).split(" ")
        for _ in range(60):
            words = list(base)
            for k in r.sample(range(len(base)), r.randint(0, 9)):
                words[k] = f"v{r.randrange(4)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, ngram=2).collect()}
    assert got == brute_near(rows, 2)


def test_rows_that_share_an_id(spark):
    """One document with several texts joins the links of all of them; as rows, each is judged alone."""
    r = random.Random(2)
    a, b, c, d = (prose(r, 30) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (9, b), (5, ""), (7, c), (7, c), (7, d), (8, d), (None, c), (None, "only here"), (None, "only here")]
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], DOCS)
    got = sorted((x["doc_id"] or 0, x["n_shingles"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(df, ngram=2).collect())
    size = lambda t: len(shingles(t, 2))
    want = [(3, size(a), 3, True), (5, size(a), 3, False), (5, size(b), 3, False), (9, size(b), 3, False), (5, 0, 5, True), (7, size(c), 7, True), (7, size(c), 7, True), (7, size(d), 7, True), (8, size(d), 7, False)]
    assert got == sorted([*want, (0, size(c), None, True), (0, 1, None, True), (0, 1, None, True)], key=lambda x: (x[0], x[1], x[2] or 0, x[3]))
    kept = lambda d: sorted((x["doc_id"] or 0, x["text"], x["n"]) for x in neardup.one_of_each(d, ngram=2).collect())
    once = kept(df)
    assert [(i, t) for i, t, _ in once] == sorted([(3, a), (5, b), (5, ""), (7, c), (7, d), (0, "only here")]) and once == kept(df.repartition(5))
    with pytest.raises(TypeError, match="integer"):
        neardup.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_near_duplicate_cases(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, " \t", "x", 0), (4, "Word", "x", 0), (9, "word", "x", 0), (5, long, "x", 0), (6, long + " more", "x", 0), (7, "a b c", "x", 0), (7, "a b c", "x", 0), (None, "a b c", "x", 0), (None, None, "x", 0)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), ngram=2).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[4] == (1, 4, True) and by[9] == (1, 4, False)
    assert by[5] == (59999, 5, True) and by[6] == (60000, 5, False) and by[7] == (2, 7, True) and by[None][1:] == (None, True)
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    kept = neardup.one_of_each(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "id", "n"] and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 5, 7]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(159, 99)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 99 for i in range(99, 160)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def brute_substrings(rows, span=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = SPACE_WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - span + 1):
            key = tuple(w[s : s + span])
            if key in seen:
                gone[s : s + span] = [True] * span
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substrings_match_brute_force(spark):
    rows = [*corpus(9, 120), (500, "x " * 300), (501, "a b c " * 40), (502, None), (503, "tail " + "a b c " * 40)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    got = substrings.repeated_spans(df)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == brute_substrings(rows)
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_substring_cases(spark):
    big = 1 << 60
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(big, text, "x", 0), (5, text + " end", "x", 0), (None, text, "x", 0), (7, text, "x", 0), (7, text, "x", 0), (-3, "short", "x", 0)]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.repeated_spans(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(-3, 0), (0, 0), (5, 0), (7, 30), (7, 30), (big, 30)]
    assert substrings.repeated_spans(spark.createDataFrame([], DOCS)).collect() == []


def test_substrings_of_rows_that_share_an_id(spark):
    """Documents of their own, in the order of their texts' hashes; equal rows are one document."""
    r = random.Random(11)
    parts = [prose(r, 40) for _ in range(4)]
    rows = [(1, parts[0]), (2, parts[0] + " and five more words here"), (2, "other " + parts[1]), (2, parts[2]), (2, parts[2]), (3, parts[2] + " " + parts[3]), (3, parts[3] + " " + parts[1])]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    got = substrings.repeated_spans(df.withColumn("key", F.xxhash64("text"))).collect()
    order = {t: r["key"] for (_, t), r in zip(rows, df.select(F.xxhash64("text").alias("key")).collect(), strict=True)}
    keyed = {(i, order[t]): t for i, t in rows}
    brute = brute_substrings([(k, t) for k, t in keyed.items()])
    want = sorted((i, *brute[i, order[t]]) for i, t in rows)
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == want and sum(x[2] for x in want) > 100


VECS = "vec_id long, embedding array<float>, label int, n long, unit string"


def brute_vectors(rows):
    unit = {}
    for i, v, label in rows:
        x = np.array(v, dtype=np.float64)
        unit[i] = (x / np.linalg.norm(x), label)
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= 0.93]
    comp = components(links, unit)
    return {i: (sum(i in p for p in links), comp[i], comp[i] == i) for i in unit}


@pytest.mark.parametrize("per_cell", [96, 1])
def test_vectors_match_brute_force(spark, monkeypatch, per_cell):
    """In one cell, and in a grid of 100 cells or so."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "PER_CELL", per_cell)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(14):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 30))):
            v = centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.25])
            rows.append((len(rows), [float(np.float32(x)) for x in v], c % 2))
    df = spark.createDataFrame([(i, v, label, 0, "u") for i, v, label in rows], VECS)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    want = brute_vectors(rows)
    found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert found >= 0.99 * there and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0, 0, "u"), (2, [2.0, 0.0], 0, 0, "u"), (3, [1.0, 0.0], 1, 0, "u"), (4, [1.0, 0.0], None, 0, "u"), (5, None, 0, 0, "u"), (6, [0.0, 0.0], 0, 0, "u"), (7, [nan, 1.0], 0, 0, "u"),
        (8, [inf, 1.0], 0, 0, "u"), (9, [1.0, None], 0, 0, "u"), (10, [], 0, 0, "u"), (11, [1.0], 0, 0, "u"), (12, [1.0, 0.0], 0, 0, "u"), (None, [1.0, 0.0], 0, 0, "u"),
    ]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, VECS)).collect()}
    assert len(got) == 13
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[12] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None, True)
    # rows that share an id are vectors of their own; components may be huge or tiny
    wide = [(1, [1e200, 1e200], 0), (2, [1e200, 1.0001e200], 0), (3, [1e-200, 1e-200], 0), (4, [5e-324, 0.0], 0), (5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (6, [0.0, 2.0], 0), (0, [0.0, 3.0], 1), (0, [-1.0, 0.1], 1)]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>, label int")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()) == [
        (0, 0, 0, True), (0, 0, 0, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 5, True), (6, 1, 5, False),
    ]
    with pytest.raises(TypeError, match="integer"):
        vectors.near_duplicates(spark.createDataFrame([("a", [1.0], 0)], "vec_id string, embedding array<float>, label int"))
    assert vectors.near_duplicates(spark.createDataFrame([], VECS)).collect() == []
