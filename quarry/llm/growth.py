"""Rules "tokens => verdict" by FP-growth, whatever the length of the rows.

The conditional base of an item set is the rows that hold it, cut to the items that may still join it; equal rows are
merged with their counts. As in parallel FP-growth, bases are mined apart: a base of more than ``BASE_ROWS`` rows is taken
one item further by Spark, the others are mined by the tasks that hold them; a base of ``FEW`` mixed items at most is
counted for all sets of these at once.

Nothing is cut off. Item sets are left out where they and all larger ones give no rule, or only rules that a shorter one
makes redundant:

* no verdict has the least rows;
* one verdict has all rows: no larger set is surer;
* an item that all rows of a base hold adds nothing to it;
* tokens that the same labelled rows hold are one item;
* no wanted row holds the set, so the rule would judge nothing.

What is left grows with the number of mixed sets that are frequent and wanted. In the worst case (long wanted rows, whose
tokens occur in long rows of several verdicts, each time with others) it is exponential in the length of a wanted row.
"Same rows" and the equality of labelled rows is equality of two 64-bit hashes and of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.store import release, stored

#: Rows of a base that a task mines at most; larger ones are divided first.
BASE_ROWS = 20_000
#: Items of a base whose sets are all counted in one array, of 2 ** FEW places.
FEW = 12

RULE = "antecedent array<int>, verdict string, confidence double, rows long"


def mine(labelled: DataFrame, wanted: DataFrame, least: int, sure: float, base_rows: int = BASE_ROWS, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """All rules of (tokens, verdict) rows that hold for ``least`` rows, are as sure as ``sure`` and fit a row of ``wanted``
    (tokens), but those that a part of their items gives as surely.

    Returns rules (antecedent of items in order, verdict, confidence, rows) and classes (token, item): a row holds an item
    if it holds a token of it. Items are numbered from the most frequent.
    """
    distinct = F.array_sort(F.array_distinct("tokens")).alias("tokens")
    known = labelled.select(distinct, "verdict").groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
    asked = wanted.select(distinct).distinct().select("tokens", F.lit(None).cast("string").alias("verdict"), F.lit(1).cast("long").alias("n"))
    sets = stored(known.union(asked).withColumn("key", F.xxhash64("tokens", F.coalesce("verdict", F.lit("")), F.col("verdict").isNull())), "rule-sets")
    seen = sets.select("key", "verdict", "n", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"mark{i}") for i in (1, 2)]
    counts = stored(seen.groupBy("token", "verdict").agg(F.sum("n").alias("n"), *marks), "rule-counts")
    said = F.col("verdict").isNotNull()
    same = [F.bit_xor(F.when(said, F.col(f"mark{i}"))).alias(f"mark{i}") for i in (1, 2)]
    tokens = counts.groupBy("token").agg(*_totals(), *same).where(f"asked and best >= {least}")
    # frequent tokens are few: their number is bounded by the rows' mean length and the least share
    order = Window.orderBy(F.col("total").desc(), "best", "mark1", "mark2")
    classes = stored(tokens.select("token", F.dense_rank().over(order).alias("item"), "total", "best"), "rule-classes")

    single = counts.where(said & (F.col("n") >= least)).join(classes, "token").select("item", "verdict", "n", "total").distinct()
    single = single.select(F.array("item").alias("antecedent"), "verdict", (F.col("n") / F.col("total")).alias("confidence"), F.col("n").alias("rows"))
    mixed = classes.where("best < total").select("token", "item")
    items = seen.join(mixed, "token").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<int>")
    rows = sets.select("key", "verdict", "n").join(items, "key", "left").select(none.alias("base"), F.coalesce("items", none).alias("items"), "verdict", "n")
    rows = stored(rows.groupBy("base", "items", "verdict").agg(F.sum("n").alias("n")), "rule-base")

    found, spent = [single.where(F.col("confidence") >= sure)], [sets, counts]
    while not rows.isEmpty():
        rules, kids = _one_further(rows, least, sure)
        found.append(rules)
        large = stored(kids.groupBy("base").agg(F.count("*").alias("held")).where(F.col("held") > base_rows).select("base"), "rule-large")
        small = kids.join(large, "base", "left_anti").groupBy("base").applyInArrow(_grown(least, sure, few), RULE)
        found.append(stored(small, "rule-grown"))
        spent += [rows, large, kids]
        rows = stored(kids.join(large, "base"), "rule-base")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = stored(every, "rule-every")
    release(*spent, *found[1:], rows)
    return _needed(every), classes


def _totals() -> tuple:
    """Of counts n by verdict: all labelled rows, those of the most frequent verdict, whether a wanted row is among them."""
    said = F.col("verdict").isNotNull()
    n = F.when(said, F.col("n")).otherwise(0)
    return F.sum(n).alias("total"), F.max(n).alias("best"), F.bool_or(~said).alias("asked")


def _one_further(rows: DataFrame, least: int, sure: float) -> tuple[DataFrame, DataFrame]:
    """Of bases (base, items, verdict, n): the rules of their sets with one item more, and the bases of these sets."""
    held = rows.groupBy("base").agg(_totals()[0].alias("held"))
    counts = rows.select("base", "verdict", "n", F.explode("items").alias("item")).groupBy("base", "item", "verdict").agg(F.sum("n").alias("n"))
    counts = stored(counts, "rule-further")
    kids = counts.groupBy("base", "item").agg(*_totals()).join(held, "base").where(f"asked and best >= {least} and total < held")
    kids = stored(kids, "rule-kids")
    rules = counts.where(F.col("verdict").isNotNull() & (F.col("n") >= least) & (F.size("base") > 0)).join(kids.select("base", "item", "total"), ["base", "item"])
    rules = rules.select(F.array_sort(F.concat("base", F.array("item"))).alias("antecedent"), "verdict", (F.col("n") / F.col("total")).alias("confidence"), F.col("n").alias("rows"))
    rules = stored(rules.where(F.col("confidence") >= sure), "rule-found")
    mixed = kids.where("best < total").groupBy("base").agg(F.collect_list("item").alias("mixed"))
    left = rows.join(mixed, "base").select("base", F.array_intersect("items", "mixed").alias("items"), "verdict", "n")
    each = left.select("base", "items", "verdict", "n", F.posexplode("items").alias("at", "item"))
    deeper = each.select(F.concat("base", F.array("item")).alias("base"), F.expr("slice(items, 1, at)").alias("items"), "verdict", "n")
    deeper = stored(deeper.groupBy("base", "items", "verdict").agg(F.sum("n").alias("n")), "rule-base")
    release(counts, kids)
    return rules, deeper


def _grown(least: int, sure: float, few: int):
    """Mines a whole base in one task."""

    def run(table: pa.Table) -> pa.Table:
        base = table.column("base")[0].as_py()
        lists = table.column("items").combine_chunks()
        verdicts, n = table.column("verdict").to_pylist(), table.column("n").to_numpy()
        names = sorted({v for v in verdicts if v is not None})
        weights = np.zeros((len(names) + 1, len(n)))  # the last line: wanted rows
        weights[[names.index(v) if v is not None else len(names) for v in verdicts], np.arange(len(n))] = n
        items, of = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        at = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
        total = weights[:-1].sum()
        start = weights[:-1].sum(axis=1) / max(total, 1)
        rules = list(_grow(base, items, at, of, weights, total, start, least, sure, few))
        kind = pa.schema([("antecedent", pa.list_(pa.int32())), ("verdict", pa.string()), ("confidence", pa.float64()), ("rows", pa.int64())])
        columns = zip(*((sorted(s), names[v], c, int(k)) for s, v, c, k in rules)) if rules else ([], [], [], [])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    return run


def _grow(base: list, items: np.ndarray, at: np.ndarray, of: np.ndarray, weights: np.ndarray, held: float, known: np.ndarray, least: int, sure: float, few: int) -> Iterator[tuple]:
    """Rules (items, verdict, confidence, rows) of all sets that add to ``base``.

    Row ``at[i]`` holds item ``items[of[i]]``; ``known`` is the best confidence so far, by verdict, on the way to ``base``.
    """
    counts = np.array([np.bincount(of, weights=w[at], minlength=len(items)) for w in weights])
    total, best = counts[:-1].sum(axis=0), counts[:-1].max(axis=0, initial=0)
    kids = np.flatnonzero((counts[-1] > 0) & (best >= least) & (total < held))
    kids = kids[np.argsort(-total[kids], kind="stable")]
    reached = {}
    for k in kids:
        confidence = counts[:-1, k] / total[k]
        reached[k] = np.maximum(known, confidence)
        for v in np.flatnonzero((counts[:-1, k] >= least) & (confidence >= sure) & (confidence > known)):
            yield [*base, int(items[k])], v, float(confidence[v]), counts[v, k]
    kids = kids[best[kids] < total[kids]]
    place = np.full(len(items), len(kids))
    place[kids] = np.arange(len(kids))
    of = place[of]
    at, of = at[of < len(kids)], of[of < len(kids)]
    if len(kids) <= few:
        yield from _sets(base, items[kids], at, of, weights, known, least, sure)
        return
    for i, k in enumerate(kids):
        holds = np.zeros(weights.shape[1], bool)
        holds[at[of == i]] = True
        rest = holds[at] & (of < i)
        if rest.any():
            yield from _grow([*base, int(items[k])], items[kids[:i]], at[rest], of[rest], weights, total[k], reached[k], least, sure, few)


def _sets(base: list, items: np.ndarray, at: np.ndarray, of: np.ndarray, weights: np.ndarray, known: np.ndarray, least: int, sure: float) -> Iterator[tuple]:
    """As ``_grow``, of sets with two items more at least: counts of all of them at once, place 2 ** i for item i."""
    if len(items) < 2:
        return
    codes = np.bincount(at, weights=2.0**of).astype(np.int64)
    held = np.flatnonzero(codes)
    counts = np.array([np.bincount(codes[held], weights=w[held], minlength=1 << len(items)) for w in weights])
    split = lambda lines, i: lines.reshape(len(lines), -1, 2, 1 << i).swapaxes(0, 2)  # noqa: E731  (without item i, with it)
    for i in range(len(items)):
        without, with_it = split(counts, i)
        without += with_it
    confidence = counts[:-1] / np.maximum(counts[:-1].sum(axis=0), 1)
    confidence[:, 0] = known
    surest = confidence.copy()  # of a set and its parts
    for i in range(len(items)):
        without, with_it = split(surest, i)
        np.maximum(with_it, without, out=with_it)
    parts = np.zeros_like(surest)
    for i in range(len(items)):
        with_it = split(parts, i)[1]
        np.maximum(with_it, split(surest, i)[0], out=with_it)
    several = np.arange(counts.shape[1])
    several = (several & (several - 1)) > 0  # single ones are told already
    for v, code in np.argwhere((counts[:-1] >= least) & (counts[-1] > 0) & (confidence >= sure) & (confidence > parts) & several):
        yield [*base, *(int(t) for i, t in enumerate(items) if code >> i & 1)], v, float(confidence[v, code]), counts[v, code]


def _needed(rules: DataFrame) -> DataFrame:
    """Without the rules that a part of their items, found under its three rarest ones or all it has, gives as surely."""
    rules = rules.withColumn("rule", F.xxhash64("antecedent", "verdict"))
    none = F.array(F.lit(0))
    before = lambda at: F.concat(none, F.slice("antecedent", F.lit(1), F.greatest(at, F.lit(0))))
    long = rules.where(F.size("antecedent") > 1).select("rule", "verdict", "confidence", "antecedent", F.posexplode("antecedent").alias("i", "x"))
    long = long.select("*", F.posexplode(before(F.col("i"))).alias("j", "y")).select("*", F.explode(before(F.col("j") - 1)).alias("z"))
    last = [F.coalesce(F.try_element_at("antecedent", F.lit(-k)), F.lit(0)).alias(c) for k, c in enumerate("xyz", 1)]
    short = rules.select(*last, "verdict", F.col("antecedent").alias("part"), F.col("confidence").alias("surer"))
    within = long.join(short, ["x", "y", "z", "verdict"]).where((F.size("part") < F.size("antecedent")) & (F.col("surer") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0))
    return rules.join(within.select("rule").distinct(), "rule", "left_anti").select("antecedent", "verdict", "confidence", "rows")
