"""Mixing sources to target weights with hash-threshold histograms. Native: DataFrame functions only.

A source's budget is met without sorting its documents. Every document has a 36-bit hash of its id. Sizes are summed by
source and the hash's first 12 bits; the cumulative histogram shows the bucket in which the budget ends; only that
bucket is summed again by the next 12 bits, then by the last 12. The result is one threshold per source: documents
hashed below it are taken once more. Thresholds for growing budgets are nested, and reruns agree.

Cases: null text has size 0; null source is a source of its own, ordered last; a null id is
hashed by the text instead; repeated rows
are documents of their own that are taken alike; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
LEVELS = 3
BITS = LEVEL_BITS * LEVELS


def hash36(doc_id: Column, text: Column) -> Column:
    """The first 36 bits of the id's MD5, the same in every engine; of the text's where the id is null."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets of (source, source_size): ``share`` of all sizes dealt by weight, no source above ``most`` times its size.

    Reshared excess ends in a common level: target = min(cap, weight * level). Sources are sorted by cap / weight; the
    level is the first one that its own source stays below. There is one row of some 50 bytes per source, whatever the number
    of documents; these rows are ordered in one task, which a million sources do not strain.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.select("source", "source_size", number.alias("number")).select(
        "source", "source_size", "number",
        F.element_at(kinds, (F.col("number") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * most).alias("cap"),
    )
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("number"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.sum("source_size").over(whole).alias("all_size"),
        F.sum("weight").over(whole).alias("all_weight"),
    ).select(
        "*", ((F.col("all_size") * F.lit(float(share)) - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))).alias("own_level")
    )
    level = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("own_level"), F.struct("cap_before", "own_level"))).over(
        Window.partitionBy()
    )
    return levels.select("source", "source_size", "cap", "weight", level["own_level"].alias("level")).select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double"))).alias("target"),
    )


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``size`` and the hash ``_mix_h``; a column of either name is replaced."""
    return docs.withColumns(
        {"size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"), "_mix_h": hash36(F.col(id_col), F.col(text_col))}
    )


def mix(
    docs: DataFrame,
    weights=(3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often each document goes into the mix: (doc_id, source, size, source_size, target, copies, taken)."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    base = stored(_sized(picked, "doc_id", "text").drop("text"), "mix-sizes")
    return _dealt(base, _plan(base, weights, share, most))


def mixed(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The documents that the mix takes, with all columns, and (size, source_size, target, copies, taken)."""
    base = stored(_sized(docs.select("doc_id", "text", "source"), "doc_id", "text").drop("text"), "mix-sizes")
    return _dealt(_sized(docs, "doc_id", "text"), _plan(base, weights, share, most)).where("copies > 0")


def _dealt(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with what the plan says of each; columns of these names are replaced."""
    added = ("source_size", "target", "copies", "taken")
    own = rows.select(*[c for c in rows.columns if c not in added and c not in PLAN])
    copies = (F.col("_mix_whole") + F.when(F.col("_mix_h") < F.col("_mix_limit"), 1).otherwise(0)).cast("long")
    joined = own.join(plan, own["source"].eqNullSafe(plan["_mix_source"])).withColumn("copies", copies)
    return joined.select(
        *[c for c in own.columns if c != "_mix_h"], F.col("_mix_size").alias("source_size"), F.col("_mix_target").alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


#: Columns of the plan; no table has such names.
PLAN = ("_mix_source", "_mix_size", "_mix_target", "_mix_whole", "_mix_limit")


def _plan(base: DataFrame, weights, share: float, most: int) -> DataFrame:
    """Per source its target, whole copies and the hash below which documents are taken once more."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(
        source_targets(sizes, weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    # The histograms: all rows by the first bits, then only each source's boundary bucket by the next ones.
    cuts = targets.select(F.col("source"), "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("double").alias("below"))
    for depth in range(1, LEVELS + 1):
        right = BITS - LEVEL_BITS * depth
        own = cuts.select(F.col("source").alias("cut_source"), "budget", "prefix", F.col("below").alias("outer"))
        inside = base.join(own, base["source"].eqNullSafe(own["cut_source"])).where(
            F.shiftright("_mix_h", right + LEVEL_BITS) == F.col("prefix")
        )
        hist = inside.groupBy("source", "budget", "outer", F.shiftright("_mix_h", right).alias("bucket")).agg(F.sum("size").alias("words"))
        order = Window.partitionBy("source").orderBy("bucket")
        summed = hist.withColumn("to", F.col("outer") + F.sum("words").over(order))
        ends = summed.where(F.col("to") > F.col("budget")).groupBy("source", "budget").agg(
            F.min(F.struct(F.col("bucket"), (F.col("to") - F.col("words")).alias("below"), F.col("to"))).alias("cut")
        )
        cuts = stored(
            ends.select("source", "budget", F.col("cut.bucket").alias("prefix"), F.col("cut.below").alias("below"), F.col("cut.to").alias("to")),
            f"mix-cuts-{depth}",
        )
    # The last bucket holds ids of one hash: it goes to the side that ends nearer to the budget.
    nearer = F.col("to") - F.col("budget") <= F.col("budget") - F.col("below")
    limits = cuts.select(
        F.col("source").alias("limit_source"), (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("limit")
    )
    return stored(
        targets.join(limits, targets["source"].eqNullSafe(limits["limit_source"]), "left").select(
            F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_size"), F.col("target").alias("_mix_target"),
            F.col("whole").alias("_mix_whole"), F.coalesce("limit", F.lit(0)).alias("_mix_limit"),
        ),
        "mix-plan",
    )


#: The same mix in DuckDB: instead of histograms, a running sum over the hash order.
MIX_SQL = r"""
base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, ''))), 1, 9))::BIGINT AS h
  FROM {docs}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT source, source_size, source_size * 2 AS cap, n, CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM sizes)),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - cap_before) / (sum(weight) OVER () - weight_before)::DOUBLE AS own_level
  FROM (SELECT *, coalesce(sum(cap) OVER w, 0)::DOUBLE AS cap_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before
        FROM ranked WINDOW w AS (ORDER BY cap::DOUBLE / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (
    SELECT own_level FROM levels WHERE cap >= weight * own_level ORDER BY cap_before, own_level LIMIT 1)) AS target
  FROM levels),
plans AS (
  SELECT *, target - whole * source_size AS budget
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets)),
hashes AS (SELECT source, h, sum(size)::BIGINT AS words FROM base GROUP BY source, h),
sums AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes),
ends AS (
  SELECT s.source, min(s.h) FILTER (s.upto > p.budget) AS edge
  FROM sums s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source GROUP BY s.source),
limits AS (
  SELECT e.source, e.edge + CASE WHEN s.upto - p.budget <= p.budget - (s.upto - s.words) THEN 1 ELSE 0 END AS edge
  FROM ends e JOIN sums s ON s.source IS NOT DISTINCT FROM e.source AND s.h = e.edge
  JOIN plans p ON p.source IS NOT DISTINCT FROM e.source),
mixed AS (
  SELECT b.doc_id, b.source, b.size, p.source_size, p.target,
         (p.whole + CASE WHEN b.h < coalesce(l.edge, 0) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM base b JOIN plans p ON b.source IS NOT DISTINCT FROM p.source
  LEFT JOIN limits l ON b.source IS NOT DISTINCT FROM l.source)
"""
