"""Document model: sections, heading paths, block ids and chunks, over rows of blocks.

Blocks are (doc, pos, tag, text) in document order, tags as in HTML; a heading's level is its tag's digit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarry.functions import text as T

MAX_TOKENS = 300
MIN_TOKENS = 150
LEVELS = 6


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc, kept columns, pos, text): a document's lines as blocks."""
    return docs.select("doc", *keep, F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def sections(blocks: DataFrame, level: str = "level") -> DataFrame:
    """``section_no`` per block: headings count up; 0 is what stands before the first one."""
    order = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section_no", F.sum(F.when(F.col(level).isNotNull(), 1).otherwise(0)).over(order).cast("long"))


def heading_paths(headings: DataFrame) -> DataFrame:
    """``heading_path`` per heading (doc, pos, level, title): its own title below the open ones of lower levels."""
    order = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(order) for k in range(1, LEVELS + 1)}
    seen = headings.withColumns({f"_l{k}": c for k, c in last.items()})
    parts, newest = [], F.lit(-1)
    for k in range(1, LEVELS + 1):
        at = F.col(f"_l{k}.pos")
        parts.append(F.when((F.col("level") >= k) & (at > newest), F.col(f"_l{k}.title")))
        newest = F.greatest(newest, F.coalesce(at, F.lit(-1)))
    return seen.withColumn("heading_path", F.array_compact(F.array(*parts))).drop(*[f"_l{k}" for k in range(1, LEVELS + 1)])


def unique_ids(rows: DataFrame, partition: str = "doc", order: str = "pos", wanted: str = "id") -> DataFrame:
    """``unique_id``: the first use keeps its id, later ones get -2, -3, ..., past ids that are taken. Exact, per document."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        used: set[str] = set()
        out = []
        for want in pdf[wanted]:
            name, k = want, 2
            while name in used:
                name, k = f"{want}-{k}", k + 1
            used.add(name)
            out.append(name)
        return pdf.assign(unique_id=out)

    fields = [*rows.schema.fields, StructField("unique_id", StringType())]
    return rows.groupBy(partition).applyInPandas(one, StructType(fields))


def block_ids(blocks: DataFrame) -> DataFrame:
    """``block_id`` b0, b1, ... in document order."""
    order = Window.partitionBy("doc").orderBy("pos")
    return blocks.withColumn("block_id", F.concat(F.lit("b"), (F.row_number().over(order) - 1).cast("string")))


def units(blocks: DataFrame, most: int = MAX_TOKENS, count=None) -> DataFrame:
    """What the chunker packs: (doc, section_no, i, run, block_id, text, tokens, piece).

    A block within the limit is one unit; a larger one is its sentences, which form a run of their own.
    """
    count = count or (lambda t: F.size(T.pre_tokenize(t)))
    sized = blocks.where(F.col("text") != "").withColumn("tokens", count(F.col("text")))
    large = F.col("tokens") > most
    parts = F.when(large, T.sentences(F.col("text"))).otherwise(F.array("text"))
    order = Window.partitionBy("doc", "section_no").orderBy("pos")
    runs = sized.withColumn("before", F.coalesce(F.sum(F.when(large, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = runs.select(
        "doc", "section_no", "pos", "block_id", large.alias("piece"), (2 * F.col("before") + F.when(large, 1).otherwise(0)).alias("run"), F.posexplode(parts).alias("part", "text"),
    )
    return cut.select(
        "doc", "section_no", F.row_number().over(Window.partitionBy("doc", "section_no").orderBy("pos", "part")).alias("i"), "run", "block_id", "text", count(F.col("text")).alias("tokens"), "piece",
    )


def groups(packed: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """``grp`` per unit: greedy packing as one fold over each section's units."""
    unit = F.sort_array(F.collect_list(F.struct("i", "run", "block_id", "text", "tokens", "piece")))

    def step(acc: Column, u: Column) -> Column:
        new = (F.size(acc["out"]) > 0) & ((u["run"] != acc["run"]) | (acc["sum"] + u["tokens"] > most))
        number = acc["grp"] + F.when(new, 1).otherwise(0)
        return F.struct(
            F.when(new, u["tokens"]).otherwise(acc["sum"] + u["tokens"]).alias("sum"), number.alias("grp"), u["run"].cast("long").alias("run"), F.concat(acc["out"], F.array(number)).alias("out")
        )

    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("grp"), F.lit(-1).cast("long").alias("run"), F.array().cast("array<int>").alias("out"))
    folded = packed.groupBy("doc", "section_no").agg(unit.alias("u")).withColumn("g", F.aggregate("u", start, step, lambda acc: acc["out"]))
    return folded.select("doc", "section_no", F.inline(F.arrays_zip("u", "g"))).select("doc", "section_no", "u.i", "u.run", "u.block_id", "u.text", "u.tokens", "u.piece", F.col("g").alias("grp"))


def merge_tails(grouped: DataFrame, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> DataFrame:
    """A short last group joins the one before, if both stay small and do not share a cut block."""
    per = grouped.groupBy("doc", "section_no", "grp").agg(
        F.sum("tokens").alias("total"), F.min_by("block_id", "i").alias("first_block"), F.max_by("block_id", "i").alias("last_block")
    )
    order = Window.partitionBy("doc", "section_no").orderBy("grp")
    looked = per.select(
        "doc", "section_no", "grp", "total", "first_block", F.lag("total").over(order).alias("prev"), F.lag("last_block").over(order).alias("prev_block"), F.lead("grp").over(order).alias("next"),
    )
    short = F.col("next").isNull() & F.col("prev").isNotNull() & (F.col("total") * 2 < least) & (F.col("total") + F.col("prev") <= most + least / 2) & (F.col("first_block") != F.col("prev_block"))
    moved = looked.select("doc", "section_no", "grp", F.when(short, F.col("grp") - 1).otherwise(F.col("grp")).alias("to_grp"))
    return grouped.join(moved, ["doc", "section_no", "grp"]).drop("grp").withColumnRenamed("to_grp", "grp")


def chunks(merged: DataFrame, count=None) -> DataFrame:
    """(doc, section_no, chunk_no, chunk_id, text, blocks, tokens); ids count through the whole document."""
    count = count or (lambda t: F.size(T.pre_tokenize(t)))
    items = F.sort_array(F.collect_list(F.struct("i", "block_id", "text", "piece")))
    one = merged.groupBy("doc", "section_no", "grp").agg(items.alias("u"))
    # sentences of a cut block are joined by a space, blocks by a line break
    joined = F.aggregate(
        "u",
        F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("last")),
        lambda acc, u: F.struct(
            F.when(acc["text"].isNull(), u["text"]).otherwise(F.concat(acc["text"], F.when(u["piece"] & (u["block_id"] == acc["last"]), F.lit(" ")).otherwise(F.lit("\n")), u["text"])).alias("text"),
            u["block_id"].alias("last"),
        ),
        lambda acc: acc["text"],
    )
    ids = F.transform("u", lambda u: u["block_id"])
    distinct = F.filter(ids, lambda b, i: (i == 0) | (b != F.element_at(ids, F.greatest(i, F.lit(1)))))
    order = Window.partitionBy("doc").orderBy("section_no", "grp")
    return one.select(
        "doc", "section_no", (F.row_number().over(order) - 1).alias("chunk_no"), joined.alias("text"), distinct.alias("blocks")
    ).select("doc", "section_no", "chunk_no", F.concat(F.lit("c"), F.col("chunk_no").cast("string")).alias("chunk_id"), "text", "blocks", count(F.col("text")).alias("tokens"))


def index_text(path: Column, text: Column) -> Column:
    return F.concat(F.array_join(path, "\n"), F.lit("\n\n"), text)


def chunk_sentences(rows: DataFrame, path: str = "heading_path", least: int = 4) -> DataFrame:
    """(keys, line_no, block_id, sentence_no, sentence): heading lines and sentences of under ``least`` words go."""
    keys = [c for c in rows.columns if c not in ("text", "blocks", path)]
    cut = rows.select(*keys, path, "blocks", F.size(F.split("text", "\n")).alias("n_lines"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    plain = cut.where(~F.array_contains(F.col(path), F.trim("line")))
    block = F.when(F.col("n_lines") == F.size("blocks"), F.get("blocks", F.col("line_no"))).otherwise(F.get("blocks", F.lit(0)))
    out = plain.select(*keys, "line_no", block.alias("block_id"), F.posexplode(T.sentences(F.col("line"))).alias("sentence_no", "sentence"))
    return out.where(F.size(F.split("sentence", r"\s+")) >= least)
