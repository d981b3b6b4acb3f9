"""Benchmark decontamination by winnowing.

Benchmark items and documents are cut into words; each run of ``gram`` words is hashed, and of every ``window`` runs the
least hash is kept, so any ``gram + window - 1`` words that both sides share leave one fingerprint in common. Items shorter
than that are one fingerprint of their own length. A Bloom filter of the benchmark's fingerprints, sized by their
number, thins the documents' before the join; after it, each hit is extended to both sides word by word, and counts if
it reaches the guaranteed length (or the whole of a short item).

An item's words travel once per text that shares a fingerprint with it, never once per fingerprint; a text that meets very
many items meets them in blocks of ``BLOCK_WORDS`` item words, whose spans are united afterwards.

Texts and items are told apart by two 64-bit hashes of their content. Cases: null text has no words and is never hit; an
item without words matches nothing; repeated rows and equal texts are judged once and reported each; null and shared ids
do not matter, since rows are judged by their text; an empty benchmark or table works; extra columns are ignored. A null
item id is left out of the list of ids but its words are hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.bloom import bloom, known
from quarry.llm.store import content_key, release, small_batches, stored

#: Consecutive words that a shared span has at least.
SPAN = 10
#: Words of a fingerprint's run; the winnowing window follows: SPAN - GRAM + 1 runs. Long runs are rarely shared by chance.
GRAM = 7
#: Words that one hit is extended by to either side; where more is shared, the next hit goes on.
EXTEND = 256
#: Item words that one text is compared with at a time.
BLOCK_WORDS = 1 << 20


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    return W.mix(W.grams(hashes, n) ^ np.uint64(n * int(W.LENGTH) % (1 << 64)))


def _first_contexts(hashes: np.ndarray, spots: np.ndarray, span: int, gram: int) -> np.ndarray:
    """The first fingerprint of each surrounding: every window that holds it lies within, so others like it add nothing."""
    reach = span - gram
    edge = [np.full(reach, x, dtype=np.uint64) for x in (W.GRAM, W.LENGTH)]
    around = W.grams(np.concatenate([edge[0], hashes, edge[1]]), gram + 2 * reach)[spots]
    return np.sort(np.unique(around, return_index=True)[1])


def _item_prints(span: int, gram: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item_id, text) to (item_id, hashes of its words, its fingerprints)."""
        for batch in batches:
            blobs, found = [], []
            for _, _, data, at in W.steps(batch.column(1)):
                words = W.split(data, at, W.ALNUM, lower=True)
                hashes = words.hashes()
                spots, values = W.winnow(words, hashes, span, gram)
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    blobs.append(hashes[a:b].tobytes())
                    if 0 < b - a < span:
                        found.append([{"print": int(W.signed(_short(hashes[a:b], int(b - a)))[0]), "spot": 0}])
                    else:
                        own = slice(*np.searchsorted(spots, [a, b]))
                        new = _first_contexts(hashes[a:b], spots[own] - a, span, gram)
                        found.append([{"print": int(v), "spot": int(s)} for s, v in zip((spots[own] - a)[new], W.signed(values[own])[new], strict=True)])
            kind = pa.list_(pa.struct([("print", pa.int64()), ("spot", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(found, kind)], ["item_id", "hashes", "prints"])

    return prints


def _doc_prints(span: int, gram: int, short: list[int], bits: bytes):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits, dtype=np.uint8)
        for batch in batches:
            counts, hits = [], []
            for _, _, data, at in W.steps(batch.column(1)):
                words = W.split(data, at, W.ALNUM, lower=True)
                hashes = words.hashes()
                spots, values = W.winnow(words, hashes, span, gram)
                for n in short:
                    here = np.flatnonzero(words.left() >= n)
                    spots, values = np.append(spots, here), np.append(values, _short(hashes, n)[here])
                ok = known(held, values)
                spots, values = spots[ok], values[ok]
                order = np.argsort(spots, kind="stable")
                spots, values = spots[order], values[order]
                cut = np.searchsorted(spots, words.first)
                counts.append(words.counts)
                for i, a in enumerate(words.first[:-1]):
                    own = slice(cut[i], cut[i + 1])
                    hits.append([{"print": int(v), "at": int(s - a)} for s, v in zip(spots[own], W.signed(values[own]), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(np.concatenate([np.zeros(0, np.int64), *counts])), pa.array(hits, pa.list_(pa.struct([("print", pa.int64()), ("at", pa.int64())])))],
                ["id", "t1", "t2", "n_words", "hits"],
            )

    return prints


def _extend(span: int):
    """Rows (t1, t2, text, items of (k1, k2, hashes, hits of (at, spot))): spans of each text and the items found in it."""

    def intervals(item: np.ndarray, doc: np.ndarray, hits: list[dict]) -> Iterator[tuple[int, int]]:
        done: dict[int, int] = {}  # per diagonal, where the last extension ended
        for h in sorted(hits, key=lambda h: h["at"]):
            shift = h["at"] - h["spot"]
            if done.get(shift, -1) > h["at"]:
                continue
            low, high = max(0, -shift, h["spot"] - EXTEND), min(len(item), len(doc) - shift, h["spot"] + EXTEND)
            wrong = np.flatnonzero(item[low:high] != doc[low + shift : high + shift])
            spot = h["spot"] - low
            cut = np.searchsorted(wrong, spot)
            if not 0 <= spot < high - low or (cut < len(wrong) and wrong[cut] == spot):
                continue
            start = wrong[cut - 1] + 1 if cut else 0
            end = wrong[cut] if cut < len(wrong) else high - low
            if end - start >= min(span, len(item)):
                yield int(start + low + shift), int(end + low + shift)
            done[shift] = int(end + low + shift)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, found = [], []
            for row, _, data, at in W.steps(batch.column(2)):
                words = W.split(data, at, W.ALNUM, lower=True)
                hashes = words.hashes()
                for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                    own, keys = [], []
                    for item in batch.column(3)[row + i].as_py():
                        here = list(intervals(np.frombuffer(item["hashes"], dtype=np.uint64), hashes[a:b], item["hits"]))
                        if here:
                            own += [{"start": s, "end": e} for s, e in here]
                            keys.append({"k1": item["k1"], "k2": item["k2"]})
                    spans.append(own)
                    found.append(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(found, pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))),
                ],
                ["t1", "t2", "spans", "keys"],
            )

    return extend


def _covered(spans: Column) -> Column:
    """How many words some span covers."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        more = F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["end"]))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + more).alias("n"))

    return F.aggregate(F.sort_array(spans), zero, step, lambda acc: acc["n"])


TEXT, ITEM = ["t1", "t2"], ["k1", "k2"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, t1, t2); the last two stand for the text."""
    t1, t2 = content_key(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), t1.alias("t1"), t2.alias("t2"))


def _judged(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(id, t1, t2, n_words, hits) per row, and (t1, t2, n_hit, items) per text that a span is found in."""
    small_batches(texts.sparkSession)
    raw = stored(
        benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).mapInArrow(
            _item_prints(span, gram), "item_id string, hashes binary, prints array<struct<print:long,spot:int>>"
        ),
        "bench-items",
    ).where("octet_length(hashes) > 0")
    k1, k2 = content_key(F.col("hashes"))
    raw = raw.withColumns({"k1": k1, "k2": k2})
    items = stored(raw.groupBy(*ITEM).agg(F.first("hashes").alias("hashes"), F.first("prints").alias("prints")), "bench-texts")
    grams = stored(items.select(*ITEM, F.inline("prints")), "bench-prints")
    lengths = items.select((F.octet_length("hashes") / 8).cast("int").alias("n")).where(F.col("n") < span).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # below ``span`` values
    kind = dict(texts.dtypes)["id"]
    prints = stored(
        texts.mapInArrow(_doc_prints(span, gram, short, bloom(grams, "print")), f"id {kind}, t1 long, t2 long, n_words long, hits array<struct<print:long,at:long>>"),
        "doc-prints",
    )
    hits = prints.where(F.size("hits") > 0).groupBy(*TEXT).agg(F.first("hits").alias("hits")).select(*TEXT, F.inline("hits"))
    met = hits.join(grams, "print").groupBy(*TEXT, *ITEM).agg(F.collect_set(F.struct("at", "spot")).alias("hits"))
    met = stored(met, "doc-items")
    known = met.join(items.select(*ITEM, "hashes"), ITEM)
    words = known.groupBy(*TEXT).agg(F.ceil(F.sum(F.octet_length("hashes")) / (8 * BLOCK_WORDS)).alias("blocks"))
    many = stored(words.where("blocks > 1"), "doc-blocks")  # hardly any text
    block = F.pmod(F.col("k1"), F.coalesce("blocks", F.lit(1)))
    grouped = known.join(many, TEXT, "left").groupBy(*TEXT, block.alias("block")).agg(F.collect_list(F.struct(*ITEM, "hashes", "hits")).alias("items"))
    own = texts.join(met.select(*TEXT).distinct(), TEXT, "left_semi").groupBy(*TEXT).agg(F.first("text").alias("text"))
    spans = stored(
        grouped.join(own, TEXT).select(*TEXT, "text", "items").mapInArrow(
            _extend(span), "t1 long, t2 long, spans array<struct<start:long,end:long>>, keys array<struct<k1:long,k2:long>>"
        ).where(F.size("spans") > 0),
        "doc-spans",
    )
    ids = spans.select(*TEXT, F.inline("keys")).join(raw.select(*ITEM, "item_id").distinct(), ITEM).groupBy(*TEXT).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    n_hit = spans.groupBy(*TEXT).agg(_covered(F.flatten(F.collect_list("spans"))).alias("n_hit"))
    judged = stored(n_hit.join(ids, TEXT), "doc-judged")
    release(grams, met, many, spans)
    return prints, judged


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items) per row: words inside spans shared with the benchmark, and whose they are."""
    prints, judged = _judged(_keyed(docs, id_col, text_col), benchmark, item_col, item_text_col, span, gram)
    return prints.join(judged, TEXT, "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark span; columns unchanged."""
    _, judged = _judged(_keyed(docs, id_col, text_col), benchmark, "item_id", "text", SPAN, GRAM)
    bad = judged.select(F.col("t1").alias("_leak_1"), F.col("t2").alias("_leak_2"))
    t1, t2 = content_key(docs[text_col])
    return docs.join(bad, (t1 == bad["_leak_1"]) & (t2 == bad["_leak_2"]), "left_anti")
