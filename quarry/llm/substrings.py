"""Substring dedup: words inside windows of ``span`` words that also start earlier in the corpus are removed.

Every stretch of ``span`` words keeps the least hash of its runs of ``gram`` words as its anchor, so equal stretches have
equal anchors. 1. Anchors that occur once are dropped: their windows cannot repeat. 2. Texts get the list of their
repeated anchors; exact copies of an earlier text need none, they are removed whole. 3. Only windows with a repeated
anchor are hashed; per window hash the earliest (document, start) is kept, so the windows that stay are listed, and all
other candidates are repeats. 4. Only documents that lose something are read again, to join their kept words.

Minima and counts are combined before each shuffle, so a passage that a third of all documents share is no hot spot.

Broadcasting suffix automata of the whole corpus would stream every document past every shard, which grows with the
square of the corpus; ``quarry.llm.automaton`` does that for a reference of bounded size (see README).

Windows are equal if their 64-bit hashes are. Ids are integers (others raise TypeError). Cases: null text has no words; rows
with a null id are left whole and compared with nothing; rows that share an id and a text are one document and reported
each; rows that share an id under different texts are documents of their own, in the order of a 64-bit hash of the text; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.store import integer_id, release, small_batches, stored

SPAN = 20
GRAM = 6
_NONE = np.uint64(np.iinfo(np.uint64).max)


def _anchors(words: W.Words, hashes: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window of ``span`` words inside one text."""
    runs = np.full(len(hashes), _NONE)
    full = W.grams(hashes, gram)
    runs[: len(full)] = full
    least = W.sliding_min(runs, span - gram + 1)
    at = np.flatnonzero(words.left()[: len(least)] >= span)
    return at, least[at]


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, text) to (id, t, words, digest of all words, bytes)."""
    for batch in batches:
        counts, digests, sizes = [], [], []
        for _, _, data, at in W.steps(batch.column(2)):
            whole = data.tobytes()
            for a, b in zip(at[:-1], at[1:], strict=True):
                kept = whole[a:b].split()
                counts.append(len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                sizes.append(int(b - a))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], ["id", "t", "n_words", "digest", "size"])


def _anchor_rows(span: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, t, text) to (anchor, id, t, n): each text's distinct anchors and at how many places each is."""
        for batch in batches:
            ids, ts = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            for row, _, data, at in W.steps(batch.column(2)):
                words = W.split(data, at, W.NON_SPACE, lower=False)
                spots, anchors = W.winnow(words, words.hashes(), span, gram)
                owner = np.searchsorted(words.first, spots, side="right") - 1
                order = np.lexsort((anchors, owner))
                anchors, owner = anchors[order], owner[order]
                first = np.ones(len(anchors), dtype=bool)
                first[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
                cut = np.flatnonzero(first)
                n = np.diff(np.append(cut, len(anchors)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(anchors[cut])), pa.array(ids[row + owner[cut]]), pa.array(ts[row + owner[cut]]), pa.array(n.astype(np.int64))], ["anchor", "id", "t", "n"]
                )

    return rows


def _candidates(batch_column, lists, span: int, gram: int):
    """Per step of a text column: (row, words, hashes, first words of the windows whose anchor is in the text's list)."""
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    cut = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
    for row, end, data, at in W.steps(batch_column):
        words = W.split(data, at, W.NON_SPACE, lower=False)
        hashes = words.hashes()
        spots, anchors = _anchors(words, hashes, span, gram)
        owner = np.searchsorted(words.first, spots, side="right") - 1
        edges = np.searchsorted(owner, np.arange(end - row + 1))
        picked = [
            a + np.flatnonzero(np.isin(anchors[a:b], values[cut[row + i] : cut[row + i + 1]]))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
        ]
        picked = np.concatenate([np.zeros(0, np.int64), *picked]).astype(np.int64)
        yield row, end, words, hashes, spots[picked], owner[picked]


def _window_rows(span: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, t, text, anchors) to (window, id, t, start); and per text one row (its key's hash, id, t, -1 - candidates)."""
        for batch in batches:
            ids, ts = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            for row, end, words, hashes, spots, owner in _candidates(batch.column(2), batch.column(3), span, gram):
                windows = W.grams(hashes, span)[spots] if len(spots) else np.zeros(0, np.uint64)
                starts = spots - words.first[owner]
                own, also = ids[row:end], ts[row:end]
                totals = -1 - np.bincount(owner, minlength=end - row)
                tags = W.mix(W.mix(own.view(np.uint64) ^ W.GRAM) + also.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.signed(np.concatenate([windows, tags]))),
                        pa.array(np.concatenate([own[owner], own])),
                        pa.array(np.concatenate([also[owner], also])),
                        pa.array(np.concatenate([starts, totals]).astype(np.int64)),
                    ],
                    ["window", "id", "t", "start"],
                )

    return rows


def _removals(span: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, t, text, anchors, firsts) to (id, t, spans, removed, digest of the kept words)."""
        for batch in batches:
            firsts = batch.column(4).to_pylist()
            spans, removed, digests = [], [], []
            for row, end, words, _, spots, owner in _candidates(batch.column(2), batch.column(3), span, gram):
                edges = np.searchsorted(owner, np.arange(end - row + 1))
                for i in range(end - row):
                    low, high = int(words.first[i]), int(words.first[i + 1])
                    own = spots[edges[i] : edges[i + 1]] - low
                    again = own[~np.isin(own, np.array(firsts[row + i], dtype=np.int64))]
                    step = np.zeros(high - low + 1, dtype=np.int64)
                    np.add.at(step, again, 1)
                    np.add.at(step, again + span, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    removed.append(int(gone.sum()))
                    kept = low + np.flatnonzero(~gone)
                    whole = words.data.tobytes() if i == 0 else whole
                    digests.append(hashlib.sha256(b" ".join([whole[a:b] for a, b in zip(words.starts[kept], words.ends[kept], strict=True)])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["id", "t", "spans", "n_removed", "digest"],
            )

    return rows


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_sha256) per row; spans are word ranges, ends exclusive."""
    small_batches(docs.sparkSession)
    texts = docs.select(integer_id(docs, id_col).alias("id"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("t"), F.col(text_col).alias("text"))
    whole = stored(texts.mapInArrow(_first_of_each, "id long, t long, n_words long, digest string, size long"), "sub-texts")
    known = whole.where("id is not null and n_words >= " + str(span))
    # documents are told apart by their id; only where ids have several texts, by the text's hash too
    alone = known.groupBy("id").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").isEmpty()
    key = ["id"] if alone else ["id", "t"]
    own = (lambda df: df.withColumn("t", F.lit(0).cast("long"))) if alone else (lambda df: df)
    texts, whole, known = own(texts), own(whole), own(known)
    originals = stored(known.groupBy("digest").agg(F.min(F.struct(*key)).alias("original")).withColumnRenamed("digest", "own"), "sub-originals")

    usable = texts.where("id is not null")
    anchored = usable.mapInArrow(_anchor_rows(span, gram), "anchor long, id long, t long, n long")
    repeated = stored(anchored.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "sub-anchors")
    pairs = anchored.select("anchor", *key).join(repeated, "anchor", "left_semi")
    pairs = pairs.join(originals.select("original.*").distinct(), key, "left_semi")
    lists = stored(pairs.groupBy(*key).agg(F.collect_set("anchor").alias("anchors")), "sub-lists")

    rows = usable.join(lists, key).select("id", "t", "text", "anchors").mapInArrow(_window_rows(span, gram), "window long, id long, t long, start long")
    marks = _earliest(rows, whole, key).groupBy(*key).agg(
        F.max(F.when(F.col("start") < 0, -1 - F.col("start"))).alias("candidates"),
        F.collect_list(F.when(F.col("start") >= 0, F.col("start"))).alias("firsts"),
    )
    losing = stored(marks.where(F.size("firsts") < F.col("candidates")).select(*key, "firsts"), "sub-firsts")
    again = usable.join(losing.join(lists, key), key).select("id", "t", "text", "anchors", "firsts")
    cuts = stored(again.mapInArrow(_removals(span, gram), "id long, t long, spans array<struct<start:long,end:long>>, n_removed long, digest string"), "sub-cuts")
    release(repeated, lists, losing)
    cuts = cuts.groupBy(*[F.col(c).alias("cut_" + c) for c in key]).agg(F.max(F.struct("n_removed", "spans", "digest")).alias("cut"))
    joined = whole.join(originals, (F.col("digest") == F.col("own")) & (F.col("n_words") >= span) & F.col("id").isNotNull(), "left")
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col("cut_" + c))
    joined = joined.join(cuts, same, "left")
    copy = F.coalesce(F.col("original") < F.struct(*key), F.lit(False))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return joined.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut.n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, everything).otherwise(F.coalesce("cut.spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut.digest", "digest")).alias("kept_sha256"),
    )


def _earliest(windows: DataFrame, whole: DataFrame, key: list[str]) -> DataFrame:
    """(key, start) of the first occurrence of each window hash. Both fit one long unless ids or texts are huge or ids are shared."""
    r = whole.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("size").alias("size")).first()
    low, high, size = r["low"] or 0, r["high"] or 0, r["size"] or 0
    bits = int(size + 2).bit_length()
    if key == ["id"] and (high - low).bit_length() + bits < 62:
        # totals (start < 0) are stored as complements: their keys are negative
        packed = F.shiftleft(F.col("id") - F.lit(low), bits) + F.when(F.col("start") < 0, -1 - F.col("start")).otherwise(F.col("start"))
        signed = F.when(F.col("start") < 0, -1 - packed).otherwise(packed)
        least = windows.select("window", signed.alias("key")).groupBy("window").agg(F.min("key").alias("key"))
        plain = F.when(F.col("key") < 0, -1 - F.col("key")).otherwise(F.col("key"))
        start = plain.bitwiseAND(F.lit((1 << bits) - 1))
        return least.select(
            (F.shiftright(plain, bits) + F.lit(low)).alias("id"), F.when(F.col("key") < 0, -1 - start).otherwise(start).alias("start")
        )
    return windows.groupBy("window").agg(F.min(F.struct(*key, "start")).alias("k")).select("k.*")
