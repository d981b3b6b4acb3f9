"""Spans shared with a reference of bounded size, by broadcast suffix automata.

The reference is cut into shards of at most ``SHARD_WORDS`` words; a suffix automaton of each shard is built on the driver
and broadcast, and documents stream past it for matching statistics: the length of the longest reference substring that
ends at each word. Words inside matches of ``span`` or more are hit. The reference's size is checked first: more than
``MOST_WORDS`` words raise, since every shard costs one pass over the documents; ``quarry.llm.substrings`` handles a
corpus against itself without that bound.

Cases: null text has no words; an empty reference hits nothing; repeated rows are reported each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.store import small_batches

SHARD_WORDS = 100_000
MOST_WORDS = 2_000_000


class SuffixAutomaton:
    """All substrings of some word sequences; sequences are kept apart."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence) -> None:
        """Extend by one sequence of word hashes (a generalized automaton: matches never run across sequences)."""
        last = 0
        for c in sequence:
            last = self._extend(last, int(c))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def statistics(self, sequence) -> list[int]:
        """For each word, the length of the longest known substring that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for c in sequence:
            c = int(c)
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            else:
                matched = 0
            out.append(matched)
        return out


def covered(statistics, span: int) -> np.ndarray:
    """Words inside matches of at least ``span`` words: maximal spans end where the statistic is long enough."""
    m = np.asarray(statistics, dtype=np.int64)
    step = np.zeros(len(m) + 1, dtype=np.int64)
    ends = np.flatnonzero(m >= span)
    np.add.at(step, ends - m[ends] + 1, 1)
    np.add.at(step, ends + 1, -1)
    return np.cumsum(step)[:-1] > 0


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = []
        for _, _, data, at in W.steps(batch.column(0)):
            words = W.split(data, at, W.NON_SPACE, lower=False)
            h = words.hashes()
            blobs += [h[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["hashes"])


def shards(reference: DataFrame, text_col: str = "text", shard_words: int = SHARD_WORDS, most_words: int = MOST_WORDS) -> list[SuffixAutomaton]:
    """Automata of the distinct reference texts; raises ValueError if they are beyond the bound."""
    hashed = reference.select(text_col).distinct().mapInArrow(_hashes, "hashes binary").where("octet_length(hashes) > 0")
    total = (hashed.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // 8
    if total > most_words:
        raise ValueError(f"the reference has {total} words; automata are broadcast up to {most_words}")
    out: list[SuffixAutomaton] = []
    room = 0
    for blob in sorted(bytes(r["hashes"]) for r in hashed.collect()):
        sequence = np.frombuffer(blob, dtype=np.uint64)
        if room < len(sequence):
            out.append(SuffixAutomaton())
            room = shard_words
        out[-1].add(sequence)
        room -= len(sequence)
    return out


def shared_spans(docs: DataFrame, reference: DataFrame, span: int = 20, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """(doc_id, n_words, n_hit, spans) per row: maximal word ranges of ``span`` or more that the reference has."""
    small_batches(docs.sparkSession)
    sent = [docs.sparkSession.sparkContext.broadcast(a) for a in shards(reference, text_col, **bounds)]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, spans = [], [], []
            for _, _, data, at in W.steps(batch.column(1)):
                words = W.split(data, at, W.NON_SPACE, lower=False)
                h = words.hashes()
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    hit = np.zeros(b - a, dtype=bool)
                    for automaton in sent:
                        hit |= covered(automaton.value.statistics(h[a:b].tolist()), span)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    n_words.append(int(b - a))
                    n_hit.append(int(hit.sum()))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, kind)], ["doc_id", "n_words", "n_hit", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(match, f"doc_id {kind}, n_words long, n_hit long, spans array<struct<start:long,end:long>>")
