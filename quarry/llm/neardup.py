"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds the hashes of its word shingles. Two small collections of MinHash half-keys are computed per
set; every pair (left half-key, right half-key) is the key of one hash table, so ``left * right`` tables cost only
``left_rows * left + right_rows * right`` MinHashes. Sets that are equal are one class from the start. Classes that share
a table key are candidates and are confirmed on their full sets:

1. Star round: in each table bucket every class is compared with one representative. This links almost all of a group.
2. Rest round: what is still outside the component that leads its bucket is compared with the bucket's other members, in
   blocks, so no pair of one bucket is left out and no bucket, however large, is expanded into pairs of rows. Buckets
   led by the same component are taken together where that is fewer comparisons (a template's tables hold the same
   members); otherwise each stands alone, so there are never more comparisons than pairs in buckets.

At similarity 0.8 a pair shares no table with probability under 0.0005 (0.9: under 1e-7).

Inside, sets are nodes and ids are joined at the end: ids are integers (others raise TypeError). Cases: null or wordless
text gives an empty set, linked with nothing, not even with other rows of its id; fewer words than a shingle give one
shingle, the whole sequence; rows that share an id are one document, so the links of all their texts are joined, and each
row keeps its own set size; a row with a null id gets a null component, is kept, and links nothing; an empty table gives
an empty table; extra columns are ignored. ``one_of_each`` filters rows and judges each as a document of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.bloom import BLOOM_MOST, BLOOM_RATE, bloom, known
from quarry.llm.graph import connected_components
from quarry.llm.store import content_key, integer_id, parallelism, release, small_batches, stored


@dataclass(frozen=True)
class Bands:
    """Sizes of the two half-key collections: MinHashes per half-key and number of half-keys."""

    left_rows: int = 3
    left: int = 12
    right_rows: int = 2
    right: int = 8


BANDS = Bands()
#: Rows that one comparison group holds at most: of the sets that are looked up, and of those streamed past them.
STAR_BLOCK = 192
REST_BLOCK = 128


def shingle_sets(column, ngram: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for row, _, data, at in W.steps(column):
        words = W.split(data, at, W.NON_SPACE, lower=True)
        hashes = words.hashes()
        runs = W.grams(hashes, ngram)
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            if b - a >= ngram:
                yield row + i, np.unique(runs[a : b - ngram + 1])
            elif b > a:
                yield row + i, W.grams(hashes[a:b], int(b - a))
            else:
                yield row + i, np.zeros(0, np.uint64)


def _signer(ngram: int, bands: Bands):
    rng = np.random.default_rng(20240601)
    n = bands.left_rows * bands.left + bands.right_rows * bands.right
    xor = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    mul = rng.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
    cut = bands.left_rows * bands.left

    def half_keys(minima: np.ndarray, rows: int) -> np.ndarray:
        keys = np.zeros((len(minima), minima.shape[1] // rows), dtype=np.uint64)
        for r in range(rows):
            keys *= W.GRAM
            keys += minima[:, r::rows]
        return W.mix(keys)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1), ngram))
            sizes = np.array([len(s) for _, s in found], dtype=np.int64)
            minima = np.zeros((len(found), n), dtype=np.uint64)
            sums = np.zeros((len(found), 2), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for i, (_, s) in enumerate(found):
                    if len(s):
                        for c in range(0, len(s), 4096):
                            part = s[c : c + 4096]
                            least = ((part[:, None] ^ xor) * mul).min(axis=0)
                            minima[i] = least if not c else np.minimum(minima[i], least)
                            sums[i, 0] += W.mix(part).sum(dtype=np.uint64)
                            sums[i, 1] += W.mix(part ^ W.LENGTH).sum(dtype=np.uint64)
            left, right = half_keys(minima[:, :cut], bands.left_rows), half_keys(minima[:, cut:], bands.right_rows)
            both = np.concatenate([left, right], axis=1)
            keys = pa.ListArray.from_arrays(
                pa.array(np.arange(0, both.size + 1, both.shape[1], dtype=np.int32)), pa.array(W.signed(both.ravel()))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(sizes), pa.array(W.signed(sums[:, 0])), pa.array(W.signed(sums[:, 1])), keys],
                ["id", "t1", "t2", "n_shingles", "f1", "f2", "half_keys"],
            )

    return sign


def _setter(ngram: int, bits: bytes | None):
    """(row key, text) to (n_shingles, f1, f2, hashes) of the rows that the filter lets through."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bits is None else np.frombuffer(bits, dtype=np.uint8)
        for batch in batches:
            texts = batch.column(1)
            if held is not None:
                texts = texts.filter(pa.array(known(held, batch.column(0).to_numpy(zero_copy_only=False))))
            found = [s for _, s in shingle_sets(texts, ngram) if len(s)]
            with np.errstate(over="ignore"):
                sums = np.array([(W.mix(s).sum(dtype=np.uint64), W.mix(s ^ W.LENGTH).sum(dtype=np.uint64)) for s in found], dtype=np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(s) for s in found], pa.int64()), pa.array(W.signed(sums[:, 0])), pa.array(W.signed(sums[:, 1])),
                    pa.array([s.tobytes() for s in found], type=pa.binary()),
                ],
                ["n_shingles", "f1", "f2", "hashes"],
            )

    return sets


class _Block:
    """Sets that others are compared with: postings from hash to set."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.percent = ids, percent
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.universe, self.at = np.unique(flat[order], return_index=True)
        self.at = np.append(self.at, len(flat))
        self.owner = owner[order]

    def links(self, s: np.ndarray) -> np.ndarray:
        """Indices of the block's sets with 100 * intersection >= percent * union."""
        spot = np.searchsorted(self.universe, s)
        spot = spot[spot < len(self.universe)] if spot.size and spot[-1] >= len(self.universe) else spot
        spot = spot[self.universe[spot] == s[: len(spot)]]
        lengths = self.at[spot + 1] - self.at[spot]
        total = int(lengths.sum())
        take = np.repeat(self.at[spot] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        common = np.bincount(self.owner[take], minlength=len(self.sizes))
        union = self.sizes + len(s) - common
        return np.flatnonzero(100 * common >= self.percent * union)


def _comparer(percent: int):
    """Rows (g, part, chunk, role, id, hashes) sorted by group, base sets (role 0) first: links as a forest of edges."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, block, root = None, [], [], None, {}
        src, dst = [], []

        def top(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            blobs = batch.column(5)
            for i, (g, part, chunk, role, doc) in enumerate(keys):
                if (g, part, chunk) != group:
                    group, ids, sets, block, root = (g, part, chunk), [], [], None, {}
                s = np.frombuffer(blobs[i].as_buffer(), dtype=np.uint64)
                if role == 0:
                    ids.append(doc)
                    sets.append(s.copy())
                    continue
                if not ids:
                    continue
                if block is None:
                    block = _Block(ids, sets, percent)
                for k in block.links(s):
                    a, b = top(block.ids[k]), top(doc)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        src.append(doc)
                        dst.append(block.ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
            src, dst = [], []

    return compare


def _compare(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges between the base and the streamed rows of each group."""
    spark = rows.sparkSession
    full = rows.join(sets, F.col("id") == F.col("node")).select("g", "part", "chunk", "role", "id", "hashes")
    dealt = full.repartition(parallelism(spark), "g", "part", "chunk").sortWithinPartitions("g", "part", "chunk", "role")
    return dealt.mapInArrow(_comparer(percent), "src long, dst long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, t1, t2); the last two stand for the text."""
    t1, t2 = content_key(F.col(text_col))
    return docs.select(integer_id(docs, id_col).alias("id"), F.col(text_col).alias("text"), t1.alias("t1"), t2.alias("t2"))


def _signed(texts: DataFrame, ngram: int, bands: Bands) -> DataFrame:
    """(id, t1, t2, n_shingles, node, half_keys) per row. ``node`` stands for the set; it is null if that is empty."""
    small_batches(texts.sparkSession)
    rows = texts.mapInArrow(_signer(ngram, bands), "id long, t1 long, t2 long, n_shingles long, f1 long, f2 long, half_keys array<long>")
    node = F.when(F.col("n_shingles") > 0, F.xxhash64("f1", "f2", "n_shingles"))
    return stored(rows.select("id", "t1", "t2", "n_shingles", node.alias("node"), "half_keys"), "dedup-signatures")


def _place() -> Column:
    """How rows of one set are ordered: by id, null last, then by their text."""
    return F.struct(F.col("id").isNull().alias("missing"), "id", "t1", "t2")


def _links(texts: DataFrame, signed: DataFrame, ngram: int, percent: int, bands: Bands) -> tuple[DataFrame, DataFrame]:
    """(node, least row) per set, and the edges (src, dst) that make its similar sets connected."""
    classes = stored(
        signed.where("node is not null").groupBy("node").agg(F.min(_place()).alias("least"), F.first("half_keys").alias("half_keys")), "dedup-classes"
    )
    tables = [
        F.xxhash64(F.lit(i * bands.right + j), F.col("half_keys")[i], F.col("half_keys")[bands.left + j])
        for i in range(bands.left)
        for j in range(bands.right)
    ]
    # each class becomes many rows here, so its few large partitions are dealt to more tasks first
    spread = classes.select("node", "half_keys").repartition(2 * parallelism(texts.sparkSession), "node")
    keyed = spread.select(F.col("node").alias("id"), F.explode(F.array(*tables)).alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "dedup-keys")
    bucketed = stored(keyed.join(shared, "key").select("key", "id"), "dedup-buckets")
    sets = _sets(texts, classes, bucketed, ngram)

    # 1. stars
    leads = stored(
        bucketed.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("lead"), F.count("*").alias("n")).select(
            F.col("key").alias("lead_key"), F.col("lead.id").alias("lead"), "n"
        ),
        "dedup-leads",
    )
    pairs = stored(
        bucketed.join(leads, bucketed["key"] == leads["lead_key"]).where("id <> lead").select("lead", "id").distinct(), "dedup-pairs"
    )
    per_lead = pairs.groupBy("lead").agg(F.count("*").alias("members")).select(
        F.col("lead").alias("of"), F.ceil(F.col("members") / STAR_BLOCK).cast("int").alias("parts")
    )
    per_lead = stored(per_lead, "dedup-parts")
    streamed = pairs.join(per_lead, pairs["lead"] == per_lead["of"]).select(
        F.col("lead").alias("g"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"),
        F.lit(0).alias("chunk"), F.lit(1).alias("role"), "id",
    )
    bases = per_lead.select(
        F.col("of").alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("chunk"), F.lit(0).alias("role"), F.col("of").alias("id"),
    )
    stars = stored(_compare(bases.unionByName(streamed), sets, percent), "dedup-stars")
    release(shared, pairs, per_lead)
    first = connected_components(stars)

    # 2. the rest: per bucket of three or more, members outside of the component that most of the bucket is in
    named = leads.where("n > 2").join(bucketed, leads["lead_key"] == bucketed["key"]).select("key", "id")
    marked = stored(
        named.join(first, named["id"] == first["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component")),
        "dedup-marked",
    )
    # the component that leads a bucket is the one that is largest overall, so hardly any row is outside of it
    whole = stored(first.groupBy("component").agg(F.count("*").alias("whole")).withColumnRenamed("component", "of"), "dedup-sizes")
    sizes = marked.join(whole, marked["component"] == whole["of"], "left").groupBy("key", "component").agg(F.max(F.coalesce("whole", F.lit(1))).alias("n"), F.count("*").alias("rows"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "rows")).alias("m"), F.sum("rows").alias("rows"), F.count("*").alias("parts"))
    main = stored(
        main.where("parts > 1").select(F.col("key").alias("main_key"), F.col("m.component").alias("main"), ((F.col("rows") - F.col("m.rows")) * F.col("rows")).alias("work")),
        "dedup-main",
    )
    split = stored(marked.join(main, marked["key"] == main["main_key"]).select("key", "main", "id", (F.col("component") == F.col("main")).alias("within")), "dedup-split")
    edges = stars
    if not split.isEmpty():
        rest = _rest(split, main, sets, percent)
        edges = stored(stars.unionByName(rest), "dedup-edges")
        release(stars, rest)
    release(bucketed, leads, marked, whole, main, split, first, sets)
    return classes, edges


def _sets(texts: DataFrame, classes: DataFrame, bucketed: DataFrame, ngram: int) -> DataFrame:
    """(node, hashes) of every set in some bucket, from the first row that has it.

    Texts are not shuffled to find these rows: a filter of their keys goes to the tasks that read the texts, and the few
    sets too many that it lets through are in no bucket, or copies that the grouping takes out. Beyond the filter's
    capacity (8 million sets) the rows are found by a join.
    """
    key = lambda a, b, c: F.xxhash64(a, b, c).alias("row_key")
    involved = classes.join(bucketed.select("id").distinct(), F.col("node") == F.col("id"), "left_semi")
    rows = stored(involved.select(key(F.col("least.id"), F.col("least.t1"), F.col("least.t2"))), "dedup-involved")
    keyed = texts.select(key(F.col("id"), F.col("t1"), F.col("t2")), "text")
    fits = rows.count() * BLOOM_RATE <= BLOOM_MOST
    if not fits:
        keyed = keyed.join(rows, "row_key", "left_semi")
    found = keyed.mapInArrow(_setter(ngram, bloom(rows, "row_key") if fits else None), "n_shingles long, f1 long, f2 long, hashes binary")
    sets = stored(found.groupBy(F.xxhash64("f1", "f2", "n_shingles").alias("node")).agg(F.first("hashes").alias("hashes")), "dedup-sets")
    release(rows)
    return sets


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = 5,
    percent: int = 80,
    bands: Bands = BANDS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; documents of similarity ``percent`` / 100 or more are linked."""
    texts = _texts(docs, id_col, text_col)
    signed = _signed(texts, ngram, bands)
    usable = signed.where("node is not null and id is not null")
    classes, edges = _links(texts, usable, ngram, percent, bands)
    # an id with several texts joins them
    several = stored(usable.groupBy("id").agg(F.min("node").alias("dst"), F.max("node").alias("last")).where("dst <> last").select(F.col("id").alias("of"), "dst"), "dedup-ids")
    joined = usable.join(several, usable["id"] == several["of"]).where("node <> dst").select(F.col("node").alias("src"), "dst").distinct()
    linked = connected_components(edges.unionByName(joined)).withColumnRenamed("node", "of")
    named = classes.join(linked, classes["node"] == linked["of"], "left").select("node", F.col("least.id").alias("low"), F.coalesce("component", "node").alias("component"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = stored(named.join(lows, "component").select(F.col("node").alias("of"), "component_id"), "dedup-components")
    release(classes, edges, several, linked)
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return signed.join(named, F.col("node") == F.col("of"), "left").select(
        F.col("id").alias("doc_id"), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept")
    )


def _rest(split: DataFrame, main: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the outsiders of each bucket, or of all buckets that one component leads, with all other members."""
    count = lambda within: F.count_distinct(F.when(F.col("within") == within, F.col("id")))
    whole = split.groupBy("main").agg(count(False).alias("n_out"), count(True).alias("n_in"))
    work = main.groupBy(F.col("main").alias("of")).agg(F.sum("work").alias("work"))
    together = whole.join(work, F.col("main") == F.col("of")).where(F.col("n_out") * (F.col("n_in") + F.col("n_out")) <= F.col("work"))
    together = stored(together.select(F.col("main").alias("as_one")), "dedup-together")
    dealt = split.join(together, split["main"] == together["as_one"], "left")
    rows = stored(dealt.select(F.xxhash64(F.col("as_one").isNull(), F.coalesce(F.when(F.col("as_one").isNull(), F.col("key")), "main")).alias("g"), "id", "within").distinct(), "dedup-rest-rows")
    outside, inside = rows.where("not within").select("g", "id"), rows.where("within").select("g", "id")

    blocks = lambda within: F.ceil(F.count_if(F.col("within") == within) / REST_BLOCK).cast("int")
    counts = stored(rows.groupBy(F.col("g").alias("of")).agg(blocks(False).alias("b_out"), blocks(True).alias("b_in")), "dedup-rest-counts")
    near = outside.join(counts, outside["g"] == counts["of"]).select("g", "id", F.pmod(F.xxhash64("id"), F.col("b_out")).cast("int").alias("block"), "b_out", "b_in")
    far = inside.join(counts, inside["g"] == counts["of"]).select("g", "id", F.pmod(F.xxhash64("id"), F.col("b_in")).cast("int").alias("block"), "b_out", "b_in")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # base blocks: the outsiders; chunks 0.. are blocks of the component, then blocks of outsiders, each pair of them once
    to = lambda first, last: F.explode(F.sequence(first, last))
    chunks = F.concat(upto(F.col("b_in")), F.sequence(F.col("b_in") + F.col("block"), F.col("b_in") + F.col("b_out") - 1))
    base = near.select("g", F.col("block").alias("part"), F.explode(chunks).alias("chunk"), F.lit(0).alias("role"), "id")
    stream_in = far.select("g", F.explode(upto(F.col("b_out"))).alias("part"), F.col("block").alias("chunk"), F.lit(1).alias("role"), "id")
    stream_out = near.select("g", to(F.lit(0), F.col("block")).alias("part"), (F.col("b_in") + F.col("block")).alias("chunk"), F.lit(1).alias("role"), "id")
    found = stored(_compare(base.unionByName(stream_in).unionByName(stream_out), sets, percent), "dedup-rest")
    release(together, rows, counts)
    return found


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, and all rows without words; columns unchanged.

    Rows are judged one by one, so rows that share an id, or have none, are documents of their own. The least id stays (null
    comes last); of rows that share it, the least by a hash of the text, then by a hash of all columns: reruns agree.
    """
    texts = _texts(docs, id_col, text_col)
    signed = _signed(texts, ngram, BANDS)
    classes, edges = _links(texts, signed, ngram, percent, BANDS)
    linked = connected_components(edges).withColumnRenamed("node", "of")
    named = classes.join(linked, classes["node"] == linked["of"], "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    leaders = named.groupBy("component").agg(F.min("least").alias("leader"))
    named = stored(named.join(leaders, "component").select(F.col("node").alias("of"), "leader"), "dedup-leaders")
    rows = signed.join(named, F.col("node") == F.col("of")).select("id", "t1", "t2", (_place() == F.col("leader")).alias("leads"))
    rows = stored(rows.groupBy("id", "t1", "t2", "leads").agg(F.count("*").alias("n")).where("not leads or n > 1"), "dedup-dropped")
    release(classes, edges, linked, named, signed)
    key = lambda df, own: df.select(F.col("id").alias(own[0]), F.col("t1").alias(own[1]), F.col("t2").alias(own[2]))
    t1, t2 = content_key(docs[text_col])
    same = lambda df, own: docs[id_col].cast("long").eqNullSafe(df[own[0]]) & (t1 == df[own[1]]) & (t2 == df[own[2]])
    own = ("_dup_id", "_dup_1", "_dup_2")
    dropped, repeated = key(rows.where("not leads"), own), key(rows.where("leads"), own)
    if repeated.isEmpty():
        return docs.join(dropped, same(dropped, own), "left_anti")
    gone = key(rows, own)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    again = docs.join(repeated, same(repeated, own)).groupBy(*own).agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.xxhash64(*[docs[c] for c in plain])).alias("_dup_row"))
    return docs.join(gone, same(gone, own), "left_anti").unionByName(again.select("_dup_row.*"))
