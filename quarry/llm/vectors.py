"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in halves; k-means on a bounded sample gives each half a codebook, and pairs of codewords form a
product grid. A vector is stored in its own cell and visits cells in the order of the multi-sequence algorithm: by the
summed squared distance that it must travel, per half, to leave its own codeword's region for another's (Voronoi
margins). It stops at a radius which is calibrated on the sample so that of pairs at exactly the least cosine either side
meets the other with probability ``TARGET_RECALL``; both do not with far less than the rest. Met pairs are verified in double precision.

Vectors that are equal are one node. A pair is found if either side visits the other's cell, and counts for both. Cells
are cut into blocks and visitors into chunks, so no task sees a whole large cell.

Rows are vectors of their own, whatever their ids, and ids are joined at the end: rows that share an id are not linked by
that, and each counts its own links. Ids are integers (others raise TypeError). Cases: vectors that are null, zero, or
hold null or non-finite components, and rows with a null label, link with nothing; components may be as large or small as
doubles get, since vectors are scaled by their largest component first; vectors of different lengths link with nothing;
a null id gets a null component, is kept, and links nothing; an empty table gives an empty table; extra columns are
ignored. A node is told apart by a 64-bit hash of its label and components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.graph import connected_components
from quarry.llm.store import integer_id, parallelism, release, stored

LEAST_COSINE = 0.93
#: Vectors that the codebooks are fitted on at most, and their components in all.
FIT_ROWS = 16384
FIT_VALUES = 1 << 22
#: Stored vectors that a cell holds about; it sets the codebooks' size.
PER_CELL = 96
#: Codewords of a half at most: a grid of 2 ** 20 cells, which hold PER_CELL vectors each up to 100 million of a label.
MOST_CODES = 1024
#: Sampled vectors per codeword at least.
PER_CODE = 8
TARGET_RECALL = 0.99
BLOCK = 128


@dataclass
class Grid:
    """Codebooks of both halves for vectors of length ``dims``, and the squared radius that traversal stops at."""

    dims: int
    books: tuple[np.ndarray, np.ndarray]
    radius2: float

    def __post_init__(self):
        self.gaps = tuple(np.sqrt(np.maximum(_distances(b, b), 1e-12)) for b in self.books)

    def margins(self, x: np.ndarray, half: int) -> np.ndarray:
        """For each vector and codeword, the squared distance to the codeword's region (0 for its own)."""
        book = self.books[half]
        part = x[:, : self.dims // 2] if half == 0 else x[:, self.dims // 2 :]
        d2 = _distances(part, book)
        own = d2.argmin(axis=1)
        to = (d2 - d2[np.arange(len(x)), own][:, None]) / (2 * self.gaps[half][own])
        to[np.arange(len(x)), own] = 0
        return np.maximum(to, 0) ** 2

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell of each vector and the cells that it visits, nearest first."""
        m1, m2 = self.margins(x, 0), self.margins(x, 1)
        k2 = m2.shape[1]
        own = m1.argmin(axis=1) * k2 + m2.argmin(axis=1)
        o1, o2 = np.argsort(m1, axis=1, kind="stable"), np.argsort(m2, axis=1, kind="stable")
        s1, s2 = np.take_along_axis(m1, o1, 1), np.take_along_axis(m2, o2, 1)
        visits = []
        for i in range(len(x)):
            n1, n2 = np.searchsorted(s1[i], self.radius2, "right"), np.searchsorted(s2[i], self.radius2, "right")
            total = s1[i, :n1, None] + s2[i, None, :n2]
            a, b = np.nonzero(total <= self.radius2)
            order = np.argsort(total[a, b], kind="stable")
            visits.append((o1[i, a] * k2 + o2[i, b])[order])
        return own, visits


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return ((a * a).sum(axis=1)[:, None] - 2 * a @ b.T) + (b * b).sum(axis=1)[None, :]


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    book = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((book * book).sum(axis=1)[None, :] - 2 * x @ book.T).argmin(axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(book)
        np.add.at(sums, near, x)
        full = counts > 0
        book[full] = sums[full] / counts[full][:, None]
    return np.unique(book, axis=0)


def fit_grid(x: np.ndarray, vectors: int, least: float = LEAST_COSINE, recall: float = TARGET_RECALL) -> Grid:
    """Codebooks for about ``vectors`` stored vectors per label, and the calibrated radius."""
    dims = x.shape[1]
    k = int(np.clip(round(np.sqrt(max(1, vectors) / PER_CELL)), 1, max(1, min(MOST_CODES, len(x) // PER_CODE))))
    grid = Grid(dims, (_kmeans(x[:, : dims // 2], k), _kmeans(x[:, dims // 2 :], k)), 0.0)
    # partners at exactly the least cosine, in random directions: how far is the partner's cell?
    rng = np.random.default_rng(13)
    q = x[rng.integers(0, len(x), 8192)]
    away = rng.normal(size=q.shape)
    away -= (away * q).sum(axis=1)[:, None] * q
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
    partner = least * q + np.sqrt(1 - least * least) * away
    met = np.zeros(len(q))
    for half in (0, 1):
        own = grid.margins(partner, half).argmin(axis=1)
        met += grid.margins(q, half)[np.arange(len(q)), own]
    grid.radius2 = float(np.quantile(met, recall)) + 1e-9
    return grid


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) to (id, label, raw, unit); unit is null where a vector links with nothing."""
    for batch in batches:
        raws, units = [], []
        for v in batch.column(2):
            x = None
            if v.is_valid and len(v) and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            most = 0.0 if x is None or not np.isfinite(x).all() else float(np.abs(x).max())
            if most > 0:
                y = np.ldexp(x, -np.frexp(most)[1])  # exact, and no square overflows or vanishes
                raws.append(x.tobytes())
                units.append((y / np.sqrt((y * y).sum())).tobytes())
            else:
                raws.append(None)
                units.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raws, pa.binary()), pa.array(units, pa.binary())], ["id", "label", "raw", "unit"])


def _placer(grids: dict[int, Grid]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [b.as_py() for b in batch.column(3)]
            cells, visits = np.zeros(len(blobs), dtype=np.int64), [[] for _ in blobs]
            lengths = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
            for dims in np.unique(lengths):
                rows = np.flatnonzero(lengths == dims)
                for k in range(0, len(rows), 1024):
                    part = rows[k : k + 1024]
                    if int(dims) not in grids:  # no such vector was in the sample: one cell
                        for i in part:
                            visits[i] = [0]
                        continue
                    own, seen = grids[int(dims)].cells(np.stack([np.frombuffer(blobs[i]) for i in part]))
                    cells[part] = own
                    for i, s in zip(part, seen, strict=True):
                        visits[i] = s.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(lengths, pa.int32()), pa.array(cells, pa.int32()), pa.array(visits, pa.list_(pa.int32()))],
                ["id", "label", "n", "unit", "dims", "cell", "visits"],
            )

    return place


def _matrix(column) -> np.ndarray:
    """Rows of equal length from a binary column of float64 values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].view(np.float64).reshape(len(column), -1)


def _links(group: pa.Table, least: float) -> Iterator[tuple]:
    """(src, dst, None) edges of a spanning forest and (id, None, links) of one block of stored rows and its visitors."""
    role = group["role"].to_numpy()
    n_base = int((role == 0).sum())
    if not n_base or n_base == len(role):
        return
    ids, n, cell = (group[c].to_numpy() for c in ("id", "n", "cell"))
    x = _matrix(group["unit"])
    base, q = slice(0, n_base), slice(n_base, len(role))
    hit = (x[q] @ x[base].T >= least) & (ids[q][:, None] != ids[base][None, :])
    i, j = np.nonzero(hit)
    if not len(i):
        return
    gains = dict(zip(ids[q].tolist(), (hit @ n[base]).tolist(), strict=True))
    visits = group["visits"].combine_chunks().slice(0, n_base)
    for k in np.unique(j):
        # where the stored side does not visit the visitor's cell, it learns of the link here
        near = i[j == k]
        unseen = near[~np.isin(cell[q][near], visits[int(k)].values.to_numpy())]
        if len(unseen):
            own = int(ids[base][k])
            gains[own] = gains.get(own, 0) + int(n[q][unseen].sum())
    root: dict[int, int] = {}

    def top(v):
        while root.get(v, v) != v:
            v = root[v]
        return v

    for a, b in zip(ids[q][i].tolist(), ids[base][j].tolist(), strict=True):
        s, t = top(a), top(b)
        if s != t:
            root[max(s, t)] = min(s, t)
            yield a, b, None
    for v, links in gains.items():
        if links:
            yield v, None, links


def _comparer(least: float):
    """Rows (g, role, id, n, cell, visits, unit) sorted by group, stored rows (role 0) first."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["src", "dst", "links"])

        def flush() -> list[tuple]:
            rows = list(_links(pa.Table.from_batches(pending), least)) if pending else []
            pending.clear()
            return rows

        for batch in batches:
            rows = []
            g = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if pending and pending[0].column(0)[0].as_py() != g[a]:
                        rows += flush()
                    pending.append(batch.slice(a, b - a))
            yield out(rows)
        yield out(flush())

    return compare


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = LEAST_COSINE,
    recall: float = TARGET_RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; vectors of one label with cosine ``least`` or more are linked."""
    spark = vectors.sparkSession
    rows = vectors.select(integer_id(vectors, id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kind = dict(rows.dtypes)["label"]
    node = F.when(F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull(), F.xxhash64("label", "raw"))
    units = stored(rows.mapInArrow(_units, f"id long, label {kind}, raw binary, unit binary").select("id", "label", "unit", node.alias("node")), "vec-units")
    usable = units.where("node is not null")
    classes = stored(usable.groupBy("node", "label").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("unit").alias("unit")), "vec-classes")

    shape = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.octet_length("unit")).alias("size")).agg(F.max("n").alias("n"), F.max("size").alias("size")).first()
    most, rows_to_fit = shape["n"] or 0, min(FIT_ROWS, FIT_VALUES // max(1, (shape["size"] or 8) // 8))
    sample = [np.frombuffer(r["unit"]) for r in classes.select("unit").orderBy(F.xxhash64("node"), "node").limit(rows_to_fit).collect()]
    lengths = {len(x) for x in sample}
    grids = {d: fit_grid(np.stack([x for x in sample if len(x) == d]), most, least, recall) for d in lengths if d > 1}

    placed = stored(
        classes.select(F.col("node").alias("id"), "label", "n", "unit").mapInArrow(
            _placer(grids), f"id long, label {kind}, n long, unit binary, dims int, cell int, visits array<int>"
        ),
        "vec-placed",
    )
    pieces = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    visits = stored(placed.select("id", "label", "dims", F.explode("visits").alias("at")), "vec-visits")
    held = placed.groupBy("label", "dims", F.col("cell").alias("at")).agg(F.count("*").alias("n_held"))
    sought = visits.groupBy("label", "dims", "at").agg(F.count("*").alias("n_sought"))
    cells = stored(held.join(sought, ["label", "dims", "at"]).select("label", "dims", "at", pieces("n_held").alias("blocks"), pieces("n_sought").alias("chunks")), "vec-cells")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    group = ["label", "dims", "at", "block", "chunk"]
    base = placed.select("id", "label", "dims", F.col("cell").alias("at")).join(cells, ["label", "dims", "at"]).select("id", "label", "dims", "at", deal("blocks").alias("block"), upto("chunks").alias("chunk"), F.lit(0).alias("role"))
    visitors = visits.join(cells, ["label", "dims", "at"]).select("id", "label", "dims", "at", upto("blocks").alias("block"), deal("chunks").alias("chunk"), F.lit(1).alias("role"))
    full = base.unionByName(visitors).join(placed.select(F.col("id").alias("own"), "n", "cell", "visits", "unit"), F.col("id") == F.col("own"))
    grouped = full.select(F.xxhash64(*group).alias("g"), "role", "id", "n", "cell", "visits", "unit")
    dealt = grouped.repartition(parallelism(spark), "g").sortWithinPartitions("g", "role")
    found = stored(dealt.mapInArrow(_comparer(least), "src long, dst long, links long"), "vec-links")
    release(placed, visits, cells)

    links = found.where("dst is null").groupBy(F.col("src").alias("link_node")).agg(F.sum("links").alias("links"))
    components = connected_components(found.where("dst is not null").select("src", "dst")).withColumnRenamed("node", "of")
    named = classes.join(links, F.col("node") == F.col("link_node"), "left").join(components, F.col("node") == F.col("of"), "left").select(
        "node", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component")
    )
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = stored(named.join(lows, "component").select(F.col("node").alias("of"), "links", "component_id"), "vec-classes-linked")
    release(classes, found, components)
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return units.join(named, F.col("node") == F.col("of"), "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )
