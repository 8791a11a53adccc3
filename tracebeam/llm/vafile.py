"""Centroid clustering over a vector-approximation file.

Vectors are whole numbers. Every dimension is cut into 2^bits cells (edges at the normal quantiles of
the dimension's mean and deviation over all vectors, outer edges at its least and largest value), and a
vector's approximation is its cell numbers, a few bits each. For given centroids a lookup table holds,
per dimension and cell, the least and the largest squared distance between the cell and the centroid;
added up over the dimensions they give an interval that contains the exact squared distance. If the
interval of one centroid lies below all others the vector is assigned without being read. Where intervals
overlap, a second table gives the interval of the difference of two distances: as both are taken from the
same unknown point of a cell, most of what is unknown cancels out, so this interval is far narrower. Only
where it too leaves several centroids is the full vector fetched, by key, and compared with those alone.

Sums for the new centroids are kept as totals: the first round adds every vector (it is in hand, as its
approximation is made from it), later rounds fetch the vectors that changed their cluster and move them
from one total to the other. The last round needs every vector once more, for its exact distance. Sums
and distances are whole numbers, so order and partitioning do not matter.

Rows whose vector has another length, or a null or non-finite component, are left out. Components beyond
2^27 in size count as 2^27, so that squared distances fit a long. Repeated rows are vectors of their own.
A null vec_id is kept and clustered, but never starts a cluster. With fewer vectors than centroids there
are as many centroids as vectors with an id; with none the result is empty. Ties go to the smaller
cluster number. Only the id and the vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebeam.session import materialize

# fixed values of the contract
DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
BITS = 5
LARGEST = 1 << 27
CHUNK = 2048

STATE = "key long, cells binary, cluster int, n long, sums array<long>"
RESULT = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
)


def whole_vectors(
    rows: DataFrame, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(key, vec_id, v) of all usable vectors, components floor(scale * x), written out under a key."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = (F.size(x) == dims) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    whole = F.transform(
        x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    )
    kept = rows.where(F.coalesce(usable, F.lit(False))).select(
        F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")
    )
    return materialize(kept, "vectors")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose id has the smallest hash; a top-k scan."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").orderBy(rank, "v").select("v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def cell_edges(vectors: DataFrame, dims: int, bits: int) -> np.ndarray:
    """(dims, 2^bits + 1) edges of the cells; cell c holds edge[c] <= x < edge[c + 1]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0), dims)
                f = v.astype(np.float64)
                parts.append((len(v), f.sum(0), (f * f).sum(0), v.min(0), v.max(0)))
        if parts:
            n, s, q, lo, hi = zip(*parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([sum(n)] * dims, pa.int64()),
                 pa.array(np.sum(s, 0)), pa.array(np.sum(q, 0)), pa.array(np.min(lo, 0)), pa.array(np.max(hi, 0))],
                ["dim", "n", "s", "q", "lo", "hi"],
            )

    parts = vectors.select("v").mapInArrow(run, "dim int, n long, s double, q double, lo long, hi long")
    rows = parts.groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    ).orderBy("dim").collect()  # one row per dimension
    cells = 1 << bits
    normal = np.array([NormalDist().inv_cdf(j / cells) for j in range(1, cells)])
    edges = np.empty((dims, cells + 1), np.int64)
    for r in rows:
        mean = r["s"] / r["n"]
        deviation = max(r["q"] / r["n"] - mean * mean, 0.0) ** 0.5
        inner = np.ceil(mean + deviation * normal).astype(np.int64)
        edges[r["dim"]] = [r["lo"], *np.clip(inner, r["lo"], r["hi"] + 1), r["hi"] + 1]
    return edges


def compress(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Cell numbers of vectors, one byte each."""
    cells = np.empty(v.shape, np.uint8)
    for d in range(v.shape[1]):
        cells[:, d] = np.searchsorted(edges[d, 1:-1], v[:, d], "right")
    return cells


def packed(cells: np.ndarray, bits: int) -> pa.Array:
    """Cell numbers in ``bits`` bits each, one binary value per vector."""
    flat = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(cells), -1)
    data = np.packbits(flat, axis=1)
    offsets = np.arange(len(cells) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(
        pa.binary(), len(cells), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )


def unpacked(column: pa.Array, dims: int, bits: int) -> np.ndarray:
    width = -(-dims * bits // 8)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)
    flat = np.unpackbits(data, axis=1)[:, : dims * bits].reshape(len(column), dims, bits)
    out = np.zeros((len(column), dims), np.uint8)
    for k in range(bits):
        out = out << 1 | flat[:, :, k]
    return out


class Intervals:
    """Least and largest squared distance between a vector in given cells and every centroid."""

    def __init__(self, centroids: np.ndarray, edges: np.ndarray):
        low, high = edges[:, :-1], edges[:, 1:] - 1
        self.centroids, self.ends = centroids, (low, high)
        below, above = low - centroids[:, :, None], centroids[:, :, None] - high
        self.low = np.maximum(np.maximum(below, above), 0) ** 2
        self.high = np.maximum(np.abs(below), np.abs(above)) ** 2

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """(vectors, centroids) marks of the centroids that can be the nearest."""
        least = np.zeros((len(self.low), len(cells)), np.int64)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            least += self.low[:, d, :][:, cells[:, d]]
            most += self.high[:, d, :][:, cells[:, d]]
        marks = (least <= most.min(axis=0)).T
        best = most.argmin(axis=0)
        open_rows = np.flatnonzero(marks.sum(1) > 1)
        for b in np.unique(best[open_rows]):
            rows = open_rows[best[open_rows] == b]
            marks[rows] &= self.not_beaten(int(b), cells[rows])
        return marks

    def not_beaten(self, b: int, cells: np.ndarray) -> np.ndarray:
        """(vectors, centroids) marks of the centroids that are not surely farther than centroid ``b``.

        In a dimension, (x - b)^2 - (x - c)^2 is linear in x: its largest value lies at an end of the cell.
        A centroid with a larger number is out at equal distance as well.
        """
        c, mine = self.centroids, self.centroids[b]
        slope, base = 2 * (c - mine), mine * mine - c * c
        low, high = self.ends
        most = base[:, :, None] + np.maximum(slope[:, :, None] * low, slope[:, :, None] * high)
        total = np.zeros((len(c), len(cells)), np.int64)
        for d in range(cells.shape[1]):
            total += most[:, d, :][:, cells[:, d]]
        return (total >= (np.arange(len(c)) > b)[:, None]).T


def nearest(v: np.ndarray, centroids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Nearest marked centroid of each vector by exact distance; ties go to the smaller number."""
    out = np.empty(len(v), np.int32)
    for lo in range(0, len(v), CHUNK):
        rows, at = np.nonzero(marks[lo : lo + CHUNK])
        square = np.full(marks[lo : lo + CHUNK].shape, np.iinfo(np.int64).max)
        square[rows, at] = ((v[lo : lo + CHUNK][rows] - centroids[at]) ** 2).sum(1)
        out[lo : lo + CHUNK] = square.argmin(1)
    return out


class Totals:
    """Count and componentwise sum of the vectors of every cluster."""

    def __init__(self, k: int, dims: int):
        self.n, self.sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)

    def add(self, v: np.ndarray, cluster: np.ndarray, sign: int = 1) -> None:
        np.add.at(self.n, cluster, sign)
        np.add.at(self.sums, cluster, sign * v)

    def batch(self) -> pa.RecordBatch:
        at = [int(c) for c in np.flatnonzero(self.n.astype(bool) | self.sums.any(1))]
        return state_batch([None] * len(at), None, at, self.n[at].tolist(), self.sums[at].tolist())


def state_batch(keys, cells, cluster, n=None, sums=None) -> pa.RecordBatch:
    blank = [None] * len(cluster)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(blank, pa.binary()) if cells is None else cells,
         pa.array(cluster, pa.int32()), pa.array(n or blank, pa.int64()),
         pa.array(sums or blank, pa.list_(pa.int64()))],
        ["key", "cells", "cluster", "n", "sums"],
    )


def members(state: DataFrame) -> DataFrame:
    return state.where("key is not null").select("key", "cells", "cluster")


def add_totals(state: DataFrame, n: list[int], sums: list[list[int]]) -> None:
    """Add the tasks' totals in ``state`` to those of the driver (centroids times dimensions numbers)."""
    whole = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")) for d in range(len(sums[0]))]
    parts = state.where("key is null").groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")), *whole)
    for cluster, count, *moved in parts.collect():
        n[cluster] += int(count)
        sums[cluster] = [x + int(y) for x, y in zip(sums[cluster], moved)]


def first_assignment(vectors: DataFrame, centroids: np.ndarray, edges: np.ndarray, bits: int) -> DataFrame:
    """Approximations with their first cluster, and the tasks' totals (rows without key)."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals, totals = Intervals(centroids, edges), Totals(*centroids.shape)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1), dims)
                cells = compress(v, edges)
                cluster = nearest(v, centroids, intervals.candidates(cells))
                totals.add(v, cluster)
                yield state_batch(batch.column(0), packed(cells, bits), cluster)
        yield totals.batch()

    return materialize(vectors.select("key", "v").mapInArrow(run, STATE), "va-state")


def bounded(state: DataFrame, centroids: np.ndarray, edges: np.ndarray, bits: int) -> DataFrame:
    """(key, cells, old, cluster, marks): new cluster from approximations alone, null where undecided."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = Intervals(centroids, edges)
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = intervals.candidates(unpacked(batch.column(1), dims, bits))
            several = marks.sum(1) > 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 pa.array(marks.argmax(1), pa.int32(), mask=several),
                 pa.array([m.tobytes() for m in np.packbits(marks, axis=1)], pa.binary())],
                ["key", "cells", "old", "cluster", "marks"],
            )

    return materialize(
        state.mapInArrow(run, "key long, cells binary, old int, cluster int, marks binary"), "va-bounds"
    )


def refined(bounds: DataFrame, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of ``bounds`` that are undecided or moved, settled on their full vectors, and the totals moved."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals(k, dims)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(4), dims)
            marks = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(v), -1)
            cluster = nearest(v, centroids, np.unpackbits(marks, axis=1)[:, :k].astype(bool))
            old = batch.column(2).to_numpy()
            moved = cluster != old
            totals.add(v[moved], cluster[moved])
            totals.add(v[moved], old[moved], -1)
            yield state_batch(batch.column(0), batch.column(1), cluster)
        yield totals.batch()

    wanted = bounds.where("cluster is null or cluster <> old").select("key", "cells", "old", "marks")
    fetched = wanted.join(vectors.select("key", "v"), "key").select("key", "cells", "old", "marks", "v")
    return materialize(fetched.mapInArrow(run, STATE), "va-refined")


def measured(vectors: DataFrame, centroids: np.ndarray, edges: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) for the final centroids."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = Intervals(centroids, edges)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1), dims)
                cluster = nearest(v, centroids, intervals.candidates(compress(v, edges)))
                distance = ((v - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                    ["vec_id", "cluster", "distance"],
                )

    return materialize(
        vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long"), "va-clusters"
    )


def clustered(
    rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, bits: int = BITS, dims: int = DIMS,
    scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding",
    report: list | None = None,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    ``report`` collects, per later round, the number of vectors and of those fetched in full.
    """
    if not 1 <= bits <= 8:
        raise ValueError(f"bits must be 1 to 8, not {bits}")
    spark = rows.sparkSession
    vectors = whole_vectors(rows, dims, scale, id_col, vector_col)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    edges = cell_edges(vectors, dims, bits)
    n, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    state = None
    for _ in range(rounds):
        if state is None:
            new = first_assignment(vectors, centroids, edges, bits)
            state = members(new)
        else:
            bounds = bounded(state, centroids, edges, bits)
            new = refined(bounds, vectors, centroids)
            state = bounds.where("cluster = old").select("key", "cells", "cluster").union(members(new))
            if report is not None:
                report.append((bounds.count(), members(new).count()))
        add_totals(new, n, sums)
        centroids = np.array(
            [[x // n[c] for x in sums[c]] if n[c] else centroids[c].tolist() for c in range(len(n))], np.int64
        )
    out = measured(vectors, centroids, edges)
    of_cluster = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    total = sum(int(r["sum"]) for r in of_cluster)
    # one row per centroid
    facts = [
        (r["cluster"], int(r["sum"]), total,
         hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
        for r in of_cluster
    ]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select(*[c.split()[0] for c in RESULT.split(", ")])
