"""Clustering over a vector-approximation file against comparing everything with everything."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from tests_llm import SF01

from check import compare, database
from tracebeam.llm import oracle, vafile
from tracebeam.llm.queries import queries


def brute(rows, k=16, rounds=3, dims=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) with Python's whole numbers."""
    kept = [
        (i, [min(max(math.floor(64 * x), -(1 << 27)), 1 << 27) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in starts[:k]]
    if not centroids:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (_, at) in zip(kept, near) if at == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assign()
    inertia = [sum(d for d, at in near if at == c) for c in range(len(centroids))]
    return [
        (i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, near)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 key", "'x' cluster", "2 v", "3 n", "'c' cells", "4 distance"
    )


def by_id(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_matches_sql(spark):
    outcome, _ = compare(spark, database(SF01), queries()["op11_centroids"], oracle.SQL["op11_centroids"], SF01)
    assert outcome.startswith("ok"), outcome


def test_overlapping_intervals_only_fetch_the_rest(spark):
    report = []
    vafile.clustered(spark.read.parquet(f"{SF01}/embeddings.parquet"), report=report).count()
    assert all(0 < fetched < total / 2 for total, fetched in report)


@pytest.mark.parametrize("bits", [1, 5, 8])
def test_odd_vectors_equal_brute_force(spark, bits):
    rng = np.random.default_rng(3)
    wide = rng.normal(0, 1, (120, 64)).tolist()
    flat = [[float(k % 3)] * 64 for k in range(30)]  # ties and repeated vectors
    rows = [(k, v) for k, v in enumerate(wide + flat)] + [(5, wide[5]), (5, wide[6]), (None, wide[7])]
    rows += [(900, None), (901, []), (902, [0.0] * 63), (903, [None] + [0.0] * 63), (904, [math.inf] + [0.0] * 63)]
    rows += [(905, [math.nan] * 64), (906, [1e300] * 64), (907, [-1e30] + [0.5] * 63)]
    got = vafile.clustered(frame(spark, rows).repartition(5), bits=bits).collect()
    assert by_id(got) == by_id(brute(rows))


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(k, [k / 7] * 64) for k in range(4)]
    assert by_id(vafile.clustered(frame(spark, rows)).collect()) == by_id(brute(rows))
    assert vafile.clustered(frame(spark, [])).collect() == []
    assert vafile.clustered(frame(spark, [(None, [1.0] * 64)])).collect() == []


def test_other_sizes(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v) for k, v in enumerate(rng.normal(0, 2, (200, 5)).tolist())]
    got = vafile.clustered(frame(spark, rows), k=70, rounds=2, bits=3, dims=5).collect()
    assert by_id(got) == by_id(brute(rows, 70, 2, 5))


def test_intervals_hold_the_exact_distances():
    rng = np.random.default_rng(5)
    v, centroids = rng.integers(-40, 40, (300, 8)), rng.integers(-40, 40, (9, 8))
    edges = np.sort(rng.integers(-40, 40, (8, 5)), axis=1)
    edges[:, 0], edges[:, -1] = -40, 41
    cells = vafile.compress(v, edges)
    marks = vafile.Intervals(centroids, edges).candidates(cells)
    exact = ((v[:, None, :] - centroids) ** 2).sum(2)
    assert marks[np.arange(300), exact.argmin(1)].all() and not marks.all()
    assert (vafile.nearest(v, centroids, marks) == exact.argmin(1)).all()
    for bits in (3, 5):
        packed = vafile.packed(cells, bits)
        assert (vafile.unpacked(packed, 8, bits) == cells).all()
