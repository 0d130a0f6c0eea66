"""Neighbours against brute force: exact on small and odd tables, recall on given and clustered vectors."""

import math

import numpy as np
import pytest
from logloom.llm import multi_index as M

KINDS = "vec_id long, embedding array<double>, label int, n int, node string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", "y") for i, v in rows], KINDS)


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain(rows, every=100):
    """Per query the (distance, id) of its ten nearest rows."""
    good = [(i, np.array(v, float)) for i, v in rows if usable(v)]
    found = []
    for k, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            near = [(math.dist(v, w), math.inf if j is None else j) for m, (j, w) in enumerate(good) if m != k and len(w) == len(v)]
            found.append((i, sorted(near)[:10]))
    return sorted(found)


def grouped(rows):
    queries, last = [], None
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        if last is None or r.query_id != last:
            queries.append((r.query_id, []))
        queries[-1][1].append((r.score, math.inf if r.vec_id is None else r.vec_id))
        last = r.query_id
    return queries


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(1, 400)]
    rows += [(0, rows[5][1]), (500, None), (600, []), (700, [0.0] * 6), (800, [1.0, None] * 3), (900, [math.nan] * 6), (1000, [math.inf] + [0.0] * 5)]
    rows += [(1100, [1.0]), (1101, [3.0]), (1200, [5.0, 5.0]), (None, rows[5][1]), (None, rows[9][1]), (1300, [1e300] * 6), (1301, [-1e300] * 6), (1400, [1e-300] * 6), (1401, [2e-300] * 6)]
    rows += [(k, rows[20][1]) for k in range(2000, 2300)]
    want = dict(plain(rows))
    got = M.nearest(frame(spark, rows)).collect()
    found = dict(grouped(got))
    assert all(r.rank >= 1 for r in got)
    for query, near in want.items():
        if not near:
            assert query not in found
            continue
        assert [i for _, i in found[query]] == [i for _, i in near], query
        assert np.allclose([s for s, _ in found[query]], [s for s, _ in near], rtol=1e-12, atol=0)
    assert set(found) <= set(want)
    assert M.nearest(frame(spark, rows).limit(0)).collect() == []
    assert M.nearest(frame(spark, [(100, None), (200, [0.0])])).collect() == []
    two = M.nearest(frame(spark, [(100, [1.0, 2.0]), (100, [1.0, 2.0])])).collect()
    assert [tuple(r) for r in two] == [(100, 1, 100, 0.0)] * 2


def recall(spark, rows, every):
    want, got = plain(rows, every), dict(grouped(M.nearest(frame(spark, rows), every).collect()))
    hits = [len({i for _, i in near} & {i for _, i in got[q]}) / len(near) for q, near in want]
    for _, near in got.items():
        assert near == sorted(near) and len(near) == 10
    return sum(hits) / len(hits)


def test_recall_on_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    assert recall(spark, [(r[0], [float(x) for x in r[1]]) for r in table.collect()], 20) >= 0.9


def test_recall_and_cost_on_groups(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(60, 16))
    rows = [(k, (centers[k % 60] + 0.1 * rng.normal(size=16)).tolist()) for k in range(6000)]
    assert recall(spark, rows, 100) >= 0.95
    sample = np.array([v for _, v in rows[:4000]])
    assert M.Codebook(sample, 6000).share < 0.1


def test_cells_by_summed_distance():
    rng = np.random.default_rng(3)
    book = M.Codebook(rng.normal(size=(300, 5)), 300)
    book.counts = rng.integers(0, 3, book.shape)
    first, second = (d[0] for d in book.distances(rng.normal(size=(1, 5))))
    both = np.sort((first[:, None] + second[None, :]).ravel())
    order = np.argsort((first[:, None] + second[None, :]).ravel(), kind="stable")
    for share in (0.01, 0.2, 0.7, 1.0):
        book.share = share
        wanted = max(11, math.ceil(share * book.counts.sum()))
        n = np.searchsorted(np.cumsum(book.counts.ravel()[order]), wanted)
        assert book.visited(first, second) == pytest.approx(both[n])


def test_exact_distances():
    rows = np.array([[3.0, 4.0], [0.0, 0.0], [1e300, 1e300], [1e-300, 0.0], [-1.7e308, 1.7e308]])
    want = [5.0, 0.0, math.sqrt(2) * 1e300, 1e-300, math.inf]
    assert np.allclose(M.exact_distances(rows, np.zeros(2))[:4], want[:4], rtol=1e-12, atol=0)
