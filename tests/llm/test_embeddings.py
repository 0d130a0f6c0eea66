"""Links and components against brute force, recall at the threshold, edge rows."""

import numpy as np
import pytest
from logloom.llm import embeddings as E


def plain(rows, cosine=0.93):
    good = []
    for k, (_, v, label) in enumerate(rows):
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        good.append(k if ok and label is not None else None)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in [g for g in good if g is not None]:
        x = np.float32(rows[a][1]).astype(float)
        for b in range(a):
            if good[b] is not None and rows[a][2] == rows[b][2] and len(rows[b][1]) == len(x):
                y = np.float32(rows[b][1]).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, links[k], least.get(find(k)), i is not None and i == least.get(find(k))) for k, (i, _, _) in enumerate(rows)), key=str)


def group(rng, center, n, noise):
    return [(center + noise * rng.normal(size=len(center))).tolist() for _ in range(n)]


@pytest.mark.parametrize("block", [1024, 16])
def test_groups_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        for n, noise in ((60, 0.05), (9, 0.2), (1, 0.1), (1, 0.1), (30, 0.3)):
            rows += [(v, label) for v in group(rng, rng.normal(size=24), n, noise)]
    rows += [(rows[0][0], 0)] * 50 + [(rows[0][0], 1)] * 3 + [([2 * x for x in rows[0][0]], 0)]
    rows += [(None, 0), ([], 0), ([0.0] * 24, 0), ([0.0] * 24, 0), ([1.0, None] * 12, 0), ([float("nan")] * 24, 0), ([float("inf")] + [0.0] * 23, 0)]
    rows += [([1.0, 1.0], 0), ([1.0, 1.0], 0), ([1e30] * 24, 5), ([1e-30] * 24, 5), ([-0.0] * 23 + [1.0], 6), ([0.0] * 23 + [1.0], 6)]
    rows = [(int(i), v, label) for i, (v, label) in zip(rng.permutation(len(rows)), rows)]
    rows += [(None, rows[0][1], 0), (rows[1][0], rows[1][1], 0)]
    frame = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, n int, node string")
    got = sorted(map(tuple, E.embedding_components(frame).collect()), key=str)
    assert got == plain(rows)
    assert E.embedding_components(frame.limit(0)).collect() == []
    assert len(E.embedding_components(frame.where("embedding is null")).collect()) == 1


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    mates = 0.935 * base + np.sqrt(1 - 0.935**2) * other
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, mates]))]
    got = E.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sum(r.n_links for r in got) >= 2 * 0.99 * 1500


def test_given_vectors_with_mates(spark):
    """The given table and, for every vector, one near the threshold; every link against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    rng = np.random.default_rng(9)
    found = [(r.vec_id, np.array(r.embedding, float), r.label) for r in rows]
    for k, (_, v, label) in enumerate(list(found)):
        unit, other = v / np.linalg.norm(v), rng.normal(size=len(v))
        other -= other @ unit * unit
        cosine = rng.choice([0.92, 0.931, 0.95, 0.99])
        found.append((1_000_000 + k, cosine * unit + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other), label))
    want = {}
    for label in {label for *_, label in found}:
        ids = [i for i, _, other in found if other == label]
        units = np.float32([v for _, v, other in found if other == label]).astype(float)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        want |= dict(zip(ids, ((units @ units.T >= 0.93).sum(axis=1) - 1).tolist(), strict=True))
    frame = spark.createDataFrame([(i, v.tolist(), label) for i, v, label in found], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in E.embedding_components(frame).collect()}
    assert set(got) == set(want) and all(got[i] <= n for i, n in want.items())  # no link below the threshold
    assert sum(want.values()) > 2500 and sum(got.values()) >= 0.9 * sum(want.values())
