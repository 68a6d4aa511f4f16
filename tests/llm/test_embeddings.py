"""Near copies of embeddings against all pairs in NumPy."""

import math

import numpy as np
import pytest

from cadenza.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, class int"


def plain(rows, threshold=0.95):
    ids = [r[0] for r in rows]
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    for d in {len(v) for (_, v), g in zip(rows, good) if g}:
        at = [i for i, (_, v) in enumerate(rows) if good[i] and len(v) == d]
        x = np.array([np.float32(rows[i][1]) for i in at], dtype=np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        near[np.ix_(at, at)] = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    least = {}
    for i, v in enumerate(ids):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    out = []
    for i, v in enumerate(ids):
        c = least.get(find(i))
        out.append((v, int(near[i].sum()), c, v is not None and v == c))
    return sorted(out, key=str)


def got(frame, **k):
    return sorted((tuple(r) for r in embeddings.near_copies(frame, **k).collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in embeddings.op13_embedding_near_dedup(spark, f"/root/testdata/{sf}").collect()), key=str) == plain(rows)


@pytest.mark.parametrize("block_rows", [40, 100_000])
def test_chains_copies_and_odd_vectors(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(6):  # chains whose ends are far apart, over blocks
        a, b = rng.normal(size=8), rng.normal(size=8)
        rows += [(len(rows) + k, (a * math.cos(t) + b * math.sin(t)).tolist()) for k, t in enumerate(np.linspace(0, 2, 30))]
    near = rng.normal(size=8)
    rows += [(1000 + k, (near + rng.normal(size=8) * 0.1).tolist()) for k in range(150)]
    rows += [(2000 + k, near.tolist()) for k in range(120)] + [(2000, near.tolist())]
    rows += [(3000 + k, (near * 7).tolist()) for k in range(3)]
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, near[:3].tolist(), near[:3].tolist(), [1e-30] * 8, [1e30] * 8, [-0.0, 1.0], [0.0, 1.0], [0.0, -1.0]]
    rows += [(4000 + k, v) for k, v in enumerate(odd)] + [(None, near.tolist()), (None, rng.normal(size=8).tolist())]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    result = got(frame, block_rows=block_rows)
    assert result == plain(rows)
    assert max(r[1] for r in result) > 120


def test_empty_and_all_odd(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], SCHEMA)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_thresholds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(300)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    for t in (0.5, 0.8, 0.99):
        assert got(frame, threshold=t, block_rows=50) == plain(rows, t)


def test_giving_up_early_loses_no_pair():
    rng = np.random.default_rng(6)
    for width in (3, 8, 40, 90):
        base = rng.normal(size=(40, width))
        raw = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.1, 0.3)])
        raw /= np.linalg.norm(raw, axis=1, keepdims=True)
        axes = np.linalg.eigh(raw.T @ raw)[1][:, ::-1]
        both = embeddings.Comparison(raw, axes, 0.9)
        i, j = both.linked(np.arange(60), np.arange(60, 120))
        want = np.argwhere(raw[:60] @ raw[60:].T >= 0.9)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist())) and len(want)


def test_reached():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n = 60
        a, b = rng.integers(0, n, 40), rng.integers(0, n, 40)
        r = embeddings.Reached(n)
        for k in range(0, 40, 7):
            r.add(a[k : k + 7], b[k : k + 7])
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(a, b):
                want[x] = want[y] = min(want[x], want[y])
        assert r.root.tolist() == want.tolist()
