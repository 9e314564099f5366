"""The small-world graph and the routing to shards, without Spark where that goes."""

import numpy as np

from ledgerloom.llm import knn


def made(n, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 3 * rng.normal(size=(30, dim))[rng.integers(30, size=n)]
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def found(x, q, at, own):
    s = q @ x.T
    if own:
        np.fill_diagonal(s, -3)
    best = np.argsort(-s, axis=1)[:, :5]
    return np.mean([len(set(a) & set(b)) / 5 for a, b in zip(at, best)])


def test_descent_finds_neighbours():
    x = made(3000)
    graph = knn.Graph(x[:2500], knn.Graphs(dim=24), np.random.default_rng(1))
    assert [len(level) for level in graph.levels] == [10, 157, 2500]
    at, sims = graph.search(x[:2500], np.arange(2500))
    assert found(x[:2500], x[:2500], at, True) > 0.97 and (at != np.arange(2500)[:, None]).all()
    assert np.allclose(sims, np.einsum("nd,nkd->nk", x[:2500], x[at]), atol=1e-5) and (np.diff(sims, axis=1) <= 1e-6).all()
    at, _ = graph.search(x[2500:])
    assert found(x[:2500], x[2500:], at, False) > 0.97


def test_small_graphs():
    for n in (1, 2, 4, 7, 65, 300):
        x = made(n)
        at, sims = knn.Graph(x, knn.Graphs(dim=24), np.random.default_rng(1)).search(x, np.arange(n))
        assert ((at >= 0).sum(1) == min(5, n - 1)).all()
    same = np.repeat(made(3), 200, axis=0)  # ties without end
    at, sims = knn.Graph(same, knn.Graphs(dim=24), np.random.default_rng(1)).search(same, np.arange(600))
    assert (at >= 0).all() and np.allclose(sims, 1, atol=1e-5)


def test_nearest_cells():
    x, centre = made(500), made(60, seed=4)
    order = np.argsort((centre @ made(6, seed=5).T).argmax(1), kind="stable")
    group = (centre @ made(6, seed=5).T).argmax(1)[order]
    cells = knn.Cells(made(6, seed=5), centre[order], np.searchsorted(group, np.arange(7)), np.ones(60, np.int64))
    at, s = cells.near(x, 3, look=6)  # all groups: exact
    assert np.allclose(s, -np.sort(-(x @ centre.T), axis=1)[:, :3], atol=1e-5)
    assert np.allclose(s, np.einsum("nd,nkd->nk", x, centre[order][at]), atol=1e-5)


def test_a_hot_cell_is_cut(spark):
    rng = np.random.default_rng(2)
    near = np.ones(16) + 0.01 * rng.normal(size=(500, 16))  # a third and more in one place
    x = np.concatenate([near, made(700, 16)])
    rows = [(f"i{i}", i, v.tolist(), "t") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, chunk_index int, embedding array<float>, ingested_at string")
    got = knn.nearest(df, "id", "chunk_index", "embedding", "ingested_at", knn.Graphs(dim=16, shard=100, groups_on=200, points=8, margin=0.5)).collect()
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    s = x @ x.T
    np.fill_diagonal(s, -3)
    want = {(i, j) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:5]}
    assert len(want & {(r.item, r.other) for r in got}) / len(want) > 0.8 and len(got) == 5 * len(x)
