"""Neighbours across shards where centres tell little, and vectors of a few copies each."""

import numpy as np

from ledgerloom.llm import knn


def near(spark, x, graphs):
    rows = [(f"i{i}", i, [float(v) for v in r], "t") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, chunk_index int, embedding array<float>, ingested_at string").repartition(3)
    return [(r.item, r.other) for r in knn.nearest(df, "id", "chunk_index", "embedding", "ingested_at", graphs).collect()]


def test_small_groups_over_many_shards(spark):
    rng = np.random.default_rng(4)
    groups = rng.normal(size=(300, 48))
    x = 0.8 * rng.normal(size=48) + groups[np.repeat(np.arange(300), 10)] + 0.5 * rng.normal(size=(3000, 48))
    got = near(spark, x, knn.Graphs(dim=48, shard=60, points=8, groups_on=300))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -3)
    want = {(i, j) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert len(got) == 5 * len(x) and len(want & set(got)) / len(want) > 0.95


def test_a_few_copies_with_ties(spark):
    base = np.random.default_rng(6).normal(size=(30, 8))
    x = np.concatenate([base] * 3)  # three copies each: two places for them, the others for the smallest copies of the next
    got = near(spark, x, knn.Graphs(dim=8))
    u = base / np.linalg.norm(base, axis=1)[:, None]
    s = np.tile(u @ u.T, (3, 3))
    want = set()
    for i in range(len(x)):
        row = np.round(s[i], 4)
        want |= {(i, j) for j in sorted(set(range(len(x))) - {i}, key=lambda j: (-row[j], j))[:5]}
    assert sorted(got) == sorted(want)
