"""Rows that were written twice."""

import numpy as np

from ledgerloom.llm import knn


def test_nearest_of_repeated_rows(spark):
    x = np.random.default_rng(5).normal(size=(40, 8))
    rows = [(f"i{i}", i, [float(v) for v in x[i]], "2025-01-01" if i % 2 else None) for i in range(len(x))]
    again = [r for r in rows for _ in range(1 + (r[1] < 10) + 7 * (r[1] == 3))]  # twice, and nine times

    def near(rows):
        df = spark.createDataFrame(rows, "id string, chunk_index int, embedding array<float>, ingested_at string").repartition(3)
        return sorted((r.item, r["rank"], r.other) for r in knn.nearest(df, "id", "chunk_index", "embedding", "ingested_at", knn.Graphs(dim=8)).collect())

    got = near(again)
    assert all(a != b for a, _, b in got) and len(got) == 5 * len(x)
    assert got == near(rows)
