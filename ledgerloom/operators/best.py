"""The best rows of each question, kept while batches go by."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "qid string, key long, score double"
CELLS = 4_000_000  # scores held at once: 32 MB of doubles


class Best:
    """The ``k`` best (score, key) of each of ``n`` questions; ties go to the smaller key.

    What falls below a question's k-th best so far is left out at once, so the pool stays near n * k rows.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf)
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, question: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        on = score >= self.floor[question]
        self.pool.append((question[on], key[on], score[on]))
        self.held += int(on.sum())
        if self.held > 2 * self.n * self.k + 100_000:
            self.prune()

    def add_matrix(self, key: np.ndarray, score: np.ndarray, on: np.ndarray) -> None:
        """``score`` (question x key); only cells that are ``on`` count."""
        q, c = np.nonzero(on & (score >= self.floor[:, None]))
        self.add(q, key[c], score[q, c])

    def prune(self) -> None:
        if not self.pool:
            return
        q, key, score = (np.concatenate(x) for x in zip(*self.pool, strict=True))
        order = np.lexsort((key, -score, q))
        q, key, score = q[order], key[order], score[order]
        count = np.bincount(q, minlength=self.n)
        start = np.cumsum(count) - count
        on = np.arange(len(q)) - start[q] < self.k
        full = np.flatnonzero(count >= self.k)
        self.floor[full] = score[start[full] + self.k - 1]
        self.pool, self.held = [(q[on], key[on], score[on])], int(on.sum())

    def rows(self, names: list) -> pa.RecordBatch:
        self.prune()
        q, key, score = self.pool[0] if self.pool else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(q)), pa.array(key, pa.int64()), pa.array(score, pa.float64())], names=["qid", "key", "score"])


def blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """All rows of about ``size`` questions (``qid``) at a time, on the driver; the rows of a question come together.

    One job if there are few; else the rows are counted and read once a block, a part of the hashes each.
    """
    got = rows.limit(size + 1).collect()
    if len(got) <= size:
        if got:
            yield got
        return
    n = math.ceil(rows.count() / size)
    for i in range(n):
        if got := rows.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i).collect():
            yield got
