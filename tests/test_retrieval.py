"""Hybrid retrieval against a plain program over random texts and vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.operators import lexical, retrieve

WORDS = "exit load fund units tax index folio manager growth plan ratio scheme switch".split()


def by_hand(texts, docs, vectors, question, vector, pin, k=5):
    """Top k (chunk, strategy), and whether it is below the floor, from the definition: no Spark, no SQL."""
    bag = [[w for w in (t or "").split() if len(w) > 1] for t in texts]
    n, mean = len(bag), sum(map(len, bag)) / len(bag)
    df = {w: sum(w in b for b in bag) for w in set(sum(bag, []))}

    def words(i):
        total = 0.0
        for w in question.split():
            f = bag[i].count(w)
            if f:
                total += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(bag[i]) / mean))
        return round(total, 6)

    cos = {i: round(float(np.dot(v, vector) / np.linalg.norm(v) / np.linalg.norm(vector)), 6) for i, v in enumerate(vectors) if pin is None or docs[i] == pin}
    dense = sorted(cos, key=lambda i: (-cos[i], i))[: 3 * k]
    if not dense:
        return [], "dense", True
    place = {i: r for r, i in enumerate(dense, 1)}
    whole = sorted(range(n), key=lambda i: (-words(i), i))
    low = cos[dense[0]] < 0.2 and pin is None
    if len(dense) == 1:
        return dense, "dense", low
    if pin is None and cos[dense[0]] < 0.3:
        a, b = whole[:2]
        rescued = words(a) >= 3 and (words(a) >= 1.4 * words(b) or docs[a] == docs[b])
        return whole[:k], "lexical", low and not rescued
    pool = set(dense) if pin else set(dense) | set(whole[: 3 * k])
    lex = {i: r for r, i in enumerate(sorted(pool, key=lambda i: (-words(i), i)), 1)}
    score = {i: 1 / (60 + place.get(i, len(dense) + 60)) + 1 / (60 + lex[i]) for i in pool}
    return sorted(pool, key=lambda i: (-round(score[i], 12), lex[i]))[:k], "pinned" if pin else "hybrid", low


@pytest.mark.parametrize("seed", [1, 2])
def test_retrieval_is_the_definition(spark, seed, tmp_path):
    rng = np.random.default_rng(seed)
    n, asks = 90, 40
    texts = [None if i % 17 == 5 else " ".join(rng.choice(WORDS, int(rng.integers(0, 14)))) for i in range(n)]
    docs = [f"d{i % 9}" for i in range(n)]
    vectors = rng.normal(size=(n, 6)) + 1.5
    questions = ["unknown words"] + [" ".join(rng.choice(WORDS, int(rng.integers(1, 4)))) for _ in range(asks - 1)]
    q = np.array([-vectors.mean(0) * 50 if i % 4 == 0 else rng.normal(size=6) for i in range(asks)])
    pins = ["none" if i % 13 == 12 else f"d{i % 9}" if i % 3 == 2 else None for i in range(asks)]
    schema = "chunk_index int, doc_id string, text string, embedding array<double>, score int"
    chunks = spark.createDataFrame([(i, docs[i], texts[i], vectors[i].tolist(), 0) for i in range(n)], schema).repartition(5)
    asked = spark.createDataFrame([(str(i), questions[i], pins[i], q[i].tolist()) for i in range(asks)], "qid string, question string, doc_id string, embedding array<double>")
    kept = lexical.index(chunks, "chunk_index", "text", str(tmp_path / "kept"))
    for idx in (None, kept, lexical.load(spark, str(tmp_path / "kept"))):
        hits, outcome = retrieve.retrieve(chunks, asked, EngineConfig(lexical_only_floor=0.3), idx=idx)
        got = {}
        for r in hits.orderBy("qid", "pos").collect():
            got.setdefault(r.qid, []).append(r.chunk_index)
            assert r.doc_id == docs[r.chunk_index]
        low = {r.qid: (r.strategy, r.below_floor) for r in outcome.collect()}
        seen = set()
        for i in range(asks):
            want, strategy, below = by_hand(texts, docs, vectors, questions[i], q[i], pins[i])
            assert got.get(str(i), []) == want and low[str(i)] == (strategy, below), i
            seen.add(strategy)
        assert seen == {"lexical", "hybrid", "pinned", "dense"}
        assert len(got["0"]) == 5


def test_a_kept_index_reads_no_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "load load fees"), (2, None)], "k int, t string")
    lexical.index(docs, "k", "t", str(tmp_path / "i"))
    q = spark.createDataFrame([("a", "load")], "qid string, q string")
    out = lexical.ask(lexical.load(spark, str(tmp_path / "i")), q, "qid", "q", 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # no text is read, and nothing meets but each partition's best
    assert "regexp_extract_all" not in plan and plan.count("Exchange") == 1
    assert [(r.key, r.rank) for r in out.collect()] == [(1, 1)]
    assert lexical.ask(lexical.load(spark, str(tmp_path / "i")), q.limit(0), "qid", "q", 3).count() == 0


def test_index_rows(spark):
    docs = spark.createDataFrame([(1, "b a b The c2 b a"), (2, None), (3, ""), (None, "x y"), (4, "zz")], "k int, t string")
    idx = lexical.index(docs, "k", "t")
    rows = {r.key: (r.dl, dict(zip(r.terms, r.tfs))) for r in idx.docs.collect()}
    assert rows == {1: (1, {"c2": 1}), 2: (0, {}), 3: (0, {}), 4: (1, {"zz": 1})}
    idx = lexical.index(docs.withColumn("t", F.regexp_replace("t", r"\b([a-z])\b", "$1$1")), "k", "t")
    assert {r.term: r.tf for r in idx.postings.where("key = 1").collect()} == {"bb": 3, "aa": 2, "c2": 1}
