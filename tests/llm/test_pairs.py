"""Near-duplicates, leaks and nearest vectors against brute force."""

import random
import re

import numpy as np
import pytest

from ledgerloom.llm import knn, leakage, neardup

NEAR = neardup.Near(words=3, similarity=0.6, least_tokens=5)


def brute(rows, near):
    sets = {}
    for i, t in rows:
        x = re.findall("[a-z0-9]+", (t or "").lower())
        if i is not None and len(x) >= max(near.least_tokens, near.words):
            sets[i] = set(zip(*(x[k:] for k in range(near.words)), strict=False))
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= near.similarity}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = rng.choices(words, k=rng.randint(15, 60))
        for _ in range(rng.randint(1, 5)):
            copy = [w if rng.random() > 0.06 else rng.choice(words) for w in base]
            rows.append((len(rows), " ".join(copy)))
    common = " ".join(words[:40])
    rows += [(len(rows) + k, common) for k in range(30)]  # exact copies
    rows += [(len(rows) + k, f"{common} tail{k}") for k in range(80)]  # one hot block
    return [*rows, (9000, None), (9001, ""), (9002, "a b c"), (None, common), (9003, "x " * 50)]


@pytest.mark.parametrize("tight", [{}, {"hot": 20, "tile": 8, "counters": 64}])
def test_near_duplicates_are_those_of_brute_force(spark, corpus, tight):
    near = neardup.Near(**(NEAR.__dict__ | tight))
    df = spark.createDataFrame(corpus, "id long, body string").withColumn("sid", neardup.F.lit("clash"))
    result = neardup.near_duplicates(df, "id", "body", near)
    want = brute(corpus, near)
    assert {(r.a, r.b) for r in neardup.expanded(result).collect()} == want
    if not tight:
        rows = neardup.groups(result).collect()
        parent = {r.id: r.id for r in rows}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in want:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        assert {r.id: r.group_id for r in rows} == {x: root(x) for x in parent}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id long, body string")
    result = neardup.near_duplicates(df, "id", "body", NEAR)
    assert neardup.expanded(result).count() == 0 and neardup.groups(result).count() == 0


def test_bit_counts_lose_no_pair():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    base = rng.choices(words, k=60)
    texts = [" ".join(w if rng.random() > p else rng.choice(words) for w in base) for p in (0, 0.02, 0.05, 0.1, 0.2)]
    owner, h, n = neardup.token_sets(texts, NEAR, {})
    vectors = neardup.bit_vectors(owner, h, len(texts)).view(np.uint64)
    for a in range(5):
        for b in range(a):
            x, y = set(h[owner == a]), set(h[owner == b])
            assert np.bitwise_count(vectors[a] ^ vectors[b]).sum() <= len(x ^ y)


ITEMS = [
    (1, "Units of Rabar Value Fund sold inside 31 months are assessed at 17.58% plus cess in the year 2024 by Noral.", "What is the exit load of Rabar Value Fund in 2024?"),
    (2, "short one", "Who?"), (3, None, None), (4, "", "?"),
]


def test_leaks(spark):
    items = spark.createDataFrame(ITEMS, "id int, passage string, question string")
    p, q = ITEMS[0][1], ITEMS[0][2]
    docs = [
        (1, f"Before. {p.upper()} After."), (2, f"x {q[:-1]} y"), (3, p.replace("31", "44").replace("2024", "2021")), (4, p.replace("31", "17").replace("2024", "31")),
        (5, " ".join(p.split()[:9])), (6, None), (7, ""), (8, "who knows"), (9, q.replace("Rabar", "Kodal")), (1, "again"), (None, p), (10, "..." + "z " * 5000 + p),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", leakage.F.lit(0)).withColumn("slots", leakage.F.lit(0))
    for few in (10**6, 0):  # with and without the hashes at the readers
        rows = leakage.leaks(df, items, windows=leakage.Windows(broadcast_windows=few)).collect()
        assert {(r.doc_id, r.item_id, r.part) for r in rows if r.literal} == {(1, 1, "passage"), (10, 1, "passage"), (2, 1, "question"), (8, 2, "question")}
        other = {(r.doc_id, r.item_id, r.part) for r in rows if not r.literal}
        assert (3, 1, "passage") in other and (9, 1, "question") in other
    assert leakage.leaks(df, items.limit(0)).count() == 0 and leakage.leaks(df.limit(0), items).count() == 0


def _vectors(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 40), dim))
    return centres[rng.integers(len(centres), size=n)] + 0.4 * rng.normal(size=(n, dim))


def test_nearest_recall(spark):
    x = _vectors(1500)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(f"i{i}", i, [float(v) for v in x[i] * (1 + i % 3)], "2025-01-01") for i in range(len(x))]
    df = spark.createDataFrame(rows, "id string, chunk_index int, embedding array<float>, ingested_at string")
    got = knn.nearest(df, "id", "chunk_index", "embedding", "ingested_at", knn.Graphs(dim=16, shard=150, groups_on=400)).collect()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(i, j) for i, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
    found = {(r.item, r.other) for r in got}
    assert len(found) == len(want) and len(found & want) / len(want) > 0.95


def test_graph_search_finds_what_brute_force_finds():
    x = _vectors(3000, seed=4).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = knn.Graph(x[:2600], knn.Graphs(dim=16), np.random.default_rng(0))
    at, _ = graph.search(x[2600:])
    want = np.argsort(-(x[2600:] @ x[:2600].T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(at, want, strict=True)]) > 0.9


def test_nearest_of_unfit_and_equal_vectors(spark):
    one, two = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    rows = [(f"i{i}", i, one, None) for i in range(20)] + [("n", 30, None, "x"), ("z", 31, [0.0] * 8, "x"), ("s", 32, [1.0], "x"), ("f", 33, [float("nan")] * 8, "x"), ("e", 34, [None] * 8, "x")]
    rows += [("t", 40, two, "2025-01-02"), ("t", 40, one, "2025-01-01"), ("t", 40, [0.0] * 8, "2025-01-03"), (None, 50, one, "x"), ("q", None, one, "x")]
    df = spark.createDataFrame(rows, "id string, chunk_index int, embedding array<float>, ingested_at string")
    got = {}
    for r in knn.nearest(df, "id", "chunk_index", "embedding", "ingested_at", knn.Graphs(dim=8)).collect():
        got.setdefault(r.item, {})[r["rank"]] = r.other
    assert set(got) == {*range(20), 40}
    assert list(got[19][k] for k in range(1, 6)) == [0, 1, 2, 3, 4] and [got[2][k] for k in range(1, 6)] == [0, 1, 3, 4, 5]
    assert knn.nearest(df.limit(0), "id", "chunk_index", "embedding", "ingested_at", knn.Graphs(dim=8)).count() == 0


def test_near_duplicates_of_a_hot_shingle_and_streamed_blocks(spark):
    """Blocks cut into tiles, and blocks that batches of rows cut anywhere, give the same pairs as brute force."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(150):
        body = list(rng.choice(words, 30))
        texts.append(" ".join(["share", "this", "page", *body[:12]]) if i % 2 else " ".join(body))
        if i % 3 == 0:
            body[int(rng.integers(30))] = "changed"
            texts.append(" ".join(body))
    texts += ["only these five words here"] * 40 + [f"only these five words here {i % 7}" for i in range(60)]
    near = neardup.Near(words=2, similarity=0.7, hot=10)

    def shingles(t):
        x = t.split()
        return set(zip(x, x[1:]))

    sets = [shingles(t) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7 - 1e-12}
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(5)
    texts_only = neardup._texts(df, "k", "t")
    counts = np.full(1 << 20, 11, np.uint32)  # every counter leaves it open
    hot = neardup.hot_shingles(texts_only, near, counts)
    assert hot and all(n > 10 for n in hot.values())
    for step in (1, 7, 50_000):
        rows = neardup.blocks(texts_only, near, counts)
        found = {tuple(sorted(r)) for r in neardup.candidates(rows, near, step).collect()}
        assert found == {tuple(sorted(r)) for r in neardup.candidates(neardup.blocks(texts_only, neardup.Near(words=2, similarity=0.7), counts), near).collect()}
    got = {(r.a, r.b) for r in neardup.expanded(neardup.near_duplicates(df, "k", "t", near)).collect()}
    assert got == want


def test_texts_of_a_repeated_key_are_compared_as_they_are(spark):
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "a b c d e f g h x"), (3, "p q r s t u v w x")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {(r.a, r.b) for r in neardup.near_duplicates(df, "k", "t", neardup.Near(words=2, similarity=0.8)).links.collect()}
    assert got == {(1, 2), (1, 3)}


def test_components_say_when_they_are_not_settled(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(41)], "id long")
    with pytest.raises(RuntimeError):
        neardup.components(links, nodes, rounds=1)
    assert {r.root for r in neardup.components(links, nodes).collect()} == {0}
