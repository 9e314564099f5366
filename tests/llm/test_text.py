"""Splitting, packing and repeated lines."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from ledgerloom.llm import packing, repeated, splitting
from ledgerloom.llm.splitting import Budget, cut

PARTS = st.lists(st.sampled_from(["a", "bb. ", "c\n", "\n\n", " ", "dddd", "e!\n\n", " f ", chr(160), "x" * 90, "क। "]), max_size=60)


@settings(max_examples=200, deadline=None)
@given(PARTS)
def test_pieces_keep_all_words_in_order_within_the_limits(parts):
    text, budget = "".join(parts), Budget(case_words=8, max_words=7, max_chars=40, overlap=3)
    covered, last = [False] * len(text), -1
    for a, b, words, _ in cut(text, budget):
        assert 0 < b - a <= 40 and words <= 7 and a > last
        last = a
        covered[a:b] = [True] * (b - a)
    assert all(c or t.isspace() for c, t in zip(covered, text, strict=True))


def test_cut_prefers_paragraphs_and_overlaps():
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(60)) + "." for i in range(6))
    pieces = cut(text, Budget())
    assert [p[3] for p in pieces[:-1]] == ["paragraph"] * (len(pieces) - 1)
    for (_, stop, _, _), (start, *_) in zip(pieces, pieces[1:], strict=False):
        assert start < stop and len(text[start:stop].split()) <= 80


def test_split_rows(spark):
    long = "word " * 300
    df = spark.createDataFrame([("a", long, 1), ("a", long, 1), (None, "x" * 2001, 2), ("c", None, 3), ("d", "", 4), ("e", "short", 5)], "k string, body string, text int")
    rows = splitting.split_oversized(df, ["k"], "body").collect()
    assert {r.k for r in rows} == {"a", None} and sum(r.k == "a" for r in rows) == 4
    assert [r.n_chars if False else len(r.text) for r in rows if r.k is None] == [2000, 1]
    assert splitting.split_oversized(df.limit(0), ["k"], "body").count() == 0
    edge = spark.createDataFrame([("a" + chr(160)) * 250, ("a" + chr(160)) * 251, "é" * 2000, "é" * 2001], "string")
    assert [r[0] for r in edge.select(splitting.oversized(edge.value, Budget())).collect()] == [False, True, False, True]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(1, 6))
def test_pack_holds_all_limits(sizes, segments):
    tokens = np.array(sizes, np.int64)
    limits = packing.Limits(tokens=50, segments=segments, loss=45)
    bins = packing.pack(tokens, tokens - 1, limits)
    assert len(bins) == len(tokens) and (bins >= 0).all()
    for b in set(bins):
        at = bins == b
        if at.sum() > 1:
            assert tokens[at].sum() <= 50 and at.sum() <= segments and (tokens[at] - 1).sum() <= 45


def test_pack_leaves_little_room():
    tokens = np.minimum(4096, np.random.default_rng(0).lognormal(6.5, 1, 4000).astype(int) + 1)
    bins = packing.pack(tokens, tokens - 1, packing.Limits())
    assert tokens.sum() / (4096 * (bins.max() + 1)) > 0.99


def test_pack_documents(spark):
    texts = ["a" * 4095, "b" * 4096, "क" * 3000, "", None, "dup", "dup"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("shard", packing.F.lit("clash"))
    rows = packing.pack_documents(df, "doc_id", "text").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {0: 1, 1: 2, 2: 3, 3: 1, 5: 1, 6: 1}
    for k, parts in by.items():
        raw = texts[k].encode()
        parts.sort(key=lambda r: r.piece)
        assert b"".join(raw[p.byte_start : p.byte_end] for p in parts) == raw
        assert sum(p.n_tokens for p in parts) == len(raw) + 1
        for p in parts:
            raw[p.byte_start : p.byte_end].decode()
    fill = {}
    for r in rows:
        fill[r.shard, r.bin] = fill.get((r.shard, r.bin), 0) + r.n_tokens
    assert max(fill.values()) <= 4096
    assert packing.pack_documents(df.limit(0), "doc_id", "text").count() == 0


def _sections(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, sec_ord int, heading string, text string, site string, line string")


def test_repeated_lines(spark):
    rows = [(str(i), 1, "Share this", f"own {'abcdefghij'[i]}\n\nCopyright © {2000 + i} Site.", "s", "clash") for i in range(10)]
    rows += [("0", 1, "Share this", "own a\n\nCopyright © 2000 Site.", "s", "x")] * 2  # again
    rows += [("1", 0, "Made up", None, "s", None), ("2", 0, "Made up", "", "s", None), ("3", 0, "Made up", "-", "s", None), ("4", 0, "Made up", "x", "s", None)]
    rows += [(str(i), 1, None, "COPYRIGHT 1 site", None, None) for i in range(20, 24)] + [(None, 1, "Share this", "q", "s", None)]
    df = _sections(spark, rows)
    got = {(r.doc_id, r.sec_ord, r.ln) for r in repeated.repeated_lines(df).collect()}
    want = {(str(i), 1, ln) for i in range(10) for ln in (-1, 2)} | {(str(i), 1, 0) for i in range(20, 24)}
    assert got == want
    clean = {(r.doc_id, r.sec_ord): (r.clean_heading, r.clean_text) for r in repeated.without_repeated(df).collect()}
    assert clean["3", 1] == (None, "own d\n") and clean["1", 0] == ("Made up", None)
    assert repeated.without_repeated(df).count() == df.count()
    assert repeated.repeated_lines(df.limit(0)).count() == 0


def test_templates_sent_and_joined_are_the_same(spark):
    rows = [(str(i), 1, "Share this", f"own {'abcdefghij'[i % 10]}{i}\nCopyright © {2000 + i} Site.\nE-mail us\ne mail  us", f"s{i % 3}", "") for i in range(30)] + [(str(i), 2, None, "Terms apply", None, "") for i in range(40, 44)]
    df = _sections(spark, rows)
    key = lambda r: (r.site or "", r.doc_id, r.sec_ord, r.ln, r.template, r.n_docs, r.site_docs)
    sent = sorted(map(key, repeated.repeated_lines(df).collect()))
    assert sent == sorted(map(key, repeated.repeated_lines(df, repeated.Cover(broadcast_templates=0)).collect()))
    assert {r[4] for r in sent} == {"sharethis", "copyright0site", "emailus", "termsapply"} and len(sent) == 30 * 4 + 4


def test_trees_merge_like_one_tree():
    lines = [("s", f"line {'abcdefg'[i % 7]} of {'xyz'[i % 3]}", str(i)) for i in range(100)] + [("t", "", "1")]

    def grow(part, alike):
        tree = repeated.Tree(alike)
        for s, x, d in part:
            if x := repeated.tokens(x):
                tree.add(s, x, d)
        return tree

    for alike, want in ((1.0, 21), (0.5, 1)):
        one, many = grow(lines, alike), repeated.Tree(alike)
        for k in range(3):
            for s, t, n in grow(lines[k::3], alike).templates():
                many.add(s, t, None, n)
        assert {t: n for _, t, n in one.templates()} == {t: n for _, t, n in many.templates()}
        assert len(list(one.templates())) == want and sum(n for *_, n in one.templates()) == 100
    assert [t for _, t, _ in grow(lines, 0.5).templates()] == ["line * of *"]


def test_only_a_learnt_slot_finds_a_line_that_names_somebody(spark):
    """No two of these lines are the same, so no line is repeated; the template is, and its documents are counted exactly."""
    names = ["asha", "ravi", "meena", "john", "lata", "omar", "kiran", "tara", "dev", "nila"]
    rows = [(str(i), 1, None, f"Share it with {n.title()} today\nA fact of {n} that no other document has {n}\nplain {n}", "s", "") for i, n in enumerate(names)]
    rows += [(str(i), 2, None, f"Share it with {n.title()} today", "s", "") for i, n in enumerate(names[:3])] + [(str(i), 1, None, "nothing", "s", "") for i in range(20, 25)]
    df = _sections(spark, rows).repartition(4)
    assert {r.template for r in repeated.repeated_templates(df).collect()} == {"nothing"}
    got = {r.template: (r.n_docs, r.site_docs, r.n_variants) for r in repeated.repeated_templates(df, repeated.Cover(alike=0.6)).collect()}
    assert got["shareitwith*today"] == (10, 15, 10) and "plain*" not in got
    hits = {(r.doc_id, r.sec_ord, r.ln) for r in repeated.repeated_lines(df, repeated.Cover(alike=0.6)).where("template = 'shareitwith*today'").collect()}
    assert hits == {(str(i), 1, 0) for i in range(10)} | {(str(i), 2, 0) for i in range(3)}


def test_examples_are_packed_under_three_limits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "q" * int(rng.integers(0, 60)), "a" * int(rng.integers(1, 40))) for i in range(400)] + [(900, "q" * 300, "a" * 100), (901, None, "abc"), (902, "q", None), (903, "q", "")]
    df = spark.createDataFrame(rows, "k int, ask string, said string")
    limits = packing.Limits(tokens=100, segments=3, loss=40)
    out = packing.pack_examples(df, "k", "ask", "said", limits, shard_items=150).collect()
    by, of = {}, {}
    for r in out:
        by.setdefault((r.shard, r.bin), []).append(r)
        of.setdefault(r.doc_id, []).append(r)
    assert all(sum(r.n_tokens for r in b) <= 100 and len(b) <= 3 and sum(r.n_loss for r in b) <= 40 for b in by.values())
    want = {k: (len(q or ""), len(a) + 1) for k, q, a in rows if a is not None}
    assert {k: (sum(r.n_tokens - r.n_loss for r in v), sum(r.n_loss for r in v)) for k, v in of.items()} == want
    assert all(len(v) == 1 or sum(want[k]) > 100 or want[k][1] > 40 for k, v in of.items()) and len(of[900]) > 3
    assert any(len(b) == 3 for b in by.values()) and any(sum(r.n_loss for r in b) > 36 for b in by.values())
    assert packing.pack_examples(df.limit(0), "k", "ask", "said").count() == 0
