"""Main bodies of pages, and subjects of documents."""

import os
import random

import pytest

from ledgerloom.llm import boilerplate, subjects

PAGE = """<html><head><title>{name} Fund</title><script>var x = "<p data-b='9'>";</script></head><body>
<nav><a data-b="1" href="/">Home</a>
<a data-b="2">All {n} tools</a></nav>
<main class="x">
<h1 data-b="3">{name} Fund</h1>
<p data-b="4">By Ann {name} | 3 Mar 2024
<table><tr data-b="5"><td>{name} <b>price</b></td><td>&#8377;{n}.5</td></tr></table>
<h2 data-b="6">Costs</h2>
<p data-b="7">The {name} house asks {n} of each holder in {town}.
<span data-b="8">Tweet <span>this</span></span>
<div data-b="9">Related: {other} Fund</div>
<div class="foot">
<li data-b="10">Related: {town} Fund</li>
<p data-b="11">© {n} Site One. All rights kept.</p></div></body></html>"""


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    names = ["".join(rng.choices("abcdefghij", k=7)).capitalize() for _ in range(120)]
    pages = [(str(i), PAGE.format(name=n, n=i, town=names[-i - 1], other=names[-i - 2 if i < 118 else 3]), "extra") for i, n in enumerate(names)]
    consent = "<html><title>X Fund</title><body><nav><a data-b='1'>Home</a></nav><main><h1 data-b='2'>One moment</h1><span data-b='3'>Tweet this</span></main></body></html>"
    pages += [pages[0], ("900", consent, ""), ("901", None, ""), (None, consent, ""), ("902", "", ""), ("903", "<p data-b=1>no heading", "")]
    sources = [(str(i), f"https://site-one.example/f/{n.lower()}", "site-one.example") for i, n in enumerate(names)] + [("900", None, None), ("900", "u", "site-one.example")]
    sections = [("7", 1, f"Tweet this\n\nThe {names[7]} house asks 7 of each holder in {names[-8]}.\nNever seen before.", "site-one.example"), ("7", 2, None, None), ("none", 0, "© 5 Site One. All rights kept.\nA new fact of the fund", "site-one.example")]
    return spark.createDataFrame(pages, "doc_id string, html string, pos string"), spark.createDataFrame(sources, "doc_id string, url string, site string"), spark.createDataFrame(sections, "doc_id string, sec_ord int, text string, site string")


def test_main_bodies(spark, tables):
    pages, sources, sections = tables
    bodies = boilerplate.main_bodies(pages, sources)
    got = {}
    for r in bodies.blocks.collect():
        got.setdefault(r.doc_id, set()).add(r.pos)
    assert set(got) == {str(i) for i in range(120)}
    assert all(v == {3, 5, 6, 7} for v in got.values())
    lines = {(r.doc_id, r.sec_ord, r.ln) for r in boilerplate.main_lines(sections, bodies).collect()}
    assert lines == {("7", 1, 2), ("7", 1, 3), ("none", 0, 1)}


def test_lines_are_shared_within_a_host(spark):
    """What is furniture on one host is a fact on another, whose pages share it too seldom; a host of three pages has enough."""
    page = "<html><title>{t}</title><body><nav><a data-b='1'>{n}</a></nav><main><h1 data-b='2'>{t}</h1><p data-b='3'>{a}<p data-b='4'>{b}</main></body></html>"
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    pages, sources = [], []
    for site, n in (("one.example", 60), ("two.example", 60), ("small.example", 3)):
        for i in range(n):
            doc = str(len(pages))
            line = "Minimum age applies" if site == "one.example" or i == 30 else word()
            pages.append((doc, page.format(t=word().title(), n="Home" if i % 2 else "Start", a=line, b=f"{word()} {word()}")))
            sources.append((doc, f"https://{site}/f/{i:03d}", site))
    bodies = boilerplate.main_bodies(spark.createDataFrame(pages, "doc_id string, html string"), spark.createDataFrame(sources, "doc_id string, url string, site string"))
    got = {}
    for r in bodies.blocks.collect():
        got.setdefault(int(r.doc_id), set()).add(r.pos)
    assert all(got[i] == {2, 4} for i in range(60)) and all(got[i] == {2, 3, 4} for i in range(60, 120)) and all(got[i] >= {2, 3, 4} for i in range(120, 123))
    lines = {(r.site, r.line) for r in bodies.lines.collect()}
    assert {x[0] for x in lines if x[1] == boilerplate.mark("minimumageapplies")} == {"one.example"}


def test_no_pages(spark, tables):
    pages, sources, sections = tables
    bodies = boilerplate.main_bodies(pages.limit(0), sources.limit(0))
    assert bodies.blocks.count() == 0
    assert boilerplate.main_lines(sections.limit(0), bodies).count() == 0


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = [a[i] for i in boilerplate.common(a, b)]
        it = iter(b)
        assert len(got) == table[-1][-1] and all(x in it for x in got)


def test_blocks_of_broken_pages():
    assert boilerplate.blocks("") == [] and boilerplate.blocks("<p data-b='1'>a<p data-b='2'>b")[1][3] == "b"
    assert boilerplate.blocks("<h2 data-b=1>T</h2><tr data-b=2><td>a<td>b</tr><p data-b=3>x &amp; <i>y</i>")[1:] == [(2, boilerplate.INSIDE | boilerplate.BELOW, 0, "a | b"), (3, boilerplate.INSIDE, 0, "x & y")]


WORDS = {"tax": "gains assessed cess filing deducted", "sport": "race league players match runners", "risk": "volatility drawdown stress duration beta"}


def _text(rng, kinds, n):
    out = []
    for i in range(n):
        k = kinds[i % len(kinds)]
        words = rng.sample(WORDS[k].split(), 3) if k else ["figures", "rounded"]
        out.append(f"The {' '.join(words)} of {rng.choice(['Abc', 'Def', 'Ghi'])} is noted {rng.randrange(99)}.{rng.choice(['', '5'])}")
    return ". ".join(out) + "."


def test_subjects(spark):
    rng = random.Random(9)
    kinds = [(a,) for a in WORDS] * 40 + [("tax", "sport"), ("risk", "tax")] * 30 + [("sport", None)] * 20
    docs = [(i, _text(rng, k, 8), "x") for i, k in enumerate(kinds)] + [(9000, None, ""), (9001, "", ""), (9002, "...", ""), (9003, _text(rng, ("tax",), 3000), "")]
    labels = [(i, k[0], "a") for i, k in enumerate(kinds) if i % 2 == 0] + [(1, "sport", "b"), (3, None, "b"), (None, "tax", "b"), (0, "tax", "a"), (77777, "tax", "a"), (5, "other", "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    sub = spark.createDataFrame([(s, w) for s, w in WORDS.items()] + [(None, "x")], "subject string, description string")
    model = subjects.train(d, lab, sub)
    got = {}
    for r in subjects.subjects_of(d, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert set(got) == {*range(len(kinds)), 9002, 9003} and got[9003] == {"tax"}
    right = sum(got[i] == {x for x in k if x} for i, k in enumerate(kinds))
    assert right / len(kinds) > 0.9
    mixed = subjects.mixtures(d, model).groupBy("doc_id", "n_sentences").agg({"n_about": "sum"}).collect()
    assert all(r["n_sentences"] == r["sum(n_about)"] for r in mixed)
    assert subjects.subjects_of(d.limit(0), model).count() == 0
    bare = subjects.train(d, lab.limit(0), sub)  # descriptions alone
    assert subjects.subjects_of(d.where("doc_id = 0"), bare).count() >= 1
    nothing = subjects.train(d, lab, sub.limit(0))
    assert subjects.subjects_of(d, nothing).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_queries_run(spark):
    from ledgerloom.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    for name in ("p1_found", "p3_found", "p5_clean", "p6_bins", "p7_leaks", "p8_composition"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_unknown_texts_get_no_invented_subject(spark):
    labelled = [(f"{w} rises. The {w} of it is {w}.", [subject]) for w, subject in (("goal", "sport"), ("match", "sport"), ("court", "law"), ("judge", "law"), ("statute", "law"), ("bond", "debt")) for _ in range(20)]
    model = subjects.fit(labelled, [("debt", "bond coupon"), ("law", "court judge"), ("sport", "match goal")])
    docs = [(1, "qqq www eee."), (2, "これは文です。"), (3, "The goal. A match is on. Goal again."), (4, "..."), (5, ""), (6, None), (7, "A bond. A bond.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.subject, r.known) for r in subjects.subjects_of(df, model).collect()}
    assert got == {1: ("law", False), 2: ("law", False), 3: ("sport", True), 4: ("law", False), 7: ("debt", True)}
    assert model.nearest(["goal and match"]) == model.subjects.index("sport") and model.nearest(["qqq"]) == -1
    assert all(t in model.vocabulary for row in model.discriminative for t in row)
