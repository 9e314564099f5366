"""The retrieval core on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions import rules, text
from ledgerloom.operators import answer, chunk, embed, evaluate, extract, lexical, memory, report, retrieve, sections, store
from ledgerloom.sources import registry


def col(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


PII = [("my pan is ABCDE1234F", "PAN"), ("2345 6789 0123", "AADHAAR"), ("234567890123", "AADHAAR"), ("account number is 601234567", "ACCOUNT"), ("otp is 482913", "OTP"), ("cvv 123", "CVV"), ("mail a.b@c.org", "EMAIL"), ("call +91 98765 43210", "PHONE"), ("abcde1234f", None), ("AUM is 1,08,324.55 Cr", None), ("18 months holding period", None), (None, None), ("", None)]


def test_pii(spark):
    assert col(spark, [t for t, _ in PII], rules.pii) == [r for _, r in PII]


SCREEN = [
    ("What is the expense ratio of the flexi cap fund?", "answered", None), ("Should I buy ELSS?", "refused_advice", "advice:SHOULD_I"), ("should i use pan ABCDE1234F", "refused_pii", "pii:PAN"),
    ("hi", "off_topic", "off_topic:GREETING"), ("how do i file my taxes", "off_topic", "off_topic:SENSITIVE"), ("tell me a joke", "off_topic", "off_topic:no_hint"), ("should i take a loan", "refused_advice", "advice:SHOULD_I"), (None, "off_topic", None), ("  ", "off_topic", None),
]


def test_screen(spark):
    got = col(spark, [q for q, *_ in SCREEN], rules.screen)
    assert [(d.status, d.rule) for d in got] == [(s, r) for _, s, r in SCREEN]
    assert got[1].link_scheme == "elss" and "ABCDE" not in got[2].message


def test_targets(spark):
    assert col(spark, ["HDFC Mutual Fund", "mid-cap of the fund house", "large-cap", None], rules.target) == ["amc", "scheme:mid_cap", "", ""]


def test_text(spark):
    assert col(spark, ["within 1, then 5. 2,214.57", "10 and 10", None], text.numbers) == [["1", "5", "2214.57"], ["10"], None]
    assert col(spark, ["0.77% and NAV is Rs 2,214.57 today.", "One. Two! 3? x", ""], text.sentences) == [["0.77% and NAV is Rs 2,214.57 today."], ["One.", "Two!", "3? x"], []]
    assert col(spark, ["A is 1%. See", "x. Refer to source:", "plain", "See source.", "a ,;", ""], text.tidy_tail) == ["A is 1%.", "x.", "plain.", "", "a.", ""]
    assert col(spark, ["0.77%【1】.", "₹100 [1].. x...", None], text.strip_references) == ["0.77%.", "₹100. x..", None]
    assert col(spark, ["a  https://x.y/z b www.q.r"], text.strip_urls) == ["a b"]
    assert col(spark, ["The fees OF a Fund x fees", None], text.tokens) == [["fees", "fund", "fees"], None]
    assert col(spark, ["A. B.  C. D."], lambda c: text.cap_sentences(c, 3)) == ["A. B. C."] and col(spark, ["A.  B."], lambda c: text.cap_sentences(c, 3)) == ["A.  B."]


def test_output_check(spark):
    got = col(spark, ["You should buy it.", "It is 1%. See https://a.b", "https://a.b", ""], lambda c: answer.check_output(c, 3))
    assert [(r.rule, r.text) for r in got] == [("drift:ADVICE", ""), (None, "It is 1%."), ("drift:EMPTY", ""), ("drift:EMPTY", "")]


def test_finalise(spark):
    chunks = [("s", "sec", "u1", "T1", "The load is 0.77% here."), ("s", "sec", "u2", "T2", "It is 5% of 100.")]
    rows = [("a", "It is 0.77% [2]."), ("b", "It is 0.63% [1]."), ("c", "I don't have that information in my source pages."), ("d", "It is 5%. [9]")]
    df = spark.createDataFrame([(q, d, chunks) for q, d in rows] + [("e", "It is.", [])], "qid string, draft string, chunks array<struct<scheme:string,section:string,url:string,title:string,text:string>>")
    got = {r.qid: r for r in answer.finalise(df).collect()}
    assert (got["a"].status, got["a"].link_url, got["a"].answer) == ("answered", "u2", "It is 0.77%.\n\nLast updated from sources: T2\nu2")
    assert got["b"].status == got["c"].status == got["e"].status == "not_in_corpus" and got["d"].link_url == "u1"
    loose = {r.qid: r.status for r in answer.finalise(df, EngineConfig(grounding=False)).collect()}
    assert loose["b"] == "answered"


HTML = """<html><body><nav><h4>My Fund</h4><p>menu</p></nav><main><header><h1>My Fund:</h1></header><p>NAV 5</p><table><tr><td>a</td><td> b </td></tr></table>
<h2>Return calculator</h2><p>gone</p><h2>Costs</h2><!-- hidden --><p>fee <b>1%</p><p>View all</p><p>Also manages these schemes</p><p>cut</p><table><tr><th>x</th><td></td><td>y</td></tr></table>
<div class="footer_abc"><h3>Foot</h3>foot</div><h1>My Fund</h1></main></body></html>"""


def test_extract_and_filter(spark):
    pages = spark.createDataFrame([("1", HTML, 0), ("2", "<p>no title</p>", 0), ("3", None, 0), ("4", "", 0)], "doc_id string, html string, title int")
    rows = sections.finalise(extract.extract(pages)).orderBy("sec_ord").collect()
    assert [(r.heading, r.kept, r.text, r.tables) for r in rows] == [("Key facts", True, "NAV 5\na | b\na\nb", []), ("Return calculator", False, "", []), ("Costs", True, "fee\n1%", ["x | y"]), ("My Fund", False, "", [])]
    assert rows[0].title == "My Fund" and rows[1].reason == "dropped section: 'Return calculator'"


def test_clean_text_round_trip(spark):
    rows = [("1", "T", 0, 1, "Key facts", "a\n# b", True, ["r | s"]), ("1", "T", 1, 2, "Costs", "c", True, []), ("1", "T", 2, 2, "Gone", "x", False, [])]
    df = spark.createDataFrame(rows, "doc_id string, title string, sec_ord int, level int, heading string, text string, kept boolean, tables array<string>")
    texts = sections.render(df)
    assert texts.first().text == "# T\n## Key facts\na\n # b\nr | s\n### Costs\nc\n"
    back = sections.parse_clean(texts).orderBy("sec_ord").collect()
    assert [(r.title, r.level, r.heading, r.text) for r in back] == [("T", 1, "Key facts", "a\n# b\nr | s"), ("T", 2, "Costs", "c")]
    assert sections.render(df.limit(0)).count() == 0 and sections.parse_clean(texts.limit(0)).count() == 0


def _merge(parts, title, least):
    """Plain loop over (heading, body)."""
    out, run = [], []
    for i, (h, b) in enumerate(parts):
        run.append((h, b))
        lines, last = [], None
        for x, y in run:
            if x and x != last:
                lines.append(x)
                last = x
            lines.append(y)
        if len(f"{title} {' '.join(lines)}".split()) >= least or i == len(parts) - 1:
            out.append(("\n".join(lines), len(run) - 1))
            run = []
    return out


def test_chunks(spark):
    rng = np.random.default_rng(1)
    config = EngineConfig(chunk_size=30, chunk_overlap=10, min_size=20)
    rows, want = [], []
    for d in range(1, 6):
        parts = []
        for s in range(8):
            words = [f"w{i}" for i in range(int(rng.integers(0, 50)))]
            heading = ["", "One", "Two", "One"][int(rng.integers(4))]
            rows.append((str(d), s, heading, " ".join(words), True, []))
            k = 0
            while words and (k == 0 or (k - 1) * 20 + 30 < len(words)):
                parts.append((heading, " ".join(words[k * 20 : k * 20 + 30])))
                k += 1
        want += [(str(d), *x) for x in _merge(parts, f"Title {d}", 20)]
    secs = spark.createDataFrame(rows, "doc_id string, sec_ord int, heading string, text string, kept boolean, tables array<string>")
    src = spark.createDataFrame([(str(d), "s", f"Title {d}", "u") for d in range(1, 6)], "doc_id string, scheme string, title string, url string")
    got = chunk.chunk_all(secs, src, config).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.body, r.n_merged) for r in got] == want
    assert [r.chunk_index for r in got] == list(range(len(want)))
    assert chunk.chunk_all(secs.limit(0), src, config).count() == 0
    with pytest.raises(ValueError):
        EngineConfig(chunk_size=5, chunk_overlap=5)


def test_bm25(spark):
    docs = [(1, "load load fees"), (2, "fees of risk"), (3, None), (4, "")]
    df = spark.createDataFrame(docs, "k int, t string")
    q = spark.createDataFrame([("a", "load load"), ("b", "unknown"), ("c", None)], "qid string, q string")
    got = lexical.bm25_top(df, "k", "t", q, "qid", "q", 5).collect()
    idf, sat = math.log(1 + (4 - 1 + 0.5) / 1.5), 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.25))
    assert [(r.qid, r.key, r.score) for r in got] == [("a", 1, round(2 * idf * sat, 6))]


def test_dense(spark):
    rows = [(i, str(i % 2), [float(x) for x in v]) for i, v in enumerate([[1, 0], [1, 0], [0, 2], [-1, 0], [0, 0]])] + [(9, "0", None), (10, "0", [1.0]), (11, "0", [float("nan"), 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_index int, doc_id string, embedding array<float>")
    q = spark.createDataFrame([("a", None, [1.0, 0.0]), ("b", "1", [1.0, 0.0]), ("c", None, None), ("d", None, [0.0, 0.0])], "qid string, doc_id string, embedding array<float>")
    got = retrieve.dense_top(chunks, q, 3).orderBy("qid", "dense_rank").collect()
    assert [(r.qid, r.key, r.dense_score) for r in got] == [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 0.0), ("b", 1, 1.0), ("b", 3, -1.0)]
    assert retrieve.dense_top(chunks, q, 0).count() == 0 and retrieve.dense_top(chunks.limit(0), q, 3).count() == 0
    bad = {r.chunk_index: r.problem for r in embed.bad_vectors(chunks, "chunk_index", "embedding", EngineConfig(embed_dim=2)).collect()}
    assert bad == {2: "not unit", 4: "not unit", 9: "null", 10: "length", 11: "not finite"}


def test_answer_end_to_end(spark):
    model = embed.HashedEmbedder()
    texts = [("1", "amc_overview", "House", "The fund house is in Pune and keeps 30 people."), ("2", "elss", "ELSS", "The exit load of the elss fund is 5% of units. It is paid once."), ("3", "mid_cap", "Mid", "The exit load of the mid cap fund is 7% of units. It is paid.")]
    chunks = spark.createDataFrame([(i, d, s, t, "sec", f"u{d}", x) for i, (d, s, t, x) in enumerate(texts)], "chunk_index int, doc_id string, scheme string, title string, section string, url string, text string")
    chunks = embed.embed(chunks, "text", model)
    src = spark.createDataFrame([(d, s, t, f"u{d}") for d, s, t, _ in texts], "doc_id string, scheme string, title string, url string")
    history = "array<struct<role:string,content:string>>"
    asked = [("a", "What is the exit load of the mid cap fund?", []), ("b", "Should I buy?", []), ("c", "and the exit load?", [("user", "tell me of elss")]), ("d", None, []), ("e", "what is zzz qqq?", [])]
    q = spark.createDataFrame(asked, f"qid string, question string, history {history}")

    def rewriter(messages):
        assert "tell me of elss" in messages[1]["content"]
        return '"What is the exit load of the elss fund?"'

    got = {r.qid: r for r in answer.answer(q, chunks, src, lambda df, c: embed.embed(df, c, model), rewriter=rewriter).collect()}
    assert got["a"].status == "answered" and got["a"].link_url == "u3" and "7%" in got["a"].message and got["a"].narrowed_by == "scheme:mid_cap"
    assert got["b"].status == "refused_advice" and got["b"].link_url == "u1" and got["b"].n_chunks == 0
    assert got["c"].link_url == "u2" and got["c"].rewritten == "What is the exit load of the elss fund?"
    assert got["d"].status == "off_topic" and got["d"].link_url is None
    assert got["e"].status == "not_in_corpus" and got["e"].link_url == "u1" and got["e"].rewritten == ""


def _asked(spark):
    model = embed.HashedEmbedder()
    texts = [("1", "amc_overview", "The fund house is in Pune and keeps 30 people."), ("2", "elss", "The exit load of the elss fund is 5% of units."), ("3", "mid_cap", "The exit load of the mid cap fund is 7%.")]
    chunks = embed.embed(spark.createDataFrame([(i, d, s, "T", "sec", f"u{d}", x) for i, (d, s, x) in enumerate(texts)], "chunk_index int, doc_id string, scheme string, title string, section string, url string, text string"), "text", model)
    src = spark.createDataFrame([(d, s, "T", f"u{d}") for d, s, _ in texts], "doc_id string, scheme string, title string, url string")
    q = [("a", "What is the exit load of the elss fund?", []), ("b", "and its exit load?", [("user", "the mid cap fund")])]
    return q, lambda generator, rewriter=None: {
        r.qid: r for r in answer.answer(spark.createDataFrame(q, "qid string, question string, history array<struct<role:string,content:string>>"), chunks, src, lambda df, c: embed.embed(df, c, model), generator=generator, rewriter=rewriter).collect()
    }


def test_links_of_refusals(spark):
    _, run = _asked(spark)
    unknown = run(lambda m: "I don't have that information in my source pages.", lambda m: "What is the exit load of the mid cap fund?")
    assert {(r.status, r.link_url, r.rewritten) for r in unknown.values()} == {("not_in_corpus", "u2", ""), ("not_in_corpus", "u3", "")}
    drift = run(lambda m: "You should buy it.")
    assert {(r.status, r.rule, r.link_url) for r in drift.values()} == {("output_drift", "drift:ADVICE", "u1")}
    ungrounded = run(lambda m: "It is 9.5% [1].")
    assert ungrounded["a"].status == "not_in_corpus" and ungrounded["a"].link_url == "u2" and ungrounded["a"].n_chunks > 0


def test_a_model_that_fails_says_so(spark):
    def no_key(_):
        raise memory.NoKey

    def broken(_):
        error = ValueError("bad request")
        error.status_code = 400
        raise error

    _, run = _asked(spark)
    assert {r.status for r in run(no_key).values()} == {"no_key"}
    got = run(broken)
    assert {r.status for r in got.values()} == {"generation_error"} and all(r.n_chunks for r in got.values())


def test_bounded_model():
    class Busy(Exception):
        status_code = 429

    class Bad(Exception):
        status_code = 400

    def scripted(*steps):
        todo = list(steps)

        def model(_):
            step = todo.pop(0)
            if isinstance(step, BaseException):
                raise step
            return step

        return model, todo

    waits = []
    model, _ = scripted(Busy(), "  ", " done ")
    assert memory.bounded(model, wait=waits.append)([]) == "done" and waits == [1.5, 3.0]
    for steps, left in (((OSError(), "", None, "late"), 1), ((Bad(), "late"), 1), ((memory.NoKey(), "late"), 1)):
        model, todo = scripted(*steps)
        with pytest.raises(memory.ModelError):
            memory.bounded(model, wait=waits.append)([])
        assert len(todo) == left


def test_memory(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}", "answered") for i in range(20)] + [(2, 0, "user", "pan ABCDE1234F", None), (2, 1, "assistant", "no", "refused_pii"), (2, 2, "assistant", "x", "no_key"), (2, 3, "user", "next", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, content string, status string")
    rows = {(r.conv_id, r.turn): [m.content for m in r.history] for r in memory.history(df, 10).collect()}
    assert rows[1, 19] == [f"m{i}" for i in range(9, 19)] and rows[2, 3] == ["no"]
    cases = [("q", '"Better q"\n', "Better q"), ("q", "", "q"), ("q", "Q", "q"), ("q", None, "q"), ("q", "‘x\ny’", "x y")]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, q string, r string, want string")
    assert all(r.got == r.want for r in d.select("want", memory.tidy_reply(F.col("q"), F.col("r")).alias("got")).collect())

    def broken(_):
        raise OSError

    asked = spark.createDataFrame([("and fees?", [("user", "x")]), ("what of elss", [("user", "x")])], "question string, history array<struct<role:string,content:string>>")
    assert [r.rewritten for r in memory.rewrite(asked, broken).collect()] == ["and fees?", "what of elss"]


def test_registry_store_and_report(spark, tmp_path):
    src = spark.createDataFrame([("2", "s", "T2", "HTTP://A.Example/X/", True), ("10", None, None, None, False)], "doc_id string, scheme string, title string, url string, allowed boolean")
    assert [r[0] for r in src.select(registry.normal_url(F.col("url"))).collect()] == ["https://a.example/X", None]
    registry.write_csv(src, str(tmp_path / "csv"))
    assert registry.read_csv(spark, str(tmp_path / "csv")).count() == 2
    (tmp_path / "7_s.html").write_text("<h1>x</h1>\n<p>y")
    assert [tuple(r) for r in registry.read_pages(spark, str(tmp_path / "7_s.html")).collect()] == [("7", "<h1>x</h1>\n<p>y")]
    chunks = spark.createDataFrame([(0, "1", "s", "sec", "u", "a b c", [1.0, 0.0]), (1, "1", "s", "sec", "u", "d", [0.0, 1.0])], "chunk_index int, doc_id string, scheme string, section string, url string, text string, embedding array<float>")
    name = store.content_hash(chunks, EngineConfig())
    assert name == store.content_hash(chunks.orderBy(F.desc("chunk_index")), EngineConfig()) != store.content_hash(chunks, EngineConfig(chunk_size=99))
    root = str(tmp_path / "index")
    assert store.build(chunks, root, name, "2025-01-01").count() == 2
    assert store.build(chunks.limit(1), root, name, "2025-01-02").count() == 2  # it is there
    assert store.orphans(spark, root, []) == [f"index_{name}"] and store.prune(spark, root, [name]) == []
    assert store.prune(spark, root, []) == [f"index_{name}"]
    with pytest.raises(RuntimeError):
        store.open_index(spark, root, name)
    assert report.sizes(chunks).first().asDict() == {"chunks": 2, "smallest": 1, "mean": 2, "largest": 3, "undersized": 2, "over_budget": 0}
    assert report.preview(chunks).count() == 2


def test_metrics(spark):
    hits = spark.createDataFrame([("1", 1, 0), ("1", 2, 1), ("2", 1, 1)], "qid string, pos int, chunk_index int")
    chunks = spark.createDataFrame([(0, "a", "x 1,000"), (1, "b", "y")], "chunk_index int, doc_id string, text string")
    labels = spark.createDataFrame([(1, "b", "X  1000"), (2, "b", None), (3, "a", "q")], "id int, doc_id string, grounding string")
    assert evaluate.metrics(evaluate.retrieval_hits(hits, chunks, labels)).first().asDict() == {"questions": 3, "recalled": 2, "first": 1, "grounded": 1, "with_grounding": 2}
    msg = spark.createDataFrame([("a b", ["b"]), ("a", ["b"]), (None, ["b"])], "message string, secrets array<string>")
    assert [r.leaked for r in evaluate.leaks_secret(msg).collect()] == [True, False, False]


def test_stream_history(spark, tmp_path):
    from ledgerloom.streaming import history as stream

    schema = "conv_id long, turn long, role string, content string, status string"
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}", "answered") for i in range(6)] + [(2, 0, "user", "my pan is ABCDE1234F", None), (2, 1, "assistant", "no", "refused_pii"), (2, 2, "user", "next", None)]
    spark.createDataFrame(turns, schema).coalesce(1).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    run = stream.stream_history(source, 2).writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert {(r.conv_id, r.turn, tuple(m.content for m in r.history)) for r in spark.table("turns").collect()} == {(1, 0, ()), (1, 2, ("m0", "m1")), (1, 4, ("m2", "m3")), (2, 0, ()), (2, 2, ("no",))}


def test_registered_queries():
    import __spark_entry__ as entry
    from ledgerloom.plans import registry as plans

    assert set(plans.oracle_sql()) <= set(plans.queries()) and set(plans.queries()) <= set(entry.queries())
