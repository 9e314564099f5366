"""Quality metrics over labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rules
from ledgerloom.functions.text import grounded, normal, sentences


def retrieval_hits(hits: DataFrame, chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, recalled, first, grounded) of each labelled question: its document among its hits, first, its fact in their texts.

    ``hits`` has qid, pos and chunk_index; ``labels`` id, doc_id and grounding.  Without a grounding the last is null;
    without hits all are false.
    """
    got = hits.join(chunks.select("chunk_index", "doc_id", "text"), "chunk_index").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "text"))).alias("h"))
    rows = labels.select(F.col("id"), F.col("id").cast("string").alias("qid"), F.col("doc_id").alias("want"), "grounding").join(got, "qid", "left")
    none = F.lit(False)
    texts = F.array_join(F.transform("h", lambda x: x["text"]), " ")
    return rows.select(
        "id",
        F.coalesce(F.exists("h", lambda x: x["doc_id"] == F.col("want")), none).alias("recalled"),
        F.coalesce(F.element_at("h", 1)["doc_id"] == F.col("want"), none).alias("first"),
        F.when(F.col("grounding").isNotNull(), F.coalesce(F.contains(normal(texts), normal(F.col("grounding"))), none)).alias("grounded"),
    )


def metrics(hits: DataFrame) -> DataFrame:
    """One row: questions, recalled, first, grounded and how many have a grounding."""
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0))
    return hits.agg(F.count(F.lit(1)).alias("questions"), count("recalled").alias("recalled"), count("first").alias("first"), count("grounded").alias("grounded"), F.count("grounded").alias("with_grounding"))


def deterministic(runs: DataFrame) -> DataFrame:
    """(qid, same): True if all runs (run, qid, pos, chunk_index) of a question gave one sequence of chunks."""
    ids = runs.groupBy("run", "qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_index"))), lambda x: x["chunk_index"].cast("string")), ",").alias("ids"))
    return ids.groupBy("qid").agg((F.count_distinct("ids") == 1).alias("same"))


def answer_checks(answers: DataFrame, allowed: DataFrame, most: int = 3) -> DataFrame:
    """(qid, one_url, allowed, short): of each answered message: one address, an approved one, and few enough sentences before the footer."""
    urls = F.regexp_extract_all("message", F.lit(r"(https?://\S+)"), 1)
    body = F.element_at(F.split("message", r"\n\nLast updated"), 1)
    rows = answers.where("status = 'answered'").select("qid", (F.size(urls) == 1).alias("one_url"), urls[0].alias("url"), (F.size(sentences(body)) <= most).alias("short"))
    good = allowed.where("allowed").select("url").distinct().withColumn("ok", F.lit(True))
    return rows.join(good, "url", "left").select("qid", "one_url", F.coalesce("ok", F.lit(False)).alias("allowed"), "short")


def leaks_secret(messages: DataFrame) -> DataFrame:
    """``messages`` (message, secrets array) with ``leaked``: any secret stands in the message."""
    return messages.withColumn("leaked", F.coalesce(F.exists("secrets", lambda s: F.contains(F.col("message"), s)), F.lit(False)))


def pipeline_checks(answers: DataFrame, labels: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """(id, status, answered, one_url, right_page, short, grounded) of every labelled question.

    ``answers`` as ``answer`` gives them, ``labels`` id and doc_id.  What isn't answered fails the other checks; a question
    without a row has the status missing.  ``right_page``: the address is that of the label's source.
    """
    url = F.regexp_extract("message", r"(https?://\S+)", 1)
    body = F.element_at(F.split("message", "\n\nLast updated"), 1)
    said = answers.where("status = 'answered'").select(
        F.col("qid"), (F.size(F.regexp_extract_all("message", F.lit(r"(https?://\S+)"), 1)) == 1).alias("one"), url.alias("said_url"), (F.size(sentences(body)) <= most).alias("short"), grounded(body, F.transform("chunks", lambda c: c["text"])).alias("grounded")
    )
    approved = sources.where("allowed").select(F.col("url").alias("said_url"), F.lit(True).alias("approved")).distinct()
    want = sources.groupBy("doc_id").agg(F.min("url").alias("want_url"))
    rows = labels.select("id", F.col("id").cast("string").alias("qid"), "doc_id").join(answers.select("qid", "status"), "qid", "left").join(said, "qid", "left").join(approved, "said_url", "left").join(want, "doc_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("id", F.coalesce("status", F.lit("missing")).alias("status"), yes(F.col("status") == "answered").alias("answered"), yes(F.col("one") & F.col("approved")).alias("one_url"), yes(F.col("said_url") == F.col("want_url")).alias("right_page"), yes(F.col("short")).alias("short"), yes(F.col("grounded")).alias("grounded"))


def refusals(questions: DataFrame, question: str = "question") -> DataFrame:
    """``questions`` with ``refused`` and ``leaked``: the screening lets none through, and its message has none of the ``secrets``, if there are any."""
    out = questions.withColumn("_d", rules.screen(F.col(question)))
    leaked = F.coalesce(F.exists("secrets", lambda s: F.contains(F.col("_d.message"), s)), F.lit(False)) if "secrets" in questions.columns else F.lit(False)
    return out.withColumns({"refused": ~F.col("_d.ok"), "leaked": leaked}).drop("_d")


def gate(hits: DataFrame, checks: DataFrame, same: DataFrame, refused: DataFrame, unanswerable: tuple[int, ...] = ()) -> DataFrame:
    """(metric, passed, total, ok) of an evaluation, S1 to S7 and the refusals; all must be ok.

    ``hits`` as ``retrieval_hits``, ``checks`` as ``pipeline_checks``, ``same`` as ``deterministic``, ``refused`` as ``refusals``.  Questions that
    the corpus can't answer count in none of the first, and must not be answered.  S4 to S7 are of the answered ones.
    """
    known = lambda df: df.where(~F.col("id").isin(*unanswerable)) if unanswerable else df

    def row(name: str, df: DataFrame, passed, total=None) -> DataFrame:
        total = F.count(F.lit(1)) if total is None else total
        return df.agg(F.coalesce(F.sum(passed.cast("long")), F.lit(0)).alias("passed"), total.cast("long").alias("total")).select(F.lit(name).alias("metric"), "passed", "total")

    answered = known(checks).where("answered")
    rows = [
        row("S1 recall at k", known(hits), F.col("recalled")),
        row("S2 first is right", known(hits), F.col("first")),
        row("facts in the hits", known(hits).where("grounded is not null"), F.col("grounded")),
        row("S3 same on repetition", same, F.col("same")),
        row("answered", known(checks), F.col("answered")),
        row("S4 one approved address", answered, F.col("one_url")),
        row("S5 right page", answered, F.col("right_page")),
        row("S6 short", answered, F.col("short")),
        row("S7 figures grounded", answered, F.col("grounded")),
        row("refused, nothing leaked", refused, F.col("refused") & ~F.col("leaked")),
    ]
    if unanswerable:
        rows.append(row("not answered from nothing", checks.where(F.col("id").isin(*unanswerable)), ~F.col("answered")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("ok", F.col("passed") == F.col("total"))
