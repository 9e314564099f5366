"""Answers to batches of questions: screening, retrieval, drafts, output checks, citations, grounding.

The status of a row is set once; stages after that see open rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions import rules
from ledgerloom.functions.text import ascii_citations, cap_sentences, citations, grounded, sentences, strip_references, strip_urls, tidy_tail
from ledgerloom.operators import lexical, memory, retrieve
from ledgerloom.storage import settle

# What stands before the title in the last line of an answer; where links go that have no scheme of their own.
FOOTER = "Last updated from sources:"
HOUSE = "amc_overview"
SYSTEM = (
    "Answer the question in at most {most} sentences from the numbered context alone and cite the context you use as [n]. "
    "Copy figures as they stand. No addresses, no advice, no opinion, nothing about returns. "
    "If the context does not have the fact, say: I don't have that information in my source pages."
)


def context_block(chunks: Column) -> Column:
    """The chunks (section, text), numbered from 1."""
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), i + 1, F.lit("] "), F.when(F.coalesce(c["section"], F.lit("")) == "", "General").otherwise(c["section"]), F.lit("\n"), c["text"], F.lit("\n"))), "\n")


def extractive(chunks: Column) -> Column:
    """A draft without a model: the first two sentences of the first chunk, citing it."""
    return F.concat(F.array_join(F.slice(sentences(chunks[0]["text"]), 1, 2), " "), F.lit(" [1]"))


def check_output(draft: Column, most: int) -> Column:
    """struct<rule, text>: a rule and no text if the draft drifts or is empty, else the draft without addresses, cut and tidied."""
    drift = rules.first_match(draft, rules.DRIFT)
    clean = tidy_tail(cap_sentences(strip_urls(draft), most))
    rule = F.when(drift.isNotNull(), F.concat(F.lit("drift:"), drift)).when(F.coalesce(clean, F.lit("")) == "", F.lit("drift:EMPTY"))
    return F.struct(rule.alias("rule"), F.when(rule.isNull(), clean).otherwise("").alias("text"))


def cited(draft: Column, chunks: Column) -> Column:
    """Position (from 1) of the chunk that the first valid reference names; 1 if none does; null without chunks."""
    valid = F.filter(citations(draft), lambda n: (n >= 1) & (n <= F.size(chunks)))
    return F.when(F.size(chunks) > 0, F.when(F.size(valid) > 0, valid[0]).otherwise(1))


def finalise(df: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``df`` (draft, chunks array<struct<scheme,section,url,title,text>>) with ``status``, ``rule``, ``answer``, and ``link_url`` of an answer
    or ``link_scheme`` of a refusal: the scheme that the ``question``, if there, names, else the house."""
    checked = df.withColumn("_out", check_output(F.col("draft"), config.max_sentences))
    body = strip_references(F.col("_out.text"))
    at = cited(F.col("_out.text"), F.col("chunks"))
    unknown = at.isNull() | rules.matches(body, rules.DONT_KNOW)
    if config.grounding:
        unknown = unknown | ~grounded(body, F.transform("chunks", lambda c: c["text"]))
    status = F.when(F.col("_out.rule").isNotNull(), "output_drift").when(unknown, "not_in_corpus").otherwise("answered")
    source = F.element_at("chunks", F.coalesce(at, F.lit(1)))
    out = checked.withColumns({"status": status, "rule": F.coalesce("_out.rule", F.when(status == "not_in_corpus", "not_in_corpus:below_floor"))})
    answered = F.col("status") == "answered"
    text = F.concat(body, F.lit(f"\n\n{FOOTER} "), F.coalesce(source["title"], F.lit("")), F.lit("\n"), F.coalesce(source["url"], F.lit("")))
    message = F.when(answered, text).when(F.col("rule") == "drift:EMPTY", rules.MESSAGES["empty"]).when(F.col("status") == "output_drift", rules.MESSAGES["drift"]).otherwise(rules.MESSAGES["not_in_corpus"])
    named = rules.scheme(F.col("question")) if "question" in df.columns else F.lit(None).cast("string")
    link = F.when(~answered, F.when(F.col("status") == "not_in_corpus", F.coalesce(named, F.lit(HOUSE))).otherwise(HOUSE))
    return out.withColumns({"answer": message, "link_url": F.when(answered, source["url"]), "link_scheme": link}).drop("_out")


def messages(question: Column, chunks: Column, config: EngineConfig = EngineConfig()) -> Column:
    """What a generator is asked: the rules, then the numbered context and the question; no history."""
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(said("system", F.lit(SYSTEM.format(most=config.max_sentences))), said("user", F.concat(F.lit("Context:\n\n"), context_block(chunks), F.lit("\n\nQuestion: "), question)))


def answer(questions: DataFrame, chunks: DataFrame, sources: DataFrame, embed, config: EngineConfig = EngineConfig(), generator: memory.Model | None = None, rewriter: memory.Model | None = None, idx: lexical.Index | None = None, k: int | None = None) -> DataFrame:
    """(qid, status, message, link_url, rule, narrowed_by, rewritten, n_chunks, chunks) for ``questions`` (qid, question, history).

    ``embed`` is a function of a DataFrame and its text column that adds ``embedding``, the one the chunks were made with;
    ``idx`` their lexical index, if one is kept.  Screening comes before the rewrite and again after it; a refused question
    goes no further.  Without a generator the draft is extractive.  A model that fails leaves the state no_key or
    generation_error and the chunks.  Refusals link the scheme's page or the house's and have no ``rewritten``.
    A null question is a blank one.
    """
    q = questions.select(F.col("qid").cast("string").alias("qid"), F.trim(F.coalesce("question", F.lit(""))).alias("question"), F.col("history"))
    q = settle(q.withColumn("d", rules.screen(F.col("question"))), "screened")
    refused = q.where("not d.ok").select("qid", "d")
    again = memory.rewrite(q.where("d.ok").drop("d"), rewriter).withColumn("d", rules.screen(F.col("rewritten")))
    again = settle(again, "rewritten")
    refused = refused.unionByName(again.where("not d.ok").select("qid", "d"))
    ask = settle(retrieve.pinned(again.where("d.ok").select("qid", F.col("rewritten").alias("question"), (F.col("rewritten") != F.col("question")).alias("changed")), sources), "open")
    hits, outcome = retrieve.retrieve(chunks, embed(ask, "question"), config, k, idx)
    facts = chunks.join(hits.select("chunk_index").distinct(), "chunk_index", "left_semi").select("chunk_index", "scheme", "title", "section", "url", "text")
    item = ["pos", "chunk_index", "dense_score", "lexical_score", "scheme", "title", "section", "url", "text"]
    found = hits.join(facts, "chunk_index").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*item))).alias("chunks"))
    kind = found.schema["chunks"].dataType.simpleString()
    rows = ask.select("qid", "question", "narrowed_by", "changed").join(outcome.select("qid", "below_floor"), "qid").join(found, "qid", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(kind)))
    rows = settle(rows.withColumn("low", F.col("below_floor") | (F.size("chunks") == 0)), "found")
    open_rows = rows.where("not low")
    if generator is None:
        drafts = open_rows.withColumns({"draft": extractive(F.col("chunks")), "failed": F.lit(None).cast("string")})
    else:
        asked = open_rows.select("qid", messages(F.col("question"), F.col("chunks"), config).alias("_m"))
        drafts = open_rows.join(settle(memory.call_model(asked, "_m", "draft", memory.bounded(generator), failed="failed").drop("_m"), "drafts"), "qid")
    done = finalise(drafts.where("failed is null").withColumn("draft", F.trim(ascii_citations(F.coalesce("draft", F.lit(""))))), config)
    rewritten = F.when(F.col("changed") & (F.col("status") == "answered"), F.col("question")).otherwise("")
    none = lambda kind="string": F.lit(None).cast(kind)
    said = done.select("qid", "status", F.col("answer").alias("message"), "link_url", "link_scheme", "rule", "narrowed_by", rewritten.alias("rewritten"), "chunks")
    broken = drafts.where("failed is not null").select("qid", F.col("failed").alias("status"), F.when(F.col("failed") == "no_key", rules.MESSAGES["no_key"]).otherwise(rules.MESSAGES["generation_error"]).alias("message"), none().alias("link_url"), none().alias("link_scheme"), none().alias("rule"), "narrowed_by", F.lit("").alias("rewritten"), "chunks")
    low = rows.where("low").select("qid", F.lit("not_in_corpus").alias("status"), F.lit(rules.MESSAGES["not_in_corpus"]).alias("message"), none().alias("link_url"), F.coalesce(rules.scheme(F.col("question")), F.lit(HOUSE)).alias("link_scheme"), F.lit("not_in_corpus:below_floor").alias("rule"), "narrowed_by", F.lit("").alias("rewritten"), "chunks")
    no = refused.select("qid", "d.status", "d.message", none().alias("link_url"), "d.link_scheme", "d.rule", F.lit("").alias("narrowed_by"), F.lit("").alias("rewritten"), F.array().cast(kind).alias("chunks"))
    pages = sources.where("scheme is not null").groupBy("scheme").agg(F.min_by("url", F.struct(F.col("doc_id").cast("long"), "doc_id")).alias("_url")).withColumnRenamed("scheme", "link_scheme")
    every = said.unionByName(broken).unionByName(low).unionByName(no).join(pages, "link_scheme", "left")
    return every.select("qid", "status", "message", F.coalesce("link_url", "_url").alias("link_url"), "rule", "narrowed_by", "rewritten", F.size("chunks").alias("n_chunks"), "chunks")
