"""The stages put together: from sources to an index, from questions to answers, from labelled questions to a gate.

Everything lives below one folder: ``sources.csv``, ``raw`` (landed pages), ``clean`` (texts), ``index_<name>``, ``lexical_<name>``
and ``questions.json``.
"""

from __future__ import annotations

import logging
import resource
import sys
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.text import words
from ledgerloom.operators import answer, chunk, embed, evaluate, extract, lexical, memory, report, sections, store
from ledgerloom.sources import registry
from ledgerloom.storage import settle

log = logging.getLogger(__name__)
HISTORY = "array<struct<role:string,content:string>>"


def peak_mb() -> float:
    """The most memory that this process has had."""
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return peak / 2**20 if sys.platform == "darwin" else peak / 2**10


@dataclass
class Built:
    """What an ingestion made: ``pages`` (doc_id, scheme, title, sections, kept, words), ``chunks``, the index's name and count, its date,
    and seconds by stage."""

    pages: DataFrame
    chunks: DataFrame
    sections: DataFrame
    name: str | None = None
    count: int = 0
    snapshot: str = ""
    seconds: dict[str, float] = field(default_factory=dict)


def load(spark: SparkSession, root: str, sources: DataFrame, offline: bool) -> DataFrame:
    """Sections of all approved sources.  Online their pages are fetched, landed and written as clean texts; offline these texts are
    read, and a source without one is an error.  Either way sections pass the filters."""
    if offline:
        texts = registry.complete(registry.read_clean(spark, f"{root}/clean"), sources)
        return sections.finalise(sections.parse_clean(texts))
    pages = registry.complete(registry.land(registry.fetch(sources), f"{root}/raw"), sources, "page")
    found = settle(sections.finalise(extract.extract(pages)), "sections")
    registry.write_clean(sections.render(found).select("doc_id", "text"), f"{root}/clean")
    return found


def page_table(found: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, scheme, title, sections, kept, words) of each approved source, in order; one without sections has none."""
    n = F.when(F.col("kept"), sections.n_words()).otherwise(0)
    per = found.groupBy("doc_id").agg(F.max("title").alias("own"), F.count(F.lit(1)).alias("sections"), F.count_if("kept").alias("kept"), F.sum(n).alias("words"))
    rows = sources.where("allowed").select("doc_id", "scheme", "title").join(per, "doc_id", "left").na.fill(0, ["sections", "kept", "words"])
    return rows.select("doc_id", "scheme", F.coalesce(F.nullif("own", F.lit("")), "title").alias("title"), "sections", "kept", "words").orderBy(F.col("doc_id").cast("long"))


def ingest(spark: SparkSession, root: str, embedder: embed.Embedder | None, config: EngineConfig = EngineConfig(), offline: bool = False, rebuild: bool = False, dump: bool = True) -> Built:
    """Sources to sections to chunks to an index named by its content.  Without an embedder it stops at the chunks.

    The folder may be any that Spark reaches.  No chunks at all is an error.
    """
    began = time.perf_counter()
    sources = registry.read_csv(spark, f"{root}/sources.csv")
    found = settle(load(spark, root, sources, offline), "sections")
    seconds = {"load": time.perf_counter() - began}
    began = time.perf_counter()
    chunks = settle(chunk.chunk_all(found, sources, config), "chunks")
    n = chunks.count()
    if not n:
        raise RuntimeError("no chunks: the pages hold no content")
    seconds["chunk"] = time.perf_counter() - began
    out = Built(page_table(found, sources), chunks, found, seconds=seconds)
    if dump:
        report.review(chunks, found, sources, config).select("entry").coalesce(1).write.mode("overwrite").text(f"{root}/dump")
    if embedder is not None:
        began = time.perf_counter()
        texts = registry.read_clean(spark, f"{root}/clean")
        out.name = store.content_hash(texts, config)
        out.snapshot = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd")).first()[0]
        index = store.build(embed.embed(chunks, "text", embedder), root, out.name, out.snapshot, rebuild)
        if rebuild or not store.exists(spark, f"{root}/lexical_{out.name}"):
            lexical.index(index, "chunk_index", "document", f"{root}/lexical_{out.name}")
        out.count = index.count()
        if rebuild:
            store.prune(spark, root, [out.name])
        seconds["embed and store"] = time.perf_counter() - began
    return out


def open_or_build(spark: SparkSession, root: str, embedder: embed.Embedder, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, lexical.Index]:
    """The index of the clean texts that are there, built if it is missing; and its lexical side, which is kept with it."""
    name = store.content_hash(registry.read_clean(spark, f"{root}/clean"), config)
    if not store.exists(spark, f"{root}/index_{name}") or not store.exists(spark, f"{root}/lexical_{name}"):
        ingest(spark, root, embedder, config, offline=True, dump=False)
    rows = store.open_index(spark, root, name).withColumnRenamed("document", "text")
    return rows, lexical.load(spark, f"{root}/lexical_{name}")


def ask(spark: SparkSession, root: str, questions: list[tuple[str, str, list]], embedder: embed.Embedder, config: EngineConfig = EngineConfig(), generator: memory.Model | None = None, rewriter: memory.Model | None = None, k: int | None = None) -> DataFrame:
    """Answers to questions (qid, question, history of (role, content))."""
    chunks, idx = open_or_build(spark, root, embedder, config)
    q = spark.createDataFrame(questions, f"qid string, question string, history {HISTORY}")
    return answer.answer(q, chunks, registry.read_csv(spark, f"{root}/sources.csv"), lambda df, c: embed.embed(df, c, embedder), config, generator, rewriter, idx, k)


def evaluation(spark: SparkSession, root: str, embedder: embed.Embedder, config: EngineConfig = EngineConfig(), generator: memory.Model | None = None, unanswerable: tuple[int, ...] = ()) -> DataFrame:
    """(metric, passed, total, ok) over the labelled questions, refusals and personal data of ``questions.json``."""
    chunks, idx = open_or_build(spark, root, embedder, config)
    src = registry.read_csv(spark, f"{root}/sources.csv")
    items, path = registry.read_questions(spark, f"{root}/questions.json", "in_scope"), f"{root}/questions.json"
    asked = items.select(F.col("id").cast("string").alias("qid"), "question", F.array().cast(HISTORY).alias("history"))
    runs = [settle(answer.answer(asked, chunks, src, lambda df, c: embed.embed(df, c, embedder), config, generator, None, idx), "answers") for _ in range(2)]
    places = [r.select("qid", F.inline("chunks")).select("qid", "pos", "chunk_index") for r in runs]
    hits = settle(evaluate.retrieval_hits(places[0], chunks, items), "hits")
    same = evaluate.deterministic(places[0].withColumn("run", F.lit(1)).unionByName(places[1].withColumn("run", F.lit(2))))
    no = registry.read_questions(spark, path, "refusals").select("question", F.array().cast("array<string>").alias("secrets"))
    private = registry.read_questions(spark, path, "pii").select(F.col("input").alias("question"), "secrets")
    checks = settle(evaluate.pipeline_checks(runs[0], items, src, config.max_sentences), "checks")
    return evaluate.gate(hits, checks, same, evaluate.refusals(no.unionByName(private)), unanswerable)


def over_length(chunks: DataFrame, most: int, key: str = "chunk_index", text: str = "text") -> DataFrame:
    """(key, n_words) of chunks that have more words than a window of ``most`` tokens can hold."""
    return chunks.select(key, F.size(words(F.col(text))).alias("n_words")).where(F.col("n_words") > most)
