"""All queries of the core, by name: (spark, directory of the tables) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions import rules, text
from ledgerloom.operators import answer as answering
from ledgerloom.operators import chunk, embed, evaluate, extract, lexical, memory, report, retrieve, sections, store
from ledgerloom.plans import oracle
from ledgerloom.shipping import ship
from ledgerloom.sources import registry as sources
from ledgerloom.storage import settle, spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, at: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{at}/{table}.parquet")


@query
def bm25_topk(spark: SparkSession, at: str) -> DataFrame:
    """The five documents that answer each held-out question best, by BM25."""
    rows = lexical.bm25_top(read(spark, at, "documents"), "doc_id", "text", read(spark, at, "in_scope"), "id", "question", 5)
    return rows.select(F.col("qid").alias("item_id"), F.col("key").alias("doc_id"), "score", F.col("rank").cast("int").alias("rank"))


@query
def term_stats(spark: SparkSession, at: str) -> DataFrame:
    """Document frequency of each term."""
    return lexical.index(read(spark, at, "documents"), "doc_id", "text").terms


@query
def index_stats(spark: SparkSession, at: str) -> DataFrame:
    """Number and mean length of the indexed documents."""
    return lexical.index(read(spark, at, "documents"), "doc_id", "text").stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def _vectors(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, at, "embeddings")
    chunks = rows.select(F.col("vec_id").alias("chunk_index"), F.col("label").cast("string").alias("doc_id"), "embedding")
    return chunks, rows.where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("qid"), F.col("label").cast("string").alias("label"), "embedding")


def _dense(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("qid").cast("long").alias("vec_id"), F.col("key").alias("other"), F.col("dense_score").alias("score"), F.col("dense_rank").cast("int").alias("rank"))


@query
def dense_topk(spark: SparkSession, at: str) -> DataFrame:
    """Exact cosine top five of every hundredth vector, against all."""
    chunks, asked = _vectors(spark, at)
    return _dense(retrieve.dense_top(chunks, asked.withColumn("doc_id", F.lit(None).cast("string")), 5))


@query
def dense_topk_narrowed(spark: SparkSession, at: str) -> DataFrame:
    """The same within the vector's own label."""
    chunks, asked = _vectors(spark, at)
    return _dense(retrieve.dense_top(chunks, asked.withColumnRenamed("label", "doc_id"), 5))


@query
def vector_dq(spark: SparkSession, at: str) -> DataFrame:
    """Rows of the index whose vector is unfit, and why."""
    return embed.bad_vectors(read(spark, at, "index_rows"), "chunk_index", "embedding").groupBy("chunk_index", "problem").agg(F.count(F.lit(1)).alias("n"))


@query
def vector_preview(spark: SparkSession, at: str) -> DataFrame:
    """The first five fit vectors of the index."""
    rows = read(spark, at, "embeddings").select(F.col("vec_id").alias("chunk_index"), "embedding")
    return report.preview(rows).select("chunk_index", "square", F.round(F.col("head")[0].cast("double"), 6).alias("first"), F.round(F.col("least").cast("double"), 6).alias("least"), F.round(F.col("largest").cast("double"), 6).alias("largest"))


def _paired(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """All documents, each with the vector of its number modulo the number of vectors, and the vectors that no document
    takes, without text; all questions, each with a vector in the same way, turned round for some, pinned to its label
    for others.  Documents and questions are numbered from 1, vectors from 0 without gaps."""
    vectors = read(spark, at, "embeddings").select("vec_id", F.col("label").cast("string").alias("doc_id"), "embedding")
    n = vectors.count()
    number = lambda key: F.pmod(F.col(key) - 1, F.lit(n)).alias("vec_id")
    docs = read(spark, at, "documents").select(number("doc_id"), (F.col("doc_id") - 1).alias("n"), "text")
    chunks = spread(vectors).join(docs, "vec_id", "left").select(F.coalesce("n", "vec_id").alias("chunk_index"), "doc_id", "text", "embedding")
    items = read(spark, at, "in_scope").select(number("id"), "id", "question")
    kinds = F.explode(F.array(F.lit("plain"), F.lit("pinned"), F.lit("turned"))).alias("kind")
    rows = items.join(vectors, "vec_id").select("id", "question", "embedding", F.col("doc_id").alias("label"), kinds)
    asked = rows.select(F.concat_ws("-", "id", "kind").alias("qid"), "question", F.when(F.col("kind") == "pinned", F.col("label")).alias("doc_id"), F.when(F.col("kind") == "turned", F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")).alias("embedding"))
    return chunks, asked


@query
def hybrid_retrieve(spark: SparkSession, at: str) -> DataFrame:
    """Hits of all questions over all documents under all strategies."""
    hits, outcome = retrieve.retrieve(*_paired(spark, at))
    return hits.join(outcome, "qid").select("qid", F.col("pos").cast("int").alias("pos"), "chunk_index", hits["doc_id"], "strategy", F.round("score", 6).alias("score"), F.round("lexical_score", 6).alias("lexical_score"), F.col("dense_rank").cast("int").alias("dense_rank"), F.col("lexical_rank").cast("int").alias("lexical_rank"))


@query
def floor_rescue(spark: SparkSession, at: str) -> DataFrame:
    """Whether a question's best cosine is too low and no lexical hit rescues it: all questions, all documents."""
    return retrieve.retrieve(*_paired(spark, at))[1].select("qid", "strategy", "floor_applied", "below_floor")


@query
def word_windows(spark: SparkSession, at: str) -> DataFrame:
    """Overlapping word windows of all documents."""
    config = EngineConfig()
    rows = read(spark, at, "documents").where("text is not null").select("doc_id", F.posexplode(chunk.windows(text.words(F.col("text")), config.chunk_size, config.chunk_overlap)).alias("win", "ws"))
    return rows.select("doc_id", "win", F.size("ws").alias("n_words"), F.md5(F.array_join("ws", " ")).alias("digest"))


@query
def section_windows(spark: SparkSession, at: str) -> DataFrame:
    """Chunks of the kept sections before small ones are merged."""
    rows = chunk.section_chunks(read(spark, at, "sections").dropDuplicates(["doc_id", "sec_ord"]), read(spark, at, "sources"))
    return rows.select("doc_id", "sec_ord", "win", F.md5("body").alias("digest"))


@query
def chunks_built(spark: SparkSession, at: str) -> DataFrame:
    """Chunks built from the sections, small runs merged."""
    rows = chunk.chunk_all(read(spark, at, "sections").dropDuplicates(["doc_id", "sec_ord"]), read(spark, at, "sources"))
    return rows.select("chunk_index", "doc_id", "section", "n_merged", "n_words", "n_chars", "id")


@query
def chunks_per_scheme(spark: SparkSession, at: str) -> DataFrame:
    return report.per_scheme(read(spark, at, "chunks"))


@query
def chunk_sizes(spark: SparkSession, at: str) -> DataFrame:
    return report.sizes(read(spark, at, "chunks"))


@query
def chunks_per_document(spark: SparkSession, at: str) -> DataFrame:
    return report.per_document(read(spark, at, "chunks"))


@query
def sections_per_page(spark: SparkSession, at: str) -> DataFrame:
    return report.per_page(read(spark, at, "sections").distinct())


@query
def dropped_sections(spark: SparkSession, at: str) -> DataFrame:
    rows = report.dropped(read(spark, at, "sections"), read(spark, at, "sources"))
    return rows.select("scheme", F.array_join("headings", "; ").alias("headings"))


@query
def dump_lines(spark: SparkSession, at: str) -> DataFrame:
    """The preview of each chunk; the whole dump is ``review_dump``."""
    return report.dump(read(spark, at, "chunks"))


@query
def review_dump(spark: SparkSession, at: str) -> DataFrame:
    """The review dump with the whole text of every chunk."""
    return report.review(read(spark, at, "chunks"), read(spark, at, "sections"), read(spark, at, "sources"))


@query
def section_rules(spark: SparkSession, at: str) -> DataFrame:
    """What the section filters leave of the sections."""
    out = sections.finalise(read(spark, at, "sections").select("doc_id", "sec_ord", "heading", "text", "tables").distinct())
    return out.select("doc_id", "sec_ord", "kept", "reason", F.md5("text").alias("digest"), F.size("tables").alias("n_tables"))


@query
def sections_from_html(spark: SparkSession, at: str) -> DataFrame:
    """Sections of all pages, by the walk over the document tree."""
    pages = read(spark, at, "html_pages").select("doc_id", "html").distinct()
    out = sections.finalise(extract.extract(pages))
    return out.select("doc_id", "title", "sec_ord", "level", "heading", "kept", F.length("text").alias("chars"), F.size("tables").alias("rows"))


@query
def clean_text(spark: SparkSession, at: str) -> DataFrame:
    """The kept sections of each document as one text, read back again."""
    rows = read(spark, at, "sections").dropDuplicates(["doc_id", "sec_ord"]).join(read(spark, at, "sources").select("doc_id", "title"), "doc_id")
    back = sections.parse_clean(sections.render(rows))
    return back.groupBy("doc_id").agg(F.max("title").alias("title"), F.count(F.lit(1)).alias("sections"), F.sum(F.length("text")).alias("chars"))


@query
def row_ids(spark: SparkSession, at: str) -> DataFrame:
    """Content ids of all chunks."""
    return read(spark, at, "chunks").select("chunk_index", text.row_id(F.col("url"), F.col("section"), F.col("text")).alias("id"))


@query
def duplicate_texts(spark: SparkSession, at: str) -> DataFrame:
    """Texts that several documents have: the smallest id, and how many."""
    rows = read(spark, at, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    return rows.where("n > 1")


@query
def index_latest(spark: SparkSession, at: str) -> DataFrame:
    """The index without rows that came again later."""
    return store.latest(read(spark, at, "index_rows"))


def _planted(spark: SparkSession, at: str, cases: tuple[str, ...], every: int) -> DataFrame:
    """All documents, each with the case of its number modulo ``every`` behind its text, if there is one."""
    rows = read(spark, at, "documents").select("doc_id", "text")
    case = F.get(F.array(*map(F.lit, cases)), F.pmod("doc_id", F.lit(every)).cast("int"))
    return rows.select("doc_id", F.concat_ws(" ", "text", case).alias("text"))


@query
def pii_scan(spark: SparkSession, at: str) -> DataFrame:
    """Documents, some with personal data behind their text, and the rule that finds it."""
    return _planted(spark, at, oracle.PERSONAL, 10).select("doc_id", rules.pii(F.col("text")).alias("rule")).where("rule is not null")


@query
def intent_classify(spark: SparkSession, at: str) -> DataFrame:
    """The screening of all held-out questions."""
    return read(spark, at, "in_scope").select("id", rules.screen(F.col("question")).alias("d")).select("id", "d.ok", "d.status", "d.link_scheme", "d.rule")


@query
def scheme_detect(spark: SparkSession, at: str) -> DataFrame:
    """The scheme or fund house that each chunk's title names."""
    return read(spark, at, "chunks").select("chunk_index", rules.target(F.col("title")).alias("narrowed_by"))


@query
def advice_scan(spark: SparkSession, at: str) -> DataFrame:
    """Documents, some with words of advice or performance behind their text, and the rule that finds them."""
    return _planted(spark, at, oracle.CLAIMS, 8).select("doc_id", rules.first_match(F.col("text"), rules.DRIFT).alias("rule")).where("rule is not null")


@query
def private_turns(spark: SparkSession, at: str) -> DataFrame:
    """Turns of whose history personal data and failed answers take no part."""
    said = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("pan ABCDE1234F "), "event_type")).otherwise(F.col("event_type"))
    state = F.when(F.col("event_id") % 5 == 0, "generation_error").when(F.col("event_id") % 11 != 0, "answered")
    turns = read(spark, at, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"), said.alias("content"), state.alias("status"))
    rows = memory.history(turns, 4)
    return rows.select("conv_id", "turn", F.size("history").alias("n"), memory.transcript(F.col("history")).alias("transcript"))


@query
def standalone_flag(spark: SparkSession, at: str) -> DataFrame:
    return read(spark, at, "in_scope").select("id", memory.stands_alone(F.col("question")).alias("alone"))


@query
def sentence_cap(spark: SparkSession, at: str) -> DataFrame:
    """Each document cut to three sentences."""
    return read(spark, at, "documents").where("text is not null").select("doc_id", F.md5(text.cap_sentences(F.trim("text"), 3)).alias("digest"))


@query
def number_tokens(spark: SparkSession, at: str) -> DataFrame:
    """The distinct numbers of each document."""
    rows = read(spark, at, "documents").where("text is not null").select("doc_id", F.sort_array(text.numbers(F.col("text"))).alias("n"))
    return rows.select("doc_id", F.size("n").alias("numbers"), F.md5(F.array_join("n", " ")).alias("digest"))


@query
def passages_grounded(spark: SparkSession, at: str) -> DataFrame:
    """Whether all numbers of an item's passage are in the chunks of its document."""
    chunks = read(spark, at, "chunks").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    items = read(spark, at, "in_scope").join(chunks, "doc_id", "left")
    return items.select("id", text.grounded(F.col("passage"), F.coalesce("texts", F.array().cast("array<string>"))).alias("grounded"))


@query
def citation_resolve(spark: SparkSession, at: str) -> DataFrame:
    """Drafts that cite their second or a missing chunk, and the chunk that counts."""
    rows = read(spark, at, "chunks").select("chunk_index", F.concat("text", F.lit(" 【"), F.col("chunk_index") % 4, F.lit("】 [1].")).alias("draft"), F.array(F.lit("a"), F.lit("b")).alias("chunks"))
    return rows.select("chunk_index", answering.cited(F.col("draft"), F.col("chunks")).alias("cited"), F.md5(text.strip_references(F.col("draft"))).alias("digest"))


def _turns(spark: SparkSession, at: str) -> DataFrame:
    """Events of a user as the turns of a conversation."""
    rows = read(spark, at, "events")
    return rows.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("event_type").alias("content"), F.lit("answered").alias("status"))


def _history(spark: SparkSession, at: str, last: int) -> DataFrame:
    rows = memory.history(_turns(spark, at), last)
    return rows.select("conv_id", "turn", F.size("history").alias("n"), memory.transcript(F.col("history")).alias("transcript"))


@query
def history_window_3(spark: SparkSession, at: str) -> DataFrame:
    return _history(spark, at, 3)


@query
def history_window_10(spark: SparkSession, at: str) -> DataFrame:
    return _history(spark, at, 10)


@query
def page_titles(spark: SparkSession, at: str) -> DataFrame:
    """Title and number of sections of every page with an h1."""
    pages = read(spark, at, "html_pages").select("doc_id", "html").distinct()
    return extract.extract(pages).groupBy("doc_id").agg(F.max("title").alias("title")).select("doc_id", F.regexp_replace("title", r"(?U)\s+", " ").alias("title"))


@query
def allowlist(spark: SparkSession, at: str) -> DataFrame:
    """Chunks whose address is approved."""
    return sources.allowed(read(spark, at, "chunks").select("chunk_index", "url"), read(spark, at, "sources"))


@query
def source_urls(spark: SparkSession, at: str) -> DataFrame:
    """Addresses of the registry in one form."""
    return read(spark, at, "sources").select("doc_id", sources.normal_url(F.col("url")).alias("url"))


@query
def registry_lines(spark: SparkSession, at: str) -> DataFrame:
    return sources.markdown(read(spark, at, "sources"))


@query
def recall_metrics(spark: SparkSession, at: str) -> DataFrame:
    """Recall and first-rank accuracy of BM25 over the chunks, for all held-out items."""
    chunks, items = read(spark, at, "chunks"), read(spark, at, "in_scope")
    hits = lexical.bm25_top(chunks, "chunk_index", "text", items, "id", "question", 5).select(F.col("qid").cast("string").alias("qid"), F.col("rank").alias("pos"), F.col("key").alias("chunk_index"))
    return evaluate.metrics(evaluate.retrieval_hits(hits, chunks, items))


def _answered(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """Answers to all held-out questions over all chunks, and the chunks."""
    model = embed.HashedEmbedder()
    columns = ["chunk_index", "doc_id", "scheme", "title", "section", "url", "text"]
    # the vectors are used twice
    chunks = settle(embed.embed(read(spark, at, "chunks").select(columns), "text", model), "vectors")
    asked = read(spark, at, "in_scope").select(F.col("id").alias("qid"), "question", F.array().cast("array<struct<role:string,content:string>>").alias("history"))
    return answering.answer(asked, chunks, read(spark, at, "sources"), lambda df, c: embed.embed(df, c, model)), chunks


@query
def answers(spark: SparkSession, at: str) -> DataFrame:
    """Extractive answers to all held-out questions, over all chunks."""
    return _answered(spark, at)[0].select("qid", "status", "rule", "narrowed_by", "link_url", "rewritten", "n_chunks")


@query
def quality_gate(spark: SparkSession, at: str) -> DataFrame:
    """The evaluation of these answers: S1 to S7 and the screening of planted personal data.  Extractive answers of a hashed embedder
    don't pass it."""
    found, items, src = settle(_answered(spark, at)[0], "answers"), read(spark, at, "in_scope"), read(spark, at, "sources")
    place = found.select("qid", F.inline("chunks")).select("qid", "pos", "chunk_index")
    hits = settle(evaluate.retrieval_hits(place, read(spark, at, "chunks"), items), "hits")
    again = place.withColumn("run", F.lit(1)).unionByName(place.withColumn("run", F.lit(2)))
    private = items.select(F.concat_ws(" ", "question", F.lit("my pan is ABCDE1234F")).alias("question"), F.array(F.lit("ABCDE1234F")).alias("secrets"))
    return evaluate.gate(hits, settle(evaluate.pipeline_checks(found, items, src), "checks"), evaluate.deterministic(again), evaluate.refusals(private))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
