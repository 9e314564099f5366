"""Hybrid retrieval for batches of questions: exact cosine, BM25, reciprocal-rank fusion, narrowing, floors.

Both arms go over the collection where it lies, a block of ``BATCH`` questions a pass, and every partition hands on its
best few a question; all later steps work on these few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.rules import target
from ledgerloom.operators import lexical
from ledgerloom.operators.best import CELLS, SCHEMA, Best, blocks
from ledgerloom.storage import settle

BATCH = 4096


def _block_top(chunks: DataFrame, ids: list, docs: list, matrix: np.ndarray, k: int, key: str, vector: str) -> DataFrame:
    """The ``k`` best chunks of each partition for each question of a block: a matrix product a batch, cut down after each."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast((ids, docs, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, pins, q = shared.value
        pinned = np.array([p is not None for p in pins])
        pin = np.array([p or "" for p in pins], object)
        best = Best(len(qid), k)
        step = max(1, CELLS // len(qid))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                b = batch.slice(a, step)
                lists = b.column(2)
                fit = np.flatnonzero(pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == q.shape[1])
                x = pa.compute.list_flatten(lists.take(pa.array(fit))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                x, fit = x[good], fit[good]
                if not len(fit):
                    continue
                x = x / np.sqrt((x * x).sum(1))[:, None]
                s = np.round(q @ x.T, 6)
                on = np.ones(s.shape, bool)
                if pinned.any():
                    doc = np.array(["" if d is None else d for d in b.column(1).take(pa.array(fit)).to_pylist()], object)
                    on[pinned] = doc[None, :] == pin[pinned][:, None]
                best.add_matrix(b.column(0).to_numpy(zero_copy_only=False)[fit], s, on)
        yield best.rows(qid)

    rows = chunks.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col("doc_id").cast("string").alias("doc_id"), F.col(vector).alias("v"))
    kind = chunks.schema[key].dataType
    return rows.mapInArrow(run, SCHEMA).select("qid", F.col("key").cast(kind).alias("key"), F.col("score").alias("dense_score"))


def dense_top(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_index", vector: str = "embedding") -> DataFrame:
    """(qid, key, dense_score, dense_rank): exact cosine top-k of ``queries`` (qid, doc_id or null, embedding) over ``chunks``.

    A question with a doc_id sees that document's chunks only.  Vectors that are null, of another length, not finite or all
    zero take no part; scores are rounded to six digits, ties go to the smaller key; k below 1 gives no rows.  The
    questions are a stated query set and are taken in blocks of ``BATCH``.
    """
    out = None
    rows = queries.select(F.col("qid").cast("string").alias("qid"), F.col("doc_id").cast("string").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    for block in blocks(rows, BATCH) if k >= 1 else ():
        fit = [r for r in block if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
        for d in sorted({len(r.embedding) for r in fit}):
            use = [r for r in fit if len(r.embedding) == d]
            m = np.array([r.embedding for r in use], np.float64)
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            part = _block_top(chunks, [r.qid for r in use], [r.doc_id for r in use], m, k, key, vector)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return chunks.sparkSession.createDataFrame([], "qid string, key long, dense_score double, dense_rank int")
    order = Window.partitionBy("qid").orderBy(F.desc("dense_score"), "key")
    return out.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= k)


def ranked(scored: DataFrame, score: str, rank: str) -> DataFrame:
    """``scored`` with its rank by (-score, key) within each question."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "key")))


def fuse(dense: DataFrame, lex: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, key, dense_score, dense_rank, lexical_score, lexical_rank, score): reciprocal-rank fusion of two arms.

    ``lex`` has a score, if of 0, for every candidate, those of the dense arm too, and ranks them all.  A candidate that the
    dense arm doesn't rank gets that arm's size plus the constant.  Ranks of 0 mean not ranked; ties go to the lexical rank.
    """
    size = dense.groupBy("qid").agg(F.count(F.lit(1)).alias("n_dense"))
    both = lex.join(dense, ["qid", "key"], "left").join(size, "qid", "left")
    k = F.lit(config.rrf_k)
    score = 1 / (k + F.coalesce("dense_rank", F.coalesce("n_dense", F.lit(0)) + k)) + 1 / (k + F.col("lexical_rank"))
    zero = {"dense_rank": F.coalesce("dense_rank", F.lit(0)), "dense_score": F.coalesce("dense_score", F.lit(0.0))}
    return both.withColumn("score", F.round(score, 12)).withColumns(zero).withColumn("tie", F.col("lexical_rank")).drop("n_dense")


def pinned(queries: DataFrame, sources: DataFrame, question: str = "question") -> DataFrame:
    """``queries`` with ``narrowed_by`` and the ``doc_id`` that a question is about: the smallest one of its scheme."""
    named = queries.withColumn("narrowed_by", target(F.col(question)))
    first = sources.where(F.col("scheme").isNotNull()).groupBy("scheme").agg(F.min_by("doc_id", F.struct(F.col("doc_id").cast("long"), "doc_id")).alias("pin"))
    scheme = F.when(F.col("narrowed_by") == "amc", "amc_overview").otherwise(F.regexp_replace("narrowed_by", "^scheme:", ""))
    return named.withColumn("_s", scheme).join(first.withColumnRenamed("scheme", "_s"), "_s", "left").drop("_s").withColumnRenamed("pin", "doc_id")


def _lexical_arms(chunks: DataFrame, info: DataFrame, dense: DataFrame, idx: lexical.Index, k: int, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(qid, key, lexical_score) of the dense candidates of questions that fuse, and (qid, key, lexical_score, lexical_rank): the ``k``
    best of all chunks for each question that isn't pinned; both from one pass.

    Chunks without a term of the question score 0 and come last, the smaller key first, so there are k if there are k chunks.
    """
    fused = dense.join(info.where("strategy in ('pinned', 'hybrid')").select("qid"), "qid").select("qid", "key")
    asked = info.where("strategy <> 'dense'").select("qid", "question", (F.col("strategy") != "pinned").alias("top"))
    scored = settle(lexical.score(idx, asked, "qid", "question", k, fused, "top", config).withColumnRenamed("score", "lexical_score"), "lexical")
    found = scored.where("listed").drop("listed")
    # of chunks that score 0 only the smallest k can count; found ones may be among these, hence twice as many
    least = [r.key for r in idx.docs.select("key").orderBy("key").limit(2 * k).collect()]
    kind = idx.docs.schema["key"].dataType.simpleString()
    spare = asked.where("top").select("qid", F.explode(F.array(*map(F.lit, least)).cast(f"array<{kind}>")).alias("key"), F.lit(0.0).alias("lexical_score"))
    rows = found.unionByName(spare).groupBy("qid", "key").agg(F.max("lexical_score").alias("lexical_score"))
    return scored.where("not listed").drop("listed"), ranked(rows, "lexical_score", "lexical_rank").where(F.col("lexical_rank") <= k)


def retrieve(chunks: DataFrame, queries: DataFrame, config: EngineConfig = EngineConfig(), k: int | None = None, idx: lexical.Index | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored chunks and one row a question.

    ``chunks`` has chunk_index, doc_id, text and embedding; ``queries`` has qid, question, embedding and doc_id (null: all).
    ``idx`` is the chunks' lexical index, if one was kept; else it is built.
    The strategy of a question: ``dense`` if re-ranking is off or the dense arm has one row; ``pinned`` if it names a
    document: BM25 over the dense candidates, fused; ``lexical`` if the best cosine is under the lexical floor: BM25 over
    all chunks; else ``hybrid``: the best of both arms together, each with both ranks, fused.  The second frame has
    strategy, below_floor and floor_applied; a low best cosine is rescued by a clear lexical winner.  A question without any
    dense row has no hits and is below the floor, and so is a blank one.
    """
    k = k or config.top_k
    wide = max(k, k * config.dense_candidates) if config.rerank else k
    # written once: questions, and what each arm has for them; all further steps work on these few rows
    queries = settle(queries.withColumn("qid", F.col("qid").cast("string")), "questions")
    asked = queries.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    dense = settle(dense_top(chunks, asked, wide), "dense")
    shape = dense.groupBy("qid").agg(F.max("dense_score").alias("best"), F.count(F.lit(1)).alias("n"))
    info = asked.select("qid", F.col("doc_id").alias("pin"), "question").join(shape, "qid", "left")
    strategy = F.when(F.lit(not config.rerank) | (F.coalesce("n", F.lit(0)) <= 1), "dense").when(F.col("pin").isNotNull(), "pinned").when(F.col("best") < config.lexical_only_floor, "lexical").otherwise("hybrid")
    info = settle(info.withColumn("strategy", strategy), "strategies")
    of = lambda *names: info.where(F.col("strategy").isin(*names))

    columns = ["qid", "key", "dense_score", "dense_rank", "lexical_score", "lexical_rank", "score", "tie"]
    plain = dense.join(of("dense").select("qid"), "qid").select("qid", "key", "dense_score", "dense_rank", F.lit(0.0).alias("lexical_score"), F.lit(0).alias("lexical_rank"), F.col("dense_score").alias("score"), F.col("dense_rank").alias("tie"))
    hits, rescue = plain, None
    if config.rerank and not of("pinned", "lexical", "hybrid").isEmpty():
        own, whole = _lexical_arms(chunks, info, dense, idx or lexical.index(chunks, "chunk_index", "text"), wide, config)
        fused = dense.join(of("pinned", "hybrid").select("qid"), "qid")
        union = own.unionByName(whole.join(of("hybrid").select("qid"), "qid").select("qid", "key", "lexical_score")).distinct()
        ranks = fuse(fused, ranked(union, "lexical_score", "lexical_rank"), config)
        only = whole.join(of("lexical").select("qid"), "qid").join(dense, ["qid", "key"], "left").select("qid", "key", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"), "lexical_score", "lexical_rank", F.col("lexical_score").alias("score"), F.col("lexical_rank").alias("tie"))
        hits = plain.select(columns).unionByName(only.select(columns)).unionByName(ranks.select(columns))
        rescue = whole.where("lexical_rank <= 2").join(of("lexical").select("qid"), "qid")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "tie", "key")
    hits = settle(hits.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).drop("tie"), "hits")

    few = hits.select("key") if rescue is None else hits.select("key").union(rescue.select("key"))
    owner = settle(chunks.select(F.col("chunk_index").alias("key"), F.col("doc_id").cast("string").alias("doc_id")).join(few.distinct(), "key", "left_semi").distinct(), "owners")
    hits = hits.join(owner, "key", "left").join(info.select("qid", "pin"), "qid").withColumn("doc_id", F.coalesce("pin", "doc_id")).drop("pin")
    info = info.withColumn("floor_applied", F.col("pin").isNull())
    low = F.coalesce("n", F.lit(0)) == 0
    if rescue is None:
        info = info.withColumn("rescued", F.lit(False))
    else:
        at = lambda r: F.max(F.when(F.col("lexical_rank") == r, F.struct("lexical_score", "doc_id")))
        pair = rescue.join(owner, "key", "left").groupBy("qid").agg(at(1).alias("a"), at(2).alias("b"))
        clear = (F.col("a.lexical_score") >= config.rescue_ratio * F.coalesce("b.lexical_score", F.lit(0.0))) | (F.col("a.doc_id") == F.col("b.doc_id"))
        info = info.join(pair, "qid", "left").withColumn("rescued", F.coalesce((F.col("a.lexical_score") >= config.rescue_min_score) & clear, F.lit(False)))
    outcome = info.withColumn("below_floor", low | (F.col("floor_applied") & (F.col("best") < config.min_score) & ~F.col("rescued")))
    blank = queries.where(F.trim(F.coalesce("question", F.lit(""))) == "").select("qid", F.lit(None).cast("string").alias("pin"), F.lit("none").alias("strategy"), F.lit(False).alias("floor_applied"), F.lit(True).alias("below_floor"))
    return hits.withColumnRenamed("key", "chunk_index"), outcome.select("qid", "pin", "strategy", "floor_applied", "below_floor").unionByName(blank)
