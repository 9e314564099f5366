"""BM25 over any collection: an inverted index as columns, global statistics, batch queries.

A row of the index is a document with its distinct terms and their counts, made where the text is read.  A question
batch goes to the rows, each partition keeps its best k a question, and only these meet: neither building nor asking
shuffles the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.text import tokens
from ledgerloom.operators.best import CELLS, SCHEMA, Best, blocks
from ledgerloom.storage import settle, spread

BATCH = 4096  # questions a pass


@dataclass(frozen=True)
class Index:
    """``docs`` (key, dl, terms, tfs) and one row of ``stats`` (n, avgdl)."""

    docs: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(key, dl, term, tf)."""
        return self.docs.select("key", "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))

    @property
    def terms(self) -> DataFrame:
        """(term, df): counted within partitions first."""
        return self.docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a document: equal neighbours of its sorted tokens are a term, their number its frequency."""
    texts = spread(docs.where(F.col(key).isNotNull()).select(key, text))
    base = texts.select(F.col(key).alias("key"), F.sort_array(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))).alias("ts"))
    t = F.col("ts")
    starts = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)), lambda i: i.isNotNull())
    cut = base.select("key", "ts", F.size("ts").alias("dl"), starts.alias("at"))
    ends = F.concat(F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), F.array("dl"))
    tfs = F.when(F.col("dl") > 0, F.zip_with("at", ends, lambda a, b: b - a)).otherwise(F.array().cast("array<int>"))
    return cut.select("key", "dl", F.array_distinct("ts").alias("terms"), tfs.alias("tfs"))


def _stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def index(docs: DataFrame, key: str, text: str, path: str | None = None) -> Index:
    """An index of ``docs``.  Texts without tokens and null texts count as documents of length 0; null keys are left out.

    Each text is tokenised once.  With ``path`` the index is kept there for further calls (see ``load``), else it is a
    table of the shared folder.
    """
    rows = _rows(docs, key, text)
    if path is None:
        rows = settle(rows, "postings")
    else:
        rows.write.mode("overwrite").parquet(path)
        rows = docs.sparkSession.read.parquet(path)
    return Index(rows, _stats(rows))


def load(spark: SparkSession, path: str) -> Index:
    """An index that was kept: no text is read again."""
    rows = spark.read.parquet(path)
    return Index(rows, _stats(rows))


def _counts(docs: DataFrame, words: list[str]) -> tuple[np.ndarray, int, float]:
    """In how many documents each word is, how many there are, and their mean length: one pass, summed within partitions first."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        total = np.zeros(len(known) + 2, np.int64)
        for b in batches:
            codes = pc.fill_null(pc.index_in(pc.list_flatten(b.column(1)), value_set=known), -1).to_numpy(zero_copy_only=False)
            total[:-2] += np.bincount(codes[codes >= 0], minlength=len(known))
            total[-2:] += b.num_rows, pc.sum(b.column(0)).as_py() or 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(len(words) + 2, np.int64)
    for r in docs.select("dl", "terms").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out[:-2], int(out[-2]), out[-1] / out[-2] if out[-2] else 0.0


def _block(docs: DataFrame, block: list, pairs: list, k: int, config: EngineConfig, digits: int) -> DataFrame:
    """(qid, key, score, listed) of the questions of a block (qid, ts, top): each partition's best ``k`` of those with ``top``, and the pairs."""
    words = sorted({t for r in block for t in r.ts or ()})
    df, n_docs, avgdl = _counts(docs, words)
    qids = sorted({r.qid for r in block})
    number, at = {q: i for i, q in enumerate(qids)}, {t: i for i, t in enumerate(words)}
    asks = Counter((at[t], number[r.qid]) for r in block for t in r.ts or ())
    term, question = np.array(sorted(asks), np.int64).reshape(-1, 2).T
    weight = np.array([asks[x] for x in sorted(asks)]) * np.log(1 + (n_docs - df[term] + 0.5) / (df[term] + 0.5))
    first = np.searchsorted(term, np.arange(len(words) + 1))
    top = np.zeros(len(qids), bool)
    top[[number[r.qid] for r in block if r.top]] = True
    wanted = np.array(sorted((r.key, number[r.qid]) for r in pairs), np.int64).reshape(-1, 2)
    shared = docs.sparkSession.sparkContext.broadcast((words, first, question, weight, avgdl or 1.0, qids, top, wanted))
    k1, b = config.bm25_k1, config.bm25_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first, question, weight, avgdl, qids, top, wanted = shared.value
        known, names = pa.array(words, pa.string()), pa.array(qids, pa.string())
        n = len(qids)
        best = Best(n, max(k, 1))
        step = max(1, CELLS // n)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                key = part.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                dl = part.column(1).to_numpy(zero_copy_only=False)
                owner = pc.list_parent_indices(part.column(2)).to_numpy(zero_copy_only=False)
                codes = pc.fill_null(pc.index_in(pc.list_flatten(part.column(2)), value_set=known), -1).to_numpy(zero_copy_only=False)
                tf = pc.list_flatten(part.column(3)).to_numpy(zero_copy_only=False)
                on = np.flatnonzero(codes >= 0)
                owner, codes, tf = owner[on], codes[on], tf[on]
                grown = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[owner] / avgdl))
                count = first[codes + 1] - first[codes]
                ends = np.cumsum(count)
                total = np.zeros(n * part.num_rows)
                begun = 0
                while begun < len(codes):  # each posting meets every question that has its term; a slice at a time, so that memory is bounded
                    stop = max(begun + 1, int(np.searchsorted(ends, (ends[begun - 1] if begun else 0) + CELLS, "right")))
                    c = count[begun:stop]
                    row = np.repeat(np.arange(begun, stop), c)
                    spot = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c) + first[codes[row]]
                    total += np.bincount(question[spot] * part.num_rows + owner[row], weights=weight[spot] * grown[row], minlength=len(total))
                    begun = stop
                score = np.round(total.reshape(n, part.num_rows), digits)
                if k > 0:
                    best.add_matrix(key, score, (total.reshape(score.shape) > 0) & top[:, None])
                if len(wanted):
                    order = np.argsort(key, kind="stable")
                    lo, hi = (np.searchsorted(key[order], wanted[:, 0], side) for side in ("left", "right"))
                    here = np.flatnonzero(hi > lo)
                    if len(here):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(wanted[here, 1])), pa.array(wanted[here, 0]), pa.array(score[wanted[here, 1], order[lo[here]]]), pa.array(np.zeros(len(here), bool))], names=["qid", "key", "score", "listed"])
        if k > 0:
            rows = best.rows(qids)
            yield rows.append_column("listed", pa.array(np.ones(rows.num_rows, bool)))

    return docs.select("key", "dl", "terms", "tfs").mapInArrow(run, f"{SCHEMA}, listed boolean")


def score(idx: Index, queries: DataFrame, qkey: str, question: str, k: int, pairs: DataFrame | None = None, top: str | None = None, config: EngineConfig = EngineConfig(), digits: int = 6) -> DataFrame:
    """(qid, key, score, listed) by one pass over the index a block of questions; ``qid`` is a string, keys are integers.

    ``listed``: the ``k`` best documents of each partition that share a term with the question, by rounded score, ties to the
    smaller key; only for questions with ``top``, if it is given.  Not listed: the score of each of ``pairs`` (qid, key), once, 0
    where they share no term.  A repeated word of a question counts each time.
    """
    asks = queries.select(F.col(qkey).cast("string").alias("qid"), tokens(F.col(question)).alias("ts"), (F.col(top) if top else F.lit(True)).alias("top")).where("qid is not null")
    kind, out = idx.docs.schema["key"].dataType, None
    for block in blocks(asks, BATCH):
        own = []
        if pairs is not None:  # as many as a few for each question of the block
            names = queries.sparkSession.createDataFrame([(q,) for q in sorted({r.qid for r in block})], "qid string")
            own = pairs.select("qid", F.col("key").cast("long").alias("key")).distinct().join(F.broadcast(names), "qid", "left_semi").collect()
        part = _block(idx.docs, block, own, k, config, digits)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = queries.sparkSession.createDataFrame([], f"{SCHEMA}, listed boolean")
    return out.withColumn("key", F.col("key").cast(kind))


def ask(idx: Index, queries: DataFrame, qkey: str, question: str, k: int, config: EngineConfig = EngineConfig(), digits: int = 6) -> DataFrame:
    """(qid, key, score, rank): the ``k`` best documents of each question that share a term with it.

    Every partition of the index gives its best k, so a question moves k rows a partition, however common its words.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    best = score(idx, queries, qkey, question, k, None, None, config, digits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("qid").cast(queries.schema[qkey].dataType).alias("qid"), "key", "score", "rank")


def bm25_top(docs: DataFrame, key: str, text: str, queries: DataFrame, qkey: str, question: str, k: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, key, score, rank): the documents that answer each question best; only those with a term of it."""
    return ask(index(docs, key, text), queries, qkey, question, k, config)
