"""Sections to chunks: overlapping word windows, then runs of small windows merged within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.text import row_id, squeeze, words
from ledgerloom.operators.sections import section_words
from ledgerloom.storage import settle


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """array<array<string>>: windows of ``size`` words that share ``overlap``; the last reaches the end; none of no words."""
    stride = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / F.lit(stride))).cast("int")
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(tokens, k * stride + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def section_chunks(sections: DataFrame, sources: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(doc_id, sec_ord, win, scheme, title, section, url, body) of the windows of all kept sections.

    Sections of unknown documents give none.  ``sources`` grows with the documents; Spark picks the join.
    """
    src = sources.select("doc_id", "scheme", F.col("title").alias("src_title"), "url")
    kept = sections.where("kept").select("doc_id", "sec_ord", F.col("heading").alias("section"), windows(section_words(), config.chunk_size, config.chunk_overlap).alias("w"))
    rows = kept.select("doc_id", "sec_ord", "section", F.posexplode("w").alias("win", "ws"))
    return rows.join(src, "doc_id").select("doc_id", "sec_ord", "win", "scheme", F.col("src_title").alias("title"), F.coalesce("section", F.lit("")).alias("section"), "url", F.array_join("ws", " ").alias("body"))


def merge_runs(parts: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Merges consecutive chunks of a document until a run, with its headings in it, has ``min_size`` words; the rest of a
    document is a run of its own.

    One fold over the ordered chunks of each document; at most a document is gathered.  Gives (doc_id, ord, scheme, title,
    section, url, text, body, n_merged, n_words, n_chars, warnings).
    """
    item = F.struct("sec_ord", "win", "section", "body", "scheme", "title", "url")
    docs = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    member = "array<struct<section:string,body:string>>"
    state = f"struct<done:array<{member}>,run:{member},words:int,last:string>"
    title_words = F.size(words(F.coalesce(F.col("items")[0]["title"], F.lit(""))))
    start = F.struct(F.array().cast(f"array<{member}>").alias("done"), F.array().cast(member).alias("run"), F.lit(0).alias("words"), F.lit(None).cast("string").alias("last")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        named = (x["section"] != "") & ~x["section"].eqNullSafe(acc["last"])
        count = acc["words"] + F.size(words(x["body"])) + F.when(named, F.size(words(x["section"]))).otherwise(0)
        run = F.concat(acc["run"], F.array(F.struct(F.when(named, x["section"]).alias("section"), x["body"].alias("body"))))
        full = count + title_words >= config.min_size
        return F.when(full, F.struct(F.concat(acc["done"], F.array(run)).alias("done"), F.array().cast(member).alias("run"), F.lit(0).alias("words"), F.lit(None).cast("string").alias("last")).cast(state)).otherwise(
            F.struct(acc["done"].alias("done"), run.alias("run"), count.alias("words"), F.when(named, x["section"]).otherwise(acc["last"]).alias("last")).cast(state)
        )

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["run"]) > 0, F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"])

    head = F.col("items")[0]
    runs = docs.select("doc_id", head["scheme"].alias("scheme"), head["title"].alias("title"), head["url"].alias("url"), F.posexplode(F.aggregate("items", start, step, finish)).alias("ord", "run"))
    body = F.array_join(F.flatten(F.transform("run", lambda m: F.when(m["section"].isNull(), F.array(m["body"])).otherwise(F.array(m["section"], m["body"])))), "\n")
    named = F.array_join(F.array_distinct(F.filter(F.transform("run", lambda m: m["section"]), lambda s: s.isNotNull())), ", ")
    out = runs.select("doc_id", "ord", "scheme", "title", named.alias("section"), "url", squeeze(F.concat_ws("\n", "title", body)).alias("text"), body.alias("body"), (F.size("run") - 1).alias("n_merged"))
    out = out.withColumns({"n_words": F.size(words(F.col("text"))), "n_chars": F.length("text")})
    warn = F.array_compact(F.array(F.when(F.col("n_words") > config.chunk_size + 20, F.format_string("over budget: %d words", "n_words")), F.when(F.col("n_merged") > 0, F.format_string("merged %d small chunk(s)", "n_merged"))))
    return out.withColumn("warnings", warn)


def numbered(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``chunk_index``: dense from 0 in the order of numeric doc_id, then ``ord``.

    Documents are counted first, and a running sum of their counts, taken in ranges of documents, gives each one's first index; no window
    runs over all rows.
    """
    order = F.col("doc_id").cast("long")
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("o", order)
    # written once, so that both uses see the same ranges
    ranged = settle(counts.repartitionByRange("o", "doc_id").sortWithinPartitions("o", "doc_id").withColumn("p", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("p").agg(F.sum("n").alias("total"))  # one row a partition
    before = per.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "base")
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = ranged.withColumn("within", inner).join(before, "p").select("doc_id", (F.col("base") + F.col("within")).alias("first"))
    return chunks.join(first, "doc_id").withColumn("chunk_index", (F.col("first") + F.col("ord")).cast("int")).drop("first")


def chunk_all(sections: DataFrame, sources: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Final chunks of all documents, with ids."""
    merged = merge_runs(section_chunks(sections, sources, config), config)
    return numbered(merged).withColumn("id", row_id(F.col("url"), F.col("section"), F.col("text")))
