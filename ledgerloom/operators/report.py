"""Figures and dumps for reviewing an ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.operators.embed import norm


def per_scheme(chunks: DataFrame) -> DataFrame:
    """(scheme, n): chunks by scheme, and TOTAL; a null scheme is a row of its own with an empty name."""
    out = chunks.rollup(F.coalesce("scheme", F.lit("")).alias("scheme")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("scheme", F.lit("TOTAL")).alias("scheme"), "n")


def sizes(chunks: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row: chunks, smallest, mean (whole words) and largest size, how many are under size and how many over budget."""
    w = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != ""))
    return chunks.select(w.alias("w")).agg(F.count(F.lit(1)).alias("chunks"), F.min("w").alias("smallest"), F.expr("sum(w) div count(w)").alias("mean"), F.max("w").alias("largest"), F.count_if(F.col("w") < config.min_size).alias("undersized"), F.count_if(F.col("w") > config.chunk_size + 20).alias("over_budget"))


def per_page(sections: DataFrame) -> DataFrame:
    """(doc_id, sections, kept, words): of each page; words of kept sections, tables included."""
    w = F.size(F.filter(F.split(F.concat_ws(" ", "text", F.array_join("tables", " ")), r"(?U)\s+"), lambda x: x != ""))
    return sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.count_if("kept").alias("kept"), F.sum(F.when(F.col("kept"), w).otherwise(0)).alias("words"))


def dropped(sections: DataFrame, sources: DataFrame) -> DataFrame:
    """(scheme, headings): the distinct headings of dropped sections by scheme, sorted."""
    rows = sections.where("not kept").join(sources.select("doc_id", "scheme"), "doc_id")
    return rows.groupBy("scheme").agg(F.sort_array(F.collect_set("heading")).alias("headings"))


def per_document(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, words) by document."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_words").alias("words"))


def dump(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, line): one line a chunk in order, a preview with the first 110 characters; ``review`` has the whole texts."""
    line = F.format_string("[%03d] %s | %s | %s", "chunk_index", F.coalesce("scheme", F.lit("")), F.coalesce("section", F.lit("")), F.substring("text", 1, 110))
    return chunks.select("doc_id", "chunk_index", line.alias("line")).orderBy(F.col("doc_id").cast("long"), "chunk_index")


def review(chunks: DataFrame, sections: DataFrame, sources: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(part, scheme, doc_id, chunk_index, entry): the review dump, in the order in which it is written.

    Part 0 has the figures, part 1 the dropped sections by scheme with their reasons, part 2 for each document its source
    (with no chunk_index) and its chunks with sizes, warnings and every line of their text.  Nulls are empty.
    """
    found = sections.select("doc_id", "sec_ord", "heading", "kept", "reason").distinct()
    of = lambda name: F.coalesce(name, F.lit(""))
    none = lambda kind: F.lit(None).cast(kind)
    n = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.expr("sum(n_words) div count(n_words)"), F.lit(0)).alias("mean"), F.coalesce(F.min("n_words"), F.lit(0)).alias("least"), F.coalesce(F.max("n_words"), F.lit(0)).alias("most"))
    m = found.agg(F.count(F.lit(1)).alias("sections"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))
    figures = F.format_string(
        f"Parameters   CHUNK_SIZE={config.chunk_size} words  CHUNK_OVERLAP={config.chunk_overlap} words  MIN_SIZE={config.min_size} words\nChunks       %d\nWords        %,d total, %d mean per chunk\nRange        %d - %d words\nSections     %d found, %d kept, %d dropped",
        "chunks", "words", "mean", "least", "most", "sections", "kept", "dropped",
    )
    head = n.crossJoin(m).select(F.lit(0).alias("part"), none("string").alias("scheme"), none("string").alias("doc_id"), none("int").alias("chunk_index"), figures.alias("entry"))
    dropped_line = F.format_string("  [%s] %s  -> %s", of("doc_id"), of("heading"), of("reason"))
    gone = found.where("not kept").join(sources.select("doc_id", "scheme"), "doc_id", "left").select(F.lit(1), of("scheme"), "doc_id", none("int"), dropped_line).distinct()
    totals = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).join(sources.select("doc_id", "title", "url"), "doc_id", "left")
    source = totals.select(F.lit(2), none("string"), "doc_id", none("int"), F.format_string("SOURCE %s  %s\n  url        %s\n  chunks     %d\n  words      %,d", of("doc_id"), F.coalesce("title", F.lit("?")), F.coalesce("url", F.lit("?")), "chunks", "words"))
    warned = F.when(F.size("warnings") > 0, F.concat(F.lit("  warnings=["), F.array_join("warnings", "; "), F.lit("]"))).otherwise("")
    size = F.format_string("        chars=%s  words=%s  source=%s  scheme=%s", of(F.format_number("n_chars", 0)), of(F.col("n_words").cast("string")), of("doc_id"), of("scheme"))
    text = F.concat(F.lit("    "), F.replace(of("text"), F.lit("\n"), F.lit("\n    ")))
    heading = F.when(of("section") != "", F.col("section")).otherwise(of("title"))
    body = chunks.select(F.lit(2), none("string"), "doc_id", F.col("chunk_index").cast("int"), F.concat(F.format_string("[%03d]  ", "chunk_index"), heading, F.lit("\n"), size, warned, F.lit("\n\n"), text))
    return head.union(gone).union(source).union(body).orderBy("part", "scheme", F.col("doc_id").cast("long"), "chunk_index", "entry")


def preview(index: DataFrame, rows: int = 5, dims: int = 10) -> DataFrame:
    """The first vectors of an index: their leading elements, squared length, least and largest element."""
    top = index.orderBy("chunk_index").limit(rows)
    return top.select("chunk_index", F.slice("embedding", 1, dims).alias("head"), F.round(norm(F.col("embedding")) ** 2, 6).alias("square"), F.array_min("embedding").alias("least"), F.array_max("embedding").alias("largest"))
