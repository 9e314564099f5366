"""Section filters, and the clean text that sections are written to and read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import rules
from ledgerloom.functions.text import heading as heading_text
from ledgerloom.functions.text import words


def keep_lines(text: Column) -> Column:
    """The lines up to the first cut marker, without empty, interface and return-claim lines."""
    lines = F.split(text, "\n", -1)
    good = F.filter(lines, lambda x: (x != "") & ~x.rlike(rules.java(rules.JUNK_LINE)) & ~x.rlike(rules.java(rules.DROP_LINE)))
    is_stop = F.transform(good, lambda x: F.exists(F.array(*map(F.lit, rules.STOP_AT)), lambda s: F.startswith(F.lower(F.trim(x)), s)))
    stop = F.array_position(is_stop, True)
    return F.trim(F.array_join(F.when(stop > 0, F.slice(good, 1, (stop - 1).cast("int"))).otherwise(good), "\n"))


def finalise(raw: DataFrame) -> DataFrame:
    """``raw`` with filtered ``text`` and ``tables``, and with ``kept`` and ``reason``.

    A section is dropped for its heading, and then has no text, or because nothing is left of it.  Null headings
    are kept, null texts and tables are empty; other columns stay.
    """
    drop = F.coalesce(rules.dropped_heading(F.col("heading")), F.lit(False))
    text = F.when(drop, F.lit("")).otherwise(F.coalesce(keep_lines(F.col("text")), F.lit("")))
    tables = F.when(drop, F.array().cast("array<string>")).otherwise(F.filter(F.coalesce("tables", F.array().cast("array<string>")), lambda r: ~r.rlike(rules.java(rules.DROP_LINE))))
    out = raw.withColumns({"text": text, "tables": tables})
    empty = (F.col("text") == "") & (F.size("tables") == 0)
    reason = F.when(drop, F.concat(F.lit("dropped section: '"), "heading", F.lit("'"))).when(empty, "empty after filtering").otherwise("")
    return out.withColumns({"kept": ~drop & ~empty, "reason": reason})


def n_words() -> Column:
    """Words of a section: text and tables."""
    return F.size(section_words())


def section_words() -> Column:
    return words(F.concat_ws(" ", F.col("text"), F.array_join("tables", "\n")))


def render(sections: DataFrame) -> DataFrame:
    """(doc_id, title, text): the kept sections of each document as text with one heading line a section.

    A line that looks like a heading gets a space before it.  At most a document is gathered.
    """

    def body(line: Column) -> Column:
        return F.when(line.rlike(r"^#{1,6}[ \t]+.+$"), F.concat(F.lit(" "), line)).otherwise(line)

    kept = sections.where("kept").where((F.col("text") != "") | (F.size("tables") > 0))
    lines = F.concat(
        F.array(F.concat_ws(" ", F.repeat(F.lit("#"), F.least(F.lit(6), F.col("level") + 1)), "heading")),
        F.transform(F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1)), body),
        F.transform("tables", body),
    )
    docs = sections.select("doc_id", "title").groupBy("doc_id").agg(F.max("title").alias("title"))
    parts = kept.select("doc_id", "sec_ord", lines.alias("lines")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sec_ord", "lines"))).alias("parts"))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.coalesce("title", F.lit("")))), F.coalesce(F.flatten(F.col("parts.lines")), F.array().cast("array<string>"))), "\n")
    return docs.join(parts, "doc_id", "left").select("doc_id", "title", F.concat(F.trim(text), F.lit("\n")).alias("text"))


def parse_clean(texts: DataFrame) -> DataFrame:
    """Sections (doc_id, title, sec_ord, level, heading, text, tables) of clean texts (doc_id, text), the inverse of ``render``.

    Table rows come back as lines.  The section of a line is the running count of headings above it.
    """
    pattern = r"^(#{1,6})[ \t]+(.+)$"
    lines = texts.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "raw")).withColumn("line", F.regexp_replace("raw", r"(?U)\s+$", "")).where(F.trim("line") != "")
    marks = F.length(F.regexp_extract("line", pattern, 1))
    in_doc = Window.partitionBy("doc_id").orderBy("ln")
    placed = lines.withColumns({"marks": marks, "name": heading_text(F.regexp_extract("line", pattern, 2))}).withColumn("part", F.sum(F.when(F.col("marks") > 1, 1).otherwise(0)).over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    title = placed.groupBy("doc_id").agg(F.max_by("name", F.when(F.col("marks") == 1, F.col("ln"))).alias("own"), F.min_by("name", F.when(F.col("marks") > 1, F.col("ln"))).alias("first")).select("doc_id", F.coalesce("own", "first", F.lit("")).alias("title"))
    stripped = F.trim(F.regexp_replace("line", "^ ", ""))
    parts = placed.where((F.col("part") > 0) & (F.col("marks") != 1)).groupBy("doc_id", "part").agg(
        F.max(F.when(F.col("marks") > 1, F.col("marks") - 1)).cast("int").alias("level"),
        F.max(F.when(F.col("marks") > 1, F.col("name"))).alias("heading"),
        F.sort_array(F.collect_list(F.when(F.col("marks") == 0, F.struct("ln", stripped.alias("line"))))).alias("lines"),
    )
    return parts.join(title, "doc_id").select("doc_id", "title", (F.col("part") - 1).cast("int").alias("sec_ord"), "level", "heading", F.array_join("lines.line", "\n").alias("text"), F.array().cast("array<string>").alias("tables"))
