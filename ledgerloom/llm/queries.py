"""Registered queries of this subpackage: ``pN_...`` for problem N, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import boilerplate, knn, leakage, neardup, packing, repeated, splitting, subjects
from ledgerloom.shipping import ship

NEAR = neardup.Near(words=3, similarity=0.6, least_tokens=20)


def _read(spark: SparkSession, at: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{at}/{table}.parquet")


def _bodies(spark: SparkSession, at: str) -> boilerplate.Bodies:
    return boilerplate.main_bodies(_read(spark, at, "html_pages"), _read(spark, at, "sources").select("doc_id", "url", "site"))


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    """Blocks of pages and lines of sections that belong to the main body."""
    bodies = _bodies(spark, at)
    blocks = bodies.blocks.select(F.lit("page").alias("src"), "doc_id", "pos", F.lit(0).alias("ln"))
    lines = boilerplate.main_lines(_read(spark, at, "sections"), bodies)
    return blocks.unionByName(lines.select(F.lit("section").alias("src"), "doc_id", F.col("sec_ord").alias("pos"), "ln"))


def p1_page_sizes(spark: SparkSession, at: str) -> DataFrame:
    """Blocks of each page, and how many of them are main body."""
    bodies = _bodies(spark, at)
    kept = bodies.blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"))
    pages = bodies.parsed.groupBy("doc_id").agg(F.max(F.size("pos")).alias("n_blocks"))
    return pages.join(kept, "doc_id", "left").select("doc_id", F.col("n_blocks").cast("long").alias("n_blocks"), F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"))


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    """All pairs of near-duplicate chunks."""
    pairs = neardup.expanded(neardup.near_duplicates(_read(spark, at, "chunks"), "chunk_index", "body", NEAR))
    return pairs.select(F.col("a").cast("int").alias("chunk_a"), F.col("b").cast("int").alias("chunk_b"))


def p2_groups(spark: SparkSession, at: str) -> DataFrame:
    """One row a chunk: its class of equal bodies, its group of near ones, and its class's links."""
    return neardup.groups(neardup.near_duplicates(_read(spark, at, "chunks"), "chunk_index", "body", NEAR)).withColumnRenamed("id", "chunk_index")


def p3_pieces(spark: SparkSession, at: str) -> DataFrame:
    """The pieces of all oversized texts of sections and chunks."""
    sections = _read(spark, at, "sections").select("doc_id", F.col("sec_ord").alias("pos"), F.lit("section.text").alias("field"), F.col("text").alias("body"))
    chunks = _read(spark, at, "chunks")
    # one reader for each table: the two fields of a chunk come from one row
    texts = sections.unionByName(chunks.select("doc_id", F.col("chunk_index").alias("pos"), F.inline(F.array(F.struct(F.lit("chunk.text").alias("field"), F.col("text").alias("body")), F.struct(F.lit("chunk.body").alias("field"), F.col("body").alias("body"))))))
    return splitting.split_oversized(texts, ["field", "doc_id", "pos"], "body")


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    """Texts that had to be cut."""
    return p3_pieces(spark, at).where("piece = 0").select("field", "doc_id", "pos").distinct()


def _neighbours(spark: SparkSession, at: str) -> DataFrame:
    return knn.nearest(_read(spark, at, "index_rows"), "id", "chunk_index", "embedding", "ingested_at")


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    """Pairs of chunks of which one is among the five most similar of the other."""
    pairs = _neighbours(spark, at).select(F.least("item", "other").cast("int").alias("chunk_a"), F.greatest("item", "other").cast("int").alias("chunk_b"))
    return pairs.distinct()


def p4_neighbours(spark: SparkSession, at: str) -> DataFrame:
    """The five most similar chunks of every chunk whose index is divisible by 100, by rank, against all."""
    return _neighbours(spark, at).where("item % 100 = 0").select(F.col("item").cast("int").alias("chunk_index"), F.col("rank").cast("int").alias("rank"), F.col("other").cast("int").alias("neighbour"), F.round("similarity", 3).alias("similarity"))


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    """Occurrences of lines repeated across a site."""
    return repeated.repeated_lines(_read(spark, at, "sections")).select("doc_id", "sec_ord", "ln").distinct()


def p5_templates(spark: SparkSession, at: str) -> DataFrame:
    """The repeated templates of each site, with the documents they cover."""
    return repeated.repeated_templates(_read(spark, at, "sections")).select("site", "template", "n_docs", "site_docs")


def p5_slots(spark: SparkSession, at: str) -> DataFrame:
    """Templates with slots learnt from lines that differ in some words, and how many different lines each has."""
    rows = repeated.repeated_templates(_read(spark, at, "sections"), repeated.Cover(alike=0.6))
    return rows.where(F.contains("template", F.lit(repeated.ANY)))


def p5_clean(spark: SparkSession, at: str) -> DataFrame:
    """Sections without repeated lines: what is left of each."""
    rows = repeated.without_repeated(_read(spark, at, "sections"))
    return rows.select("doc_id", "sec_ord", F.length("text").alias("chars"), F.length("clean_text").alias("clean_chars"), F.col("clean_heading").alias("heading")).distinct()


def _packed(spark: SparkSession, at: str) -> DataFrame:
    return packing.pack_documents(_read(spark, at, "documents"), "doc_id", "text")


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    """Documents that alone exceed a container: those that were cut."""
    return _packed(spark, at).where("n_pieces > 1").select("doc_id").distinct()


def p6_bins(spark: SparkSession, at: str) -> DataFrame:
    """Containers by shard: what they hold, and how full they are together."""
    bins = _packed(spark, at).groupBy("shard", "bin").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"))
    out = bins.groupBy("shard").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.max("segments").alias("most_segments"))
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * packing.Limits().tokens), 6))


def p6_instructions(spark: SparkSession, at: str) -> DataFrame:
    """Chunks as instruction examples (title and section ask, the body answers) in containers of 4,096 tokens, 16 examples and 2,048
    loss-bearing tokens: how full they are by each limit, and how many containers each limit closes."""
    limits = packing.Limits(segments=16, loss=2048)
    rows = _read(spark, at, "chunks").select("chunk_index", F.concat_ws(" ", "title", "section").alias("ask"), "body")
    bins = packing.pack_examples(rows, "chunk_index", "ask", "body", limits).groupBy("shard", "bin").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("n_loss").alias("loss"))
    full = lambda c, most: F.round(F.sum(c) / (F.count(F.lit(1)) * most), 6)
    return bins.groupBy("shard").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("segments").alias("segments"), F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"), F.max("tokens").alias("most_tokens"), F.max("segments").alias("most_segments"), F.max("loss").alias("most_loss"),
        full("tokens", limits.tokens).alias("token_fill"), full("segments", limits.segments).alias("segment_fill"), full("loss", limits.loss).alias("loss_fill"),
        F.count_if(F.col("segments") == limits.segments).alias("closed_by_segments"), F.count_if(F.col("loss") > limits.loss - 64).alias("closed_by_loss"),
    )


def _leaks(spark: SparkSession, at: str, exchanged: bool = True) -> DataFrame:
    return leakage.leaks(_read(spark, at, "documents"), _read(spark, at, "in_scope"), exchanged=exchanged)


def p7_found(spark: SparkSession, at: str) -> DataFrame:
    """Documents and the items that they hold word for word."""
    return _leaks(spark, at, exchanged=False).where("literal").select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, at: str) -> DataFrame:
    """Documents with items, word for word or with other numbers, names or units."""
    return _leaks(spark, at)


def _model(spark: SparkSession, at: str) -> subjects.Model:
    return subjects.train(_read(spark, at, "documents"), _read(spark, at, "labels"), _read(spark, at, "subjects"))


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    """The one or two subjects of each document."""
    return subjects.subjects_of(_read(spark, at, "documents"), _model(spark, at)).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, at: str) -> DataFrame:
    """The make-up of the collection: documents and sentences by subject."""
    rows = subjects.mixtures(_read(spark, at, "documents"), _model(spark, at))
    return rows.groupBy("subject").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum("n_about").alias("n_sentences"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_page_sizes, p2_found, p2_groups, p3_found, p3_pieces, p4_found, p4_neighbours, p5_found, p5_templates, p5_slots, p5_clean, p6_found, p6_bins, p6_instructions, p7_found, p7_leaks, p8_found, p8_composition)}


_LINES5 = r"""
lines AS (
  SELECT site, doc_id, sec_ord, -1 AS ln, heading AS line FROM sections WHERE sec_ord <> 0 AND heading IS NOT NULL AND doc_id IS NOT NULL
  UNION ALL
  SELECT site, doc_id, sec_ord, CAST(i - 1 AS INTEGER), parts[i] FROM (
    SELECT site, doc_id, sec_ord, parts, unnest(range(1, len(parts) + 1)) AS i
    FROM (SELECT site, doc_id, sec_ord, string_split(text, chr(10)) AS parts FROM sections WHERE text IS NOT NULL AND doc_id IS NOT NULL))
),
keyed AS (SELECT *, regexp_replace(regexp_replace(lower(line), '\d+', '0', 'g'), '[^\p{L}\p{N}]', '', 'g') AS template FROM lines),
sites AS (SELECT site, count(DISTINCT doc_id) AS site_docs FROM sections WHERE doc_id IS NOT NULL GROUP BY site),
covered AS (
  SELECT k.site, k.template, count(DISTINCT k.doc_id) AS n_docs, any_value(s.site_docs) AS site_docs
  FROM keyed k JOIN sites s ON k.site IS NOT DISTINCT FROM s.site WHERE k.template <> '' GROUP BY k.site, k.template
  HAVING count(DISTINCT k.doc_id) >= 4 AND count(DISTINCT k.doc_id) >= 0.3 * any_value(s.site_docs)
)"""

_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say over whole tables; the others are tested against brute force in ``tests/llm``."""
    case = "(length(COLUMN) > 2000 OR len(regexp_extract_all(COLUMN, '[^SPACE]+')) > 250)".replace("SPACE", _SPACE)
    return {
        "p2_found": """
WITH t AS (SELECT chunk_index AS id, regexp_extract_all(lower(body), '[a-z0-9]+') AS ts FROM chunks WHERE body IS NOT NULL AND chunk_index IS NOT NULL),
s AS (SELECT DISTINCT id, ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2] AS run FROM (SELECT id, ts, unnest(range(1, len(ts) - 1)) AS i FROM t WHERE len(ts) >= 20)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2)
SELECT a AS chunk_a, b AS chunk_b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9""",
        "p3_found": " UNION ".join(f"SELECT '{field}' AS field, doc_id, {pos} AS pos FROM {table} WHERE {case.replace('COLUMN', column)}" for field, table, pos, column in (("section.text", "sections", "sec_ord", "text"), ("chunk.text", "chunks", "chunk_index", "text"), ("chunk.body", "chunks", "chunk_index", "body"))),
        "p5_found": f"WITH {_LINES5} SELECT DISTINCT k.doc_id, k.sec_ord, k.ln FROM keyed k JOIN covered c ON k.template = c.template AND k.site IS NOT DISTINCT FROM c.site",
        "p4_neighbours": """
WITH v AS (SELECT id, chunk_index, coalesce(ingested_at, '') AS stamp, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM index_rows WHERE id IS NOT NULL AND chunk_index IS NOT NULL AND len(embedding) = 384),
fit AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
last AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY id ORDER BY stamp DESC) = 1),
pairs AS (SELECT a.chunk_index, b.chunk_index AS neighbour, list_cosine_similarity(a.e, b.e) AS s FROM last a JOIN last b ON a.chunk_index % 100 = 0 AND a.chunk_index <> b.chunk_index),
best AS (SELECT *, row_number() OVER (PARTITION BY chunk_index ORDER BY s DESC, neighbour) AS rank FROM pairs QUALIFY rank <= 5)
SELECT chunk_index, CAST(rank AS INTEGER) AS rank, neighbour, round(s, 3) AS similarity FROM best""",
        "p5_clean": rf"""
WITH {_LINES5},
gone AS (SELECT DISTINCT k.site, k.doc_id, k.sec_ord, k.ln FROM keyed k JOIN covered c ON k.template = c.template AND k.site IS NOT DISTINCT FROM c.site),
lists AS (SELECT site, doc_id, sec_ord, list(ln) AS gone FROM gone GROUP BY ALL),
s AS (SELECT s.*, coalesce(l.gone, []) AS gone FROM sections s LEFT JOIN lists l ON s.doc_id = l.doc_id AND s.sec_ord = l.sec_ord AND s.site IS NOT DISTINCT FROM l.site),
kept AS (SELECT doc_id, sec_ord, heading, text, gone, CASE WHEN text IS NOT NULL THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, CAST(i - 1 AS INTEGER))), chr(10)) END AS clean FROM s)
SELECT DISTINCT doc_id, sec_ord, CAST(length(text) AS INTEGER) AS chars, CAST(length(clean) AS INTEGER) AS clean_chars, CASE WHEN NOT list_contains(gone, -1) THEN heading END AS heading FROM kept""",
        "p5_templates": f"WITH {_LINES5} SELECT site, template, n_docs, site_docs FROM covered",
        "p6_found": "SELECT DISTINCT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 4096",
        "p7_found": r"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS body, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, array_to_string(t[i:i + 11], ' ') AS run FROM (SELECT doc_id, t, unnest(range(1, len(t) - 10)) AS i FROM d)),
p AS (SELECT DISTINCT id, array_to_string(t[i:i + 11], ' ') AS run FROM (SELECT id, t, unnest(range(1, len(t) - 10)) AS i FROM (SELECT id, regexp_extract_all(lower(passage), '[a-z0-9]+') AS t FROM in_scope))),
q AS (SELECT DISTINCT id, array_to_string(regexp_extract_all(lower(question), '[a-z0-9]+'), ' ') AS run FROM in_scope WHERE question IS NOT NULL)
SELECT DISTINCT doc_id, id AS item_id FROM w JOIN p USING (run)
UNION SELECT doc_id, id FROM d JOIN q ON q.run <> '' AND contains(d.body, ' ' || q.run || ' ')""",
    }
