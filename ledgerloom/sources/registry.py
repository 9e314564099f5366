"""The registry of approved sources: reading, lookups, allow-list, exports; fetching, landed pages, clean texts and question sets."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.request import Request, urlopen

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, scheme string, title string, url string, allowed boolean"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).csv(path, header=True, mode="FAILFAST")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, html) of files named <doc_id>_<scheme>.html, one row a file."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).alias("doc_id"), F.col("value").alias("html"))


def fetch(sources: DataFrame, agent: str = "ledgerloom", timeout: float = 30.0) -> DataFrame:
    """(doc_id, scheme, html) of all approved sources, fetched by the tasks that hold them.

    Any answer but 200 and any type but text/html is an error of the job: a corpus with a page missing is none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(doc: str, url: str) -> str:
            with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:  # noqa: S310
                kind = r.headers.get_content_type()
                if kind != "text/html":
                    raise ValueError(f"{doc}: expected text/html, got {kind}")
                return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

        for b in batches:
            yield b.assign(html=[one(d, u) for d, u in zip(b["doc_id"], b["url"], strict=True)])[["doc_id", "scheme", "html"]]

    return sources.where("allowed and url is not null").select("doc_id", "scheme", "url").mapInPandas(run, "doc_id string, scheme string, html string")


def land(pages: DataFrame, path: str) -> DataFrame:
    """Write pages (doc_id, scheme, html) as they came, and read them."""
    pages.write.mode("overwrite").parquet(path)
    return pages.sparkSession.read.parquet(path)


def write_clean(texts: DataFrame, path: str) -> DataFrame:
    """Write clean texts (doc_id, text) and read them."""
    texts.write.mode("overwrite").parquet(path)
    return texts.sparkSession.read.parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a written table, or of files named <doc_id>_<scheme>.txt, one row a file."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    if fs.exists(p):
        return spark.read.parquet(path).select("doc_id", "text")
    rows = spark.read.text(f"{path}/*.txt", wholetext=True)
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).alias("doc_id"), F.col("value").alias("text"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def complete(rows: DataFrame, sources: DataFrame, what: str = "cached text") -> DataFrame:
    """``rows`` (doc_id, ...) of approved sources; raises ``FileNotFoundError`` with the first names if any source has none."""
    wanted = sources.where("allowed").select("doc_id", "scheme")
    missing = wanted.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").orderBy(F.col("doc_id").cast("long")).limit(10).collect()
    if missing:
        raise FileNotFoundError(f"no {what} for " + ", ".join(f"{r.doc_id}_{r.scheme}" for r in missing))
    return rows.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")


def lookup(sources: DataFrame, *, doc_id: str | None = None, scheme: str | None = None, url: str | None = None) -> DataFrame:
    """The source of a doc_id, of a scheme (the first by number) or of an address (byte for byte), with the ``label`` that a citation shows."""
    rows = sources.where(F.lit(True) if doc_id is None else F.col("doc_id") == doc_id).where(F.lit(True) if scheme is None else F.col("scheme") == scheme).where(F.lit(True) if url is None else F.col("url") == url)
    return rows.withColumn("label", F.coalesce("title", "url")).orderBy(F.col("doc_id").cast("long"), "doc_id").limit(1)


def read_questions(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One list of a JSON file of question lists."""
    return spark.read.json(path, multiLine=True).select(F.inline(part))


def allowed(urls: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """Rows of ``urls`` whose address is approved, byte for byte."""
    good = sources.where("allowed").select(F.col("url").alias("_u")).distinct()
    return urls.join(good, F.col(url) == F.col("_u"), "left_semi")


def not_allowed(urls: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    good = sources.where("allowed").select(F.col("url").alias("_u")).distinct()
    return urls.join(good, F.col(url) == F.col("_u"), "left_anti")


def normal_url(url: Column) -> Column:
    """Lower-case scheme and host, https, no slash at the end."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/]+)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://[^/]+", ""), "/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path)).otherwise(url)


def write_csv(sources: DataFrame, path: str) -> None:
    """One CSV file in numeric order of doc_id, booleans capitalised."""
    rows = sources.orderBy(F.col("doc_id").cast("long")).select("doc_id", "scheme", "title", "url", F.initcap(F.col("allowed").cast("string")).alias("allowed"))
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, lineSep="\n")


def markdown(sources: DataFrame) -> DataFrame:
    """(doc_id, line): the registry as rows of a Markdown table, in order."""
    line = F.format_string("| %s | %s | %s | %s | %s |", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "scheme", "title", "url", "allowed")))
    return sources.select("doc_id", line.alias("line")).orderBy(F.col("doc_id").cast("long"))
