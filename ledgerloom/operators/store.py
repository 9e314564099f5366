"""The persisted index: Parquet in a folder named by what it was built from."""

from __future__ import annotations

import hashlib
import re
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.text import row_id

NAME = re.compile(r"^index_[0-9a-f]{8}$")


def content_hash(texts: DataFrame, config: EngineConfig, key: str = "doc_id", text: str = "text") -> str:
    """Eight hexadecimal digits of all texts, their keys and the configuration.

    Documents are hashed where they are; only a fixed number of sums reaches the driver, so their order doesn't matter.
    """
    h = F.sha2(F.concat_ws("|", F.lit(config.schema_version), F.col(key).cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256)), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{i}")
    row = texts.agg(F.count(F.lit(1)).cast("string").alias("n"), *(part(i) for i in range(8))).first()
    joined = "|".join([*(str(x) for x in row), *(f"{k}={v}" for k, v in sorted(asdict(config).items()))])
    return hashlib.sha256(joined.encode()).hexdigest()[:8]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def build(chunks: DataFrame, root: str, name: str, stamp: str, rebuild: bool = False) -> DataFrame:
    """Write ``chunks`` (with ``embedding``) as the index ``name`` below ``root`` and read it.

    The name is that of the content, so an index that is there stays, unless told.  A chunk without a vector, or whose vector
    has another length than the others', is an error, and no index is left.
    """
    spark = chunks.sparkSession
    path = f"{root}/index_{name}"
    if rebuild or not exists(spark, path):
        rows = chunks.withColumn("ingested_at", F.lit(stamp)).withColumn("id", row_id(F.col("url"), F.col("section"), F.col("text"))).withColumnRenamed("text", "document")
        columns = ["id", "chunk_index", "doc_id", "scheme", "title", "section", "url", "ingested_at", "document", "n_merged", "embedding"]
        rows.select(*[c for c in columns if c in rows.columns]).write.mode("overwrite").parquet(path)
        if "embedding" in rows.columns:
            stored = spark.read.parquet(path)
            n, vectors, least, most = stored.agg(F.count(F.lit(1)), F.count("embedding"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
            if n != vectors or least != most:
                fs, p = _fs(spark, path)
                fs.delete(p, True)
                raise RuntimeError(f"{vectors} vectors of {least} to {most} elements for {n} chunks")
    return open_index(spark, root, name)


def open_index(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root}/index_{name}"
    if not exists(spark, path):
        raise RuntimeError(f"no index {name} below {root}: build it first")
    return spark.read.parquet(path)


def orphans(spark: SparkSession, root: str, live: list[str]) -> list[str]:
    """Names of index folders below ``root`` that nothing uses."""
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return sorted(n for n in names if NAME.match(n) and n.removeprefix("index_") not in live)


def prune(spark: SparkSession, root: str, live: list[str]) -> list[str]:
    """Deletes the orphans; other folders are left alone."""
    gone = orphans(spark, root, live)
    for n in gone:
        fs, p = _fs(spark, f"{root}/{n}")
        fs.delete(p, True)
    return gone


def latest(index: DataFrame) -> DataFrame:
    """One row an id: the last ingested, of equals the largest chunk_index."""
    return index.groupBy("id").agg(F.max(F.struct(F.coalesce("ingested_at", F.lit("")).alias("ingested_at"), F.col("chunk_index"), F.col("doc_id"))).alias("v")).select("id", "v.chunk_index", "v.doc_id", "v.ingested_at")


def snapshot_date(files: DataFrame) -> DataFrame:
    """One row: the UTC date of the oldest file read (``_metadata``), today if there is none."""
    return files.select(F.col("_metadata.file_modification_time").alias("t")).agg(F.date_format(F.coalesce(F.min("t"), F.current_timestamp()), "yyyy-MM-dd").alias("snapshot_date"))
