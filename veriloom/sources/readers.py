"""Readers and writers: Parquet, CSV, JSON lines, raw files and pages, with the schemas of the evidence tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.text import html_text, html_title, sniff_format

# Columns of the evidence tables.
SCHEMAS = {
    "documents": "document_id string, economy string, source_sha256 string, title string, language string, source_url string, local_path string, ocr_applied boolean, full_text string",
    "chunks": "chunk_id string, document_id string, section_label string, char_start int, char_end int, page_start int, page_end int, chunk_kind string, embedding array<float>",
    "mappings": "run_id string, mapping_id string, document_id string, chunk_id string, economy string, indicator_id string, section string, subsection string, verbatim_quote string, page_number int, impact string, score_contribution double, insufficient_evidence boolean, confidence double, verification_status string, uncertainty_flags array<string>, controlling_evidence boolean, extraction_attempts int, timeline struct<adopted:string,entry_into_force:string,last_amended:string,repeal_status:string>",
    "reviews": "run_id string, mapping_id string, status string, reviewer string, comment string, corrected_indicator_id string, reviewed_at timestamp",
    "events": "run_id string, seq bigint, ts string, type string, step string, document_id string, message string",
    "runs": "run_id string, kind string, economy string, pillars array<int>, indicators array<string>, engine string, status string, started_at timestamp, ended_at timestamp, prompt_tokens bigint, completion_tokens bigint, cost_usd double, provider_cost_usd double",
    "crawl_manifest": "url string, economy string, kind string, status string, sha256 string, attempts int, error string, is_duplicate_of string, fetched_at timestamp",
    "document_words": "document_id string, idx int, char_start int, char_end int, page int, x0 double, y0 double, x1 double, y1 double",
    "gate_scores": "chunk_id string, indicator_id string, cosine double",
}


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A folder that executors share: below spark.checkpoint.dir, or a local one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.gettempdir() if (spark.sparkContext.master or "").startswith("local[") else None)
    if not base:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to a shared folder and read again, and the folder."""
    place = shared(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place), place


def remove(spark: SparkSession, place: str) -> None:
    """Deletes a folder in whatever store its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(place)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a run's events; broken lines are dropped."""
    return spark.read.schema(SCHEMAS["events"]).option("mode", "DROPMALFORMED").json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """path, format, sha256, content of each file."""
    return spark.read.format("binaryFile").load(path).select("path", sniff_format(F.col("content")).alias("format"), F.sha2("content", 256).alias("sha256"), "content")


def pages(df: DataFrame, html: str) -> DataFrame:
    """df with title and text of its pages."""
    return df.withColumn("title", html_title(F.col(html))).withColumn("text", html_text(F.col(html)))


def write_csv(df: DataFrame, path: str, order: list) -> None:
    """A small, ordered table as one file. Lists are joined by '; '."""
    flat = df.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Tables of a folder as views, so that plain SQL works."""
    for name in names:
        parquet(spark, folder, name).createOrReplaceTempView(name)


def cache_key(*parts):
    return F.sha2(F.concat_ws("\u001f", *parts), 256)
