"""Queries on chunking and the mapping funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.operators import chunking, mapping
from veriloom.operators.evidence import ABSENCE
from veriloom.plans.catalogue import query
from veriloom.sources.readers import parquet as T

_STATUTE = "s AS (SELECT o_custkey AS doc, 'An Act of ' || o_custkey || chr(10) || string_agg('Section ' || n || '. Title' || chr(10) || 'text of order ' || o_orderkey || ' which is long enough to quote', chr(10) ORDER BY n) AS text, count(*) AS k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY o_custkey)"


def statutes(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the sections of an act."""
    o = T(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    section = lambda x, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(". Title\ntext of order "), x.cast("string"), F.lit(" which is long enough to quote"))
    return o.select(F.col("o_custkey").alias("doc"), F.concat(F.lit("An Act of "), F.col("o_custkey").cast("string"), F.lit("\n"), F.array_join(F.transform("k", section), "\n")).alias("text"))


@query(f"WITH {_STATUTE} SELECT doc, CASE WHEN k >= 2 THEN 1 + k ELSE 1 END AS chunks, length(text) AS covered FROM s")
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each act and the characters they cover."""
    c = chunking.chunks(statutes(spark, d), "doc", "text")
    return c.groupBy("doc").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("char_end") - F.col("char_start")).alias("covered"))


@query(None)
def passage_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every passage with its label and place: breaks are looked for in turn, beyond SQL; held against brute force."""
    return chunking.chunks(T(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("""WITH p AS (SELECT doc_id, i AS indicator, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) >= 40)[1] AS line FROM documents, (SELECT unnest(['6.1', '6.2', '6.3', '6.4', '7.1', '7.2', '7.3', '7.4', '7.5']) AS i)),
s AS (SELECT *, CASE WHEN indicator = '7.3' THEN 'dropped' WHEN indicator = '7.1' OR line IS NULL THEN 'no_evidence' WHEN length(line) > 1500 THEN 'dropped' ELSE 'passed' END AS status FROM p)
SELECT doc_id, indicator, status, CASE WHEN status = 'dropped' THEN 3 ELSE 1 END AS extraction_attempts FROM s""")
def scripted_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Every document against every indicator with the scripted model: quotes are checked, failures retried, then dropped."""
    pairs = T(spark, d, "documents").select("doc_id", "text").crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in ABSENCE], "indicator string")))
    return mapping.run(pairs, "indicator", "text").select("doc_id", "indicator", "status", "extraction_attempts")
