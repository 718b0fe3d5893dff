"""Exact dedup by a heavy-hitter split, in DataFrame and SQL functions alone.

A Misra-Gries summary (the frequent-items sketch behind approx_top_k) names the candidates for frequent digests; their
exact counts are taken, and the winners, at most HEAVY of them, are broadcast, so that their copies are settled where they
are read. All other digests are grouped by an ordinary shuffle. The summary only decides which way a row takes, never the result.

Defined cases: a null text counts as empty; a null doc_id ranks last (a group of null ids keeps one of them, with keep_id null);
rows that repeat doc_id and text are ranked by an order of their own, so exactly one row of a group is kept; an empty table
gives no rows; other columns, whatever their names, pass through keep_first as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import SPACE, cut, rows_kept

#: Counters of the summary, and the winners that may be broadcast (64 bytes of digest each).
COUNTERS, HEAVY = 16_384, 1_024
#: A digest is settled map-side from so many copies on.
HEAVY_ROWS = 32


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


def frequent(thin: DataFrame) -> DataFrame:
    """Verified winners of the summary over thin (text_sha256, doc_id, rid): text_sha256, keep_id, keep_rid (the row that stays),
    group_size."""
    named = thin.agg(F.expr(f"approx_top_k(text_sha256, {HEAVY}, {COUNTERS})").alias("t")).select(F.explode("t.item").alias("text_sha256"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    won = thin.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(first.alias("k"), F.count(F.lit(1)).alias("group_size"))
    return won.where(F.col("group_size") >= HEAVY_ROWS).select("text_sha256", F.col("k.doc_id").alias("keep_id"), F.col("k.rid").alias("keep_rid"), "group_size")


def _thin(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Ids and digests, with a number of each row that is fixed by the checkpoint."""
    return cut(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("text_sha256"), F.monotonically_increasing_id().alias("rid")))


def _judged(thin: DataFrame) -> DataFrame:
    tagged = thin.join(F.broadcast(cut(frequent(thin))), "text_sha256", "left")
    settled = F.col("group_size").isNotNull()
    copies = tagged.where(settled).withColumn("kept", F.col("rid") == F.col("keep_rid"))
    ranked = Window.partitionBy("text_sha256").orderBy(F.col("doc_id").asc_nulls_last(), "rid")
    whole = Window.partitionBy("text_sha256")
    rest = (
        tagged.where(~settled)
        .withColumn("kept", F.row_number().over(ranked) == 1)
        .withColumn("keep_id", F.min("doc_id").over(whole))
        .withColumn("group_size", F.count(F.lit(1)).over(whole))
    )
    return copies.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Only ids and digests are shuffled."""
    return _judged(_thin(docs, text, doc_id))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns: judged by ids and digests, then told which rows go."""
    thin = _thin(docs, text, doc_id)
    keepers = cut(_judged(thin).where("kept").select("doc_id", F.col("text_sha256").alias("fp")))
    return rows_kept(docs, thin.select("doc_id", F.col("text_sha256").alias("fp")), keepers, digest, text, doc_id)
