"""What a reviewer is shown of a run: its documents, the pillars it covered, the engine of record and what may be exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("accepted", "rejected", "flagged", "corrected")


def document_summaries(records: DataFrame, reviews: DataFrame, document: str, id_: str, status: str = "status") -> DataFrame:
    """document, n_records and the number of its records of each review status (reviews: one a record)."""
    told = records.select(document, id_).join(reviews.select(id_, F.col(status).alias("__s")), id_, "left")
    counts = [F.count_if(F.col("__s") == s).alias(f"n_{s}") for s in STATUSES]
    return told.groupBy(document).agg(F.count(F.lit(1)).alias("n_records"), *counts)


def pillar(indicator: Column) -> Column:
    """The number before the first point."""
    return F.substring_index(indicator, ".", 1).try_cast("int")


def pillars_covered(records: DataFrame, scores: DataFrame, run: str, indicator: str) -> DataFrame:
    """(run, pillar) that a run mapped or screened, each once."""
    return records.select(run, indicator).unionByName(scores.select(run, indicator)).select(run, pillar(F.col(indicator)).alias("pillar")).distinct()


def engine_of_record(log: DataFrame, keys: list[str], method: str, id_: str, known: list[str], default: str) -> DataFrame:
    """keys, engine: what the last row `engine:<name>` names, the default where the registry doesn't know it or no row does."""
    named = F.col(method).rlike("^engine:")
    last = log.groupBy(*keys).agg(F.max_by(F.when(named, F.substring(method, 8, 1 << 20)), F.when(named, F.col(id_))).alias("engine"))
    return last.withColumn("engine", F.when(F.col("engine").isin(*known), F.col("engine")).otherwise(default))
