"""Table changes as rewrites, review state, and the fold of fetch events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace rows of old with their key; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_fill(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As upsert, but a null in new keeps the old value."""
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in cols if c in new.columns], F.lit(True).alias("__new"))
    joined = old.join(n, keys, "full")
    return joined.select(*keys, *[F.coalesce(f"__{c}", c).alias(c) if c in new.columns else F.col(c) for c in cols])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New keys are appended, the first of each; known ones stay as they are."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def delete_where(df: DataFrame, doomed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What stays, and what goes, of a cascade by keys."""
    d = doomed.select(*keys).distinct()
    return df.join(d, keys, "left_anti"), df.join(d, keys, "left_semi")


def latest(history: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return history.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def review_counts(mappings: DataFrame, reviews: DataFrame, keys: list[str], status: str = "status", statuses: tuple = ("accepted", "rejected", "flagged", "corrected")) -> DataFrame:
    joined = mappings.join(reviews.select(*keys, F.col(status).alias("__s")), keys, "left")
    return joined.agg(*[F.sum((F.col("__s") == s).cast("long")).alias(s) for s in statuses], F.sum(F.col("__s").isNull().cast("long")).alias("unreviewed"))


def accept_all(mappings: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """history with an acceptance of each mapping that has no decision."""
    fresh = mappings.select(*keys).join(history.select(*keys).distinct(), keys, "left_anti").withColumn("status", F.lit("accepted"))
    return history.unionByName(fresh, allowMissingColumns=True)


def review_queue(mappings: DataFrame, confidence: str, id_: str, keys: list[str]) -> DataFrame:
    """mappings with their place in the whole queue of keys (a run, an economy): least confidence first, missing ones before all."""
    w = Window.partitionBy(*keys).orderBy(F.col(confidence).asc_nulls_first(), id_)
    return mappings.withColumn("place", F.row_number().over(w))


def review_gate(records: DataFrame, reviews: DataFrame, drops: DataFrame, id_: str, indicator: str) -> tuple[DataFrame, DataFrame]:
    """What may ship (accepted, or corrected with a new indicator; drops taken out), and counts withheld by the first indicator."""
    r = records.join(reviews.select(id_, F.col("status").alias("__s"), F.col("corrected").alias("__c")), id_, "left")
    withheld = r.where(F.coalesce(F.col("__s") != "accepted", F.lit(True))).groupBy(indicator).agg(F.count(F.lit(1)).alias("withheld"))
    kept = r.where((F.col("__s") == "accepted") | ((F.col("__s") == "corrected") & F.col("__c").isNotNull())).withColumn(indicator, F.coalesce("__c", indicator)).drop("__s", "__c")
    return kept.join(drops.select(id_), id_, "left_anti"), withheld


def page(df: DataFrame, order: list, limit: int, offset: int) -> tuple[DataFrame, DataFrame]:
    """A page of a table in a full order, and the count of all as a table of one row that is counted when asked."""
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


def manifest(events: DataFrame, url: str = "url", order: str = "seq") -> DataFrame:
    """Fetch events (url, seq, kind: add, fetched, failed, reset; sha256) to the state of each url: the first add names it;
    attempts count fetches and failures; the last of fetched, failed, reset decides; a failure keeps the bytes it had; the same
    bytes under another url are a duplicate of the url that fetched them first."""
    e = events
    state = e.groupBy(url).agg(
        F.min(order).alias("first_seq"),
        F.sum(F.col("kind").isin("fetched", "failed").cast("long")).alias("attempts"),
        F.max_by(F.when(F.col("kind") == "reset", "pending").otherwise(F.col("kind")), F.when(F.col("kind") != "add", F.col(order))).alias("last"),
        F.max_by("sha256", F.when(F.col("kind") == "fetched", F.col(order))).alias("sha256"),
        F.max(F.when(F.col("kind") == "fetched", F.col(order))).alias("fetched_seq"),
    )
    origins = state.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min_by(url, F.struct("fetched_seq", url)).alias("__o"))
    told = state.join(origins, "sha256", "left").withColumn("status", F.coalesce("last", F.lit("pending")))
    return told.withColumn("is_duplicate_of", F.when(F.col("__o") != F.col(url), F.col("__o"))).drop("__o", "last")


def resolved_ids(docs: DataFrame, id_: str, sha: str) -> DataFrame:
    """Ids made unique: where different bytes share an id, the later ones get 12 digits of their digest."""
    first = F.min(sha).over(Window.partitionBy(id_))
    return docs.withColumn("resolved_id", F.when(F.col(sha) == first, F.col(id_)).otherwise(F.concat(F.col(id_), F.lit("_"), F.substring(sha, 1, 12))))


def replay_delays(events: DataFrame, run: str, seq: str, ts: str, speed: float, max_gap: float) -> DataFrame:
    """delay before each event: the gap to the one before over the speed, between 0 and max_gap; 0 for the first."""
    gap = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(Window.partitionBy(run).orderBy(seq)))) / 1e6
    return events.withColumn("delay", F.coalesce(F.least(F.lit(max_gap), F.greatest(F.lit(0.0), gap / speed)), F.lit(0.0)))


def unfinished_steps(events: DataFrame, run: str, step: str, kind: str) -> DataFrame:
    """Steps that a run started and didn't finish."""
    done = events.where(F.col(kind) == "finished").select(run, step).distinct()
    return events.where(F.col(kind) == "started").select(run, step).distinct().join(done, [run, step], "left_anti")
