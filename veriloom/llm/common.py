"""What the corpus operators share: reading, cutting lineage, blocks of bounded size."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage has it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a block: what one task ranks or sums in order.
BLOCK_ROWS = 20_000
#: Rows up to which a table of blocks or groups is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_arrow_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds what a Python worker holds: so many whole texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def checkpoint_dir(spark: SparkSession) -> None:
    """The folder named by spark.checkpoint.dir; one of our own only on a single machine without that setting."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        spark.sparkContext.setCheckpointDir(set_dir)
        return
    if not (spark.sparkContext.master or "").startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "veriloom-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives lost executors and is computed once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written below the shared folder and read again, and its path. For iterations: a checkpoint hands on the size that the
    planner guesses, which the joins of each round square until planning stalls; files have the size they have."""
    checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows: the counted rows of df. Beyond the limit the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def rows_kept(docs: DataFrame, thin: DataFrame, keepers: DataFrame, named: Callable[[Column], Column], text: str, doc_id: str) -> DataFrame:
    """The rows of docs that keepers (doc_id, fp) name, one for each, with all their columns. thin has (doc_id, fp) of all rows, named
    gives the fp of a text. Whole rows are shuffled only where more than BROADCAST_ROWS ids go: fewer are told map-side."""
    often = cut(thin.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("o")))
    n_often = often.count()
    ids = keepers.select(F.col("doc_id").alias("k")).where("k IS NOT NULL")
    away = thin.select("doc_id").where("doc_id IS NOT NULL").join(ids, F.col("doc_id") == F.col("k"), "left_anti")
    away = cut(away.unionByName(often.select(F.col("o").alias("doc_id")).where("doc_id IS NOT NULL")).distinct().select(F.col("doc_id").alias("g")))
    n_away = away.count()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("__id"))
    if n_away <= BROADCAST_ROWS:
        once = packed.where("__id IS NOT NULL").join(F.broadcast(away), F.col("__id") == F.col("g"), "left_anti")
    else:
        single = ids.join(often, F.col("k") == F.col("o"), "left_anti") if n_often else ids
        once = packed.join(single, F.col("__id") == F.col("k"), "left_semi")
    if not n_often:
        return once.select("row.*")
    # rows that share a doc_id, or have none: one row with the fingerprint that was kept
    checked = cut(keepers.join(often, F.col("doc_id").eqNullSafe(F.col("o"))).select(F.col("doc_id").alias("k"), F.col("fp").alias("f")))
    again = packed.join(maybe_broadcast(checked, checked.count()), F.col("__id").eqNullSafe(F.col("k"))).where(named(F.col(f"row.`{text}`")) == F.col("f"))
    ranked = Window.partitionBy("__id", "f").orderBy(F.xxhash64(F.col(f"row.`{text}`")))
    return once.select("row.*").union(again.withColumn("__r", F.row_number().over(ranked)).where("__r = 1").select("row.*"))


def give_back() -> None:
    """Hands memory that a Python worker has freed back to the system, so that a worker that waits holds little. Does nothing where
    the C library has no such call."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
    pa.default_memory_pool().release_unused()


def bounded_sample(df: DataFrame, key: Column, most: int, slack: float = 2.0) -> DataFrame:
    """min(n, most) rows: those with the least hash of the key and the row's other values. A first cut by hash, from the count,
    keeps what is ranked small whatever the size of df; where repeated rows leave too few under the cut, it is widened, so
    it decides nothing. Rows alike in all columns share a hash and are interchangeable."""
    n = df.count()
    draw = F.pmod(F.xxhash64(key, *[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 40))
    share = slack * most / max(n, 1)
    while share < 1:
        some = df.where(draw < int((1 << 40) * share))
        if some.count() >= most:
            return some.orderBy(draw).limit(most)
        share *= 8
    return df.orderBy(draw).limit(most)


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with their number (from 0) among those alike in keys (nulls are alike), in an order of their own. Rows are cut
    first, so that the numbers survive a lost executor; a block of BLOCK_ROWS neighbours is the most that one key ranks in a task."""
    marked = rows.withColumn("__rid", F.monotonically_increasing_id())
    marked = cut(marked.withColumn("__block", F.floor(F.col("__rid") / BLOCK_ROWS)))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    blocks = cut(blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where("__before > 0").drop("__n"))
    at = [F.col(f"m.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__block"]]
    placed = marked.alias("m").join(maybe_broadcast(blocks, blocks.count()).alias("b"), reduce(and_, at), "left")
    inside = Window.partitionBy(*keys, "__block").orderBy("__rid")
    placed = placed.select("m.*", F.coalesce("b.__before", F.lit(0)).alias("__before"))
    return placed.withColumn(name, F.col("__before") + F.row_number().over(inside) - 1).drop("__rid", "__block", "__before")
