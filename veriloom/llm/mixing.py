"""Mixing sources to target weights by systematic sampling.

Within a source, documents are laid out by size, each with its expected copies r = target / size of the source; one random
offset u is added to the prefix sums, and a document is emitted once for each integer that its piece of the line crosses:
floor(r * (k + 1) + u) - floor(r * k + u) for the k-th. Laid out by size, neighbours are alike, so what is taken stays near
the target. The prefix sums are made of blocks: (source, size class, part of the ids), each of a number of rows that grows with
the table up to BLOCK_ROWS, so no source is ever ordered in one task.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is drawn like
any other; rows alike in id and size are interchangeable; a source of size 0 gets nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import BLOCK_ROWS, SPACE, WORD, cut, maybe_broadcast

#: By turns, in the order of the sources' code points.
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Size classes to a doubling.
CLASSES = 8
#: A block holds the table's rows over BLOCKS, but no fewer than LEAST_ROWS.
BLOCKS, LEAST_ROWS = 1_024, 256


def words(text: Column) -> Column:
    """Each word and the white space behind it becomes one letter, and letters are counted: matches are never listed, so a text of
    a million words costs as many bytes, not as many strings."""
    letters = F.regexp_replace(text, f"{WORD}{SPACE[:-1]}*", "x")
    return F.coalesce(F.length(F.ltrim(letters, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)).cast("long")


def _size_class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size.cast("double")) * CLASSES).cast("int")).otherwise(-1)


def _draw(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id)


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with weight and target: shares of all sizes by weight; what exceeds cap times a source's
    size is shared anew among the others by weight, until none exceeds it. Rounds of two sums each; no source list on the driver."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    have = cut(sources.withColumn("weight", pick).withColumn("most", F.col("source_size") * F.lit(float(cap))))
    total = have.agg(F.sum("source_size")).first()[0] or 0
    rate, before = None, -1
    while True:
        full = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) >= F.col("most")
        weight, held, n = have.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("most"))), F.count(F.when(full, 1))).first()
        if not weight or n == before:
            break
        rate, before = (total - (held or 0.0)) / weight, n
    return have.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(rate or 0.0))).drop("most")


def mix(docs: DataFrame, size: Column, source: Column, doc_id: Column, seed: int = 7, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """A row per document: row (struct of all its columns), size, source_size, target, copies. Only sizes and hashes are kept
    between the passes; size and the draw are recomputed from the row in the last one."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        source.alias("source"), size.alias("size"), _draw(doc_id, seed).alias("draw"), doc_id.alias("id"),
    ).withColumn("class", _size_class(F.col("size")))
    thin = cut(rows.select("source", "class", "size", "draw", "id"))
    groups = cut(thin.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    block = min(BLOCK_ROWS, max(LEAST_ROWS, n_rows // BLOCKS))
    goal = targets(groups.groupBy("source").agg(F.sum("bytes").alias("source_size")), weights, cap)
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(1024)) / 1024.0
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    goal = goal.select(F.col("source").alias("s"), "source_size", "target", rate.alias("rate"), u.alias("u"))
    parts = groups.select(F.col("source").alias("s"), F.col("class").alias("c"), F.ceil(F.col("n") / block).alias("parts"))

    def dealt(df: DataFrame) -> DataFrame:
        at = df["source"].eqNullSafe(F.col("s")) & (df["class"] == F.col("c"))
        return df.join(maybe_broadcast(parts, n_groups), at).drop("s", "c").withColumn("part", F.pmod(F.col("draw"), F.col("parts")))

    line = Window.partitionBy("s").orderBy("c", "p").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt(thin).groupBy(F.col("source").alias("s"), F.col("class").alias("c"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).drop("n")
    blocks = cut(blocks.join(goal.withColumnRenamed("s", "g"), F.col("s").eqNullSafe(F.col("g"))).drop("g"))
    n_blocks = blocks.count()

    def ranked(df: DataFrame) -> DataFrame:
        found = dealt(df)
        at = found["source"].eqNullSafe(F.col("s")) & (found["class"] == F.col("c")) & (found["part"] == F.col("p"))
        order = Window.partitionBy("source", "class", "part").orderBy("size", "draw", F.col("id").asc_nulls_last())
        return found.join(maybe_broadcast(blocks, n_blocks), at).withColumn("k", F.col("before") + F.row_number().over(order) - 1)

    step = F.floor(F.col("rate") * (F.col("k") + 1) + F.col("u")) - F.floor(F.col("rate") * F.col("k") + F.col("u"))
    copies = F.least(F.lit(int(cap)), step).cast("long")
    return ranked(rows).select("row", "size", "source_size", "target", copies.alias("copies"))


def emitted(docs: DataFrame, size: Column, source: Column, doc_id: Column, **how) -> DataFrame:
    """docs as the mix takes it: each row as often as its copies."""
    return mix(docs, size, source, doc_id, **how).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
