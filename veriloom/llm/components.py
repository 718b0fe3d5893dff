"""Connected components of a graph given as links, by alternating large and small stars.

Each round is two aggregations and two joins over the links, hubs apart; nothing is gathered on the driver but the count of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import BLOCK_ROWS, cut, remove, stored

#: Nodes that may be told map-side.
HUBS = 50_000


def _told(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """rows with m of their node a. Nodes of very many rows, fewer than HUBS by their count, are told map-side, the others by a
    shuffle, so the label that a giant component shares is no task of its own."""
    least = cut(least)
    many = F.col("n") > max(BLOCK_ROWS, n // HUBS)
    hubs = F.broadcast(least.where(many).select("a", F.col("m").alias("hub_m")))
    split = rows.join(hubs, "a", "left")
    rest = split.where("hub_m IS NULL").drop("hub_m").join(least.where(~many).select("a", "m"), "a")
    return split.where("hub_m IS NOT NULL").withColumnRenamed("hub_m", "m").unionByName(rest)


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Links each node's larger neighbours to the least of its neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _told(both, least, n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them. Links run from larger a to smaller b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _told(links, least, n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of comparable ids, never null, to (node, label): label is the least node of the component. Nodes without a link to
    another node are left out; self links and repeated links are harmless; no links give no rows."""
    now, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        after, written = stored(_small_star(_large_star(now, mark[0]), mark[0]))
        remove(links.sparkSession, path)
        now, path, before, mark = after, written, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _mark(links: DataFrame) -> tuple:
    """Count and an order-free digest of the links."""
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)
