"""Resharding by minimum-cost flow.

From the old shards' sizes and the new shards' capacities a flow is solved on a bipartite graph of shards (bounded by their
number, on the driver): a byte that stays costs nothing, a byte that moves costs one. The flow is carried out in blocks: each
old shard is a line of blocks of about BLOCK_ROWS rows in hash order, and cut points on that line say which stretch goes
where; only a block with a cut in it is split. Documents over 1/GRAIN of a shard (at most GRAIN times the shards, a bound that
doesn't grow with the corpus) are placed first, one by one, at home where they fit. Law: bytes.

plan says where each row goes; rewrite carries a plan out on a folder of shard=N folders, and reshard does both.

Defined cases: a null text has 16 bytes and the CRC of the empty text; a null doc_id hashes like any value; rows alike in
id, size and CRC are interchangeable, and each is written once; an empty table gives no rows; other columns, whatever their
names, are written as they are.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import BLOCK_ROWS, cut, maybe_broadcast, numbered, remove

SHARDS = 40
#: A document over the capacity / GRAIN counts as a block of its own.
GRAIN = 256


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16)


def min_cost_flow(supply: list[int], room: list[int], cost) -> dict[tuple[int, int], int]:
    """Successive shortest paths (Dijkstra with potentials) from each supply to each room; cost(i, j) >= 0 a unit.
    The sum of supply must not exceed that of room. Returns the positive flows."""
    n, m = len(supply), len(room)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, space = list(supply), list(room)
    price = [0.0] * (n + m)
    while any(left):
        dist = [float("inf")] * (n + m)
        came: list[int] = [-1] * (n + m)
        heap = [(0.0, i) for i in range(n) if left[i]]
        for _, i in heap:
            dist[i] = 0.0
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            if v < n:
                steps = [(n + j, cost(v, j)) for j in range(m)]
            else:
                steps = [(i, -cost(i, v - n)) for i in range(n) if flow[i, v - n] > 0]
            for w, c in steps:
                to = d + max(0.0, c + price[v] - price[w])
                if to < dist[w]:
                    dist[w], came[w] = to, v
                    heapq.heappush(heap, (to, w))
        ends = [j for j in range(m) if space[j] > 0 and dist[n + j] < float("inf")]
        if not ends:
            raise ValueError("the new shards cannot hold the old ones")
        best = min(ends, key=lambda j: dist[n + j] + price[n + j])
        path, v = [n + best], n + best
        while came[v] >= 0:
            v = came[v]
            path.append(v)
        path.reverse()
        amount = min(left[path[0]], space[best], *(flow[b, a - n] for a, b in zip(path, path[1:]) if a >= n))
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[path[0]] -= amount
        space[best] -= amount
        top = max(d for d in dist if d < float("inf"))
        price = [p + min(d, top) for p, d in zip(price, dist)]
    return {k: v for k, v in flow.items() if v > 0}


def level(loads: list[int], more: int) -> list[int]:
    """Room of each shard when more bytes are poured over loads until they stand level."""
    order = sorted(loads)
    height, spent = order[0] if order else 0, 0
    for k, nxt in enumerate([*order[1:], None], 1):
        step = None if nxt is None else (nxt - height) * k
        if step is None or spent + step >= more:
            height += -(-(more - spent) // k)
            break
        spent, height = spent + step, nxt
    return [max(0, height - x) for x in loads]


def place_large(items: list[tuple[int, int]], shards: int, capacity: float) -> list[int]:
    """Shard of each (size, old shard): at home, largest first, while it fits; else the emptiest."""
    loads, at, away = [0] * shards, [-1] * len(items), []
    for k in sorted(range(len(items)), key=lambda k: -items[k][0]):
        size, old = items[k]
        if 0 <= old < shards and loads[old] + size <= capacity:
            loads[old] += size
            at[k] = old
        else:
            away.append(k)
    heap = [(x, j) for j, x in enumerate(loads)]
    heapq.heapify(heap)
    for k in away:
        x, j = heapq.heappop(heap)
        at[k] = j
        heapq.heappush(heap, (x + items[k][0], j))
    return at


def plan(docs: DataFrame, old_shard: Column, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot of every row. old_shard: an int from 0 that says where a row lies now."""
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    thin = cut(docs.select(F.col(doc_id).alias("doc_id"), size_of(F.col(text)).alias("size"), crc.alias("text_crc32"), old_shard.cast("int").alias("old_shard")).withColumn("h", F.xxhash64("doc_id", "text_crc32")))
    total = thin.agg(F.sum("size")).first()[0] or 0
    capacity = total / shards
    least = max(1, total // (shards * GRAIN))
    keys = ["doc_id", "text_crc32", "size", "old_shard"]
    alike = Window.partitionBy(*keys).orderBy("h")
    big = cut(thin.where(F.col("size") > least).withColumn("nth", F.row_number().over(alike)))  # fewer than shards * GRAIN rows, by their size
    large = big.select(*keys, "nth").collect()
    large.sort(key=lambda r: tuple((r[k] is None, r[k] or 0) for k in (*keys, "nth")))
    at = place_large([(r["size"], r["old_shard"]) for r in large], shards, capacity)
    loads = [0] * shards
    for r, j in zip(large, at):
        loads[j] += r["size"]
    small = thin.where(F.col("size") <= least)
    olds = {r["old_shard"]: (r["b"], r["n"]) for r in small.groupBy("old_shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(olds)
    flow = min_cost_flow([olds[s][0] for s in names], level(loads, sum(b for b, _ in olds.values())), lambda i, j: 0.0 if names[i] == j else 1.0)
    cuts = []
    for i, s in enumerate(names):
        reach, ends = 0, []
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != s, j)):
            reach += flow[i, j]
            ends.append((float(reach), j))
        cuts.append((s, ends, max(1, -(-olds[s][1] // BLOCK_ROWS))))
    lines = F.broadcast(spark.createDataFrame(cuts, "old_shard int, ends array<struct<reach:double,shard:int>>, parts long"))
    blocked = small.join(lines, "old_shard").withColumn("part", F.pmod(F.col("h"), F.col("parts")).cast("long"))
    so_far = Window.partitionBy("old_shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(blocked.groupBy("old_shard", "part").agg(F.sum("size").alias("b")).withColumn("start", F.coalesce(F.sum("b").over(so_far), F.lit(0))).drop("b"))
    order = ["h", F.col("doc_id").asc_nulls_last(), "size"]
    inside = Window.partitionBy("old_shard", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.sum("size").over(inside) - F.col("size") / 2
    last = F.element_at("ends", -1)["shard"]
    cut_small = (
        blocked.join(maybe_broadcast(offsets, offsets.count()), ["old_shard", "part"])
        .withColumn("middle", middle)
        .withColumn("shard", F.coalesce(F.try_element_at(F.filter("ends", lambda e: F.col("middle") <= e["reach"]), F.lit(1))["shard"], last))
        .select(*keys, "h", "part", "shard")
    )
    kinds = f"doc_id {thin.schema['doc_id'].dataType.simpleString()}, text_crc32 long, size long, old_shard int, nth int, shard int"
    chosen = F.broadcast(spark.createDataFrame([(*(r[k] for k in (*keys, "nth")), j) for r, j in zip(large, at)], kinds))
    same = [big[k].eqNullSafe(chosen[k]) for k in (*keys, "nth")]
    cut_large = big.join(chosen, same).select(*[big[k] for k in keys], big["h"], F.lit(-1).cast("long").alias("part"), chosen["shard"])
    placed = cut(cut_small.unionByName(cut_large))
    # slots: rank within (shard, old shard, part), after the rows of the pieces before it
    piece = ["shard", "old_shard", "part"]
    ahead = Window.partitionBy("shard").orderBy("old_shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(placed.groupBy(*piece).count().withColumn("before", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count"))
    rank = F.row_number().over(Window.partitionBy(*piece).orderBy(*order, "text_crc32"))
    return placed.withColumn("rank", rank).join(maybe_broadcast(starts, starts.count()), piece).withColumn("slot", (F.col("before") + F.col("rank") - 1).cast("long")).select(*keys, "shard", "slot")


def layout(columns: Sequence[str]) -> tuple[str, str]:
    """Names of the folders' column and of the slot's in the files: shard and slot, with underscores where a column has the name."""
    taken, out = {c.lower() for c in columns}, []
    for name in ("shard", "slot"):
        while name in taken:
            name += "_"
        out.append(name)
    return out[0], out[1]


def _matched(rows: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with their moves: one to one, also where several are alike in keys."""
    often = cut(moves.groupBy(*keys).count().where("count > 1").select(*keys))
    n = often.count()
    met = lambda a, b, on: a.alias("a").join(b.alias("b"), reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in on])).select("a.row", "b.shard", "b.slot")
    if not n:
        return met(rows, moves, keys)
    marks = maybe_broadcast(often, n)
    some = lambda df, how: df.join(marks, reduce(and_, [df[k].eqNullSafe(marks[k]) for k in keys]), how)
    single = met(some(rows, "left_anti"), some(moves, "left_anti"), keys)
    alike = [numbered(some(df, "left_semi"), keys, "nth") for df in (rows, moves)]
    return single.unionByName(met(*alike, [*keys, "nth"]))


def rewrite(docs: DataFrame, moves: DataFrame, path: str, old_shard: Column, keep: Sequence[str] | None = None, text: str = "text", doc_id: str = "doc_id") -> list[int]:
    """Carries out moves (the plan of docs with old_shard) on path, which holds a folder for each shard: only affected shards,
    those that give or take a row, are written, in the order of their slots; returns their numbers. The files of other
    shards stay as they are, and the folder of a shard that gave all its rows away is removed.

    Files hold the columns of docs named by keep (all of them) and the slot, under the names of layout(keep). docs may be read from
    path itself, with old_shard its folder's column and keep without the layout's: new files are written aside by Spark's
    committer and take the old ones' place only when all are written, so a job that fails changes nothing."""
    keep = list(docs.columns if keep is None else keep)
    by, slot = layout(keep)
    keys = ["doc_id", "text_crc32", "size", "old_shard"]
    touched = cut(moves.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("touched")).distinct())
    numbers = sorted(r["touched"] for r in touched.collect())  # shard numbers, bounded by the shards
    if not numbers:
        return []
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(doc_id).alias("doc_id"), crc.alias("text_crc32"),
        size_of(F.col(text)).alias("size"), old_shard.cast("int").alias("old_shard"),
    )
    rows = rows.join(F.broadcast(touched), F.col("old_shard") == F.col("touched"), "left_semi")
    moved = cut(moves.join(F.broadcast(touched), F.col("old_shard") == F.col("touched"), "left_semi"))
    out = _matched(rows, moved, keys).select("row.*", F.col("slot").alias(slot), F.col("shard").alias(by))
    out = out.repartitionByRange(by, slot).sortWithinPartitions(by, slot)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for shard in set(numbers) - {r["shard"] for r in moved.select("shard").distinct().collect()}:
        remove(docs.sparkSession, f"{path}/{by}={shard}")
    return numbers


def reshard(docs: DataFrame, old_shard: Column, path: str, shards: int = SHARDS, keep: Sequence[str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Plans and rewrites; returns the plan."""
    moves = cut(plan(docs, old_shard, shards, text, doc_id))
    rewrite(docs, moves, path, old_shard, keep, text, doc_id)
    return moves
