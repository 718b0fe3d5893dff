"""Resharding and mixing: laws, plain recounts, and the defined cases."""

import random
import re
import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriloom.llm import mixing, sharding
from veriloom.llm.common import bounded_sample, numbered

SCHEMA = "doc_id long, text string, source string, size string"


def docs(spark, n=900, seed=1):
    r = random.Random(seed)
    out = [(i, " ".join("w" * r.randrange(1, 9) for _ in range(int(r.paretovariate(1.1) * 20) % 4000)), r.choice(["hot"] * 6 + ["b", "c", "dé", None]), "clash") for i in range(n)]
    out += [(None, None, None, None), (None, "x", "b", None), (5, "again", "b", None), (5, "again", "b", None)] + [(10_000 + i, "one copy of a text", "hot", "s") for i in range(300)]
    return spark.createDataFrame(out, SCHEMA), out


def test_flow_is_cheapest():
    cost = lambda i, j: 0 if i == j else 1
    flow = sharding.min_cost_flow([70, 10, 20], [40, 30, 30], cost)
    assert sum(v for (i, j), v in flow.items() if i != j) == 30
    assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(3)] == [70, 10, 20]
    # a path that must undo an earlier choice
    price = {(0, 0): 1, (0, 1): 2, (1, 0): 1, (1, 1): 9}
    flow = sharding.min_cost_flow([5, 5], [5, 5], lambda i, j: price[i, j])
    assert sum(price[k] * v for k, v in flow.items()) == 15
    assert sharding.level([5, 1, 3], 3) == [0, 3, 1]


def test_plan_obeys_the_law(spark):
    df, data = docs(spark)
    old = F.when(F.col("source") == "hot", 0).otherwise(F.pmod(F.xxhash64("source"), F.lit(40)))
    rows = sharding.plan(df, old).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((repr(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in data)
    load, slots = {}, {}
    for r in rows:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) <= 2 * max(size(t) for _, t, *_ in data)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.plan(df.repartition(7), old).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert sharding.plan(df.limit(0), old).count() == 0


def test_many_small_rows_move_little(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    rows = sharding.plan(df, F.when(F.col("doc_id") % 2 == 0, 3).otherwise(F.pmod("doc_id", F.lit(40))))
    stats = rows.groupBy("shard").agg(F.sum("size").alias("b"), F.sum(F.when(F.col("shard") != F.col("old_shard"), F.col("size")).otherwise(0)).alias("m")).collect()
    loads = [r["b"] for r in stats]
    assert len(loads) == 40 and max(loads) - min(loads) <= 0.02 * max(loads)
    held = {r["old_shard"]: r["b"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("b")).collect()}
    need = sum(max(0, b - sum(loads) / 40) for b in held.values())
    assert sum(r["m"] for r in stats) <= 1.05 * need


def files_of(path):
    return {p.relative_to(path).as_posix(): p.read_bytes() for p in path.rglob("*.parquet")}


def test_rewrite_touches_affected_shards_only(spark, tmp_path):
    out = tmp_path / "out"
    old = F.col("old")
    df = spark.createDataFrame([(i, "t" * (1 + i % 7), "mine", k) for k in range(4) for i in range(100 * k, 100 * k + 40)], "doc_id long, text string, Shard string, old int")
    data = df.columns[:3]
    by, slot = sharding.layout(data)
    assert (by, slot) == ("shard_", "slot")
    df.withColumn(slot, F.lit(0).cast("long")).withColumn(by, old).drop("old").write.partitionBy(by).parquet(str(out))
    before = files_of(out)
    # a plan that moves shard 1 into 2 and leaves 0 and 3 alone
    moves = sharding.plan(df, old, shards=4).select("doc_id", "size", "text_crc32", "old_shard", F.when(F.col("old_shard") == 1, 2).otherwise(F.col("old_shard")).alias("shard"))
    moves = moves.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy("doc_id")).cast("long") - 1)
    kept = spark.read.parquet(str(out))
    numbers = sharding.rewrite(kept, moves, str(out), F.col(by), keep=data)
    after = files_of(out)
    assert numbers == [1, 2] and not (out / f"{by}=1").exists()
    calm = {k for k in before if k.startswith((f"{by}=0/", f"{by}=3/"))}
    assert calm and all(after.get(k) == before[k] for k in calm) and {k for k in after if k.startswith((f"{by}=0/", f"{by}=3/"))} == calm
    back = spark.read.parquet(str(out)).collect()
    assert sorted((r["doc_id"], r["text"], r["Shard"], r[by]) for r in back) == sorted((r["doc_id"], r["text"], "mine", 2 if r["old"] == 1 else r["old"]) for r in df.collect())
    assert sorted(r[slot] for r in back if r[by] == 2) == list(range(80))


def test_reshard_writes_each_of_the_rows_alike_once(spark, tmp_path):
    rows = [(5, "again", f"v{k}", k % 3) for k in range(30)] + [(None, None, "n", k % 2) for k in range(20)] + [(i, "w " * i, "x", 0) for i in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string, old int")
    moves = sharding.reshard(df, F.col("old"), str(tmp_path / "out"), shards=3, keep=["doc_id", "text", "slot"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == ["doc_id", "text", "slot", "slot_", "shard"]
    got = back.collect()
    assert sorted((repr(r["doc_id"]), repr(r["text"]), r["slot"]) for r in got) == sorted((repr(i), repr(t), v) for i, t, v, _ in rows)
    want = sorted((repr(r["doc_id"]), r["shard"], r["slot"]) for r in moves.collect())
    assert sorted((repr(r["doc_id"]), r["shard"], r["slot_"]) for r in got) == want
    empty = df.limit(0)
    assert sharding.reshard(empty, F.col("old"), str(tmp_path / "none"), shards=3).count() == 0


def test_large_rows_alike_are_dealt_one_by_one(spark):
    df = spark.createDataFrame([(7, "x" * 5000, "s") for _ in range(64)], "doc_id long, text string, source string")
    loads = {r["shard"]: r["n"] for r in sharding.plan(df, F.lit(0), shards=8).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert set(loads.values()) == {8}


def test_bounded_sample_is_never_short(spark):
    same = spark.range(30_000).select(F.lit(4).alias("doc_id"), F.lit("t").alias("text"))
    some = spark.range(30_000).select(F.lit(4).alias("doc_id"), F.col("id").cast("string").alias("text"))
    for df, n in ((same, 500), (some, 500), (same.limit(20), 20), (same.limit(0), 0)):
        assert bounded_sample(df, F.col("doc_id"), 500).count() == n
    draw = lambda df: sorted(r["text"] for r in bounded_sample(df, F.col("doc_id"), 500).collect())
    assert draw(some) == draw(some.repartition(7))


def test_numbers_of_rows_alike(spark):
    df = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, 1).alias("z"))
    rows = numbered(df.where("k < 2"), ["k", "z"], "nth").groupBy("k", "z").agg(F.count("*").alias("n"), F.count_distinct("nth").alias("d"), F.min("nth").alias("a"), F.max("nth").alias("b")).collect()
    assert len(rows) == 4 and all(r["n"] == r["d"] == r["b"] + 1 and r["a"] == 0 for r in rows)


def test_mix_follows_its_targets(spark):
    df, data = docs(spark, 3000)
    base = df.select("doc_id", "text", "source", "size", mixing.words(F.col("text")).alias("n"))
    out = mixing.mix(base, F.col("n"), F.col("source"), F.col("doc_id")).select("row.*", F.col("size").alias("w"), "source_size", "target", "copies")
    rows = out.select("doc_id", "source", "n", "w", "source_size", "target", "copies").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((repr(r["doc_id"]), r["w"]) for r in rows) == sorted((repr(i), count(t)) for i, t, *_ in data)
    order = sorted({s for _, _, s, _ in data if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = {s: sum(count(t) for _, t, x, _ in data if x == s) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    for s in order:
        own = [r for r in rows if r["source"] == s]
        assert abs(own[0]["target"] - target[s]) < 1e-6 * max(1, target[s]) and own[0]["source_size"] == sizes[s]
        taken = sum(r["copies"] * r["w"] for r in own)
        assert abs(taken - target[s]) <= max(0.02 * target[s], max(r["w"] for r in own))
        rate = target[s] / sizes[s]
        assert all(int(rate) <= r["copies"] <= min(3, int(rate) + 1) for r in own)
    again = mixing.mix(base.repartition(5), F.col("n"), F.col("source"), F.col("doc_id")).select("row.doc_id", "copies", "size").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in out.select("doc_id", "copies", F.col("w").alias("size")).collect())


def test_emitted_repeats_rows_and_empty(spark):
    df, _ = docs(spark, 200)
    got = mixing.emitted(df, mixing.words(F.col("text")), F.col("source"), F.col("doc_id"))
    assert got.columns == df.columns and got.count() > 0
    assert mixing.emitted(df.limit(0), mixing.words(F.col("text")), F.col("source"), F.col("doc_id")).count() == 0
    empty = spark.createDataFrame([(1, None, "a", None), (2, "", None, None)], SCHEMA)
    assert mixing.emitted(empty, mixing.words(F.col("text")), F.col("source"), F.col("doc_id")).count() == 0


def test_words_are_counted_as_listed(spark):
    odd = [None, "", " ", "\t\n\x0b\x0c\r ", " a", "a ", "a b", "x x  x", "😀 😀\n", "\x1c a\x85b", "日本 語", " \n a \n\n b\t", " x" * 20_000]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", mixing.words(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == {t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in odd}
