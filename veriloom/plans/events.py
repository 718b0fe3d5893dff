"""Queries on event logs, run records, tables and their changes; and streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.operators import compare as C
from veriloom.operators import tables as B
from veriloom.plans.catalogue import query
from veriloom.sources.readers import parquet as T
from veriloom.sources.readers import shared
from veriloom.streaming import events as S


@query("SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS total, min(epoch_us(ts)) AS first FROM events GROUP BY event_type")
def stage_durations(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("first"))


@query("SELECT event_type AS stage, round(sum(value), 4) AS total FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY event_type")
def stage_durations_window(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events").where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")))
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, user_id % 3 AS decision, count(*) AS n FROM events GROUP BY ALL")
def stage_decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, round(coalesce(least(60.0, greatest(0.0, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 / 20)), 0), 4) AS delay FROM events""")
def replay_delays(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return B.replay_delays(e, "user_id", "event_id", "ts", 20.0, 60.0).select("event_id", F.round("delay", 4).alias("delay"))


_FOLD = "f AS (SELECT 'u' || user_id AS url, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'fetched' WHEN 2 THEN 'failed' WHEN 3 THEN 'fetched' ELSE 'reset' END AS kind, CASE WHEN event_id % 5 IN (1, 3) THEN md5((user_id % 37)::VARCHAR) END AS sha256 FROM events)"


def fetches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    kind = F.when(k == 0, "add").when(k.isin(1, 3), "fetched").when(k == 2, "failed").otherwise("reset")
    return T(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(k.isin(1, 3), F.md5((F.col("user_id") % 37).cast("string").cast("binary"))).alias("sha256"))


@query(f"""WITH {_FOLD}, s AS (SELECT url, min(seq) AS first_seq, count(*) FILTER (kind IN ('fetched', 'failed')) AS attempts, coalesce(max_by(CASE WHEN kind = 'reset' THEN 'pending' ELSE kind END, seq) FILTER (kind <> 'add'), 'pending') AS status,
 max_by(sha256, seq) FILTER (kind = 'fetched') AS sha256, max(seq) FILTER (kind = 'fetched') AS fetched_seq FROM f GROUP BY url),
o AS (SELECT *, CASE WHEN sha256 IS NOT NULL THEN first_value(url) OVER (PARTITION BY sha256 ORDER BY fetched_seq) END AS o FROM s)
SELECT url, first_seq, attempts, status, sha256, fetched_seq, CASE WHEN o <> url THEN o END AS is_duplicate_of FROM o""")
def manifest_fold(spark: SparkSession, d: str) -> DataFrame:
    return B.manifest(fetches(spark, d))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS original FROM documents")
def manifest_first_duplicate(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("original"))
    return docs.join(first, "sha").select("doc_id", "original")


@query("SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 GROUP BY ALL EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 2 = 1")
def unfinished_steps(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events").withColumn("kind", F.when(F.col("event_id") % 2 == 0, "started").otherwise("finished"))
    return B.unfinished_steps(e, "user_id", "event_type", "kind")


_RUNS = "r AS (SELECT event_id AS run, 'e' || (user_id % 6) AS economy, event_type AS engine, epoch_us(ts) AS started, epoch_us(ts) + (value * 1e6)::BIGINT AS ended, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, value AS cost, CASE WHEN event_id % 3 = 0 THEN value * 2 END AS provider_cost FROM events)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as run records."""
    e = T(spark, d, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("run"), F.concat(F.lit("e"), F.col("user_id") % 6).alias("economy"), F.col("event_type").alias("engine"), start.alias("started"), (start + F.round(F.col("value") * 1e6).cast("long")).alias("ended"),
        F.when(F.col("event_id") % 4 == 0, "failed").otherwise("completed").alias("status"), F.col("value").alias("cost"), F.when(F.col("event_id") % 3 == 0, F.col("value") * 2).alias("provider_cost"), F.lit(1).alias("documents"),
    )


@query(f"WITH {_RUNS} SELECT a.run, max(b.ended) AS window_start FROM r a LEFT JOIN r b ON a.economy = b.economy AND a.engine <> b.engine AND b.status = 'completed' AND b.ended <= a.started GROUP BY a.run")
def pass_window_asof(spark: SparkSession, d: str) -> DataFrame:
    return C.pass_windows(runs(spark, d), "economy", "engine", "run", "started", "ended", "status").select("run", "window_start")


@query(f"""WITH {_RUNS}, w AS (SELECT a.run, a.economy, a.started, max(b.ended) AS ws FROM r a LEFT JOIN r b ON a.economy = b.economy AND a.engine <> b.engine AND b.status = 'completed' AND b.ended <= a.started GROUP BY ALL)
SELECT w.run, f.run AS item FROM w JOIN r f ON f.economy = w.economy AND (ws IS NULL OR f.started >= ws) AND f.ended <= w.started""")
def pass_discoveries(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    w = C.pass_windows(r, "economy", "engine", "run", "started", "ended", "status")
    found = r.select(F.col("economy"), F.col("run").alias("item"), F.col("started").alias("fs"), F.col("ended").alias("fe"))
    return C.run_discoveries(w, found, "economy", "run", "started", "item", "fs", "fe")


@query(f"WITH {_RUNS} SELECT economy, engine, min(started) AS started, max(ended) AS ended, count(*)::BIGINT AS documents, round(sum(coalesce(provider_cost, cost)), 4) AS cost FROM r GROUP BY ALL")
def engine_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.engine_summary(runs(spark, d), ["economy", "engine"], "started", "ended", "documents", "cost", "provider_cost").withColumn("cost", F.round("cost", 4))


@query(f"WITH {_RUNS} SELECT economy, engine, arg_max(run, started::HUGEINT * 10000 + run) AS run FROM r WHERE status = 'completed' GROUP BY ALL")
def evidence_runs(spark: SparkSession, d: str) -> DataFrame:
    return B.latest(runs(spark, d).where("status = 'completed'"), ["economy", "engine"], [F.desc("started"), F.desc("run")]).select("economy", "engine", "run")


@query("SELECT source AS economy, coalesce(nullif(trim(lang), ''), 'unrecorded') AS language, count(*) AS n FROM documents GROUP BY ALL")
def corpus_languages(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").groupBy(F.col("source").alias("economy"), F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("unrecorded")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS economy, count(s_suppkey) AS documents, coalesce(round(sum(s_acctbal), 2), 0) AS total FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_name")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every configured economy, with zero where the corpus has none."""
    s = T(spark, d, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("s_acctbal"), 2).alias("total"))
    n = T(spark, d, "nation")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").select(F.col("n_name").alias("economy"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT orders.* REPLACE (epoch_us(o_orderdate) AS o_orderdate) FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def table_browser(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders").where("o_orderstatus = 'F'").withColumn("o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return B.page(o, [F.desc("o_totalprice"), "o_orderkey"], 50, 100)[0]


@query("""WITH n AS (SELECT o_orderkey, o_orderstatus || '!' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey + 10000000, 'N', 1 FROM orders WHERE o_orderkey % 50 = 0)
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM n UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)""")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.concat("o_orderstatus", F.lit("!")).alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    fresh = o.where("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    return B.upsert(o, changed.unionByName(fresh), ["o_orderkey"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, o.c_mktsegment FROM customer o FULL JOIN (SELECT c_custkey * 2 AS c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'edited' END AS c_name FROM customer) n ON o.c_custkey = n.c_custkey""")
def merge_fill(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.select((F.col("c_custkey") * 2).alias("c_custkey"), F.when(F.col("c_custkey") % 3 > 0, "edited").alias("c_name"))
    return B.merge_fill(c, new, ["c_custkey"])


@query("SELECT count(*) AS customers, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') AS orders, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') AS lines FROM customer WHERE c_mktsegment = 'BUILDING'")
def cascade_preview(spark: SparkSession, d: str) -> DataFrame:
    gone = T(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = B.delete_where(T(spark, d, "orders"), gone, ["o_custkey"])[1].select(F.col("o_orderkey").alias("l_orderkey"))
    lines = B.delete_where(T(spark, d, "lineitem"), orders, ["l_orderkey"])[1]
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return n(gone, "customers").crossJoin(n(orders, "orders")).crossJoin(n(lines, "lines"))


@query("SELECT doc_id, CASE WHEN sha256(text) = min(sha256(text)) OVER (PARTITION BY source || '_' || lang || n_chars % 50) THEN source || '_' || lang || n_chars % 50 ELSE source || '_' || lang || n_chars % 50 || '_' || substr(sha256(text), 1, 12) END AS resolved_id FROM documents")
def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents").select("doc_id", F.concat("source", F.lit("_"), "lang", (F.col("n_chars") % 50).cast("string")).alias("id"), F.sha2("text", 256).alias("sha"))
    return B.resolved_ids(docs, "id", "sha").select("doc_id", "resolved_id")


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS used FROM events")
def usage_meter(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)), 4).alias("used"))


def _streamed(spark: SparkSession, source: DataFrame, build, mode: str) -> DataFrame:
    """source written as files, streamed to the end through build, and what the sink holds. Append only: a sink of files."""
    place = shared(spark, "stream")
    source.write.parquet(f"{place}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{place}/in")
    build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{place}/out")).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")


@query(f"""WITH {_FOLD} SELECT url, count(*) FILTER (kind IN ('fetched', 'failed')) AS attempts, coalesce(max_by(CASE WHEN kind = 'reset' THEN 'pending' ELSE kind END, seq) FILTER (kind <> 'add'), 'pending') AS status, max_by(sha256, seq) FILTER (kind = 'fetched') AS sha256 FROM f GROUP BY url""")
def event_stream_fold(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's fold as a stream with keyed state: the last state of each url equals the batch fold."""
    states = _streamed(spark, fetches(spark, d), S.manifest_states, "update")
    return B.latest(states, ["url"], [F.desc("batch"), F.desc("seq")]).select("url", "attempts", "status", "sha256")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, time_bucket(INTERVAL 1 day, ts)")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows of a day (an addition): update mode, the last value of each window."""
    source = T(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = _streamed(spark, source, lambda s: S.windowed_counts(s, "ts", "event_type", "value", "1 day", "60 days"), "update")
    return B.latest(out, ["window", "event_type"], [F.desc("batch")]).select("event_type", "n", F.round("total", 4).alias("total"))
