"""Queries on what surrounds an export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.text import instrument_rank
from veriloom.operators import publishing as P
from veriloom.plans.catalogue import query
from veriloom.plans.evidence import _MAP, mappings
from veriloom.sources.readers import parquet as T


@query(f"""WITH {_MAP} SELECT economy, indicator, mapping_id FROM (SELECT *, row_number() OVER (PARTITION BY economy, indicator ORDER BY CASE WHEN document LIKE '%1' THEN 0 WHEN document LIKE '%2' THEN 1 END NULLS LAST, document LIKE '%3', section LIKE '%5' DESC, controlling DESC, confidence DESC NULLS LAST, mapping_id) AS r FROM m WHERE indicator IN ('7.1', '7.2') AND status = 'passed') WHERE r = 1""")
def framework_pick(spark: SparkSession, d: str) -> DataFrame:
    m = mappings(spark, d).where("indicator IN ('7.1', '7.2') AND status = 'passed'")
    tier = F.when(F.col("document").endswith("1"), 0).when(F.col("document").endswith("2"), 1)
    picked = P.framework_pick(m, ["economy", "indicator"], tier, F.col("document").endswith("3"), F.col("section").endswith("5"), "controlling", "confidence", instrument_rank(F.lit("Act")), "mapping_id")
    return picked.select("economy", "indicator", "mapping_id")


@query(f"WITH {_MAP} SELECT economy, document, count(*)::INT AS n FROM m WHERE status = 'passed' GROUP BY ALL")
def submission_json(spark: SparkSession, d: str) -> DataFrame:
    out = P.submission(mappings(spark, d).where("status = 'passed'"), ["economy", "document"], ["section", "indicator", "mapping_id"])
    whole = F.size(F.from_json("json", "provisions array<struct<mapping_id:string>>")["provisions"])
    return out.select("economy", "document", F.when(whole == F.col("n"), F.col("n")).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'edited ' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def document_edits(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    fields = F.when(F.col("c_custkey") % 6 == 0, F.array(F.lit("c_name"), F.lit("c_mktsegment"))).otherwise(F.array(F.lit("c_name")))
    edits = c.where("c_custkey % 3 = 0").select("c_custkey", fields.alias("edited_fields"), F.concat(F.lit("edited "), F.col("c_custkey").cast("string")).alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    return P.edited(c, edits, "c_custkey", ["c_name", "c_mktsegment"])


@query("""WITH l AS (SELECT s_suppkey, list_filter(['6.1', '6.2', '7.1'], lambda x: (s_suppkey % 7 = 0 AND x = '6.1') OR (s_suppkey % 3 = 0 AND x = '6.2') OR (s_suppkey % 5 = 0 AND x = '7.1')) AS ind FROM supplier)
SELECT s_suppkey, len(ind)::INT AS cited, row_number() OVER (ORDER BY len(ind) DESC, s_suppkey % 2 = 0 DESC, s_suppkey % 4 = 0 DESC, s_suppkey % 30 DESC, s_suppkey) AS place FROM l WHERE len(ind) > 0""")
def baseline_law_ranking(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    laws = T(spark, d, "supplier").select(k, F.array_compact(F.array(F.when(k % 7 == 0, "6.1"), F.when(k % 3 == 0, "6.2"), F.when(k % 5 == 0, "7.1"))).alias("ind"), (k % 2 == 0).alias("seeded"), F.when(k % 4 == 0, F.array(F.lit("u"))).otherwise(F.array(F.lit("u"), F.lit("v"))).alias("urls"), (k % 30).alias("year"))
    return P.ranked_laws(laws, ["6.1", "6.2", "7.1"], "ind", "seeded", "urls", "year", "s_suppkey").select("s_suppkey", "cited", "place")


@query("SELECT event_id FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap < 3600 * 1e6")
def rate_limit_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return P.gap_violations(e, "user_id", "ts", 3600.0).select("event_id")


@query("""WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, '\\S')) AS v, len(regexp_extract_all(text, '[\\p{L}\\p{M}]')) AS l FROM documents),
w AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, trim(line, ' ') AS line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE len(regexp_extract_all(line, '\\p{L}')) >= 3 GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, CASE WHEN v < 200 THEN NULL WHEN l / v < 0.4 THEN 'few letters' WHEN coalesce(n, 0) >= 200 THEN 'watermark' END AS reason FROM t LEFT JOIN w USING (doc_id)""")
def garbage_text(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", P.garbage_reason(F.col("text"), F.lit(1)).alias("reason"))
