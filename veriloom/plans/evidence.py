"""Queries on evidence rules, comparison and review. Line items are mappings, orders and nations their laws and economies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.operators import compare as C
from veriloom.operators import evidence as E
from veriloom.operators import tables as B
from veriloom.plans.catalogue import query
from veriloom.plans.texts import _LAWS, laws
from veriloom.sources.readers import parquet as T

_IDS = "['6.1', '6.2', '6.3', '6.4', '7.1', '7.2', '7.3', '7.4', '7.5']"
_NATURES = "['transfer_ban', 'local_storage', 'local_infrastructure', 'conditional_transfer', 'protection_framework', 'protection_framework', 'retention_requirement', 'dpo_requirement', 'government_access']"
_MAP = f"""m AS (SELECT l_returnflag AS run, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS mapping_id, n_name AS economy, 'c' || (l_partkey % 300) AS chunk, ({_IDS})[1 + l_suppkey % 9] AS indicator,
 CASE WHEN l_linestatus = 'O' THEN 'passed' WHEN l_quantity > 25 THEN 'dropped' ELSE 'no_evidence' END AS status, CASE WHEN l_tax >= 0.02 THEN l_discount * 10 END AS confidence, l_tax > 0.07 AS controlling, 'd' || (l_partkey % 40) AS document, 's. ' || (l_suppkey % 60) AS section
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def mappings(spark: SparkSession, d: str) -> DataFrame:
    li = T(spark, d, "lineitem").join(T(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    li = li.join(F.broadcast(T(spark, d, "nation").select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    ids = F.array(*[F.lit(k) for k in E.ABSENCE])
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return li.select(
        F.col("l_returnflag").alias("run"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("mapping_id"), F.col("n_name").alias("economy"),
        text("c", F.col("l_partkey") % 300).alias("chunk"), F.element_at(ids, (1 + F.col("l_suppkey") % 9).cast("int")).alias("indicator"),
        F.when(F.col("l_linestatus") == "O", "passed").when(F.col("l_quantity") > 25, "dropped").otherwise("no_evidence").alias("status"),
        F.when(F.col("l_tax") >= 0.02, F.col("l_discount") * 10).alias("confidence"), (F.col("l_tax") > 0.07).alias("controlling"),
        text("d", F.col("l_partkey") % 40).alias("document"), text("s. ", F.col("l_suppkey") % 60).alias("section"),
    )


@query(f"""WITH {_LAWS}, r AS (SELECT *, o_custkey % 200 AS grp, CASE WHEN regexp_matches(lower(law), 'code of practice') THEN 3 WHEN regexp_matches(lower(law), '\\bnotice\\b') THEN 2 WHEN regexp_matches(lower(law), '\\brules\\b') THEN 1 WHEN regexp_matches(lower(law), '\\bact\\b') THEN 0 ELSE 4 END AS rank,
 coalesce(nullif(regexp_extract(law, '(\\d{{4}})', 1), '')::INT, -1) AS recency FROM l)
SELECT o_orderkey, grp, rank, recency, row_number() OVER (PARTITION BY grp ORDER BY rank, recency DESC, o_orderkey) AS pick, rank = min(rank) OVER (PARTITION BY grp) AS same_rank FROM r""")
def ladder_pick(spark: SparkSession, d: str) -> DataFrame:
    rows = laws(spark, d).withColumn("grp", F.col("o_custkey") % 200).withColumn("amended", F.col("law"))
    return E.ladder_pick(rows, ["grp"], "law", "amended", "o_orderkey").select("o_orderkey", "grp", "rank", "recency", "pick", "same_rank")


@query(f"""WITH {_LAWS}, r AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey + 1000000 ELSE o_custkey % 200 END AS grp, CASE WHEN regexp_matches(lower(law), 'code of practice') THEN 3 WHEN regexp_matches(lower(law), '\\bnotice\\b') THEN 2 WHEN regexp_matches(lower(law), '\\brules\\b') THEN 1 WHEN regexp_matches(lower(law), '\\bact\\b') THEN 0 ELSE 4 END AS rank,
 coalesce(nullif(regexp_extract(law, '(\\d{{4}})', 1), '')::INT, -1) AS recency FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank, recency DESC, o_orderkey) AS pick, rank = min(rank) OVER (PARTITION BY grp) AS same_rank, count(*) OVER (PARTITION BY grp) AS n FROM r),
p AS (SELECT grp, max(o_orderkey) AS proposed FROM r WHERE grp % 2 = 0 GROUP BY grp),
j AS (SELECT k.*, proposed, coalesce(max((same_rank AND o_orderkey = proposed)::INT) OVER (PARTITION BY k.grp), 0) = 1 AS accepted FROM k LEFT JOIN p USING (grp)),
c AS (SELECT *, CASE WHEN n = 1 THEN true WHEN accepted THEN o_orderkey = proposed ELSE pick = 1 END AS controlling FROM j)
SELECT o_orderkey, grp, controlling, CASE WHEN n = 1 THEN 'sole_source' WHEN proposed IS NULL OR controlling THEN 'complementary' WHEN o_orderkey = proposed THEN 'complementary' ELSE 'complementary' END AS relationship FROM c""")
def reconcile_groups(spark: SparkSession, d: str) -> DataFrame:
    grp = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderkey") + 1_000_000).otherwise(F.col("o_custkey") % 200)
    rows = laws(spark, d).withColumn("grp", grp).withColumn("amended", F.col("law"))
    told = rows.where("grp % 2 = 0").groupBy("grp").agg(F.max("o_orderkey").alias("proposed"))
    told = told.withColumn("relationships", F.create_map("proposed", F.lit("superseded_by"))).withColumn("relationships", F.map_filter("relationships", lambda k, v: F.lit(False)))
    return E.reconcile(rows, told, ["grp"], "o_orderkey", "law", "amended").select("o_orderkey", "grp", "controlling", "relationship")


@query(f"WITH {_MAP} SELECT run, indicator, mapping_id FROM (SELECT *, row_number() OVER (PARTITION BY run, indicator ORDER BY controlling DESC, coalesce(confidence, -1) DESC, mapping_id DESC) AS r FROM m) WHERE r = 1")
def controlling_per_group(spark: SparkSession, d: str) -> DataFrame:
    return E.controlling_first(mappings(spark, d), ["run", "indicator"], "controlling", "confidence", "mapping_id").select("run", "indicator", "mapping_id")


@query(f"WITH {_MAP} SELECT mapping_id FROM m WHERE indicator = '6.1' AND EXISTS (SELECT 1 FROM m o WHERE o.indicator = '6.4' AND o.status = 'passed' AND o.economy = m.economy AND o.chunk = m.chunk)")
def boundary_excluded(spark: SparkSession, d: str) -> DataFrame:
    return E.boundary_excluded(mappings(spark, d), "economy", "chunk", "indicator", "status").select("mapping_id")


@query(f"""WITH {_MAP}, p AS (SELECT * FROM m WHERE status = 'passed'), x AS (SELECT DISTINCT economy, chunk FROM p WHERE indicator = '6.4'),
k AS (SELECT DISTINCT economy, indicator FROM p WHERE NOT (indicator = '6.1' AND EXISTS (SELECT 1 FROM x WHERE x.economy = p.economy AND x.chunk = p.chunk))),
i AS (SELECT unnest({_IDS}) AS indicator) SELECT e.economy, i.indicator, CASE WHEN i.indicator IN ('7.1', '7.2') THEN (k.economy IS NULL)::INT::DOUBLE ELSE (k.economy IS NOT NULL)::INT::DOUBLE END AS score
FROM (SELECT DISTINCT economy FROM p) e CROSS JOIN i LEFT JOIN k ON k.economy = e.economy AND k.indicator = i.indicator""")
def presence_scores(spark: SparkSession, d: str) -> DataFrame:
    return E.presence_scores(mappings(spark, d), "economy", "chunk", "indicator", "status")


_CLASS = f"""k AS (SELECT *, CASE WHEN length(chunk) % 2 = 0 THEN 'horizontal' ELSE 'sectoral' END AS application, CASE WHEN chunk LIKE '%1' THEN 'personal' WHEN chunk LIKE '%2' THEN 'non_personal' ELSE 'dataset' END AS data_scope, (({_NATURES})[list_position({_IDS}, indicator)]) AS nature FROM m),
v AS (SELECT *, CASE WHEN indicator IN ('6.1', '6.2', '6.4') THEN CASE WHEN data_scope = 'personal' OR (application = 'horizontal' AND data_scope = 'non_personal') THEN 1.0 ELSE 0.5 END WHEN indicator = '6.3' THEN 1.0
 WHEN indicator IN ('7.1', '7.2') THEN CASE WHEN controlling AND application = 'horizontal' THEN 0.0 ELSE 0.5 END WHEN indicator = '7.3' THEN CASE WHEN controlling THEN 1.0 END WHEN indicator = '7.4' THEN CASE WHEN application = 'horizontal' THEN 1.0 ELSE 0.5 END ELSE CASE WHEN NOT controlling THEN 1.0 END END AS c FROM k WHERE status = 'passed')"""


def classified(spark: SparkSession, d: str) -> DataFrame:
    m = mappings(spark, d)
    natures = F.create_map(*[F.lit(x) for k, v in E.ELIGIBLE.items() for x in (k, v[0])])
    c = F.struct(
        F.when(F.length("chunk") % 2 == 0, "horizontal").otherwise("sectoral").alias("application"), F.when(F.col("chunk").endswith("1"), "personal").when(F.col("chunk").endswith("2"), "non_personal").otherwise("dataset").alias("data_scope"),
        natures[F.col("indicator")].alias("measure_nature"), F.lit(True).alias("confirmed"), F.lit(False).alias("government_data_only"), F.col("controlling").alias("comprehensive_framework"), F.col("controlling").alias("dedicated_framework"),
        F.col("controlling").alias("minimum_period_specified"), F.col("controlling").alias("judicial_authorization_required"),
    )
    return m.where("status = 'passed'").withColumn("c", E.contribution(F.col("indicator"), c))


@query(f"WITH {_MAP}, {_CLASS} SELECT mapping_id, c AS contribution FROM v")
def record_contribution(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("mapping_id", F.col("c").alias("contribution"))


@query(f"""WITH {_MAP}, {_CLASS}, g AS (SELECT economy, indicator, max(c) AS most, min(c) AS least, count(DISTINCT document || '|' || section) AS places FROM v WHERE c IS NOT NULL GROUP BY ALL)
SELECT n_name AS economy, i.indicator, CASE WHEN most IS NULL THEN CASE WHEN i.indicator IN ('7.1', '7.2') THEN 1.0 ELSE 0.0 END WHEN i.indicator IN ('6.1', '6.2') AND (most = 1 OR places >= 2) THEN 1.0 WHEN i.indicator IN ('6.3', '7.3', '7.5') THEN 1.0
 WHEN i.indicator IN ('7.1', '7.2') THEN CASE WHEN least = 0 THEN 0.0 ELSE 0.5 END ELSE most END AS score, coalesce(places, 0) AS places
FROM nation CROSS JOIN (SELECT unnest({_IDS}) AS indicator) i LEFT JOIN g ON g.economy = n_name AND g.indicator = i.indicator""")
def rubric_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = T(spark, d, "nation").select(F.col("n_name").alias("economy")).crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in E.ABSENCE], "indicator string")))
    return E.rubric_cells(classified(spark, d), cells, "economy", "indicator", "c", ["document", "section"])


@query(f"""WITH {_MAP}, {_CLASS}, w AS (SELECT *, CASE WHEN indicator IN ('7.1', '7.2') THEN min(c) OVER p ELSE max(c) OVER p END AS best FROM v WINDOW p AS (PARTITION BY economy, indicator)) SELECT mapping_id FROM w WHERE c = best""")
def fit_subset(spark: SparkSession, d: str) -> DataFrame:
    return E.fit_subset(classified(spark, d), ["economy", "indicator"], "indicator", "c").select("mapping_id")


@query(f"""WITH {_MAP}, r AS (SELECT *, row_number() OVER (PARTITION BY economy, indicator, document, section ORDER BY controlling DESC, confidence DESC NULLS LAST, mapping_id) AS r, count(*) OVER (PARTITION BY economy, indicator, document, section) AS n FROM m)
SELECT mapping_id, n - 1 AS collapsed FROM r WHERE r = 1""")
def collapse_duplicates(spark: SparkSession, d: str) -> DataFrame:
    out = E.collapse(mappings(spark, d), ["economy", "indicator", "document", "section"], "controlling", "confidence", "mapping_id")
    return out.select("mapping_id", F.size("collapsed").cast("long").alias("collapsed"))


@query(f"""WITH {_MAP}, r AS (SELECT economy, indicator, mapping_id, row_number() OVER (PARTITION BY economy ORDER BY confidence DESC NULLS LAST, economy, indicator, mapping_id) AS depth FROM m)
SELECT economy, indicator, mapping_id, depth FROM r ORDER BY depth, economy LIMIT 101""")
def round_robin_cap(spark: SparkSession, d: str) -> DataFrame:
    return E.round_robin(mappings(spark, d), "economy", "confidence", ["economy", "indicator", "mapping_id"]).select("economy", "indicator", "mapping_id", "depth")


@query(f"WITH {_MAP} SELECT n_name AS economy, i.indicator FROM nation CROSS JOIN (SELECT unnest({_IDS}) AS indicator) i WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.economy = n_name AND m.indicator = i.indicator AND status = 'passed')")
def absence_rows(spark: SparkSession, d: str) -> DataFrame:
    cells = T(spark, d, "nation").select(F.col("n_name").alias("economy")).crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in E.ABSENCE], "indicator string")))
    return E.absences(cells, mappings(spark, d).where("status = 'passed'"), ["economy", "indicator"])


@query(f"""WITH {_MAP}, b AS (SELECT *, count(*) OVER (PARTITION BY economy, indicator, document, section) > 1 AS twice FROM m WHERE status = 'passed')
SELECT mapping_id, message FROM (SELECT mapping_id, unnest(list_filter([CASE WHEN twice THEN 'duplicate key' END, CASE WHEN confidence IS NULL THEN 'blank confidence' END, CASE WHEN confidence < 0.2 THEN 'low confidence' END], lambda x: x IS NOT NULL)) AS message FROM b)""")
def battery_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = mappings(spark, d).where("status = 'passed'")
    return E.battery(rows, "mapping_id", ["economy", "indicator", "document", "section"], ["confidence"], {"low confidence": F.col("confidence") < 0.2})


@query("""WITH v AS (SELECT d.doc_id, substr(d.text, 1, 10 + (d.doc_id % 30)::INT) AS quote, CASE WHEN d.doc_id % 7 = 0 THEN b.text ELSE d.text END AS chunk, CASE d.doc_id % 4 WHEN 0 THEN '(a)' WHEN 1 THEN 'para one' ELSE '' END AS sub
 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, concat_ws('|', CASE WHEN length(trim(quote)) < 15 THEN 'quote too short' WHEN NOT contains(chunk, quote) THEN 'quote not found' END, CASE WHEN sub = 'para one' THEN 'subsection unparseable' END,
 CASE WHEN sub = '(a)' AND NOT regexp_matches(chunk, '[(（]a[)）]') THEN 'marker not in chunk' END) AS failures FROM v""")
def verify_records(spark: SparkSession, d: str) -> DataFrame:
    b = T(spark, d, "benchmark").select("item_id", F.col("text").alias("other"))
    n = b.count()
    docs = T(spark, d, "documents").withColumn("item_id", F.col("doc_id") % n).join(b, "item_id")
    quote = F.substring(F.col("text"), F.lit(1), (10 + F.col("doc_id") % 30).cast("int"))
    chunk = F.when(F.col("doc_id") % 7 == 0, F.col("other")).otherwise(F.col("text"))
    sub = F.when(F.col("doc_id") % 4 == 0, "(a)").when(F.col("doc_id") % 4 == 1, "para one").otherwise("")
    return docs.select("doc_id", F.array_join(E.verify_failures(quote, chunk, sub), "|").alias("failures"))


@query(f"""WITH {_MAP}, k AS (SELECT c_name AS law, 'd' || (c_custkey % 40) AS law_key, n_name AS economy, CASE WHEN c_custkey % 5 = 0 THEN [] ELSE ['s. ' || (c_custkey % 60)] END AS sections FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT mapping_id, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.economy = m.economy AND (contains(m.document, k.law_key) OR contains(k.law_key, m.document)) AND (len(sections) = 0 OR list_contains(sections, m.section))) THEN 'KNOWN' ELSE 'NEW' END AS discovery_tag FROM m WHERE status = 'passed'""")
def discovery_tags(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "customer").join(F.broadcast(T(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.concat(F.lit("d"), (F.col("c_custkey") % 40).cast("string"))
    known = c.select(F.col("n_name").alias("economy"), F.array(key).alias("law_keys"), F.when(F.col("c_custkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s. "), (F.col("c_custkey") % 60).cast("string")))).alias("sections")).distinct()
    rows = mappings(spark, d).where("status = 'passed'").select(F.col("mapping_id").alias("record_id"), "economy", F.array("document").alias("keys"), "section")
    return E.discovery_tag(rows, known, "economy", "keys", "section").select(F.col("record_id").alias("mapping_id"), "discovery_tag")


@query(f"""WITH {_MAP}, s AS (SELECT *, row_number() OVER (PARTITION BY run, indicator ORDER BY controlling DESC, coalesce(confidence, -1) DESC, mapping_id DESC) AS r FROM m WHERE status = 'passed'),
a AS (SELECT * FROM s WHERE r = 1 AND run = 'A' AND indicator <> '6.2'), b AS (SELECT * FROM s WHERE r = 1 AND run = 'N' AND indicator <> '7.4'), l AS (SELECT unnest({_IDS}) AS indicator)
SELECT l.indicator, a.mapping_id AS a_id, b.mapping_id AS b_id, CASE WHEN a.mapping_id IS NULL AND b.mapping_id IS NULL THEN 'neither' WHEN b.mapping_id IS NULL THEN 'only_a' WHEN a.mapping_id IS NULL THEN 'only_b' WHEN a.document = b.document AND a.section = b.section THEN 'agree' ELSE 'disagree' END AS mark
FROM l LEFT JOIN a ON a.indicator = l.indicator LEFT JOIN b ON b.indicator = l.indicator""")
def compare_full_outer(spark: SparkSession, d: str) -> DataFrame:
    m = mappings(spark, d).where("status = 'passed'")
    listed = spark.createDataFrame([(k,) for k in E.ABSENCE], "indicator string")
    return C.compare_runs(m.where("run = 'A' AND indicator <> '6.2'"), m.where("run = 'N' AND indicator <> '7.4'"), listed, "indicator", ["document", "section"], "controlling", "confidence", "mapping_id")


@query(f"""WITH {_MAP}, a AS (SELECT *, row_number() OVER (PARTITION BY document, section, indicator, chunk ORDER BY mapping_id) AS n FROM m WHERE run = 'A'), b AS (SELECT *, row_number() OVER (PARTITION BY document, section, indicator, chunk ORDER BY mapping_id) AS n FROM m WHERE run = 'N'),
p AS (SELECT a.mapping_id AS a_id, b.mapping_id AS b_id, 1 AS stage FROM a JOIN b USING (document, section, indicator, chunk, n)),
a2 AS (SELECT document, section, mapping_id, row_number() OVER (PARTITION BY document, section ORDER BY mapping_id) AS n FROM a WHERE mapping_id NOT IN (SELECT a_id FROM p)), b2 AS (SELECT document, section, mapping_id, row_number() OVER (PARTITION BY document, section ORDER BY mapping_id) AS n FROM b WHERE mapping_id NOT IN (SELECT b_id FROM p))
SELECT * FROM p UNION ALL SELECT a2.mapping_id, b2.mapping_id, CASE WHEN a2.mapping_id IS NULL OR b2.mapping_id IS NULL THEN 0 ELSE 2 END FROM a2 FULL JOIN b2 USING (document, section, n)""")
def compare_staged_pairing(spark: SparkSession, d: str) -> DataFrame:
    m = mappings(spark, d)
    return C.staged_pairs(m.where("run = 'A'"), m.where("run = 'N'"), ["document", "section"], [["indicator", "chunk"], []], "mapping_id").select("a_id", "b_id", "stage")


@query("""WITH p AS (SELECT a.conv_id, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
x AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(a), '[\\p{L}\\p{M}\\p{N}_]+')) AS w FROM p) GROUP BY ALL), y AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(b), '[\\p{L}\\p{M}\\p{N}_]+')) AS w FROM p) GROUP BY ALL)
SELECT conv_id, sum(least(coalesce(x.n, 0), coalesce(y.n, 0)))::BIGINT AS shared, sum(coalesce(x.n, 0))::BIGINT AS n_a, sum(coalesce(y.n, 0))::BIGINT AS n_b FROM x FULL JOIN y USING (conv_id, w) GROUP BY conv_id""")
def bag_word_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "conversations")
    turn = lambda k, name: c.where(F.col("turn") == k).select("conv_id", F.col("text").alias(name))
    return C.shared_words(turn(0, "a").join(turn(1, "b"), "conv_id"), "conv_id", "a", "b")


_REVIEWS = "r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS status FROM labels)"


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("status"))


@query(f"WITH {_REVIEWS} SELECT count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'flagged') AS flagged, 0::BIGINT AS corrected, count(*) FILTER (status IS NULL) AS unreviewed FROM documents LEFT JOIN r USING (doc_id)")
def review_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.review_counts(T(spark, d, "documents").select("doc_id"), reviews(spark, d), ["doc_id"])


@query(f"WITH {_REVIEWS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r)")
def unreviewed_anti(spark: SparkSession, d: str) -> DataFrame:
    return B.delete_where(T(spark, d, "documents").select("doc_id"), reviews(spark, d), ["doc_id"])[0]


@query(f"WITH {_REVIEWS} SELECT doc_id, status FROM r UNION ALL SELECT doc_id, 'accepted' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r)")
def accept_all(spark: SparkSession, d: str) -> DataFrame:
    return B.accept_all(T(spark, d, "documents").select("doc_id"), reviews(spark, d), ["doc_id"])


@query(f"WITH {_MAP} SELECT mapping_id, row_number() OVER (PARTITION BY economy ORDER BY confidence NULLS FIRST, mapping_id) AS place FROM m")
def review_queue_nulls_first(spark: SparkSession, d: str) -> DataFrame:
    """Every mapping with its place in its economy's queue."""
    return B.review_queue(mappings(spark, d), "confidence", "mapping_id", ["economy"]).select("mapping_id", "place")


@query(f"""WITH {_MAP}, {_REVIEWS}, x AS (SELECT m.*, r.status AS s FROM m LEFT JOIN r ON r.doc_id = (split_part(mapping_id, '-', 1))::BIGINT % 1000)
SELECT indicator, count(*) FILTER (s = 'accepted') AS kept, count(*) FILTER (coalesce(s <> 'accepted', true)) AS withheld FROM x GROUP BY indicator""")
def review_gate(spark: SparkSession, d: str) -> DataFrame:
    m = mappings(spark, d).withColumn("doc_id", F.split("mapping_id", "-")[0].cast("long") % 1000)
    told = m.join(reviews(spark, d).withColumnRenamed("status", "s"), "doc_id", "left").where("s IS NOT NULL").select("mapping_id", F.col("s").alias("status"), F.lit(None).cast("string").alias("corrected"))
    kept, withheld = B.review_gate(mappings(spark, d).drop("status"), told, spark.createDataFrame([], "mapping_id string"), "mapping_id", "indicator")
    return kept.groupBy("indicator").agg(F.count(F.lit(1)).alias("kept")).join(withheld, "indicator", "full").fillna(0, ["kept", "withheld"])
