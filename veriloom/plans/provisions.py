"""Queries on the names of laws, where a provision stands, and how two records of it differ. Parts and line items name the laws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import titles as N
from veriloom.functions.text import quoted_words
from veriloom.operators import compare as C
from veriloom.plans.catalogue import query
from veriloom.sources.readers import parquet as T


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], at: str) -> str:
    return f"({_list(values)})[({at}) % {len(values)} + 1]"


_ECONOMIES = ["CN", "sg", "ID", "AU", "VN", "my", "kz", "TH", ""]
_LABELS = ["s. ", "Part IV, s.", "Schedule ", "Acts. "]


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_pick_sql(_ECONOMIES, "l_suppkey")} AS e, {_pick_sql(_LABELS, "l_partkey")} || (l_partkey % 90 + 1) AS label FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN upper(e) IN ('CN', 'ID', 'LA', 'VN', 'KZ', 'RU', 'MN', 'TL') THEN regexp_replace(label, '(^|[^A-Za-z])s\\.\\s*', '\\1Art. ') ELSE label END AS label FROM x""")
def drafting_labels(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(_pick(_LABELS, F.col("l_partkey")), (F.col("l_partkey") % 90 + 1).cast("string"))
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.drafting_label(label, _pick(_ECONOMIES, F.col("l_suppkey"))).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'HTML: s. ' || l_partkey END
 WHEN l_suppkey % 9 = 0 THEN '' ELSE 'PDF: page ' || (l_suppkey % 9) END AS location FROM lineitem""")
def location_references(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("l_partkey") % 7 != 0, F.concat(F.lit("s. "), F.col("l_partkey").cast("string")))
    kind = F.when(F.col("l_linestatus") == "O", "html").otherwise("pdf")
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.location_reference(kind, F.col("l_suppkey") % 9, path).alias("location"))


_SPOKEN = ["english", " Thai ", "Bahasa", "MANDARIN", "Malay", "tiếng Việt", "", "Other", "Laotian", "Russian"]
_LISTED = ["English", "Thai", "Bahasa Indonesia", "Chinese", "Other", "Vietnamese", "Other", "Other", "Lao", "Russian"]


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Other' ELSE {_pick_sql(_LISTED, "o_custkey")} END AS language FROM orders""")
def listed_languages(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 11 != 0, _pick(_SPOKEN, F.col("o_custkey")))
    return T(spark, d, "orders").select("o_orderkey", N.listed_language(raw).alias("language"))


_HEAD = "substr(coalesce(text, ''), 1, 600)"


@query(f"""SELECT doc_id, regexp_replace(array_to_string(list_filter(regexp_split_to_array({_HEAD}, '\\r\\n|[\\n\\r]'), lambda x: NOT regexp_matches(x, '[_|｜]')), chr(10)), '(?is)(?:{N.BLOCK_END}).*$', '') AS block FROM documents""")
def title_blocks(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", N.title_block(F.col("text")).alias("block"))


_NAMES = ["Personal Data Protection Act ", "Cyber Security Law ", "Tax Act ", "网络安全法 ", "Banking Code ", "Amendment of the Privacy Act ", "Peraturan Pemerintah "]
_HEADS = ["An Act\nto protect personal data\nWhereas privacy", "Act | Cyber Agency\nLaw on trade", "Rules for critical infrastructure\nMenimbang cyber", "Regulation of the Minister", ""]
_BLOCKS = ["An Act\nto protect personal data\n", "Law on trade", "Rules for critical infrastructure\n", "Regulation of the Minister", ""]
_FAMILY = "CASE WHEN i = '7.1' THEN len(list_filter(" + _list(N.FAMILIES["7.1"]) + ", lambda w: contains(lower(@), w))) > 0 WHEN i = '7.2' THEN len(list_filter(" + _list(N.FAMILIES["7.2"]) + ", lambda w: contains(lower(@), w))) > 0 ELSE false END"


@query(f"""WITH x AS (SELECT p_partkey, {_pick_sql(["7.1", "7.2", "6.1"], "p_size")} AS i, {_pick_sql(_NAMES, "p_partkey")} || p_size AS name, {_pick_sql(_BLOCKS, "p_partkey // 7")} AS block, p_partkey % 3 = 0 AS cited FROM part)
SELECT p_partkey, CASE WHEN {_FAMILY.replace('@', 'name')} THEN 0 WHEN {_FAMILY.replace('@', 'block')} THEN 1 WHEN cited THEN 2 END AS tier,
 len(list_filter({_list(N.SUBORDINATE_WORDS)}, lambda w: contains(lower(name), w) OR contains(lower(block), w))) > 0 OR regexp_matches(lower(name), '{N.SUBORDINATE_OPENING}') AS subordinate FROM x""")
def framework_tiers(spark: SparkSession, d: str) -> DataFrame:
    p = T(spark, d, "part").withColumn("name", F.concat(_pick(_NAMES, F.col("p_partkey")), F.col("p_size").cast("string"))).withColumn("head", _pick(_HEADS, F.floor(F.col("p_partkey") / 7)))
    tier = N.framework_tier(_pick(["7.1", "7.2", "6.1"], F.col("p_size")), F.col("name"), F.col("head"), F.col("p_partkey") % 3 == 0)
    return p.select("p_partkey", tier.alias("tier"), N.is_subordinate(F.col("name"), F.col("head")).alias("subordinate"))


_SITED = ["Privacy Act 1988 - Federal Register", "Act - Site", "网络安全法_办公室", "Data Law | Portal | Home", "plain title", " – only", "Two words — x_y"]
_BARE = ["Privacy Act 1988", "Act - Site", "网络安全法", "Data Law", "plain title", " – only", "Two words"]


@query(f"SELECT page_id, {_pick_sql(_BARE, 'page_id')} AS title FROM pages")
def site_names(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "pages").select("page_id", N.strip_site_name(_pick(_SITED, F.col("page_id"))).alias("title"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(((epoch_us(ts + INTERVAL 1 HOUR * (event_id % 9)) - epoch_us(ts)) / 1e6), 3) END AS seconds FROM events")
def run_durations(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    text = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    end = F.when(F.col("event_id") % 5 != 0, text(F.timestamp_micros(F.unix_micros(ts) + (F.col("event_id") % 9) * 3_600_000_000)))
    return T(spark, d, "events").select("event_id", F.round(N.duration_seconds(text(ts), end), 3).alias("seconds"))


_BAG = "list_sum(list_transform(list_distinct({0}), lambda w: least(len(list_filter({0}, lambda v: v = w)), len(list_filter({1}, lambda v: v = w)))))"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, p_name AS qa, CASE l_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' more' WHEN 2 THEN 'other words' ELSE split_part(p_name, ' ', 1) END AS qb,
  'k' || l_suppkey AS ka, CASE l_suppkey % 3 WHEN 0 THEN 'k' || l_suppkey WHEN 1 THEN 'k' || l_suppkey || '(1)' ELSE 'z' END AS kb, '6.' || (l_partkey % 2) AS ia, '6.' || (l_suppkey % 2) AS ib
  FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT *, regexp_extract_all(lower(qa), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS a, regexp_extract_all(lower(qb), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS b FROM x),
q AS (SELECT *, CASE WHEN a = b THEN 'same quoted words' WHEN len(b) > 0 AND contains(array_to_string(a, ' '), array_to_string(b, ' ')) THEN 'Engine A quoted more of the same text'
  WHEN len(a) > 0 AND contains(array_to_string(b, ' '), array_to_string(a, ' ')) THEN 'Engine B quoted more of the same text'
  ELSE 'different quoted words (' || round_even(100.0 * coalesce({_BAG.format('a', 'b')}, 0) / greatest(len(a), len(b), 1), 0)::INT || '% of words shared, A ' || len(a) || ' words, B ' || len(b) || ' words)' END AS q FROM w)
SELECT l_orderkey, l_linenumber, CASE WHEN ka = kb AND ia = ib AND q = 'same quoted words' THEN 'Same provision, Indicator and quoted words on both Engines' ELSE concat_ws('; ',
  CASE WHEN ka <> kb THEN 'Engine A cited ' || ka || ', Engine B cited ' || kb || CASE WHEN starts_with(ka, kb) THEN ', A is the more precise citation' WHEN starts_with(kb, ka) THEN ', B is the more precise citation' ELSE '' END END,
  CASE WHEN ia <> ib THEN 'Engine A mapped it to ' || ia || ', Engine B to ' || ib END, q) END AS difference FROM q""")
def provision_differences(spark: SparkSession, d: str) -> DataFrame:
    li = T(spark, d, "lineitem").join(T(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    name, key = F.col("p_name"), F.concat(F.lit("k"), F.col("l_suppkey").cast("string"))
    k, s = F.col("l_partkey") % 4, F.col("l_suppkey") % 3
    quote = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(" more"))).when(k == 2, "other words").otherwise(F.substring_index(name, " ", 1))
    other = F.when(s == 0, key).when(s == 1, F.concat(key, F.lit("(1)"))).otherwise("z")
    side = lambda key, quote, i: F.struct(key.alias("key"), key.alias("cite"), quote.alias("quote"), F.concat(F.lit("6."), (F.col(i) % 2).cast("string")).alias("indicator"))
    sides = li.select("l_orderkey", "l_linenumber", side(key, name, "l_partkey").alias("a"), side(other, quote, "l_suppkey").alias("b"))
    return sides.select("l_orderkey", "l_linenumber", C.difference(F.col("a"), F.col("b")).alias("difference"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS w FROM documents), p AS (SELECT doc_id, len(list_filter(w, lambda x: length(x) < 4)) AS low, len(w) AS n FROM w)
SELECT doc_id, n > 0 AND low / n > 0.5 AS scanned FROM p""")
def scanned_documents(spark: SparkSession, d: str) -> DataFrame:
    """Words as pages, short ones as pages of low yield."""
    w = quoted_words(F.col("text"))
    return T(spark, d, "documents").select("doc_id", N.needs_ocr(F.size(F.filter(w, lambda x: F.length(x) < 4)), F.size(w)).alias("scanned"))
