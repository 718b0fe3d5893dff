"""Queries on text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import python as P
from veriloom.functions import text as X
from veriloom.plans.catalogue import query
from veriloom.plans.retrieval import tokens_sql
from veriloom.sources import readers
from veriloom.sources.readers import parquet as T

_LAW = "CASE o_orderkey % 6 WHEN 0 THEN 'Privacy Act ' || y WHEN 1 THEN 'Data Rules (Amendment) ' || y WHEN 2 THEN 'Code of Practice No. ' || o_custkey WHEN 3 THEN 'Notice ' || y || '/' || o_custkey WHEN 4 THEN 'Draft Bill ' || o_custkey ELSE 'UU Nomor ' || (o_custkey % 30) || ' Tahun ' || y END"
_LAWS = f"l AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, {_LAW} AS law, 's. ' || (o_custkey % 90) || '(' || (o_orderkey % 4) || ')' AS section FROM (SELECT *, 1990 + o_custkey % 30 AS y FROM orders))"


def laws(spark: SparkSession, d: str) -> DataFrame:
    """Orders as provisions: a law's name and a section label made of the keys."""
    o = T(spark, d, "orders").withColumn("y", (1990 + F.col("o_custkey") % 30).cast("string"))
    n = F.col("o_custkey").cast("string")
    k = F.col("o_orderkey") % 6
    law = (
        F.when(k == 0, F.concat(F.lit("Privacy Act "), "y"))
        .when(k == 1, F.concat(F.lit("Data Rules (Amendment) "), "y"))
        .when(k == 2, F.concat(F.lit("Code of Practice No. "), n))
        .when(k == 3, F.concat(F.lit("Notice "), "y", F.lit("/"), n))
        .when(k == 4, F.concat(F.lit("Draft Bill "), n))
        .otherwise(F.concat(F.lit("UU Nomor "), (F.col("o_custkey") % 30).cast("string"), F.lit(" Tahun "), "y"))
    )
    section = F.concat(F.lit("s. "), (F.col("o_custkey") % 90).cast("string"), F.lit("("), (F.col("o_orderkey") % 4).cast("string"), F.lit(")"))
    return o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", law.alias("law"), section.alias("section"))


@query(f"SELECT doc_id, len({tokens_sql('text')}) AS n, md5(array_to_string({tokens_sql('text')}, ' ')) AS tokens FROM documents")
def legal_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "documents").select("doc_id", X.legal_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens"))


@query(f"WITH {_LAWS} SELECT o_orderkey, array_to_string({tokens_sql("law || ' ' || section || ' Part IVA Cap. 88'")}, ' ') AS tokens FROM l")
def legal_tokens_of_citations(spark: SparkSession, d: str) -> DataFrame:
    return laws(spark, d).select("o_orderkey", F.array_join(X.legal_tokens(F.concat_ws(" ", "law", "section", F.lit("Part IVA Cap. 88"))), " ").alias("tokens"))


@query(f"""WITH {_LAWS} SELECT o_orderkey, regexp_extract(section, '(\\d+)', 1) AS base, regexp_replace(section, '^s\\. ', '') AS citation,
 trim(regexp_replace(lower(regexp_replace(law, '\\([^)]*\\)', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS law_key,
 CASE WHEN regexp_matches(lower(law), 'code of practice') THEN 3 WHEN regexp_matches(lower(law), '\\bnotice\\b') THEN 2 WHEN regexp_matches(lower(law), '\\brules\\b') THEN 1 WHEN regexp_matches(lower(law), '\\bact\\b') THEN 0 ELSE 4 END AS rank,
 coalesce(nullif(regexp_extract(law, '(\\d{{4}})', 1), '')::INT, -1) AS recency, regexp_extract(law, '\\b((?:19|20)\\d{{2}})\\b', 1) AS year FROM l""")
def citation_keys(spark: SparkSession, d: str) -> DataFrame:
    s, law = F.col("section"), F.col("law")
    return laws(spark, d).select("o_orderkey", X.section_base(s).alias("base"), X.citation_key(s, s).alias("citation"), X.norm_law(law).alias("law_key"), X.instrument_rank(law).alias("rank"), X.recency(law).alias("recency"), X.first_year(law).alias("year"))


@query(f"""WITH {_LAWS} SELECT o_orderkey, CASE WHEN regexp_matches(law, '^UU') THEN 'uu:' || regexp_extract(law, 'Nomor (\\d+)', 1) || ':' || regexp_extract(law, 'Tahun (\\d+)', 1) END AS ident FROM l""")
def instrument_identity(spark: SparkSession, d: str) -> DataFrame:
    return laws(spark, d).select("o_orderkey", X.instrument_ident(F.lit("ID"), F.col("law")).alias("ident"))


@query(f"""WITH {_LAWS} SELECT o_orderkey, concat_ws('|', CASE WHEN regexp_matches(law, '(?i)\\bdraft\\b|\\bbill\\b') THEN 'draft' END, CASE WHEN contains(law, 'Amendment') OR law IN ('UU Nomor 19 Tahun 2016', 'UU Nomor 1 Tahun 2024') THEN 'amending' END,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'duration' END, CASE WHEN o_orderpriority = '2-HIGH' THEN 'conditional' END) AS flags FROM l""")
def trap_flags(spark: SparkSession, d: str) -> DataFrame:
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    indicator = F.when(urgent, "7.3").when(high, "6.1").otherwise("7.1")
    quote = F.when(high, "no transfer unless approved").otherwise("records are to be kept")
    none = F.lit(None).cast("string")
    names = F.create_map(*[F.lit(x) for k, v in X.TRAP_TEXTS.items() for x in (v, k)])
    flags = X.trap_flags(F.col("law"), quote, none, none, F.col("section"), indicator)
    return laws(spark, d).select("o_orderkey", F.array_join(F.transform(flags, lambda f: names[f]), "|").alias("flags"))


@query("""WITH u AS (SELECT page_id, trim(url) AS u FROM pages), p AS (SELECT page_id, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') AS host,
 regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(u, '\\?([^#]*)', 1) AS q, regexp_extract(u, '#(/.*)$', 1) AS r FROM u)
SELECT page_id, CASE WHEN host = '' OR (path = '' AND q = '' AND r = '') THEN '' ELSE host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END || CASE WHEN r <> '' THEN '#' || r ELSE '' END END AS key FROM p""")
def norm_url(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "pages").select("page_id", X.norm_url(F.col("url")).alias("key"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, CASE WHEN contains(substr(html, 1, 1024), '%PDF-') THEN 'pdf' ELSE 'html' END AS format FROM pages")
def html_titles(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"), X.sniff_format(F.col("html").cast("binary")).alias("format"))


@query(None)
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """The parsed text, and whether the native chain gives the same words."""
    both = readers.pages(T(spark, d, "pages"), "html").select("page_id", "text", P.page_text_udf()(F.col("html")).alias("parsed"))
    words = lambda c: F.regexp_replace(F.trim(c), r"(?U)\s+", " ")
    return both.select("page_id", "parsed", (words(F.col("text")) == words(F.col("parsed"))).alias("same_words"))


@query("""SELECT doc_id, CASE WHEN length(text) > 0 THEN round(coalesce(list_sum(list_transform(regexp_extract_all(text, '\\S{30,}'), lambda m: length(m))), 0) / length(text), 6) ELSE 0 END AS squash,
 CASE WHEN regexp_matches(text, '[\\x{0E80}-\\x{0EFF}]') THEN 'lo' WHEN regexp_matches(text, '[\\x{0E00}-\\x{0E7F}]') THEN 'th' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'zh' ELSE 'und' END AS script FROM documents""")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return T(spark, d, "documents").select("doc_id", F.round(X.squash_fraction(t), 6).alias("squash"), X.script_language(t).alias("script"))


_FUNCTION = ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS)


@query(f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z'']+') AS w, list_filter(string_split_regex(lower(text), '[,;]'), lambda i: regexp_matches(i, '[a-z'']')) AS items FROM documents)
SELECT doc_id, len(w) >= 8 AND NOT (len(items) >= 3 AND len(list_filter(items, lambda i: len(regexp_extract_all(i, '[a-z'']+')) > 3)) = 0) AND NOT list_has_any(w, [{_FUNCTION}]) AS non_english FROM w""")
def non_english(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", X.looks_non_english(F.col("text")).alias("non_english"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\t\\n\\v\\f\\r ]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
m AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t) WHERE w[i] = w[i + 1] GROUP BY doc_id)
SELECT doc_id, coalesce(m.n, 0) > 3 OR coalesce(a.n, 0) > 3 AS degenerate FROM t LEFT JOIN m USING (doc_id) LEFT JOIN a USING (doc_id)""")
def degenerate_text(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    # counts of runs within the row: sorted neighbours, so nothing leaves it
    runs = F.sort_array(F.expr("transform(sequence(1, greatest(size(w) - 2, 0)), i -> if(i < 1 or i > size(w) - 2, null, concat_ws(' ', w[i - 1], w[i], w[i + 1])))"))
    four = F.exists(F.arrays_zip(F.col("r").alias("a"), F.slice("r", 4, 1 << 30).alias("b")), lambda z: z["a"] == z["b"])
    beside = F.size(F.filter(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1 << 30).alias("b")), lambda z: z["a"] == z["b"]))
    return t.withColumn("r", F.filter(runs, lambda x: x.isNotNull())).select("doc_id", (F.coalesce(four, F.lit(False)) | (beside > 3)).alias("degenerate"))


@query("""WITH n AS (SELECT doc_id, length(text) AS n FROM documents), c AS (SELECT *, ceil(n / 400)::BIGINT AS k FROM n)
SELECT doc_id, unnest(CASE WHEN k <= 8 THEN list_transform(range(0, k), lambda i: i * 400) ELSE list_distinct(list_transform(range(0, 8), lambda i: round_even(i * (n - 400) / 7, 0)::BIGINT)) END) AS start FROM c WHERE n > 0""")
def char_windows(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", F.explode(X.char_windows(F.length("text"), 400, 8)).alias("w")).select("doc_id", "w.start")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS cosine, l_quantity * 10 AS len, l_linenumber AS n, l_orderkey % 4 AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, round(0.45 * greatest(0, least(1, (cosine - 0.35) / 0.40)) + 0.25 * least(1, len / 240.0) + 0.15 * CASE WHEN n <= 1 THEN 1.0 ELSE greatest(0.4, 1 - 0.15 * (n - 1)) END
 + 0.15 * CASE a WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.3 END, 9) AS confidence FROM x""")
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    li = T(spark, d, "lineitem")
    told = X.confidence(F.col("l_discount") * 10, F.col("l_quantity") * 10, F.col("l_linenumber"), F.col("l_orderkey") % 4, places=9)
    return li.select("l_orderkey", "l_linenumber", told.alias("confidence"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(substr(text, 1, 299), ' [^ ]*$', '') || '…' END AS rationale FROM documents""")
def rationale_cap(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", X.rationale(F.col("text")).alias("rationale"))


@query("SELECT doc_id, sha256(concat_ws(chr(31), source, lang, text)) AS cache_key, sha256(text) AS sha FROM documents")
def extraction_keys(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", readers.cache_key("source", "lang", "text").alias("cache_key"), F.sha2("text", 256).alias("sha"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents), v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark)
SELECT doc_id, round(avg((v.w IS NOT NULL)::INT), 6) AS hit_rate FROM t LEFT JOIN v USING (w) GROUP BY doc_id""")
def dictionary_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    words = lambda name: F.explode(X.matches(F.lower(F.col("text")), "[a-z]{3,}")).alias(name)
    known = T(spark, d, "benchmark").select(words("w")).distinct().withColumn("hit", F.lit(1))
    counted = T(spark, d, "documents").select("doc_id", words("w")).groupBy("doc_id", "w").count()
    return counted.join(known, "w", "left").groupBy("doc_id").agg(F.round(F.sum(F.col("count") * F.coalesce("hit", F.lit(0))) / F.sum("count"), 6).alias("hit_rate"))


@query(None)
def unicode_forms(spark: SparkSession, d: str) -> DataFrame:
    """Composed text with the places of its code points, and the name key in compatibility form."""
    t = T(spark, d, "documents").select("doc_id", "source", P.compose_udf()(F.col("text")).alias("c"), P.law_key_udf()(F.col("text")).alias("law_key"))
    return t.select("doc_id", F.length("c.text").alias("n"), F.size("c.old").alias("offsets"), "law_key")


@query(None)
def character_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages against each other's neighbour: a semi-global distance, by the item before."""
    b = T(spark, d, "benchmark").select("item_id", F.col("text").alias("a"))
    other = b.select((F.col("item_id") + 1).alias("item_id"), F.col("a").alias("b"))
    return b.join(other, "item_id").select("item_id", F.round(P.error_rate_udf()(F.col("a"), F.col("b")), 6).alias("rate"))
