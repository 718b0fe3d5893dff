"""Queries on what a report says of its rows; orders, line items and events stand for records, runs and found files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import reports as R
from veriloom.operators import review as V
from veriloom.plans.catalogue import query
from veriloom.sources.readers import parquet as T


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _sql(values: list, at: str) -> str:
    return f"([{', '.join(map(_text, values))}])[({at}) % {len(values)} + 1]"


def _of(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values) + 1).cast("int"))


_RAW, _LISTED = ["Thai", "bahasa", None, "Malay", ""], ["Thai", "Bahasa Indonesia", None, "Other", None]
_PORTAL, _ONE = [["Lao"], ["English", "Thai"], []], ["Lao", None, None]


@query(f"""WITH x AS (SELECT o_orderkey, {_sql(_LISTED, "o_custkey")} AS r, {_sql(_ONE, "o_custkey // 5")} AS p FROM orders)
SELECT o_orderkey, coalesce(r, p, 'Other') AS language, coalesce(r, p) IS NULL AS disclosed FROM x""")
def resolved_languages(spark: SparkSession, d: str) -> DataFrame:
    portals = F.array(*[F.array(*map(F.lit, p)).cast("array<string>") for p in _PORTAL])
    portal = F.element_at(portals, (F.floor(F.col("o_custkey") / 5) % 3 + 1).cast("int"))
    return T(spark, d, "orders").withColumn("l", R.resolved_language(_of(_RAW, F.col("o_custkey")), portal)).select("o_orderkey", "l.language", "l.disclosed")


_URLS = ["https://a.gov/x", " HTTP://b.gov/y#s1 ", None, "file:/tmp/x", ""]
_PLACES = ["PDF: page 12", "HTML: s. 3 #sec-3", None, "page"]


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag || ' ' || l_linestatus AS doc, trim(coalesce({_sql(_URLS, "l_partkey")}, '')) AS url, CASE WHEN l_linestatus = 'O' THEN 'pdf' ELSE 'html' END AS f,
  coalesce({_sql(_PLACES, "l_suppkey")}, '') AS place, CASE WHEN l_linenumber % 2 = 0 THEN 'run_' || l_linenumber END AS run FROM lineitem),
y AS (SELECT *, CASE WHEN f = 'pdf' AND contains(place, 'page 12') THEN 12 END AS page, CASE WHEN f = 'html' AND contains(place, '#sec-3') THEN '#sec-3' END AS anchor FROM x)
SELECT l_orderkey, l_linenumber, page, CASE WHEN starts_with(lower(url), 'http') THEN 'official' ELSE 'local' END AS kind,
 CASE WHEN starts_with(lower(url), 'http') THEN url || CASE WHEN contains(url, '#') THEN '' ELSE coalesce('#page=' || page, anchor, '') END
  ELSE '/api/documents/' || replace(doc, ' ', '%20') || '/pdf' || coalesce('?run_id=' || run, '') || coalesce('#page=' || page, '') END AS href FROM y""")
def source_links(spark: SparkSession, d: str) -> DataFrame:
    run = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("run_"), F.col("l_linenumber").cast("string")))
    kind = F.when(F.col("l_linestatus") == "O", "pdf").otherwise("html")
    link = R.source_link(F.concat_ws(" ", "l_returnflag", "l_linestatus"), _of(_URLS, F.col("l_partkey")), kind, _of(_PLACES, F.col("l_suppkey")), run)
    return T(spark, d, "lineitem").withColumn("l", link).select("l_orderkey", "l_linenumber", "l.*")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'local-upload:' ELSE 'https://h/' || doc_id || '#sha256=' END || sha256(coalesce(text, '')) AS key,
 CASE WHEN doc_id % 3 <> 0 THEN 'https://h/' || doc_id END AS address FROM documents""")
def manifest_keys(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://h/"), F.col("doc_id").cast("string")))
    keyed = T(spark, d, "documents").select("doc_id", R.manifest_key(url, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"))
    return keyed.withColumn("address", R.manifest_address(F.col("key")))


_OPENINGS = [b"%PDF-1.7\n", b"PK\x03\x04", b"\xef\xbb\xbf <!DOCTYPE html>", b"", b"\xff\xfe", b"a\x00"]
_KINDS = ["pdf", None, "html", "text", None, None]
_PROBLEMS = [None, "a Word, Excel or PowerPoint file, or a zip archive", None, None, "not a PDF, a web page or plain text", "not a PDF, a web page or plain text"]


@query(f"SELECT doc_id, {_sql(_KINDS, 'doc_id')} AS kind, {_sql(_PROBLEMS, 'doc_id')} AS problem FROM documents")
def readable_kinds(spark: SparkSession, d: str) -> DataFrame:
    first = F.element_at(F.array(*[F.lit(bytearray(x)) for x in _OPENINGS]), (F.col("doc_id") % len(_OPENINGS) + 1).cast("int"))
    content = F.concat(first, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return T(spark, d, "documents").select("doc_id", R.readable_kind(content).alias("r")).select("doc_id", "r.kind", "r.problem")


_CODES = [*R.SKIP_REASONS, "unknown"]
_TOLD = {k: v.replace("%s", "HTTP 503") for k, v in R.SKIP_DETAILS.items()}


@query(f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_sql([*R.SKIP_REASONS.values(), None], "event_id")}
 ELSE {_sql([*({**R.SKIP_REASONS, **_TOLD}.values()), None], "event_id")} END AS reason FROM events""")
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return T(spark, d, "events").select("event_id", R.skip_reason(_of(_CODES, e), F.when(e % 2 == 1, "HTTP 503")).alias("reason"))


@query("""SELECT p_partkey, regexp_replace(lower(regexp_replace('The  ' || p_name || ' Act,' || chr(10) || '2023..', '\\s+', ' ', 'g')), '^the |\\.+$', '', 'g') AS key FROM part""")
def register_keys(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "part").select("p_partkey", R.register_key(F.concat(F.lit("The  "), "p_name", F.lit(" Act,\n2023.."))).alias("key"))


_COVERS = [
    "LAWS OF MALAYSIA\nPERSONAL DATA PROTECTION ACT 2010\ntext", "Surveillance Legislation Amendment\n(Identify and Disrupt) Act 2021\nNo. 98, 2021", "WARTA\nAct 709\nAKTA KESELAMATAN SIBER 2024",
    "no title\n\nhere", "The Criminal Procedure   Code 2010", "Privacy (Consequential\nAct 2012", "",
]
_NAMES = ["PERSONAL DATA PROTECTION ACT 2010", "Surveillance Legislation Amendment (Identify and Disrupt) Act 2021", "AKTA KESELAMATAN SIBER 2024", None, "Criminal Procedure Code 2010", None, None]


@query(f"SELECT p_partkey, {_sql(_NAMES, 'p_partkey')} AS title FROM part")
def statute_headings(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "part").select("p_partkey", R.heading_of(_of(_COVERS, F.col("p_partkey"))).alias("title"))


_FRONTS = [("SG", "version in force from 1/10/2022"), ("SG", "version in force from 1/13/2022, amendments up to and including 2 May 2021"), ("MY", "Publication in the Gazette ... 10 June 2010"), ("MY", "Date of Royal Assent : 2 June 2010"), ("AU", "Compilation date: 1 July 2023"), ("AU", "10 June 2010"), ("ID", "Compilation date: 1 July 2023")]
_DATES = ["October 2022", "May 2021", "June 2010", "June 2010", "July 2023", None, None]


@query(f"SELECT o_orderkey, {_sql(_DATES, 'o_orderkey')} AS amended FROM orders")
def stated_dates(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderkey")
    return T(spark, d, "orders").select("o_orderkey", R.last_amended(_of([t for _, t in _FRONTS], at), _of([e for e, _ in _FRONTS], at)).alias("amended"))


_ANSWERS = [
    '{"glosses": [{"mapping_id": "m", "english": "a"}, {"mapping_id": "m", "english": "b"}]}', 'Here:\n```json\n{"glosses": [{"mapping_id": "m", "english": "c"}]}\n```', 'see {"glosses": [{"mapping_id": 3, "english": "d"}, {"mapping_id": "n", "english": "e"}]} ok',
    "{broken", "", None, '{"glosses": "none"}',
]
_ENTRIES = ["m=b", "m=c", "n=e", "", "", "", ""]


@query(f"SELECT o_orderkey, {_sql(_ENTRIES, 'o_orderkey')} AS entries FROM orders")
def gloss_answers(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.transform(R.parse_glosses(_of(_ANSWERS, F.col("o_orderkey"))), lambda x: F.concat(x["mapping_id"], F.lit("="), x["english"]))
    return T(spark, d, "orders").select("o_orderkey", F.array_join(parsed, ";").alias("entries"))


_TONGUES, _PLACED = ["English", "Lao", "Other", None, "Chinese"], ["MY", "TL", "SG"]


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_sql(_TONGUES, "l_partkey")} AS l, {_sql(_PLACED, "l_suppkey")} AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN e = 'MY' AND coalesce(l, 'Other') IN ('English', 'Other') THEN 'eng+msa' WHEN e = 'TL' AND coalesce(l, 'Other') = 'Other' THEN 'por+eng'
 WHEN l = 'Lao' THEN 'lao+eng' WHEN l = 'Chinese' THEN 'chi_sim+eng' ELSE 'eng' END AS models, coalesce(l, 'Other') IN ('English', 'Other') AS proxy, coalesce(l, '') <> 'Lao' AS second,
 CASE WHEN l = 'Other' AND e = 'SG' THEN 'no tesseract language data is vendored for Language ''Other'', so the page was read as eng: the text is not trustworthy without a human check' END AS reason FROM x""")
def ocr_policies(spark: SparkSession, d: str) -> DataFrame:
    language, economy = _of(_TONGUES, F.col("l_partkey")), _of(_PLACED, F.col("l_suppkey"))
    p = R.ocr_policy(language, economy)
    named = [p["dictionary_proxy"].alias("proxy"), p["rapidocr_escalation"].alias("second"), p["manual_review_reason"].alias("reason")]
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.reading_models(language, economy).alias("models"), *named)


@query(f"""SELECT l_orderkey, l_linenumber, concat_ws(' / ', CASE WHEN l_partkey % 2 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN {_text(R.MECHANICAL_MANUAL_NOTE)} WHEN l_suppkey % 3 = 0 THEN {_text(R.MECHANICAL_PREPARED_NOTE)} ELSE {_text(R.MECHANICAL_NOTE)} END END,
 CASE WHEN l_partkey % 3 = 0 THEN {_text(R.ANY_HOST_NOTE)} END, CASE WHEN l_suppkey % 2 = 0 THEN {_text(R.MANUAL_NOTE)} END, CASE WHEN l_partkey % 5 = 0 THEN {_text(R.FIXTURE_NOTE)} END, CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS notes FROM lineitem""")
def disclosure_notes(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    notes = R.disclosures(p % 2 == 0, s % 2 == 0, s % 3 == 0, p % 3 == 0, p % 5 == 0, F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")))
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(notes, " / ").alias("notes"))


@query("""SELECT l_suppkey, count(*) AS n_records, count(*) FILTER (o_orderpriority LIKE '1%') AS n_accepted, count(*) FILTER (o_orderpriority LIKE '2%') AS n_rejected,
 count(*) FILTER (o_orderpriority LIKE '3%') AS n_flagged, count(*) FILTER (o_orderpriority LIKE '4%') AS n_corrected FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey""")
def document_summaries(spark: SparkSession, d: str) -> DataFrame:
    named = F.get(F.array(*map(F.lit, V.STATUSES)), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    reviews = T(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), named.alias("status"))
    return V.document_summaries(T(spark, d, "lineitem"), reviews, "l_suppkey", "l_orderkey")


@query("""SELECT DISTINCT l_suppkey, (CASE WHEN s THEN l_linenumber + 10 ELSE l_linenumber END)::INT AS pillar FROM lineitem, (VALUES (true), (false)) v(s)""")
def pillars_covered(spark: SparkSession, d: str) -> DataFrame:
    li = T(spark, d, "lineitem")
    rows = lambda more: li.select("l_suppkey", F.concat((F.col("l_linenumber") + more).cast("string"), F.lit(".1")).alias("indicator"))
    return V.pillars_covered(rows(0), rows(10), "l_suppkey", "indicator")
