"""Queries on spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.operators import spans as S
from veriloom.plans.catalogue import query
from veriloom.sources.readers import parquet as T


@query("""WITH c AS (SELECT doc_id, i * 500 AS char_start, least(length(text), i * 500 + 700) AS char_end FROM (SELECT doc_id, text, unnest(range(0, 1 + length(text) // 500)) AS i FROM documents) WHERE i * 500 < length(text))
SELECT doc_id, char_start, char_end, md5(substr(text, char_start + 1, char_end - char_start)) AS chunk FROM c JOIN documents USING (doc_id)""")
def chunk_slice_join(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents").select("doc_id", "text")
    starts = docs.select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 500))).alias("i")).where(F.col("i") * 500 < F.col("n"))
    chunks = starts.select("doc_id", (F.col("i") * 500).cast("int").alias("char_start"), F.least("n", F.col("i") * 500 + 700).cast("int").alias("char_end"))
    return S.chunk_texts(chunks, docs, "doc_id", "text").select("doc_id", "char_start", "char_end", F.md5(F.col("chunk_text").cast("binary")).alias("chunk"))


_PAGES = "p AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, length(text) AS n FROM conversations)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as the pages of a conversation."""
    return S.page_spans(T(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")


@query(f"WITH {_PAGES} SELECT conv_id, turn, char_start, char_start + n AS char_end FROM p")
def page_join_spans(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("conv_id", "turn", "char_start", "char_end")


@query(f"""WITH {_PAGES}, e AS (SELECT event_id, event_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS conv_id, (event_id * 37) % 3000 AS pos FROM events)
SELECT event_id, pos, coalesce(max_by(turn, char_start) FILTER (char_start <= pos), min_by(turn, char_start)) AS page FROM e JOIN p USING (conv_id) GROUP BY event_id, pos""")
def page_asof_lookup(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select("conv_id", "char_start", F.col("turn").alias("page"))
    n = T(spark, d, "conversations").select("conv_id").distinct().count()
    points = T(spark, d, "events").select("event_id", (F.col("event_id") % n).alias("conv_id"), ((F.col("event_id") * 37) % 3000).alias("pos"))
    return S.as_of(points, pages, "conv_id", "pos", "char_start", "page").where(F.col("page").isNotNull()).select("event_id", "pos", "page")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber AS idx, (l_partkey % 4000) AS s, (l_partkey % 4000) + 10 + l_quantity::INT AS e FROM lineitem),
q AS (SELECT o_orderkey, o_orderkey // 8 * 8 AS k, (o_custkey * 13) % 4000 AS s, (o_custkey * 13) % 4000 + 400 AS e FROM orders)
SELECT o_orderkey, w.l_orderkey, idx FROM q JOIN w ON w.l_orderkey // 8 * 8 = k AND w.s < q.e AND w.e > q.s""")
def span_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    group = lambda c: (F.floor(F.col(c) / 8) * 8).alias("k")
    words = T(spark, d, "lineitem").select(group("l_orderkey"), "l_orderkey", F.col("l_linenumber").alias("idx"), (F.col("l_partkey") % 4000).alias("l_start"), ((F.col("l_partkey") % 4000) + 10 + F.col("l_quantity").cast("int")).alias("l_end"))
    at = (F.col("o_custkey") * 13) % 4000
    quotes = T(spark, d, "orders").select(group("o_orderkey"), "o_orderkey", at.alias("r_start"), (at + 400).alias("r_end"))
    return S.overlaps(words, quotes, "k").select("o_orderkey", "l_orderkey", "idx")


_BOXES = "b AS (SELECT l_orderkey, (l_partkey % 2)::INT AS page, l_partkey * 10 + l_linenumber AS x0, l_partkey * 10 + l_linenumber + 50 AS x1, (l_partkey % 60) AS y0, (l_partkey % 60) + 5 + l_quantity::INT % 9 AS y1 FROM lineitem)"


@query(f"""WITH {_BOXES}, l AS (SELECT *, lag(page) OVER w AS p, least(y1, lag(y1) OVER w) - greatest(y0, lag(y0) OVER w) AS shared, least(y1 - y0, lag(y1) OVER w - lag(y0) OVER w) AS low FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY page, y0, x0, x1, y1)),
n AS (SELECT *, sum((p IS NULL OR p <> page OR shared < 0.5 * low)::INT) OVER (PARTITION BY l_orderkey ORDER BY page, y0, x0, x1, y1 ROWS UNBOUNDED PRECEDING) AS line FROM l)
SELECT l_orderkey, line::BIGINT AS line, min(page) AS page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM n GROUP BY l_orderkey, line""")
def line_islands_merge(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_partkey") * 10 + F.col("l_linenumber"), F.col("l_partkey") % 60
    boxes = T(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 2).cast("int").alias("page"), x.alias("x0"), (x + 50).alias("x1"), y.alias("y0"), (y + 5 + F.col("l_quantity").cast("int") % 9).alias("y1"))
    return S.merge_lines(boxes, ["l_orderkey"])


@query("""WITH l AS (SELECT l_orderkey, pos, v, lag(v) OVER (PARTITION BY l_orderkey ORDER BY pos, v) AS p FROM (SELECT l_orderkey, l_linenumber * 100000000 + l_partkey AS pos, l_partkey % 50 AS v FROM lineitem)),
r AS (SELECT *, sum((p IS NULL OR v <= p)::INT) OVER (PARTITION BY l_orderkey ORDER BY pos, v ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l),
c AS (SELECT l_orderkey, run, count(*) AS n FROM r GROUP BY ALL) SELECT l_orderkey, max(n) AS longest, count(*) AS runs FROM c GROUP BY l_orderkey""")
def increasing_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * F.lit(100_000_000) + F.col("l_partkey")).alias("at"), (F.col("l_partkey") % 50).alias("v"))
    runs = S.increasing_runs(rows, ["l_orderkey"], "at", "v").groupBy("l_orderkey", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("l_orderkey").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("runs"))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents)
SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL HAVING count(*) >= 3""")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.furniture(T(spark, d, "documents"), "doc_id", "text", 3)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no::INT AS line_no, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM l""")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    return S.lines(T(spark, d, "documents"), "doc_id", "text").select("doc_id", "line_no", F.length("line").alias("n"), "offset")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_suppkey % 5 AS num FROM lineitem),
n AS (SELECT *, lead(l_linenumber) OVER (PARTITION BY l_orderkey, num ORDER BY l_linenumber) AS nxt FROM k)
SELECT l_orderkey, l_linenumber, num FROM n WHERE nxt IS NULL OR nxt - l_linenumber > 2""")
def catchword_drop(spark: SparkSession, d: str) -> DataFrame:
    """A heading whose number comes again within the next lines is a catchword."""
    k = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 5).alias("num"))
    w = Window.partitionBy("l_orderkey", "num").orderBy("l_linenumber")
    return k.withColumn("nxt", F.lead("l_linenumber").over(w)).where(F.col("nxt").isNull() | (F.col("nxt") - F.col("l_linenumber") > 2)).drop("nxt")


@query("SELECT item_id, doc_id, instr(d.text, b.text) - 1 AS char_start FROM benchmark b, documents d WHERE contains(d.text, b.text)")
def quote_containment(spark: SparkSession, d: str) -> DataFrame:
    quotes = T(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = S.containments(quotes, T(spark, d, "documents").select("doc_id", "text"), "quote", "text")
    return found.select("item_id", "doc_id", (F.instr(F.col("text"), F.col("quote")) - 1).alias("char_start"))


@query("""WITH q AS (SELECT doc_id, text, substr(text, 101, 60) AS quote FROM documents WHERE length(text) > 200)
SELECT doc_id, instr(text, quote) - 1 AS char_start, instr(text, quote) - 1 + length(quote) AS char_end, length(substr(text, greatest(instr(text, quote) - 301, 0) + 1, instr(text, quote) - 1 - greatest(instr(text, quote) - 301, 0) + length(quote) + 300)) AS around FROM q""")
def quote_locate(spark: SparkSession, d: str) -> DataFrame:
    q = T(spark, d, "documents").where(F.length("text") > 200).withColumn("quote", F.substring("text", 101, 60))
    at = S.locate_quote(F.col("text"), F.col("quote"), F.lit(0), F.length("text"))
    return q.select("doc_id", at.alias("at"), F.length(S.context(F.col("text"), F.col("quote"))).alias("around")).select("doc_id", F.col("at.start").alias("char_start"), F.col("at.end").alias("char_end"), "around")


@query("""SELECT doc_id, md5(substr(text, 11, 80)) AS anchored FROM documents WHERE length(text) > 400""")
def quote_anchor(spark: SparkSession, d: str) -> DataFrame:
    """The words of a quote whose white space was changed are found again as they stand, where they stand once."""
    docs = T(spark, d, "documents").where(F.length("text") > 400).withColumn("own", F.substring("text", 11, 80))
    drift = F.regexp_replace("own", r"\s+", "  ")
    anchored = S.anchor_quote(F.col("own"), F.trim(drift))
    same = F.trim(F.regexp_replace(anchored, r"\s+", " ")) == F.trim(F.regexp_replace("own", r"\s+", " "))
    return docs.withColumn("same", same).select("doc_id", F.when(F.col("same"), F.md5(F.col("own").cast("binary"))).alias("anchored"))
