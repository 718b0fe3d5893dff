"""Queries on ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.text import STOPWORDS, quoted_words
from veriloom.operators import retrieval as R
from veriloom.plans.catalogue import query
from veriloom.sources.readers import parquet as T

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
#: The tokens of texts that hold statutory references are tested apart (legal_tokens); here the words rule alone is spelled out.
_SPECIAL = r"(?:\bs\.?|\bsection)\s+(\d+[a-z]{0,3})\s*(\(\d+[a-z]?\))?|\bpart\s+([ivxlc]+[a-z]?|\d+(?:\.\d+)?[a-z]{0,2})\b|\bcap\.?\s*(\d+)"
_TOKENS = rf"""list_concat(
    list_transform(list_zip(regexp_extract_all(@text, '{_SPECIAL}', 1), regexp_extract_all(@text, '{_SPECIAL}', 2), regexp_extract_all(@text, '{_SPECIAL}', 3), regexp_extract_all(@text, '{_SPECIAL}', 4)),
      lambda m: CASE WHEN m[1] <> '' THEN 's' || m[1] || m[2] WHEN m[3] <> '' THEN 'part' || m[3] ELSE 'cap' || m[4] END),
    list_filter(regexp_extract_all(regexp_replace(@text, '{_SPECIAL}', ' ', 'g'), '[a-z][a-z0-9-]+'), lambda w: w NOT IN ({_STOP})))"""


def tokens_sql(text: str) -> str:
    return _TOKENS.replace("@text", f"lower({text})")


_WINDOWS = f"""
v AS (SELECT item_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM benchmark),
s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 2000)) AS start FROM documents),
w AS (SELECT doc_id, start // 2000 AS win, substr(text, start + 1, 4000) AS piece FROM s),
t AS (SELECT doc_id, win, {tokens_sql('piece')} AS tokens FROM w),
n AS (SELECT doc_id, win, len(tokens) AS n FROM t),
g AS (SELECT count(*) AS pieces, avg(n) AS mean FROM n),
e AS (SELECT doc_id, win, unnest(tokens) AS term FROM t),
f AS (SELECT doc_id, win, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM v) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
b AS (SELECT doc_id, win, item_id, sum(ln(1 + (pieces - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS bm25
      FROM f JOIN df USING (term) JOIN v USING (term) JOIN n USING (doc_id, win), g GROUP BY ALL),
best AS (SELECT doc_id, item_id, round(max(bm25), 9) AS bm25 FROM b GROUP BY ALL),
r AS (SELECT doc_id, item_id, 1 - (rank() OVER (PARTITION BY item_id ORDER BY bm25 DESC) - 1) / (SELECT count(*) FROM documents) AS lexical FROM best),
lex AS (SELECT doc_id, max(lexical) AS lexical FROM r GROUP BY doc_id)"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return R.query_terms(T(spark, d, "benchmark"), "item_id", "text")


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return R.best_ranks(T(spark, d, "documents"), "doc_id", "text", _terms(spark, d), "item_id")


@query(f"WITH {_WINDOWS} SELECT doc_id, round(lexical, 6) AS lexical FROM lex")
def bm25_best_window_rank(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d).select("doc_id", F.round("lexical", 6).alias("lexical"))


@query(f"WITH {_WINDOWS} SELECT doc_id, item_id, round(bm25, 6) AS bm25 FROM best")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    best = R.best_windows(T(spark, d, "documents"), "doc_id", "text", _terms(spark, d), "item_id")
    return best.select("doc_id", "item_id", F.round("bm25", 6).alias("bm25"))


_COS = """
p AS (SELECT label, list_transform(range(1, 65), lambda i: 0.0) AS z FROM embeddings GROUP BY label),
x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM x GROUP BY label),
k AS (SELECT count(*) AS n FROM embeddings),
ew AS (SELECT doc_id, vec_id, embedding FROM documents, k JOIN embeddings ON vec_id = doc_id % n),
cs AS (SELECT doc_id, max(list_cosine_similarity(embedding::DOUBLE[], centroid)) AS cosine FROM ew, c GROUP BY doc_id)"""


def _cosines(spark: SparkSession, d: str) -> DataFrame:
    vectors = T(spark, d, "embeddings")
    pillars = R.centroids(vectors, "label", "embedding").select("label", "centroid")
    n = vectors.count()
    # pillars are a dimension, one row a label; each vector is scored once, then bound to its documents
    best = R.best_cosine(vectors, "vec_id", "embedding", R.small(pillars, 10_000), "centroid")
    return T(spark, d, "documents").select("doc_id", (F.col("doc_id") % n).alias("vec_id")).join(best, "vec_id").select("doc_id", "cosine")


@query(f"WITH {_COS} SELECT doc_id, round(cosine, 6) AS cosine FROM cs")
def max_window_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _cosines(spark, d).select("doc_id", F.round("cosine", 6).alias("cosine"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = T(spark, d, "embeddings")
    query_vector = vectors.where("vec_id = 0").first()["embedding"]
    return R.cosine_top_k(vectors, "vec_id", "embedding", list(query_vector), 10).select("vec_id", F.round("score", 6).alias("score"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE) * (x::DOUBLE))), 4) AS square,
 round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: (y::DOUBLE) * (y::DOUBLE)))), 1e-12)) ** 2)), 6) AS unit_square FROM embeddings""")
def unit_normalise(spark: SparkSession, d: str) -> DataFrame:
    v = T(spark, d, "embeddings").select("vec_id", R.dot(F.col("embedding"), F.col("embedding")).alias("s"), R.unit(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round("s", 4).alias("square"), F.round(R.dot(F.col("u"), F.col("u")), 6).alias("unit_square"))


_PHRASES = """
ph AS (SELECT DISTINCT item_id, list_aggregate(list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), k, k + 1), 'string_agg', ' ') AS phrase
       FROM benchmark, (VALUES (1), (4), (7), (10)) v(k)),
lw AS (SELECT doc_id, win, lower(piece) AS low FROM w),
pm AS (SELECT doc_id, win, item_id, phrase FROM lw JOIN ph ON contains(low, phrase)),
pd AS (SELECT phrase FROM pm GROUP BY phrase HAVING count(DISTINCT doc_id) <= greatest(1, (SELECT count(*) FROM documents) // 2)),
pw AS (SELECT doc_id, item_id, win, count(*) AS n FROM pm JOIN pd USING (phrase) GROUP BY ALL),
ps AS (SELECT doc_id, max(s) AS phrase FROM (SELECT doc_id, item_id, least(1.0, max(n) / 3.0) AS s FROM pw GROUP BY ALL) GROUP BY doc_id)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    words = quoted_words(F.col("text"))
    pair = T(spark, d, "benchmark").select("item_id", words.alias("w"))
    return pair.select("item_id", F.explode(F.array(*[F.array_join(F.slice("w", k, 2), " ") for k in (1, 4, 7, 10)])).alias("phrase"))


@query(f"WITH {_WINDOWS}, {_PHRASES} SELECT doc_id, round(phrase, 6) AS phrase FROM ps")
def phrase_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents")
    scores = R.phrase_scores(docs, "doc_id", "text", _pairs(spark, d), "item_id", "phrase", docs.count())
    return scores.groupBy("doc_id").agg(F.round(F.max("phrase_score"), 6).alias("phrase"))


_SHORTLIST = f"""{_WINDOWS}, {_PHRASES}, {_COS},
sc AS (SELECT doc_id, round(0.45 * greatest(coalesce(cosine, 0), 0) + 0.25 * coalesce(lexical, 0) + 0.3 * coalesce(phrase, 0), 6) AS score
       FROM documents LEFT JOIN cs USING (doc_id) LEFT JOIN lex USING (doc_id) LEFT JOIN ps USING (doc_id))"""


def _shortlist(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents")
    lexical, phrase = R.text_tiers(docs, "doc_id", "text", _terms(spark, d), "item_id", _pairs(spark, d), "item_id", "phrase")
    return R.composite(docs, "doc_id", _cosines(spark, d), lexical, phrase)


def _first(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, score, rank: a top-100 report, told once however often it is read."""
    top = _shortlist(spark, d).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(100)
    rows = [(*r, k) for k, r in enumerate(top.collect(), 1)]
    return spark.createDataFrame(rows, f"doc_id {dict(top.dtypes)['doc_id']}, score double, rank int")


@query(f"WITH {_SHORTLIST} SELECT doc_id, score FROM sc")
def shortlist_composite(spark: SparkSession, d: str) -> DataFrame:
    return _shortlist(spark, d).select("doc_id", "score")


@query(f"""WITH {_SHORTLIST}, rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc ORDER BY score DESC, doc_id LIMIT 100),
j AS (SELECT rank, quality FROM rk LEFT JOIN labels USING (doc_id)), m AS (SELECT least(20, count(*), sum(coalesce(quality, 0))) AS k FROM j)
SELECT round(avg(coalesce(quality, 0)), 6) AS precision FROM j, m WHERE rank <= k""")
def shortlist_precision(spark: SparkSession, d: str) -> DataFrame:
    ranked = _first(spark, d).join(T(spark, d, "labels"), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(0)))
    return R.precision_at(ranked, "rank", F.col("quality") == 1, 20).select(F.round("precision", 6).alias("precision"))


@query(f"""WITH {_SHORTLIST}, rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc ORDER BY score DESC, doc_id LIMIT 100),
l AS (SELECT rank, source AS law FROM rk JOIN documents USING (doc_id)), nl AS (SELECT count(DISTINCT law) AS r FROM l)
SELECT round(avg(hit), 6) AS recall FROM (SELECT law, max((rank <= greatest(10, r))::INT) AS hit FROM l, nl GROUP BY law)""")
def shortlist_recall(spark: SparkSession, d: str) -> DataFrame:
    ranked = _first(spark, d).join(T(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return R.recall_at(ranked, "rank", F.col("source"), 10).select(F.round("recall", 6).alias("recall"))


_GATE = """
c AS (SELECT source AS doc, doc_id AS chunk, embedding FROM documents, (SELECT count(*) AS n FROM embeddings) JOIN embeddings ON vec_id = doc_id % n),
x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
p AS (SELECT label, list(m ORDER BY i) AS centroid FROM x GROUP BY label),
pr AS (SELECT doc, chunk, label, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS cosine, (chunk * 7 + label) % 5 AS bm25, doc IN ('src1', 'src3') AS meaning FROM c, p),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc, label ORDER BY bm25 DESC, chunk) AS lr, row_number() OVER (PARTITION BY doc, label ORDER BY cosine DESC, chunk) AS cr FROM pr)
"""


@query(f"""WITH {_GATE} SELECT doc, chunk, label, CASE WHEN meaning THEN 'meaning-only' ELSE 'two-tier' END AS lane,
CASE WHEN cosine >= 0.1 AND CASE WHEN meaning THEN cr <= 20 ELSE bm25 > 0 AND lr <= 20 END THEN 'passed' ELSE 'excluded' END AS outcome FROM rk""")
def gate_two_lanes(spark: SparkSession, d: str) -> DataFrame:
    vectors, n = T(spark, d, "embeddings"), T(spark, d, "embeddings").count()
    chunks = T(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("chunk"), (F.col("doc_id") % n).alias("vec_id")).join(vectors.select("vec_id", "embedding"), "vec_id")
    pairs = chunks.crossJoin(R.small(R.centroids(vectors, "label", "embedding"), 10_000)).select("doc", "chunk", "label", F.round(R.cosine(F.col("embedding"), F.col("centroid")), 6).alias("cosine"), ((F.col("chunk") * 7 + F.col("label")) % 5).cast("double").alias("bm25"))
    return R.gate(pairs, "doc", "chunk", "label", "cosine", "bm25", ~F.col("doc").isin("src1", "src3"), least=0.1).select("doc", "chunk", "label", "lane", "outcome")
