"""Section chunks of a stream: headings in several drafting styles, runs of rising numbers, and chunks that cover the whole text.

All styles are tried at once: lines meet every style's pattern in one pass, and windows of (document, style) find the runs.
A document without a credible style is cut into passages. Chunks of a document always add up to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.python import passage_starts_udf
from veriloom.operators.spans import increasing_runs, lines

# Drafting styles in order of precedence: name, heading pattern with the number as group 1, ambiguous, least run.
STYLES = [
    ("section_word", r"^\s{0,2}Section\s+(\d{1,3}[A-Z]{0,2})\.\s+\S", False, 2),
    ("article_word", r"^\s{0,2}(?:Pasal|Artigo|Điều|Статья|มาตรา|ມາດຕາ)\s+(\d{1,3}[A-Z]{0,2})\b", False, 2),
    ("article_num_first", r"^\s{0,2}(\d{1,3}(?:[.-]\d{1,2})?)\s*-?\s*(?:дүгээр зүйл|дугаар зүйл|бап)", False, 2),
    ("article_en", r"^\s{0,2}Article\s+(\d{1,3}[A-Z]{0,2})\b", False, 2),
    ("article_zh", r"^\s*第\s*(\d{1,4})\s*条", False, 2),
    ("num_alone", r"^(\d{1,3}[A-Z]{0,3})\.\s*$", False, 2),
    ("num_dot", r"^(\d{1,3}[A-Z]{0,3})\.(?:[—–-]\(|\s+\S)", True, 3),
    ("num_title", r'^(\d{1,3}(?:\.\d{1,3})?[A-Z]{0,2})\s+[A-Z“"]', True, 3),
]
LEAST_MEDIAN, REPEATED_TITLE, PASSAGE = 80, 5, 1000


def number_key(num: Column) -> Column:
    """Order of section numbers: 3 < 3A < 4 < 4.1 < 4.2A."""
    part = lambda k: F.regexp_extract(num, r"^(\d+)(?:[.-](\d+))?([A-Z]{0,3})$", k)
    return F.struct(part(1).try_cast("int").alias("major"), F.coalesce(part(2).try_cast("int"), F.lit(-1)).alias("minor"), part(3).alias("suffix"))


def candidates(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, style, at (line number), offset, num, title of each line that a style reads as a heading; titles that a document
    repeats REPEATED_TITLE times are furniture."""
    tries = [F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("style"), F.regexp_extract("line", p, 1).alias("num"))) for k, (_, p, _, _) in enumerate(STYLES)]
    found = lines(docs, doc, text).withColumn("c", F.explode(F.array_compact(F.array(*tries))))
    title = F.trim(F.regexp_replace("line", r"^[^\p{L}]*\d+[^\p{L}]*", ""))
    rows = found.select(doc, F.col("c.style").alias("style"), F.col("line_no").alias("at"), "offset", F.col("c.num").alias("num"), title.alias("title"))
    often = F.count(F.lit(1)).over(Window.partitionBy(doc, "style", "title"))
    return rows.withColumn("often", often).where((F.col("often") < REPEATED_TITLE) | (F.col("title") == "")).drop("often")


def headings(docs: DataFrame, doc: str, text: str, least_median: int = LEAST_MEDIAN) -> DataFrame:
    """The headings of each document's best style: runs of rising numbers that are long enough, and for ambiguous styles far
    enough apart; the style that keeps most headings wins, the earlier of equals."""
    found = candidates(docs, doc, text).withColumn("key", number_key(F.col("num")))
    runs = increasing_runs(found, [doc, "style"], "at", "key")
    ends = docs.select(doc, F.length(text).alias("n"))
    following = F.lead("offset").over(Window.partitionBy(doc, "style").orderBy("at"))
    spaced = runs.join(ends, doc).withColumn("span", F.coalesce(following, F.col("n")) - F.col("offset"))
    whole = spaced.groupBy(doc, "style", "run").agg(F.count(F.lit(1)).alias("size"), F.median("span").alias("median"))
    least = F.element_at(F.array(*[F.lit(m) for *_, m in STYLES]), F.col("style") + 1)
    ambiguous = F.element_at(F.array(*[F.lit(a) for _, _, a, _ in STYLES]), F.col("style") + 1)
    good = whole.where((F.col("size") >= least) & (~ambiguous | (F.col("median") >= least_median)))
    best = good.groupBy(doc, "style").agg(F.sum("size").alias("kept")).groupBy(doc).agg(F.max_by("style", F.struct("kept", -F.col("style"))).alias("style"))
    return spaced.join(good.select(doc, "style", "run"), [doc, "style", "run"], "left_semi").join(best, [doc, "style"], "left_semi")


def chunks(docs: DataFrame, doc: str, text: str, passage: int = PASSAGE) -> DataFrame:
    """doc, chunk (from 0), label, kind, char_start, char_end: front matter and sections; where no style holds, passages that
    end at breaks of the text, labelled in turn."""
    heads = headings(docs, doc, text).select(doc, "offset", F.col("num").alias("label"), F.lit("section").alias("kind"))
    n = docs.select(doc, F.length(text).cast("long").alias("n"))
    front = heads.groupBy(doc).agg(F.min("offset").alias("first")).where("first > 0").select(doc, F.lit(0).cast("long").alias("offset"), F.lit(None).cast("string").alias("label"), F.lit("front").alias("kind"))
    bare = docs.where(F.length(text) > 0).join(heads.select(doc).distinct(), doc, "left_anti")
    cut = bare.select(doc, F.posexplode(passage_starts_udf(passage)(F.col(text))).alias("at", "offset"))
    cut = cut.select(doc, "offset", F.concat(F.lit("Passage "), (F.col("at") + 1).cast("string")).alias("label"), F.lit("section").alias("kind"))
    starts = heads.unionByName(front).unionByName(cut)
    w = Window.partitionBy(doc).orderBy("offset")
    out = starts.withColumn("char_end", F.lead("offset").over(w)).withColumn("chunk", F.row_number().over(w) - 1)
    return out.join(n, doc).select(doc, "chunk", "label", "kind", F.col("offset").alias("char_start"), F.coalesce("char_end", "n").alias("char_end"))
