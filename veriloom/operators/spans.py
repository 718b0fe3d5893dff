"""Spans of texts: slices, pages, overlaps, lines, runs and quotes. Offsets are code points from 0, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def chunk_texts(chunks: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks with their text, cut from the document's stream."""
    return chunks.join(documents.select(key, F.col(text).alias("__t")), key).withColumn("chunk_text", slice_of(F.col("__t"), F.col("char_start"), F.col("char_end"))).drop("__t")


def page_spans(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Spans of pages joined by a line feed."""
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))
    return pages.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length(text))


def as_of(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, value: str, first: bool = True) -> DataFrame:
    """points with the value of the last start at or before them within key; before the first start, the first's value (if
    first) or null. One union and one ordered window, so cost is linear and ties of start take the largest value."""
    mark = lambda df, where, kind, got: df.select(key, F.col(where).alias("__at"), F.lit(kind).alias("__kind"), got.alias("__value"), F.struct(*[F.col(c) for c in points.columns] if kind else [F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema]).alias("__row"))
    both = mark(starts, start, 0, F.col(value)).union(mark(points, at, 1, F.lit(None).cast(starts.schema[value].dataType)))
    order = Window.partitionBy(key).orderBy("__at", "__kind", "__value")
    told = F.last("__value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if first:
        lead = F.first("__value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        told = F.coalesce(told, lead)
    return both.withColumn("__told", told).where("__kind = 1").select("__row.*", F.col("__told").alias(value))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Pairs of left (l_start, l_end) and right (r_start, r_end) that overlap within key. Both sides are dealt to cells of a
    fixed width, and a pair is kept in the cell of its first common position, so a long document is not one group."""
    cells = lambda df, s, e: df.where(F.col(e) > F.col(s)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    met = cells(left, "l_start", "l_end").join(cells(right, "r_start", "r_end"), [key, "__cell"])
    begin = F.greatest("l_start", "r_start")
    return met.where((F.col("l_start") < F.col("r_end")) & (F.col("l_end") > F.col("r_start")) & (F.floor(begin / width) == F.col("__cell"))).drop("__cell")


def islands(rows: DataFrame, keys: list[str], order: list, fresh: Column, name: str = "island") -> DataFrame:
    """Numbers runs from 1: a row for which fresh holds (or the first) starts a new one. fresh may use lag over the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def increasing_runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A new run where the value is not above the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("__prev", F.lag(value).over(w))
    return islands(marked, keys, [order], F.col("__prev").isNull() | (F.col(value) <= F.col("__prev")), "run").drop("__prev")


def merge_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of words (page, x0, y0, x1, y1) to boxes of lines: a new line on a new page, or where the overlap in height with
    the word before is under half of the lower of the two."""
    w = Window.partitionBy(*keys).orderBy("page", "y0", "x0", "x1", "y1")
    p, a, b = (F.lag(c).over(w) for c in ("page", "y0", "y1"))
    marked = words.withColumn("__p", p).withColumn("__a", a).withColumn("__b", b)
    shared = F.least("y1", "__b") - F.greatest("y0", "__a")
    fresh = F.col("__p").isNull() | (F.col("__p") != F.col("page")) | (shared < 0.5 * F.least(F.col("y1") - F.col("y0"), F.col("__b") - F.col("__a")))
    lined = islands(marked, keys, ["page", "y0", "x0", "x1", "y1"], fresh, "line")
    return lined.groupBy(*keys, "line").agg(F.first("page").alias("page"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line_no, line, offset of each line."""
    cut = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    before = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def furniture(docs: DataFrame, doc: str, text: str, least: int = 5) -> DataFrame:
    """doc, line, n: trimmed lines that a document holds so often."""
    cut = docs.select(doc, F.explode(F.split(text, "\n")).alias("line")).select(doc, F.trim("line").alias("line")).where("line <> ''")
    return cut.groupBy(doc, "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def quote_pattern(quote: Column) -> Column:
    """A pattern that matches the quote's words with any white space between."""
    safe = F.regexp_replace(F.trim(quote), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.regexp_replace(safe, r"\s+", r"\\s+")


def anchor_quote(text: Column, quote: Column) -> Column:
    """The text's own words for a quote: itself if it stands there, else the one match that differs in white space alone."""
    loose = F.regexp_extract_all(text, quote_pattern(quote), F.lit(0))
    return F.when(F.trim(quote) == "", None).when(F.contains(text, quote), quote).when(F.size(loose) == 1, F.get(loose, F.lit(0)))


def locate_quote(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """Struct(start, end) of a quote: inside the chunk's range, else its first place in the stream; null if it is nowhere."""
    inside = F.instr(slice_of(text, start, end), quote)
    whole = F.instr(text, quote)
    at = F.when(inside > 0, start + inside - 1).when(whole > 0, whole - 1)
    return F.when(at.isNotNull(), F.struct(at.alias("start"), (at + F.length(quote)).alias("end")))


def context(text: Column, quote: Column, around: int = 300) -> Column:
    at = F.instr(text, quote)
    begin = F.greatest(at - 1 - around, F.lit(0))
    return F.when(at > 0, F.substring(text, begin + 1, at - 1 - begin + F.length(quote) + around))


def containments(quotes: DataFrame, texts: DataFrame, quote: str, text: str, words: int = 3) -> DataFrame:
    """Pairs of a quote and a text that contains it. Texts meet quotes through a shared run of words (the quote's rarest in the
    order of hashes), so the join is by key; containment is then tested. Quotes shorter than a run are compared directly with all texts."""
    run = lambda c: F.expr(f"transform(sequence(0, greatest(size(w) - {words}, 0)), i -> xxhash64(array_join(slice(w, i + 1, {words}), ' ')))")
    tokens = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    inner = quotes.withColumn("w", F.slice(tokens(F.col(quote)), 2, 1 << 20)).withColumn("w", F.slice(F.col("w"), 1, F.greatest(F.size("w") - 1, F.lit(0))))  # end words may be cut
    long = inner.where(F.size("w") >= words).withColumn("__k", F.array_min(run("w"))).drop("w")
    short = inner.where(F.size("w") < words).drop("w")
    keyed = texts.withColumn("w", tokens(F.col(text))).withColumn("__k", F.explode(F.array_distinct(run("w")))).drop("w")
    by_key = keyed.join(long, "__k").drop("__k").where(F.contains(F.col(text), F.col(quote)))
    direct = texts.join(F.broadcast(short), F.contains(F.col(text), F.col(quote))) if not short.isEmpty() else None
    return by_key if direct is None else by_key.unionByName(direct.select(*by_key.columns))
