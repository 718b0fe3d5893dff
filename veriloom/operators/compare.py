"""Comparison of two runs: by indicator, by provision, and the windows of their passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.text import normalise_location, quoted_words
from veriloom.operators.evidence import controlling_first
from veriloom.operators.spans import as_of


def agreement(a: Column, b: Column, fields: list[str]) -> Column:
    """Mark of two sides (structs, null if nothing was found): neither, only_a, only_b, agree, disagree."""
    same = reduce(lambda x, y: x & y, [normalise_location(a[f]) == normalise_location(b[f]) for f in fields])
    return F.when(a.isNull() & b.isNull(), "neither").when(b.isNull(), "only_a").when(a.isNull(), "only_b").when(same, "agree").otherwise("disagree")


def compare_runs(a: DataFrame, b: DataFrame, listed: DataFrame, indicator: str, fields: list[str], flag: str, confidence: str, id_: str) -> DataFrame:
    """indicator, a_id, b_id, mark: the listed indicators and those that only a run has, each side by its controlling record."""
    side = lambda df, n: controlling_first(df, [indicator], flag, confidence, id_).select(indicator, F.struct(*[F.col(f) for f in [id_, *fields]]).alias(n))
    both = listed.select(indicator).distinct().join(side(a, "a").join(side(b, "b"), indicator, "full"), indicator, "full")
    return both.select(indicator, F.col(f"a.{id_}").alias("a_id"), F.col(f"b.{id_}").alias("b_id"), agreement(F.col("a"), F.col("b"), fields).alias("mark"))


def staged_pairs(a: DataFrame, b: DataFrame, group: list[str], stages: list[list[str]], id_: str) -> DataFrame:
    """(group, a_id, b_id, stage): items of two sides matched one to one, most alike first. In each stage items that agree in its
    columns are paired by their order of id; what is left goes on; an empty stage pairs by order alone."""
    left, right, out = a, b, None
    for n, cols in enumerate(stages, 1):
        keys = [*group, *cols]
        at = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(id_)))
        met = at(left).select(*keys, "__n", F.col(id_).alias("a_id")).join(at(right).select(*keys, "__n", F.col(id_).alias("b_id")), [*keys, "__n"]).select(*group, "a_id", "b_id", F.lit(n).alias("stage"))
        out = met if out is None else out.unionByName(met)
        left = left.join(met.select(*group, F.col("a_id").alias(id_)), [*group, id_], "left_anti")
        right = right.join(met.select(*group, F.col("b_id").alias(id_)), [*group, id_], "left_anti")
    ends = [left.select(*group, F.col(id_).alias("a_id"), F.lit(None).cast(b.schema[id_].dataType).alias("b_id"), F.lit(0).alias("stage")), right.select(*group, F.lit(None).cast(a.schema[id_].dataType).alias("a_id"), F.col(id_).alias("b_id"), F.lit(0).alias("stage"))]
    return reduce(lambda x, y: x.unionByName(y), ends, out)


def shared_words(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, shared, n_a, n_b: the bag intersection of the words of two texts."""
    bag = lambda c, n: pairs.select(key, F.explode(quoted_words(F.col(c))).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias(n))
    met = bag(a, "na").join(bag(b, "nb"), [key, "w"], "full").groupBy(key).agg(F.sum(F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))).alias("shared"), F.sum(F.coalesce("na", F.lit(0))).alias("n_a"), F.sum(F.coalesce("nb", F.lit(0))).alias("n_b"))
    return pairs.select(key).join(met, key, "left").fillna(0, ["shared", "n_a", "n_b"])


def quote_difference(a: Column, b: Column) -> Column:
    """How two quotes differ, in words."""
    x, y = quoted_words(a), quoted_words(b)
    one, two = F.array_join(x, " "), F.array_join(y, " ")
    times = lambda w, words: F.size(F.filter(words, lambda v: v == w))
    shared = F.aggregate(F.transform(F.array_distinct(x), lambda w: F.least(times(w, x), times(w, y))), F.lit(0), lambda s, n: s + n)
    share = F.bround(100 * shared / F.greatest(F.size(x), F.size(y), F.lit(1))).cast("int")
    told = F.concat(F.lit("different quoted words ("), share.cast("string"), F.lit("% of words shared, A "), F.size(x).cast("string"), F.lit(" words, B "), F.size(y).cast("string"), F.lit(" words)"))
    more = lambda side: F.lit(f"Engine {side} quoted more of the same text")
    return F.when(x == y, "same quoted words").when((two != "") & F.contains(one, two), more("A")).when((one != "") & F.contains(two, one), more("B")).otherwise(told)


def difference(a: Column, b: Column) -> Column:
    """What sets apart two records of a provision (structs of cite, key, indicator, quote)."""
    precise = F.when(F.startswith(a["key"], b["key"]), ", A is the more precise citation").when(F.startswith(b["key"], a["key"]), ", B is the more precise citation").otherwise("")
    cited = F.when(a["key"] != b["key"], F.concat(F.lit("Engine A cited "), a["cite"], F.lit(", Engine B cited "), b["cite"], precise))
    mapped = F.when(a["indicator"] != b["indicator"], F.concat(F.lit("Engine A mapped it to "), a["indicator"], F.lit(", Engine B to "), b["indicator"]))
    quotes = quote_difference(a["quote"], b["quote"])
    alike = cited.isNull() & mapped.isNull() & (quotes == "same quoted words")
    return F.when(alike, "Same provision, Indicator and quoted words on both Engines").otherwise(F.concat_ws("; ", cited, mapped, quotes))


def pass_windows(runs: DataFrame, economy: str, engine: str, run: str, started: str, ended: str, status: str) -> DataFrame:
    """runs with window_start: the latest end of a completed run of another engine, in the economy, that ended by the run's start.
    A run asks each other engine of its economy once, by an as-of lookup in order of time, so nothing is paired."""
    done = runs.where(F.col(status) == "completed").select(economy, F.col(engine).alias("__g"), F.col(ended).alias("__end"))
    others = done.select(economy, "__g").distinct()
    asked = runs.select(F.col(run).alias("__run"), economy, F.col(engine).alias("__own"), F.col(started).alias("__at")).join(F.broadcast(others), economy).where("__own <> __g")  # a row an engine of an economy
    key = F.struct(economy, "__g")
    points = asked.select(key.alias("__k"), "__run", "__at")
    found = as_of(points, done.select(key.alias("__k"), F.col("__end").alias("__from"), F.col("__end").alias("window_start")), "__k", "__at", "__from", "window_start", first=False)
    last = found.groupBy("__run").agg(F.max("window_start").alias("window_start"))
    return runs.join(last, F.col(run) == F.col("__run"), "left").drop("__run")


def run_discoveries(windows: DataFrame, found: DataFrame, economy: str, run: str, started: str, item: str, f_started: str, f_ended: str, width: int = 86_400_000_000, block: int = 16) -> DataFrame:
    """(run, item) of discoveries that lie within a run's window; unfinished ones belong to none. Windows are dealt to cells of time
    (width in the unit of the columns). In a cell, discoveries are numbered in order of their start, and a window counts those before
    it and up to its end, so it knows the numbers it may hold: it is joined with their blocks alone, two more at most than it needs.
    The work grows with the rows and the discoveries begun in a window, not with all pairs of a cell."""
    have = found.where(F.col(f_ended).isNotNull()).select(F.col(economy).alias("__e"), F.floor(F.col(f_started) / width).alias("__cell"), F.col(f_started).alias("__fs"), F.col(f_ended).alias("__fe"), F.col(item).alias("__item"))
    least = have.groupBy("__e").agg(F.min("__fs").alias("__least"))
    w = windows.select(F.col(run).alias("__run"), F.col(economy).alias("__e"), F.col(started).alias("__s"), "window_start")
    w = w.join(F.broadcast(least), "__e").withColumn("__w", F.coalesce("window_start", "__least")).where("__w <= __s").drop("window_start", "__least")
    w = w.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__w") / width), F.floor(F.col("__s") / width))))
    # each window twice: before the discoveries that begin with it, and after those that begin at its end
    ends = F.explode(F.array(F.struct(F.col("__w").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("__s").alias("at"), F.lit(2).alias("kind"))))
    none = lambda c: F.lit(None).cast(have.schema[c].dataType).alias(c)
    marks = w.withColumn("__m", ends).select("__e", "__cell", F.col("__m.at").alias("__at"), F.col("__m.kind").alias("__kind"), none("__fe"), none("__item"), F.struct("__run", "__w", "__s").alias("__window"))
    items = have.select("__e", "__cell", F.col("__fs").alias("__at"), F.lit(1).alias("__kind"), "__fe", "__item", F.lit(None).cast(marks.schema["__window"].dataType).alias("__window"))
    so_far = Window.partitionBy("__e", "__cell").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    laid = items.unionByName(marks).withColumn("__n", F.sum((F.col("__kind") == 1).cast("long")).over(so_far))
    at = laid.where("__kind = 1").select("__e", "__cell", F.floor((F.col("__n") - 1) / block).alias("__block"), F.col("__at").alias("__fs"), "__fe", "__item")
    # a window's first mark has the number of discoveries before it; its last one is alone in a later cell, and so is its first in an earlier one
    spans = laid.where("__kind <> 1").groupBy("__e", "__cell", "__window").agg(F.min("__n").alias("__from"), F.max("__n").alias("__to")).where("__from < __to")
    asked = spans.select("__e", "__cell", "__window.*", F.explode(F.sequence(F.floor(F.col("__from") / block), F.floor((F.col("__to") - 1) / block))).alias("__block"))
    met = at.join(asked, ["__e", "__cell", "__block"]).where("__fs >= __w AND __fe <= __s")
    return met.select(F.col("__run").alias(run), F.col("__item").alias(item))


def engine_summary(runs: DataFrame, keys: list[str], started: str, ended: str, documents: str, cost: str, provider_cost: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.min(started).alias("started"), F.max(ended).alias("ended"), F.sum(documents).alias("documents"), F.sum(F.coalesce(provider_cost, cost)).alias("cost"))
