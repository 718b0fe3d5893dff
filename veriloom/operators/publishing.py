"""What surrounds an export: framework picks, nested submissions, edits, baseline rankings, portal rules, garbage text layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the garbage tests.
UNMAPPED_MOST, LETTERS_LEAST, VISIBLE_LEAST, REPEATS_LEAST, REPEATS_PER_PAGE, SAMPLE = 0.2, 0.4, 200, 200, 10, 200_000


def framework_pick(records: DataFrame, keys: list[str], tier: Column, subordinate: Column, scope: Column, controlling: str, confidence: str, rank: Column, id_: str) -> DataFrame:
    """One record for each economy and framework indicator: known tier, principal instruments, scope clauses, controlling,
    confidence, ladder rank, least id."""
    w = Window.partitionBy(*keys).orderBy(tier.asc_nulls_last(), subordinate.asc(), scope.desc(), F.col(controlling).desc(), F.col(confidence).desc_nulls_last(), rank.asc(), F.col(id_).asc())
    return records.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def submission(rows: DataFrame, law: list[str], provision: list[str]) -> DataFrame:
    """A JSON object for each law, its provisions as an ordered list."""
    nested = rows.groupBy(*law).agg(F.sort_array(F.collect_list(F.struct(*provision))).alias("provisions"))
    return nested.select(*law, F.size("provisions").alias("n"), F.to_json(F.struct(*law, "provisions")).alias("json"))


def edited(corpus: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """corpus with the fields that a person edited: edits hold values and the list of edited fields."""
    e = edits.select(key, F.col("edited_fields").alias("__f"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = corpus.join(e, key, "left")
    return joined.select(*[F.when(F.array_contains("__f", c), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in corpus.columns])


def ranked_laws(laws: DataFrame, drawn: list[str], indicators: str, seeded: str, urls: str, year: str, position: str) -> DataFrame:
    """Baseline laws that cite a drawn indicator: most cited first, then seeded, single-address, newest, in list order."""
    cited = F.array_intersect(indicators, F.array(*map(F.lit, drawn)))
    some = laws.withColumn("cited", F.size(cited)).where("cited > 0")
    w = Window.orderBy(F.desc("cited"), F.desc(seeded), (F.size(urls) == 1).desc(), F.col(year).desc_nulls_last(), position)  # a dimension of laws
    return some.withColumn("place", F.row_number().over(w))


def gap_violations(fetches: DataFrame, host: str, ts: str, least_seconds: float) -> DataFrame:
    """Fetches that came sooner after the one before, on the same host, than allowed."""
    gap = (F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(Window.partitionBy(host).orderBy(ts))) / 1e6
    return fetches.withColumn("gap", gap).where(F.col("gap") < least_seconds)


def robots_rules(files: DataFrame, host: str, text: str, agent: str) -> DataFrame:
    """host, kind (allow or disallow), path: the rules of the groups that name the agent, else of those for all."""
    line = F.trim(F.regexp_replace(F.col("raw"), "#.*$", ""))
    rows = files.where(~F.lower(F.substring(text, 1, 500)).rlike("<html|<!doctype")).select(host, F.posexplode(F.split(text, r"\r\n?|\n")).alias("at", "raw")).withColumn("line", line).where(F.instr("line", ":") > 0)
    rows = rows.select(host, "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy(host).orderBy("at")
    fresh = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    grouped = rows.withColumn("fresh", fresh.cast("int")).withColumn("group", F.sum("fresh").over(w))
    named = F.lower("value")
    own = (named == agent.lower()) | F.startswith(named, F.lit(agent.lower() + "/"))
    agents = grouped.where("field = 'user-agent'").groupBy(host, "group").agg(F.max(own.cast("int")).alias("own"), F.max((named == "*").cast("int")).alias("any"))
    has = agents.groupBy(host).agg(F.max("own").alias("__has"))
    bound = agents.join(has, host).where((F.col("own") == 1) | ((F.col("__has") == 0) & (F.col("any") == 1))).select(host, "group")
    return grouped.where("field <> 'user-agent' AND value <> ''").join(bound, [host, "group"]).select(host, F.col("field").alias("kind"), F.col("value").alias("path"))


def robots_allowed(urls: DataFrame, rules: DataFrame, host: str, path: str) -> DataFrame:
    """urls with allowed: the longest rule that starts the path decides, an allow wins a tie, no rule allows."""
    r = rules.select(F.col(host).alias("__h"), "kind", F.col("path").alias("__p"))
    best = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.length("__p"))), F.lit(-1))
    keys = [host, path]
    met = urls.select(*keys).distinct().join(r, (F.col(host) == F.col("__h")) & F.startswith(F.col(path), F.col("__p")), "left")
    verdict = met.groupBy(*keys).agg((best("allow") >= best("disallow")).alias("allowed"))
    return urls.join(verdict, keys)


def garbage_reason(text: Column, pages: Column) -> Column:
    """Why a text layer isn't its text: unmapped glyphs, too few letters, a watermark line; null where it reads as text."""
    head = F.substring(text, 1, SAMPLE)
    n = lambda pattern: F.regexp_count(head, F.lit(pattern))
    visible = n(r"(?U)\S")
    cid = F.aggregate(F.regexp_extract_all(head, F.lit(r"\(cid:\d+\)"), F.lit(0)), F.lit(0), lambda s, m: s + F.length(m))
    unmapped = (cid + n(r"[\x{E000}-\x{F8FF}\x{FFFD}]")) / visible
    letters = n(r"[\p{L}\p{M}]") / visible
    lined = F.sort_array(F.filter(F.transform(F.split(head, "\n"), lambda x: F.trim(x)), lambda x: F.regexp_count(x, F.lit(r"\p{L}")) >= 3))
    least = F.greatest(F.lit(REPEATS_LEAST), REPEATS_PER_PAGE * F.greatest(pages, F.lit(1)) + 1)
    watermark = F.exists(F.arrays_zip(lined.alias("a"), F.slice(lined, least, 1 << 30).alias("b")), lambda z: z["a"] == z["b"])
    return F.when(visible < VISIBLE_LEAST, None).when(unmapped > UNMAPPED_MOST, "unmapped glyphs").when(letters < LETTERS_LEAST, "few letters").when(F.coalesce(watermark, F.lit(False)), "watermark")
