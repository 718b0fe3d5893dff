"""Rules on mapped evidence: verification, reconciliation, scores, duplicates, caps, absences and the battery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.text import cited_markers, instrument_rank, present_markers, recency

# Natures that may score, scores of an empty cell, indicators whose score runs the other way.
ELIGIBLE = {"6.1": ["transfer_ban"], "6.2": ["local_storage"], "6.3": ["local_infrastructure"], "6.4": ["conditional_transfer"], "7.1": ["protection_framework"], "7.2": ["protection_framework"], "7.3": ["retention_requirement"], "7.4": ["dpo_requirement", "dpia_only"], "7.5": ["government_access"]}
ABSENCE = {"6.1": 0.0, "6.2": 0.0, "6.3": 0.0, "6.4": 0.0, "7.1": 1.0, "7.2": 1.0, "7.3": 0.0, "7.4": 0.0, "7.5": 0.0}
INVERSE = ["7.1", "7.2"]
NOT_FOR_GOVERNMENT = ["6.1", "6.2", "6.3", "6.4", "7.3"]
LEAST_QUOTE, CAP_ROWS = 15, 101


def is_evidence(status: Column, insufficient: Column) -> Column:
    return (status != "dropped") & ~F.coalesce(insufficient, F.lit(False))


def verify_failures(quote: Column, chunk: Column, subsection: Column) -> Column:
    """Messages: a quote under 15 characters, or not a substring of its chunk; cited markers, in brackets or other forms and
    numbers of any script, that the chunk lacks."""
    blank = F.trim(F.coalesce(subsection, F.lit(""))) == ""
    cited = cited_markers(F.coalesce(subsection, F.lit("")))
    tests = [
        F.when(F.length(F.trim(quote)) < LEAST_QUOTE, "quote too short").when(~F.contains(chunk, quote), "quote not found"),
        F.when(~blank & (F.size(cited) == 0), "subsection unparseable"),
        F.when(~blank & (F.size(F.array_except(cited, present_markers(chunk))) > 0), "marker not in chunk"),
    ]
    return F.array_compact(F.array(*tests))


def ladder_pick(records: DataFrame, keys: list[str], name: str, amended: str, id_: str) -> DataFrame:
    """rank, recency, pick (1 for the strongest, newest, least id) and same_rank for the candidates of the strongest rank."""
    ranked = records.withColumn("rank", instrument_rank(F.col(name))).withColumn("recency", recency(F.col(amended)))
    w = Window.partitionBy(*keys).orderBy("rank", F.desc("recency"), id_)
    return ranked.withColumn("pick", F.row_number().over(w)).withColumn("same_rank", F.col("rank") == F.min("rank").over(Window.partitionBy(*keys)))


def reconcile(records: DataFrame, proposals: DataFrame, keys: list[str], id_: str, name: str, amended: str) -> DataFrame:
    """relationship and controlling of each record of a group. A single record is sole_source. Else a proposal (keys,
    proposed id, relationships map) wins if its id is of the strongest rank; otherwise the ladder's pick, and a proposal's
    superseded_by of that pick becomes complementary; without a proposal all are complementary."""
    picked = ladder_pick(records, keys, name, amended, id_).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    told = picked.join(proposals, keys, "left")
    accepted = F.max((F.col("same_rank") & (F.col(id_) == F.col("proposed"))).cast("int")).over(Window.partitionBy(*keys)) == 1
    told = told.withColumn("controlling", F.when(F.col("n") == 1, True).when(accepted, F.col(id_) == F.col("proposed")).otherwise(F.col("pick") == 1))
    given = F.coalesce(F.col("relationships")[F.col(id_)], F.lit("complementary"))
    relation = F.when(F.col("n") == 1, "sole_source").when(F.col("proposed").isNull(), "complementary").when(F.col("controlling") & (given == "superseded_by"), "complementary").otherwise(given)
    return told.withColumn("relationship", relation).drop("proposed", "relationships", "n", "pick")


def controlling_first(records: DataFrame, keys: list[str], flag: str, confidence: str, id_: str) -> DataFrame:
    """One record a side: flagged first, then confidence (null as -1), then the largest id."""
    w = Window.partitionBy(*keys).orderBy(F.col(flag).desc(), F.coalesce(F.col(confidence), F.lit(-1.0)).desc(), F.col(id_).desc())
    return records.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def boundary_excluded(records: DataFrame, economy: str, chunk: str, indicator: str, status: str) -> DataFrame:
    """Records of 6.1 whose chunk also passed 6.4 in the economy."""
    other = records.where((F.col(indicator) == "6.4") & (F.col(status) == "passed")).select(economy, chunk).distinct()
    return records.where(F.col(indicator) == "6.1").join(other, [economy, chunk], "left_semi")


def contribution(indicator: Column, c: Column) -> Column:
    """What a classified record alone implies; null where it counts for nothing. c: struct of the classification."""
    natures = reduce(lambda rest, kv: F.when(indicator == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(rest), ELIGIBLE.items(), F.lit(None).cast("array<string>"))
    horizontal = c["application"] == "horizontal"
    strong = (c["data_scope"] == "personal") | (horizontal & (c["data_scope"] == "non_personal"))
    value = (
        F.when(indicator.isin("6.1", "6.2", "6.4"), F.when(strong, 1.0).otherwise(0.5))
        .when(indicator == "6.3", 1.0)
        .when(indicator == "7.1", F.when(c["comprehensive_framework"] & horizontal, 0.0).otherwise(0.5))
        .when(indicator == "7.2", F.when(c["dedicated_framework"] & horizontal, 0.0).otherwise(0.5))
        .when(indicator == "7.3", F.when(c["minimum_period_specified"], 1.0))
        .when(indicator == "7.4", F.when(c["measure_nature"] == "dpia_only", 0.25).when(horizontal, 1.0).otherwise(0.5))
        .when(indicator == "7.5", F.when(~c["judicial_authorization_required"], 1.0))
    )
    allowed = c["confirmed"] & F.array_contains(natures, c["measure_nature"]) & ~(indicator.isin(*NOT_FOR_GOVERNMENT) & c["government_data_only"])
    return F.when(allowed, value)


def rubric_cells(records: DataFrame, cells: DataFrame, economy: str, indicator: str, value: str, place: list[str]) -> DataFrame:
    """score of each cell (economy, indicator): absence value without contributions; a strong one gives 1; two places or more
    give 1 on 6.1 and 6.2; 7.1 and 7.2 take the least, 6.3, 7.3 and 7.5 are 1 with any, all else the most."""
    scored = records.where(F.col(value).isNotNull()).groupBy(economy, indicator).agg(F.max(value).alias("most"), F.min(value).alias("least"), F.count_distinct(F.struct(*place)).alias("places"))
    i = F.col(indicator)
    absent = reduce(lambda rest, kv: F.when(i == kv[0], kv[1]).otherwise(rest), ABSENCE.items(), F.lit(0.0))
    score = (
        F.when(F.col("most").isNull(), absent)
        .when(i.isin("6.1", "6.2") & ((F.col("most") == 1) | (F.col("places") >= 2)), 1.0)
        .when(i.isin("6.3", "7.3", "7.5"), 1.0)
        .when(i.isin(*INVERSE), F.when(F.col("least") == 0, 0.0).otherwise(0.5))
        .otherwise(F.col("most"))
    )
    return cells.join(scored, [economy, indicator], "left").withColumn("score", score).select(economy, indicator, "score", F.coalesce("places", F.lit(0)).alias("places"))


def presence_scores(records: DataFrame, economy: str, chunk: str, indicator: str, status: str) -> DataFrame:
    """1 where an economy has a passed record of a scored indicator, else 0; the other way for 7.1 and 7.2. 6.1 rows of chunks
    that passed 6.4 don't count. Economies without a passed record are left out."""
    passed = records.where(F.col(status) == "passed")
    out = boundary_excluded(passed, economy, chunk, indicator, status).select(economy, chunk, indicator).distinct()
    kept = passed.join(out, [economy, chunk, indicator], "left_anti")
    spark = records.sparkSession
    scored = spark.createDataFrame([(k,) for k in ABSENCE], f"{indicator} string")
    cells = passed.select(economy).distinct().crossJoin(F.broadcast(scored))
    have = kept.select(economy, indicator).distinct().withColumn("__has", F.lit(1.0))
    has = F.coalesce(F.col("__has"), F.lit(0.0))
    return cells.join(have, [economy, indicator], "left").select(economy, indicator, F.when(F.col(indicator).isin(*INVERSE), 1.0 - has).otherwise(has).alias("score"))


def collapse(rows: DataFrame, keys: list[str], controlling: str, confidence: str, id_: str) -> DataFrame:
    """One row a provision: controlling first, confidence, least id; collapsed lists the ids it stands for. Aggregated, so that a
    provision's rows are brought together before they are sent."""
    rank = F.struct(F.coalesce(~F.col(controlling), F.lit(True)), F.col(confidence).isNull(), -F.col(confidence), F.col(id_))
    whole = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    best = rows.groupBy(*keys).agg(F.min_by(whole, rank).alias("__row"), F.collect_list(id_).alias("__ids"))
    return best.select(*keys, "__row.*", "__ids").withColumn("collapsed", F.array_sort(F.array_remove("__ids", F.col(id_)))).select(*rows.columns, "collapsed")


def round_robin(rows: DataFrame, economy: str, confidence: str, order: list[str], cap: int = CAP_ROWS) -> DataFrame:
    """Economies take turns, each by confidence (null last) and row order, until cap rows are chosen; then in row order."""
    w = Window.partitionBy(economy).orderBy(F.col(confidence).desc_nulls_last(), *order)
    deep = rows.withColumn("depth", F.row_number().over(w)).where(F.col("depth") <= cap)
    return deep.orderBy("depth", economy).limit(cap).orderBy(*order)


def absences(searched: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Searched combinations without evidence."""
    return searched.join(records.select(*keys).distinct(), keys, "left_anti")


def fit_subset(records: DataFrame, keys: list[str], indicator: str, value: str) -> DataFrame:
    """Records whose contribution is the group's strongest: the most, or the least on 7.1 and 7.2."""
    ends = records.groupBy(*keys).agg(F.min(value).alias("__least"), F.max(value).alias("__most"))
    best = F.when(F.col(indicator).isin(*INVERSE), F.col("__least")).otherwise(F.col("__most"))
    return records.join(ends, keys).where(F.col(value) == best).drop("__least", "__most").select(*records.columns)


def battery(rows: DataFrame, id_: str, key: list[str], required: list[str], checks: dict[str, Column]) -> DataFrame:
    """(id, message) of each failed condition: a duplicate key, a blank required column, a check that holds."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1
    tests = [F.when(F.col("__twice"), F.lit("duplicate key"))] + [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"blank {c}")) for c in required] + [F.when(F.coalesce(t, F.lit(False)), F.lit(m)) for m, t in checks.items()]
    return rows.withColumn("__twice", twice).select(id_, F.explode(F.array_compact(F.array(*tests))).alias("message"))


def discovery_tag(records: DataFrame, known: DataFrame, economy: str, keys: str, section: str) -> DataFrame:
    """KNOWN if a known law of the economy (keys array, sections array; no sections: any) matches by containment either way."""
    k = known.select(economy, F.col("law_keys").alias("__keys"), F.col("sections").alias("__sections"))
    hit = F.exists(F.col(keys), lambda a: F.exists(F.col("__keys"), lambda b: F.contains(a, b) | F.contains(b, a)))
    ok = hit & ((F.size("__sections") == 0) | F.array_contains(F.col("__sections"), F.col(section)))
    found = records.join(k, economy).where(ok).select("record_id").distinct().withColumn("__k", F.lit("KNOWN"))
    return records.join(found, "record_id", "left").withColumn("discovery_tag", F.coalesce("__k", F.lit("NEW"))).drop("__k")
