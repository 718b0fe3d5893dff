"""The model seam: prompts, strict answers, the scripted model and bounded retries. A model is a function of Columns (prompt
parts) to an answer Column: a native expression as here, or an Arrow function that calls a service."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.evidence import verify_failures
from veriloom.operators.spans import anchor_quote

Model = Callable[[Column, Column, Column], Column]
ATTEMPTS, LEAST, MOST = 3, 15, 1500
ANSWER = "maps_to_indicator boolean, verbatim_quote string, impact string, subsection string"
# The lanes of the scripted model.
NO_EVIDENCE, DROPPED = "7.1", "7.3"
NOWHERE = "THIS SENTENCE APPEARS NOWHERE IN THE SOURCE DOCUMENT AT ALL."


def prompt(indicator: Column, description: Column, provision: Column, strict: Column) -> Column:
    return F.concat(F.lit("INDICATOR "), indicator, F.lit(": "), description, F.when(strict, F.lit("\nQuote exactly.\n")).otherwise(F.lit("\n")), F.lit("<<<PROVISION\n"), provision, F.lit("\nPROVISION>>>"))


def scripted(indicator: Column, provision: Column, attempt: Column) -> Column:
    """Answers without a model: one indicator finds nothing, one invents a quote, all else quote the first line of 40 characters."""
    first = F.get(F.filter(F.transform(F.split(provision, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 40), F.lit(0))
    answer = lambda maps, quote: F.to_json(F.struct(maps.alias("maps_to_indicator"), quote.alias("verbatim_quote"), F.lit("scripted").alias("impact")))
    none = answer(F.lit(False), F.lit(""))
    return F.when((indicator == NO_EVIDENCE) | first.isNull() & (indicator != DROPPED), none).when(indicator == DROPPED, answer(F.lit(True), F.lit(NOWHERE))).otherwise(answer(F.lit(True), first))


def parse(answer: Column) -> Column:
    """The answer's fields, or null: an object (fenced or among other text) with known keys and the flag."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*\n(.*?)```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(answer), r"(?s)\{.*\}", 0)
    keys = F.json_object_keys(body)
    known = F.size(F.array_except(keys, F.array(*[F.lit(k.split()[0]) for k in ANSWER.split(", ")]))) == 0
    got = F.from_json(body, ANSWER)
    return F.when(keys.isNotNull() & known & got["maps_to_indicator"].isNotNull(), got)


def run(pairs: DataFrame, indicator: str, provision: str, model: Model = scripted, attempts: int = ATTEMPTS) -> DataFrame:
    """pairs with quote, failures, extraction_attempts and status: passed, no_evidence or dropped. Each of the bounded attempts
    is a step of columns that asks only where the one before failed, so all attempts share one budget."""
    done, text = pairs.withColumn("__s", F.lit(None).cast("struct<quote:string,failures:array<string>,attempt:int,status:string>")), F.col(provision)
    for n in range(1, attempts + 1):
        due = F.col("__s").isNull() | (F.col("__s.status") == "failed")
        done = done.withColumn("__a", F.when(due, model(F.col(indicator), text, F.lit(n)))).withColumn("__g", parse(F.col("__a")))
        done = done.withColumn("__q", F.coalesce(anchor_quote(text, F.col("__g.verbatim_quote")), F.col("__g.verbatim_quote")))
        checked = verify_failures(F.col("__q"), text, F.col("__g.subsection"))
        failures = F.when(F.col("__g").isNull(), F.array(F.lit("malformed answer"))).when(F.length("__q") > MOST, F.array(F.lit("quote too long"))).otherwise(checked)
        nothing = F.coalesce(~F.col("__g.maps_to_indicator"), F.lit(False))
        done = done.withColumn("__f", F.when(due, F.when(nothing, F.array().cast("array<string>")).otherwise(failures)))
        status = F.when(nothing, "no_evidence").when(F.size("__f") == 0, "passed").otherwise("dropped" if n == attempts else "failed")
        this = F.struct(F.when(~nothing, F.col("__q")).alias("quote"), F.col("__f").alias("failures"), F.lit(n).alias("attempt"), status.alias("status"))
        done = done.withColumn("__s", F.when(due, this).otherwise(F.col("__s")))
    told = done.select("*", F.col("__s.quote").alias("quote"), F.col("__s.failures").alias("failures"), F.col("__s.attempt").alias("extraction_attempts"), F.col("__s.status").alias("status"))
    return told.drop("__s", "__a", "__g", "__q", "__f")
