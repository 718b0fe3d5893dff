"""Quality rules by host.

RULES are measured on each text. The failures of each rule are added up by host, and each rule's failure rates are shrunk
towards all hosts' by a beta prior whose two parameters come from the hosts' rates by moments. Verdicts are joined back:

* a host is suspect by a rule where its shrunk rate is over the prior's mean: of its documents those that fail the rule go;
  on other hosts a failure of a rule that isn't a base rule is forgiven;
* a host is condemned, with all its documents, where two deviations below its posterior mean most documents still fail a base rule.

A small host with a few bad pages is thus not condemned by chance, and a good document of a mixed host stays.

Defined cases: a null text has no words (and fails the base rule); a null host is a host of its own; rows that repeat count
each; with fewer than two hosts, or none that differ, the prior of a rule is Beta(m, 1 - m) of the mean m, and no host is
suspect by it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veriloom.llm.common import cut, maybe_broadcast, small_arrow_batches

LEAST_WORDS, MOST_REPEATED, MOST_FAILED = 50, 50, 0.5
#: What fails a rule: few words, repeated windows, more than a symbol to ten words, over half the lines repeated.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeats": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
}
BASE_RULES = ("few_words", "repeats")
#: From so many words on, windows are counted in arrays, not in a table of tuples.
LONG = 100_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    if n >= LONG:
        ids: dict[bytes, int] = {}
        codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        _, pair = np.unique(codes[:-1] * len(ids) + codes[1:], return_inverse=True)
        _, triple, count = np.unique(pair[:-1] * np.int64(len(ids)) + codes[2:], return_inverse=True, return_counts=True)
        again = count[triple] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return int(covered.sum())
    first: dict[tuple, int] = {}
    covered = bytearray(n)
    seen = first.setdefault
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        j = seen(window, i)
        if j != i:
            covered[j : j + 3] = covered[i : i + 3] = b"\1\1\1"
    return covered.count(1)


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space alone
    gaps = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    return len(words), len(text) - gaps, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


@F.arrow_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        columns = list(zip(*(measure(t.as_py()) for t in batch))) or [()] * len(MEASURES)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], MEASURES)


def beta_priors(hosts: DataFrame, rules: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Of each rule the parameters by moments from hosts (n, and failures by rule): the mean and variance of their rates, less what
    chance alone gives."""
    rates = [x for r in rules for x in (F.avg(F.col(r) / F.col("n")), F.var_pop(F.col(r) / F.col("n")))]
    k, chance, *found = hosts.agg(F.count(F.lit(1)), F.avg(1 / F.col("n")), *rates).first()
    return {r: _prior(k, m, v, chance) for r, m, v in zip(rules, found[::2], found[1::2])}


def _prior(k: int, m: float | None, v: float | None, chance: float | None) -> tuple[float, float]:
    if not k:
        return 0.5, 0.5
    if m <= 0 or m >= 1:
        return max(m, 0.01), max(1 - m, 0.01)
    v = max((v or 0.0) - m * (1 - m) * chance, 0.0)
    strength = min(max(m * (1 - m) / v - 1 if v > 0 else 1.0, 1.0), 1e6)
    return m * strength, (1 - m) * strength


def host_verdicts(hosts: DataFrame) -> DataFrame:
    """hosts (host, n, failures by rule and base) with the shrunk rate and suspicion by each rule, and condemned."""
    priors = beta_priors(hosts, [*RULES, "base"])
    rate = lambda r: (F.col(r) + priors[r][0]) / (F.col("n") + sum(priors[r]))
    p = rate("base")
    low = p - 2 * F.sqrt(p * (1 - p) / (F.col("n") + sum(priors["base"]) + 1))
    suspect = [(rate(r) > priors[r][0] / sum(priors[r]) + 1e-9).alias(f"suspect_{r}") for r in RULES]
    return hosts.select("host", "n", *[rate(r).alias(f"rate_{r}") for r in RULES], *suspect, (low > MOST_FAILED).alias("condemned"))


def judged(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, host, the measures, base_failed, kept."""
    small_arrow_batches(docs.sparkSession)
    thin = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), measured(F.col(text)).alias("m")).select("doc_id", "host", "m.*"))
    thin = thin.withColumns({f"fails_{r}": F.expr(test) for r, test in RULES.items()})
    thin = thin.withColumn("base_failed", reduce(or_, [F.col(f"fails_{r}") for r in BASE_RULES]))
    failures = [F.sum(F.col(c).cast("long")).alias(r) for r, c in [(r, f"fails_{r}") for r in RULES] + [("base", "base_failed")]]
    hosts = cut(thin.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *failures))
    verdicts = host_verdicts(hosts).withColumnRenamed("host", "__host").select("__host", "condemned", *[f"suspect_{r}" for r in RULES])
    out = thin.join(maybe_broadcast(verdicts, hosts.count()), thin["host"].eqNullSafe(verdicts["__host"]))
    caught = reduce(or_, [F.col(f"fails_{r}") & F.col(f"suspect_{r}") for r in RULES])
    kept = ~F.col("base_failed") & ~F.col("condemned") & ~caught
    return out.select("doc_id", "host", *MEASURES, "base_failed", kept.alias("kept"))
