"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

What the base patterns find are seeds. The words around a seed are lexical patterns (left word with the marks between, right
word, and both); other tokens with digits are candidates with patterns of their own. On the graph of patterns and instances
Spark scores in turn: a pattern by the share of its known instances that are of a kind (shrunk by one unknown instance), an
instance by the noisy-or of its good patterns; what is accepted counts as an instance in the next round. Known are seeds, what was
accepted, and candidates that contradict a kind: letters in an ip, card or phone, none in an email. Other candidates count neither
for nor against a pattern, however many there are. A candidate needs TWO good patterns of LEAST_SEEDS instances each that come to
ACCEPT together, or one that has it alone (some 20 instances), so chance neighbours don't make a finding. Base spans always stay.

A fifth kind, secret, has weak seeds: tokens of SECRET_LENGTH or more letters and digits, as keys have. They teach patterns like
other seeds, but a secret, weak seed or candidate, becomes a span only where good patterns say so.

A candidate has a digit and LEAST_LENGTH characters or more: identifiers without a digit, as names, are not sought. Words
and marks around an instance count whole, however far they reach; long ones enter a pattern as their hash.

Defined cases: a null text is empty; null or repeated doc_ids are rows of their own; spans are code points, end exclusive;
without seeds or candidates only base spans remain; every scan is linear in the text; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from veriloom.llm.common import cut, maybe_broadcast, small_arrow_batches

KINDS = ["email", "ip", "card", "phone", "secret"]
EMAIL, SECRET = KINDS.index("email"), KINDS.index("secret")
ROUNDS, GOOD_PATTERN, ACCEPT, LEAST_SEEDS, LEAST_PATTERNS = 3, 0.8, 0.95, 5, 2
LEAST_LENGTH, SECRET_LENGTH = 6, 32
#: Characters of a context that enter a pattern as they are.
LONGEST = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+@-")
_SECRET = re.compile(rf"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]{{{SECRET_LENGTH},}}")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        else:
            done = at + 1  # no match holds an @ but its own
        at = text.find("@", done)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _DIGITS.finditer(text):
        digits = run.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(run.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(s, 1, e) for s, e in ips(text)] if "." in text else []
        out += [(s, 2, e) for s, e in cards(text)]
        out += [(s, 3, e) for s, e in phones(text)] if "+" in text else []
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit, of LEAST_LENGTH or more, outside the base spans."""
    out, at = [], 0
    covered = sorted((s, e) for s, _, e in taken)
    k = 0
    while found := _DIGIT.search(text, at):
        start, end = found.start(), found.end()
        while start > at and text[start - 1] in _TOKEN:
            start -= 1
        while end < len(text) and text[end] in _TOKEN:
            end += 1
        at = end
        while end > start and text[end - 1] in "._+@-":
            end -= 1
        while start < end and text[start] in "._+@-":
            start += 1
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if end - start >= LEAST_LENGTH and not (k < len(covered) and covered[k][0] < end):
            out.append((start, end))
    return out


def _short(context: str) -> str:
    return context if len(context) <= LONGEST else f"#{xxhash.xxh64_hexdigest(context.encode('utf-8', 'surrogatepass'))}"


def patterns(text: str, start: int, end: int) -> list[str]:
    """What stands around an instance; a stretch between two instances is read by each of them once."""
    i = start
    while i > 0 and not (text[i - 1].isalnum() or text[i - 1] == "_"):
        i -= 1
    j = i
    while j > 0 and text[j - 1].isalpha():
        j -= 1
    before = f"L:{_short(text[j:i].lower() + text[i:start].replace(' ', ''))}" if j < i else ""
    i = end
    while i < len(text) and not (text[i].isalnum() or text[i] == "_"):
        i += 1
    j = i
    while j < len(text) and text[j].isalpha():
        j += 1
    after = f"R:{_short(text[i:j].lower())}" if i < j else ""
    return [p for p in (before, after, f"{before} {after}" if before and after else "") if p]


def scan(text: str | None) -> tuple[list[dict], list[dict]]:
    """Base spans, and slots: seeds (rank of their kind) and candidates (rank null) with surface and patterns."""
    if not text:
        return [], []
    base = base_spans(text)
    spans = [{"start": s, "rank": k, "stop": e} for s, k, e in base]
    found = [(s, k, e) for s, k, e in base] + ([(s, SECRET if _SECRET.fullmatch(text, s, e) else None, e) for s, e in candidates(text, base)] if _DIGIT.search(text) else [])
    return spans, [{"start": s, "rank": k, "stop": e, "surface": text[s:e].lower(), "patterns": patterns(text, s, e)} for s, k, e in found]


_SPAN = [StructField("start", IntegerType()), StructField("rank", IntegerType()), StructField("stop", IntegerType())]
_SLOT = StructType([*_SPAN, StructField("surface", StringType()), StructField("patterns", ArrayType(StringType()))])
_SCAN = StructType([StructField("spans", ArrayType(StructType(_SPAN))), StructField("slots", ArrayType(_SLOT))])


def scanner():
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(_SCAN)

    @F.arrow_udf(_SCAN)
    def personal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([dict(zip(("spans", "slots"), scan(t.as_py()))) for t in batch], kind)

    return personal


def bootstrap(slots: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """slots (surface, rank, patterns) to accepted (surface, rank); None if there are none. Accepted are candidates and secrets."""
    edges = cut(slots.select("surface", "rank", F.explode("patterns").alias("pattern")).distinct())
    known = edges.where("rank IS NOT NULL").select(F.col("surface").alias("s")).distinct()
    open_edges = edges.where("rank IS NULL").select("surface", "pattern").join(known, F.col("surface") == F.col("s"), "left_anti").distinct()
    against = cut(open_edges.groupBy("pattern", F.col("surface").rlike("[a-z]").alias("letters")).agg(F.count_distinct("surface").alias("against")))
    secrets = edges.where(F.col("rank") == SECRET).select("surface", "pattern", F.lit(SECRET).alias("must"))
    sought = cut(open_edges.select("surface", "pattern", F.lit(None).cast("int").alias("must")).unionByName(secrets))
    seeds = edges.where("rank IS NOT NULL").select("surface", "rank", F.lit(1.0).alias("score")).distinct()
    members = edges.select("surface", "pattern").distinct()
    scores, accepted, before = seeds, None, -1
    for _ in range(rounds):
        share = members.join(scores, "surface").groupBy("pattern", "rank").agg(F.sum("score").alias("mass"))
        sizes = members.join(scores.select("surface").distinct(), "surface").groupBy("pattern").agg(F.count_distinct("surface").alias("n"))
        # letters in a candidate speak against ip, card and phone, their absence against an email, nothing against a secret
        contrary = F.when(F.col("rank") != SECRET, F.col("rank") != EMAIL)
        share = share.where(F.col("mass") >= LEAST_SEEDS).withColumn("letters", contrary)
        good = share.join(sizes, "pattern").join(against, ["pattern", "letters"], "left")
        good = good.withColumn("confidence", F.col("mass") / (F.col("n") + F.coalesce("against", F.lit(0)) + 1))
        good = cut(good.where(F.col("confidence") >= GOOD_PATTERN).select("pattern", "rank", "confidence"))
        met = sought.join(maybe_broadcast(good, good.count()), "pattern").where(F.col("must").isNull() | (F.col("must") == F.col("rank")))
        score = 1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))
        found = met.groupBy("surface", "rank").agg(score.alias("score"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"))
        enough = (F.col("n") >= LEAST_PATTERNS) & (F.col("score") >= ACCEPT) | (F.col("best") >= ACCEPT)
        found = cut(found.where(enough).select("surface", "rank", "score"))
        n = found.count()
        if n == before or n == 0:
            accepted = found if n else accepted
            break
        accepted, before = found, n
        scores = seeds.unionByName(found.join(known, F.col("surface") == F.col("s"), "left_anti"))
    if accepted is None:
        return None
    return accepted.groupBy("surface").agg(F.max_by("rank", F.struct("score", -F.col("rank"))).alias("rank"))


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base and spans: arrays of struct(start, rank, stop) in order; spans holds base and what the method adds."""
    small_arrow_batches(docs.sparkSession)
    scanned = docs.select(F.col(doc_id).alias("doc_id"), scanner()(F.col(text)).alias("p"))
    thin = cut(scanned.select("doc_id", F.col("p.spans").alias("base"), F.col("p.slots").alias("slots")).withColumn("row", F.monotonically_increasing_id()))
    slots = thin.where(F.size("slots") > 0).select("row", F.explode("slots").alias("s")).select("row", "s.*")
    accepted = bootstrap(slots)
    if accepted is None:
        return thin.select("doc_id", "base", F.col("base").alias("spans"))
    added = slots.where(F.col("rank").isNull() | (F.col("rank") == SECRET)).drop("rank").join(accepted, "surface").groupBy("row").agg(F.collect_list(F.struct("start", "rank", "stop")).alias("more"))
    return thin.join(added, "row", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(thin.schema["base"].dataType)))).alias("spans"))


def written(spans):
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")
