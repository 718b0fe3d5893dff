"""Quality scores by Bradley-Terry pairwise ranking.

Each preference pair is a document labelled good and one labelled bad; P(good wins) = logistic(w . (x_good - x_bad)), and w
is fitted by Newton's method on the logistic loss of the feature differences. A quantile of the labelled sample's scores,
the one that splits the labels best, becomes the threshold, and the score is a logistic of the distance to it, scaled
so that the threshold reads THRESHOLD. Features are shares within the text, so they mean the same at every length.

The fit reads at most MAX_LABELLED labelled rows, half of each label (those with the least hash); scoring reads every whole text.

Defined cases: a null text scores as the empty one; without rows of both labels every score is 0.5; a null doc_id or label is
never learned from; a label that is repeated counts once, contrary ones count each; of repeated documents no more rows
than the bound are learned from; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import bounded_sample, small_arrow_batches

THRESHOLD = 0.3
#: Bounds of the fit: labelled rows read, and preference pairs made of them.
MAX_LABELLED, PAIRS = 12_000, 60_000
SYMBOLS = b"#*$%&|<>"
_PUNCTUATION = b".,;:!?)\"'"
N_FEATURES = 16


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    size = len(raw)
    solid = sum(map(len, words))
    upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = size - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    marks = size - len(raw.translate(None, SYMBOLS))
    digits = size - len(raw.translate(None, b"0123456789"))
    stops = raw.count(b".") + raw.count(b",")
    equal = sum(map(bytes.__eq__, words, words[1:]))
    kinds = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = len(lines) - len(set(lines))
    share = lambda x, of: math.log1p(100.0 * x / of)  # noqa: E731  small shares count
    return [
        share(upper, upper + lower + 1),
        share(marks, n),
        share(raw.count(b"!"), n),
        share(raw.count(b"|"), n),
        share(equal, n),
        kinds / n,
        share(digits, solid),
        solid / n / 10.0,
        share(stops, n),
        math.log1p(n / len(lines)),
        share(again, len(lines)),
        math.log1p(n) / 10.0,
        kinds / n * math.log1p(n) / 10.0,
        float(n < 20),
        share(sum(1 for w in words if len(w) == 1), n),
        share(raw.count(b"<") + raw.count(b"{") + raw.count(b"="), n),
    ]


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-2, seed: int = 5) -> dict | None:
    """Weights, mean, spread, threshold and scale; None without both labels."""
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    if not len(good) or not len(bad):
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / spread
    draw = np.random.default_rng(seed)
    gap = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(gap @ w, -30, 30)))
        step = np.linalg.solve((gap * (p * (1 - p))[:, None]).T @ gap / pairs + ridge * np.eye(len(w)), gap.T @ (1 - p) / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    order = np.argsort(raw)
    below_bad = np.cumsum(y[order] == 0) / len(bad)
    below_good = np.cumsum(y[order] == 1) / len(good)
    k = int(np.argmax(below_bad - below_good))  # the quantile (k + 1) / n of the scores
    cut_at = float(raw[order[k]] + raw[order[min(k + 1, len(raw) - 1)]]) / 2
    return {"w": w, "mean": mean, "spread": spread, "cut": cut_at, "quantile": (k + 1) / len(raw), "scale": float(raw.std()) + 1e-9}


def score_rows(model: dict | None, texts: list[str | None]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    raw = ((np.array([features(t) for t in texts]) - model["mean"]) / model["spread"]) @ model["w"]
    return 1.0 / (1.0 + np.exp(-np.clip(math.log(THRESHOLD / (1 - THRESHOLD)) + 4.0 * (raw - model["cut"]) / model["scale"], -30, 30)))


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MAX_LABELLED) -> dict | None:
    """Fits on docs whose label may be learned: crc32(doc_id) mod 5 not 0."""
    small_arrow_batches(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([features(t.as_py()) for t in batch], pa.list_(pa.float64()))

    taught = labels.where((remainder(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("__id"), "quality").distinct()
    sample = reduce(DataFrame.unionByName, [bounded_sample(taught.where(F.col("quality") == q), F.col("__id"), most // 2) for q in (0, 1)])
    got = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
    seen = got.select("__id", "quality", measured(F.col("__text")).alias("x"))
    place = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("__id", "x")))
    rows = seen.withColumn("place", place).where(F.col("place") <= most // 2).collect()  # at most MAX_LABELLED, however often ids repeat
    if not rows:
        return None
    rows.sort(key=lambda r: (r["__id"], r["quality"], r["x"]))
    return fit(np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows]))


def scorer(model: dict | None):
    """An Arrow function: text to score."""

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(score_rows(model, batch.to_pylist()))

    return quality


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = learn(docs, labels, text, doc_id)
    out = docs.select(F.col(doc_id).alias("doc_id"), scorer(model)(F.col(text)).alias("score"))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with their columns."""
    model = learn(docs, labels, text, doc_id)
    return docs.where(scorer(model)(F.col(text)) >= THRESHOLD)
