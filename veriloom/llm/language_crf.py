"""Language of text, word by word, by a linear-chain conditional random field.

A line is a sequence of words. A word's features are its prefixes and suffixes, its character n-grams and its place in a
lexicon of the commonest words; emission and transition weights are learned together by gradient ascent on the likelihood,
and forward-backward gives each word's posterior over languages, so code-switched text is labelled word by word. A document's
language is the one with the most posterior mass over its words, its score that share.

The fit reads at most MAX_DOCS labelled documents, as many of each language (those with the least hash, whole texts), so a rare
language is learned too, and keeps features met LEAST_SEEN times; prediction reads every whole text. A run of over LONGEST
characters, as in text without spaces, is read whole, in consecutive pieces. Lines of a batch run side by side, longest first.

Defined cases: a null text or one without a letter is "und" with score 0; without labelled documents all are "und"; a null
doc_id is never learned from and isn't held out; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from veriloom.llm.common import small_arrow_batches
from veriloom.llm.quality_classifier import remainder

MAX_DOCS, LEAST_SEEN, LEXICON, ROUNDS, RATE, RIDGE = 500, 4, 3_000, 24, 0.5, 1e-4
#: Words kept with their emissions in a Python worker.
MAX_WORDS = 400_000
#: Characters of a word; longer runs, as in text without spaces, are read in pieces.
LONGEST = 40


_MARKS = ".,;:!?()[]{}\"'*#$%&|<>-_=+/0123456789"


def word_features(core: str) -> list[str]:
    """Of a word without the marks around it: itself for the lexicon, prefixes and suffixes, bigrams and trigrams with its ends."""
    if not core:
        return []
    own = f"^{core}$"
    n = len(core)
    out = ["w" + core, "p" + core[0], "s" + core[-1]]
    if n > 1:
        out += ["p" + core[:2], "s" + core[-2:]]
    if n > 2:
        out += ["p" + core[:3], "s" + core[-3:]]
    return out + [own[i : i + 2] for i in range(n + 1)] + [own[i : i + 3] for i in range(n)]


def core_of(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip(_MARKS)


def pieces(word: bytes) -> list[bytes]:
    """A run of over LONGEST characters in consecutive pieces, each a word of its own; any other word as it is."""
    core = core_of(word)
    return [word] if len(core) <= LONGEST else [core[k : k + LONGEST].encode() for k in range(0, len(core), LONGEST)]


def lines_of(text: str) -> list[list[bytes]]:
    lines = [x.split() for x in text.lower().encode("utf-8", "surrogatepass").split(b"\n")]  # ASCII white space
    return [x if max(map(len, x)) <= LONGEST else [p for w in x for p in pieces(w)] for x in lines if x]


class Sequences:
    """Lines laid end to end; where each starts, longest first, for steps over all lines at once."""

    def __init__(self, lengths: list[int]):
        size = np.asarray(lengths, np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        order = np.argsort(-size, kind="stable")
        self.size, self.start, self.words = size[order], start[order], int(size.sum())
        top = int(self.size[0]) if len(size) else 0
        self.active = np.searchsorted(-self.size, -np.arange(top), side="left")  # lines longer than t


def forward_backward(emission: np.ndarray, transition: np.ndarray, s: Sequences, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors of all words; and the expected transitions, summed, if asked for."""
    hot = np.exp(emission - emission.max(axis=1, keepdims=True)) if len(emission) else emission
    step = np.exp(transition)
    ahead, behind = np.empty_like(hot), np.ones_like(hot)
    total = np.zeros_like(transition) if pairs else None
    for t, k in enumerate(s.active):
        at = s.start[:k] + t
        now = hot[at] if t == 0 else (ahead[at - 1] @ step) * hot[at]
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(s.active) - 2, -1, -1):
        at = s.start[: s.active[t + 1]] + t
        right = hot[at + 1] * behind[at + 1]
        now = right @ step.T
        behind[at] = now / now.sum(axis=1, keepdims=True)
        if total is not None:
            mass = (ahead[at] * now).sum(axis=1, keepdims=True)
            total += ((ahead[at] / mass).T @ right) * step
    posterior = ahead * behind
    return posterior / posterior.sum(axis=1, keepdims=True), total


def fit(texts: list[str], langs: list[str]) -> dict | None:
    names = sorted(set(langs))
    if not names:
        return None
    ids: dict[bytes, int] = {}
    words, lengths, gold = [], [], []
    for text, lang in zip(texts, langs):
        for line in lines_of(text):
            words += [ids.setdefault(w, len(ids)) for w in line]
            lengths.append(len(line))
            gold += [names.index(lang)] * len(line)
    if not words:
        return None
    word_at, gold_at = np.asarray(words), np.asarray(gold)
    often = np.bincount(word_at, minlength=len(ids))
    cores: Counter = Counter()
    for w, times in zip(ids, often.tolist()):
        cores[core_of(w)] += times
    lexicon = {f"w{c}" for c, _ in sorted(cores.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if c}
    seen: Counter = Counter()
    lists = []
    for w in ids:
        found = [f for f in word_features(core_of(w)) if f[0] != "w" or f in lexicon]
        lists.append(found)
        seen.update(set(found))
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_SEEN or f in lexicon))}
    rows = np.asarray([r for r, fs in enumerate(lists) for f in fs if f in index], np.int64)
    cols = np.asarray([index[f] for fs in lists for f in fs if f in index], np.int64)
    n, k = len(index), len(names)
    weight, transition = np.zeros((n, k)), np.zeros((k, k))
    speed_w, speed_t = np.full((n, k), 1e-8), np.full((k, k), 1e-8)
    s = Sequences(lengths)
    truth = np.zeros((len(word_at), k))
    truth[np.arange(len(word_at)), gold_at] = 1
    inner = np.ones(len(word_at), bool)
    inner[s.start] = False
    moves = np.zeros((k, k))
    np.add.at(moves, (gold_at[np.nonzero(inner)[0] - 1], gold_at[inner]), 1)
    for _ in range(ROUNDS):
        table = np.zeros((len(ids), k))
        for j in range(k):
            table[:, j] = np.bincount(rows, weight[cols, j], len(ids))
        posterior, expected = forward_backward(table[word_at], transition, s, pairs=True)
        miss = truth - posterior
        by_word = np.stack([np.bincount(word_at, miss[:, j], len(ids)) for j in range(k)], axis=1)
        up_w = np.stack([np.bincount(cols, by_word[rows, j], n) for j in range(k)], axis=1) / len(word_at) - RIDGE * weight
        up_t = (moves - expected) / len(word_at) - RIDGE * 100 * transition
        speed_w += up_w**2
        speed_t += up_t**2
        weight += RATE * up_w / np.sqrt(speed_w)
        transition += RATE / 4 * up_t / np.sqrt(speed_t)
    return {"names": names, "index": index, "weight": weight.astype(np.float32), "transition": transition}


class _Emissions(dict):
    """Words to rows of a growing table of emissions; words that differ in the marks around them share a row."""

    def __init__(self, model: dict):
        super().__init__()
        self.model, self.cores = model, {}
        self.rows = np.zeros((1024, len(model["names"])), np.float64)

    def forget(self) -> None:
        self.clear()
        self.cores.clear()

    def __missing__(self, word: bytes) -> int:
        core = core_of(word)
        at = self.cores.get(core)
        if at is None:
            at = self.cores[core] = len(self.cores)
            if at >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            own = [i for i in map(self.model["index"].get, word_features(core)) if i is not None]
            self.rows[at] = np.add.reduce(self.model["weight"].take(own, axis=0)) if own else 0.0
        self[word] = at
        return at


def label_batch(emissions: _Emissions, texts: list[str | None]) -> list[tuple[str, float]]:
    if len(emissions) > MAX_WORDS:
        emissions.forget()
    model = emissions.model
    owner, lengths, at = [], [], []
    lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    for d, text in enumerate(texts):
        if lettered[d]:
            for line in lines_of(text):
                at.extend(map(emissions.__getitem__, line))
                owner.append(d)
                lengths.append(len(line))
    sums = np.zeros((len(texts), len(model["names"])))
    if at:
        posterior, _ = forward_backward(emissions.rows[np.asarray(at)], model["transition"], Sequences(lengths))
        who = np.repeat(owner, lengths)
        for j in range(sums.shape[1]):
            sums[:, j] = np.bincount(who, posterior[:, j], len(texts))
    best = sums.argmax(axis=1)
    return [(model["names"][b], float(row[b] / row.sum())) if ok else ("und", 0.0) for ok, b, row in zip(lettered, best, sums)]


def word_posteriors(model: dict, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each word, line by line."""
    emissions = _Emissions(model)
    lines = lines_of(text)
    at = [emissions[w] for line in lines for w in line]
    if not at:
        return []
    posterior, _ = forward_backward(emissions.rows[np.asarray(at)], model["transition"], Sequences([len(x) for x in lines]))
    return [(w.decode("utf-8", "replace"), model["names"][int(p.argmax())], float(p.max())) for w, p in zip((w for x in lines for w in x), posterior)]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most: int = MAX_DOCS) -> dict | None:
    """Fits on documents whose lang may be learned: crc32(doc_id) mod 4 not 2. Hashes are ranked first, without the texts."""
    taught = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where((remainder(F.col("i"), 4) != 2) & F.col("l").isNotNull() & F.col("t").isNotNull())
    taught = taught.withColumn("draw", F.xxhash64("i", "t"))
    n = taught.agg(F.count_distinct("l")).first()[0]
    each = max(1, most // max(n, 1))
    first = Window.partitionBy("l").orderBy("draw")
    ranked = lambda df: df.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each)
    reach = ranked(taught.select("l", "draw")).groupBy(F.col("l").alias("name")).agg(F.max("draw").alias("reach"))
    near = taught.join(F.broadcast(reach.orderBy("reach", "name").limit(most)), (F.col("l") == F.col("name")) & (F.col("draw") <= F.col("reach")))
    got = ranked(near).orderBy("draw").limit(most).collect()  # at most MAX_DOCS texts
    got.sort(key=lambda r: (r["i"], r["l"], r["t"]))
    return fit([r["t"] for r in got], [r["l"] for r in got])


def labeller(model: dict | None):
    kind = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])

    @F.arrow_udf(kind)
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        emissions = _Emissions(model) if model else None
        for batch in batches:
            found = label_batch(emissions, batch.to_pylist()) if emissions is not None else [("und", 0.0)] * len(batch)
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang", "score"])

    return language


def identified(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    small_arrow_batches(docs.sparkSession, 256)
    model = learn(docs, text, lang, doc_id)
    out = docs.select(F.col(doc_id).alias("doc_id"), labeller(model)(F.col(text)).alias("p"))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
