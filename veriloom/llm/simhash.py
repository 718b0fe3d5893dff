"""SimHash near-dedup by multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints within RADIUS = 3 bits differ in one bit or none in at least one
segment, so each fingerprint looks up, for each segment, its own value and the values of the Hamming ball of radius one in
the table of segments, and the complete distance of what is fetched is verified. Of a pair that differs by one bit in a
segment, the side with that bit at zero finds the other, so only flips from zero to one are enumerated: half the ball.

A table entry that holds over HOT fingerprints isn't paired: its members are linked in a star around the least member at
each point of their other segment's balls (radius one against radius two), 529 rows a member. That gives the same components
with true links only, and rows in proportion to the members. All of this runs over distinct fingerprints; copies share one.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a text of fewer words than a shingle
is one shingle; a null doc_id never names a component unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import cut, give_back, rows_kept, small_arrow_batches
from veriloom.llm.components import components

RADIUS, WORDS, SEED = 3, 3, 42
#: From so many fingerprints in a table entry on, stars cost fewer rows than pairs.
HOT = 1_058
#: Shingles hashed at a time: what a very long text may hold in memory.
CHUNK = 1 << 16


def fingerprint_of(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64 bits: a bit is set if it is set in over half of the shingles' hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both work on ASCII alone
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    totals = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, CHUNK):
        piece = parts[at : min(at + CHUNK, n) + words - 1]
        runs = zip(*(piece[k:] for k in range(words))) if len(piece) >= words else [piece]
        hashes = np.fromiter((digest(join(r), seed) for r in runs), dtype=np.uint64)
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(words: int = WORDS, seed: int = SEED):
    """An Arrow function: text to the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(np.array([fingerprint_of(t.as_py(), words, seed) for t in batch], dtype=np.uint64).view(np.int64))
        give_back()

    return simhash


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segments(fps: DataFrame) -> DataFrame:
    """fp with (seg, key, rest): a segment's value and the other segment's."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    both = F.array(F.struct(F.lit(0).alias("seg"), low.alias("key"), high.alias("rest")), F.struct(F.lit(1).alias("seg"), high.alias("key"), low.alias("rest")))
    return fps.select("fp", F.explode(both).alias("s")).select("fp", "s.seg", "s.key", "s.rest")


def _half_ball(segments: DataFrame) -> DataFrame:
    """Each segment's value and those with one zero bit set."""
    flips = F.filter(F.array(*[F.lit(1 << k) for k in range(32)]), lambda m: F.col("key").bitwiseAND(m) == 0)
    keys = F.concat(F.array(F.struct(F.col("key").alias("key"), F.lit(0).alias("flips"))), F.transform(flips, lambda m: F.struct(F.col("key").bitwiseOR(m).alias("key"), F.lit(1).alias("flips"))))
    return segments.select("fp", "seg", "rest", F.explode(keys).alias("k")).select("fp", "seg", "rest", "k.key", "k.flips")


def _ball(radius: int) -> Column:
    """Masks of 32 bits with so many bits or fewer, and their number of bits."""
    masks = [(0, 0)] + [(1 << a, 1) for a in range(32)]
    if radius == 2:
        masks += [((1 << a) | (1 << b), 2) for a in range(32) for b in range(a)]
    return F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("far")) for m, n in masks])


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints (fp long) to links (a, b): all pairs within RADIUS but those of hot entries, which get stars."""
    table = _segments(fps)
    crowded = cut(table.groupBy("seg", "key").count().where(F.col("count") > hot).select("seg", "key", F.lit(True).alias("hot")))
    n_crowded = crowded.count()
    probes = _half_ball(table)
    if not n_crowded:
        return _pairs(table, probes)
    marked = crowded if n_crowded > 100_000 else F.broadcast(crowded)
    table, probes = (df.join(marked, ["seg", "key"], "left") for df in (table, probes))
    return _pairs(table.where("hot IS NULL"), probes.where("hot IS NULL")).union(_stars(table.where("hot"), probes.where("hot AND flips = 1")))


def _pairs(table: DataFrame, probes: DataFrame) -> DataFrame:
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    found = probes.select("seg", "key", "flips", F.col("fp").alias("a")).join(table.select("seg", "key", F.col("fp").alias("b")), ["seg", "key"])
    return found.where(near & ((F.col("flips") == 1) | (F.col("a") < F.col("b")))).select("a", "b")


def _stars(table: DataFrame, probes: DataFrame) -> DataFrame:
    """At each point v of the rest: the least table member within one bit is linked to members within two and probes within one."""
    at = lambda df, radius, kind: df.select("seg", "key", "fp", "rest", F.explode(_ball(radius)).alias("m")).select("seg", "key", F.col("rest").bitwiseXOR(F.col("m.mask")).alias("v"), "fp", F.col("m.far").alias("far"), F.lit(kind).alias("kind"))
    points = at(table, 2, "table").union(at(probes, 1, "probe"))
    centres = points.where("kind = 'table' AND far <= 1").groupBy("seg", "key", "v").agg(F.min("fp").alias("a"))
    return points.join(centres, ["seg", "key", "v"]).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def _labelled(docs: DataFrame, text: str, doc_id: str, words: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp), and for each distinct fp its component's label and least doc_id."""
    small_arrow_batches(docs.sparkSession)
    thin = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(words)(F.col(text)).alias("fp")))
    fps = cut(thin.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(fps.select("fp"), hot))
    known = fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    names = known.groupBy("label").agg(F.min("least").alias("component_id"))
    return thin, known.select("fp", "label").join(names, "label")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, hot: int = HOT) -> DataFrame:
    """doc_id, fp (signed long), component_id: the least doc_id that links reach."""
    thin, known = _labelled(docs, text, doc_id, words, hot)
    return thin.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, hot: int = HOT) -> DataFrame:
    """The rows of docs that stay: of each component the row with the least doc_id (of rows alike in it, one; null ids last)."""
    thin, known = _labelled(docs, text, doc_id, words, hot)
    return rows_kept(docs, thin, firsts(thin, known), fingerprint(words), text, doc_id)


def firsts(thin: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, fp) of the row that stays of each label: thin holds (doc_id, fp) of the rows, known the label of each distinct fp."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k")
    alike = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("f")
    chosen = thin.groupBy("fp").agg(alike).select("fp", "f.doc_id").join(known.select("fp", "label"), "fp")
    return cut(chosen.groupBy("label").agg(least).select("k.doc_id", "k.fp"))
