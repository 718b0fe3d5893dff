"""Near copies by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

Candidates come from SimHash first, by op1's operator: the components that simhash.links makes of the fingerprints by multi-index
hashing are groups, whose members an exact check decides on. Fingerprints of 64 bits can't find all: at a similarity of 0.8 two
differ by some 10 bits, and segments that balls of so many bits can be enumerated in hold a good part of any corpus. So beside
them candidates share one of BANDS groups of ROWS minimal hashes; a pair at 0.8 shares none once in about 300,000 times, and less
often above. Of all candidates only pairs in which SKETCH or more of the
minimal hashes agree (a byte of each is compared; fewer agree once in 100,000 pairs at 0.8) are looked at further, and what
is linked is decided by the exact similarity of the sets.

In a group each member is first compared with the least one. Then only members that these links don't already join are compared,
block by block of BLOCK members with their sets, and of the links between two blocks those are given that join what others didn't
join yet. So rows are in proportion to the members, and the components are those that all pairs would give. All of this
runs over distinct sets; texts with one set share a node.

Defined cases: case and white space don't count; a text of fewer words than a shingle is one shingle; null and blank texts share
one node; rows without an id and repeated ids are treated as in simhash.keep_first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm import simhash
from veriloom.llm.common import cut, give_back, maybe_broadcast, rows_kept, small_arrow_batches
from veriloom.llm.components import components

WORDS, BANDS, ROWS, SEED = 5, 24, 4, 42
#: The least similarity of a link, as a fraction of whole numbers.
LEAST = (4, 5)
#: Of the BANDS * ROWS minimal hashes, how many must agree.
SKETCH = 60
#: Members of a group that are compared with as many others at a time.
BLOCK = 256
#: Shingles put through all hash functions at a time.
CHUNK = 4_096

_DRAW = np.random.default_rng(SEED)
_FACTORS = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles_of(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    parts = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(parts[k:] for k in range(words))) if len(parts) >= words else [parts]
    return np.unique(np.fromiter((digest(join(r), SEED) for r in runs), dtype=np.uint64))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def minima_of(shingles: np.ndarray) -> np.ndarray:
    """The minimal hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), CHUNK):
        least = np.minimum(least, (_FACTORS * shingles[at : at + CHUNK] + _TERMS).min(axis=1))
    return least


def bands_of(least: np.ndarray) -> list[int]:
    """A hash of each group of minimal hashes."""
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


def sketch_of(least: np.ndarray) -> bytes:
    """A byte of each minimal hash, from its lower half: the upper bits of a minimum are mostly zero."""
    return ((least >> np.uint64(24)) & np.uint64(255)).astype(np.uint8).tobytes()


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def node():
    """An Arrow function: text to the node of its set as a signed long."""

    @F.arrow_udf("long")
    def named(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(_signed([node_of(shingles_of(t.as_py())) for t in batch]), pa.int64())

    return named


def _read():
    """An Arrow function: text to struct(node, bands, sketch, fp), fp being op1's fingerprint; no bands for a text without a word."""
    out = pa.struct([("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("fp", pa.int64())])

    @F.arrow_udf("node long, bands array<long>, sketch binary, fp long")
    def signed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            nodes, bands, sketches, fps = [], [], [], []
            for t in batch:
                fps.append(simhash.fingerprint_of(t.as_py()))
                shingles = shingles_of(t.as_py())
                least = minima_of(shingles)
                nodes.append(node_of(shingles))
                bands.append(_signed(bands_of(least) if len(shingles) else []))
                sketches.append(sketch_of(least))
            yield pa.StructArray.from_arrays([pa.array(_signed(nodes), pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(_signed(fps), pa.int64())], fields=list(out))
        give_back()

    return signed.asNondeterministic()  # so that no part of the struct is computed apart


def _sets():
    """An Arrow function: text to struct(node, values), the values being its shingles."""
    out = pa.struct([("node", pa.int64()), ("values", pa.list_(pa.int64()))])

    @F.arrow_udf("node long, values array<long>")
    def listed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            sets = [shingles_of(t.as_py()) for t in batch]
            nodes = pa.array(_signed([node_of(s) for s in sets]), pa.int64())
            yield pa.StructArray.from_arrays([nodes, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], fields=list(out))
        give_back()

    return listed.asNondeterministic()


def _agreeing():
    """An Arrow function: two sketches to the number of bytes in which they agree."""

    @F.arrow_udf("int")
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        grid = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1)
        return pa.array((grid(a) == grid(b)).sum(axis=1) if len(a) else [], pa.int32())

    return agree


def _similar(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as a link asks."""
    n = likely.count()
    wanted = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    some = sets.join(maybe_broadcast(wanted, 2 * n), "node", "left_semi")
    of = lambda name: some.select(F.col("node").alias(name), F.col("values").alias(f"s{name}"))
    both = maybe_broadcast(likely, n).join(of("a"), "a").join(of("b"), "b")
    na, nb, shared = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    over, under = LEAST
    sizes = F.least(na, nb) * under >= F.greatest(na, nb) * over
    return both.where(sizes).where(shared * under >= (na + nb - shared) * over).select("a", "b")


def joining_links(nodes: np.ndarray, labels: list[int], sides: np.ndarray, grid: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members, of the two sides if there are two, that join classes: members with one label are of one class."""
    left = sides == sides.min()
    right = ~left if not left.all() else left
    within, out, over, under = left is right, [], *LEAST
    root = {x: x for x in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at = np.flatnonzero(right)
    for i in np.flatnonzero(left):
        others = at[at > i] if within else at
        for j in others[(grid[others] == grid[i]).sum(axis=1) >= SKETCH]:
            x, y, m, n = find(labels[i]), find(labels[j]), len(sets[i]), len(sets[j])
            if x == y or min(m, n) * under < max(m, n) * over:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared * under >= (m + n - shared) * over:
                root[x] = y
                out.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, i, k) to links (a, b): one group's blocks, some twice BLOCK rows, are held at a time."""
    kept, now = [], None

    def found() -> pa.RecordBatch:
        nodes, sides = (np.array([r[c] for r in kept], np.int64) for c in (0, 2))
        grid = np.frombuffer(b"".join(r[3] for r in kept), np.uint8).reshape(len(kept), -1)
        links = joining_links(nodes, [r[1] for r in kept], sides, grid, [r[4] for r in kept])
        return pa.RecordBatch.from_arrays([pa.array([p[c] for p in links], pa.int64()) for c in range(2)], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "i", "k", "node", "label", "own", "sketch")]
        for key, i, k, *row, values in zip(*columns, batch.column("values")):
            if (key, i, k) != now:
                if len(kept) > 1:
                    yield found()
                kept, now = [], (key, i, k)
            kept.append((*row, values.values.to_numpy()))
    if len(kept) > 1:
        yield found()
    give_back()


def _across(told: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """told (key, node, label) to links (a, b) that join labels, from groups of more than the two that were compared already."""
    mixed = told.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("label") < F.max("label")).alias("mixed")).where("mixed AND n > 2")
    rows = told.join(mixed.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "key")
    rows = rows.join(sketches, "node").join(sets, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("k"), "node", "label", "own", "sketch", "values")
    laid = dealt.repartition("key", "i", "k").sortWithinPartitions("key", "i", "k")
    return laid.mapInArrow(_compared, "a long, b long").distinct()


def _fingerprint_groups(nodes: DataFrame) -> DataFrame:
    """nodes (node, bands, fp) to (node, key): key names the component of the node's fingerprint, of simhash.links."""
    some = nodes.where(F.size("bands") > 0)
    labels = components(simhash.links(cut(some.select("fp").distinct()))).select(F.col("node").alias("fp"), "label")
    return some.select("node", "fp").join(labels, "fp", "left").select("node", F.xxhash64(F.lit("simhash"), F.coalesce("label", "fp")).alias("key"))


def links(nodes: DataFrame, sets_of) -> DataFrame:
    """nodes (node, bands, sketch, fp) to links (a, b); sets_of gives the shingles (node, values) of a table of nodes."""
    table = nodes.select("node", F.explode("bands").alias("key")).union(_fingerprint_groups(nodes))
    centres = table.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    members = cut(table.join(centres, "key"))
    names = members.select("node").distinct()
    sets = cut(sets_of(names))
    sketches = cut(nodes.select("node", "sketch").join(names, "node"))
    of = lambda name: sketches.select(F.col("node").alias(name), F.col("sketch").alias(f"s{name}"))
    star = members.where("node <> a").select("a", F.col("node").alias("b")).distinct().join(of("a"), "a").join(of("b"), "b")
    first = cut(_similar(cut(star.where(_agreeing()(F.col("sa"), F.col("sb")) >= SKETCH).select("a", "b")), sets))
    labels = components(first)
    told = cut(members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    return first.union(_across(told, sketches, sets))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: of each component the row with the least doc_id."""
    small_arrow_batches(docs.sparkSession, 256)
    read = cut(docs.select(F.col(doc_id).alias("doc_id"), _read()(F.col(text)).alias("s")).select("doc_id", "s.*"))
    nodes = cut(read.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("fp").alias("fp")))

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = cut(nodes.join(some, "node").select("node", "least"))
        wanted = maybe_broadcast(wanted, wanted.count())
        rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(wanted.select("least").distinct(), F.col("__id").eqNullSafe(F.col("least")), "left_semi")
        sets = rows.select(_sets()(F.col("__text")).alias("s")).select("s.node", "s.values")
        return sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])

    labels = components(links(nodes.select("node", "bands", "sketch", "fp"), sets_of))
    known = nodes.join(labels, "node", "left").select(F.col("node").alias("fp"), F.coalesce("label", "node").alias("label"))
    thin = read.select("doc_id", F.col("node").alias("fp"))
    return rows_kept(docs, thin, simhash.firsts(thin, known), node(), text, doc_id)
