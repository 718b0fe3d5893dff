"""Exact and near duplicates against brute force, and the defined cases."""

import hashlib
import random
import re

import pytest
import xxhash

from veriloom.llm import exact_dedup, simhash
from veriloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, kept string"


def rows():
    r = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "eps", "zeta"]
    out = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 30))), "en", "x") for i in range(60)]
    out += [(100 + i, "hot copy  of\ttext", "en", None) for i in range(80)] + [(500 + i, f"hot copy{' ' * (1 + i % 3)}of text", None, "y") for i in range(5)]
    out += [(None, None, None, None), (7000, "", None, None), (None, "no id", "en", "z"), (None, "no id", "en", "z"), (3, out[3][1], "en", "again"), (3, "same id, other text here", "en", "k")]
    out += [(9000, "long " * 50_000, "en", "x"), (9001, "Ünï  cödé " * 3, "de", "q")]
    return out


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_verdicts(spark):
    data = rows()
    got = exact_dedup.verdicts(spark.createDataFrame(data, SCHEMA)).collect()
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(normal(t), []).append(i)
    want = sorted((repr(i), repr(min((x for x in groups[normal(t)] if x is not None), default=None)), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t, *_ in data)
    assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_keep_first_has_whole_rows(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = exact_dedup.keep_first(df)
    assert got.columns == df.columns
    assert len({normal(r["text"]) for r in got.collect()}) == got.count() == len({normal(t) for _, t, *_ in data})


def test_exact_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.verdicts(df).count() == 0 and exact_dedup.keep_first(df).count() == 0


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in ([w[i : i + 3] for i in range(len(w) - 2)] or [w])]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fs}


def test_fingerprints():
    for _, t, *_ in rows()[:150]:
        assert simhash.fingerprint_of(t) == brute_fingerprint(t)
    r = random.Random(4)
    long = " ".join(r.choice("abcdefgh") + str(r.randrange(99)) for _ in range(70_000))  # over one chunk
    assert simhash.fingerprint_of(long) == brute_fingerprint(long)


def crowd():
    """Fingerprints in tight and loose balls, and strangers."""
    r = random.Random(5)
    out = {0}
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(40):
            out.add(base ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))))
        for _ in range(20):
            out.add(base ^ sum(1 << b for b in r.sample(range(32), r.randrange(7))))
    return out | {r.getrandbits(64) for _ in range(40)}


@pytest.mark.parametrize("hot", [1_058, 5, 0])
def test_links_and_stars_give_the_components(spark, hot):
    fps = crowd()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), hot)
    unsigned = lambda x: x % (1 << 64)
    assert all((unsigned(r["a"]) ^ unsigned(r["b"])).bit_count() <= 3 for r in links.collect())
    got = {unsigned(r["node"]): r["label"] for r in components(links).collect()}
    want = brute_components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(got.get(f, ("alone", f)), set()).add(f)
    expected = {}
    for f in fps:
        expected.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates_and_rows_kept(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = simhash.near_duplicates(df).select("doc_id", simhash.hex16(simhash.F.col("fp")).alias("h"), "component_id").collect()
    label = brute_components({brute_fingerprint(t) for _, t, *_ in data})
    least = {}
    for i, t, *_ in data:
        k = label[brute_fingerprint(t)]
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = sorted((repr(i), f"{brute_fingerprint(t):016x}", repr(least.get(label[brute_fingerprint(t)]))) for i, t, *_ in data)
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in got) == want
    stay = simhash.keep_first(df)
    assert stay.columns == df.columns
    marks = [label[brute_fingerprint(r["text"])] for r in stay.collect()]
    assert sorted(marks) == sorted(set(label.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
