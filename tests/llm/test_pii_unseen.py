"""Contexts with more unseen identifiers than seeds, secrets, and the graph against plain Python."""

import math
import random

from veriloom.llm import pii


def spans(spark, rows):
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: r["s"] for r in got.select("doc_id", pii.written("spans").alias("s")).collect()}


def test_many_unseen_identifiers_do_not_hide_each_other(spark):
    seeds = [(i, f"say phone: +1 (555) 200-{1000 + i} ext thanks") for i in range(6)]
    got = spans(spark, seeds + [(100 + i, f"say phone: 555-867-{5000 + i} ext now") for i in range(60)])
    assert all(got[100 + i] == "phone:11:23" for i in range(60))


def test_one_strong_pattern_where_only_one_exists(spark):
    seeds = [(i, f"say phone: +1 (555) 200-{1000 + i}") for i in range(30)]
    unseen = [(100 + i, f"say phone: 555-867-{5000 + i}") for i in range(60)]
    got, few = spans(spark, seeds + unseen), spans(spark, seeds[:8] + unseen)
    assert all(got[100 + i] == "phone:11:23" and few[100 + i] == "" for i in range(60))


def test_candidates_that_contradict_a_pattern_count_against_it(spark):
    seeds = [(i, f"see ref: +1 (555) 200-{1000 + i} ext thanks") for i in range(6)]
    codes = [(100 + i, f"see ref: item-{5000 + i} ext now") for i in range(30)]
    got = spans(spark, seeds + codes + [(200, "see ref: 555-867-5309 ext now")])
    assert all(v == "" for k, v in got.items() if k >= 100)


def test_secrets_need_a_context(spark):
    r = random.Random(3)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'{r.choice(["la", "the", "und"])} {i} key = "{key()}" w{chr(97 + i % 26)} end') for i in range(30)]
    lone, odd = key(), "k3y-of-another-form"
    got = spans(spark, rows + [(200, f"commit {lone} of a tree"), (201, f'a key = "{odd}" here'), (202, f'key = "{rows[0][1][-52:]}')])
    assert all(got[i].startswith("secret:") for i in range(30)) and got[200] == "" and got[201] == "secret:9:28"


def brute(slots):
    """The graph's rounds in plain Python: slots (surface, rank, patterns)."""
    edges = {(s, k, p) for s, k, ps in slots for p in ps}
    known = {s for s, k, _ in edges if k is not None}
    free = {(s, p) for s, k, p in edges if k is None and s not in known}
    sought = {(s, p, None) for s, p in free} | {(s, p, 4) for s, k, p in edges if k == 4}
    of = {}
    for s, _, p in edges:
        of.setdefault(p, set()).add(s)
    seeds = {(s, k): 1.0 for s, k, _ in edges if k is not None}
    scores, accepted, before = seeds, {}, -1
    for _ in range(pii.ROUNDS):
        good = {}
        for p, members in of.items():
            n = len({s for s, _ in scores} & members)
            for k in range(5):
                mass = sum(v for (s, kk), v in scores.items() if kk == k and s in members)
                letters = {0: False, 4: None}.get(k, True)
                against = len({s for s, q in free if q == p and letters is not None and any("a" <= c <= "z" for c in s) == letters})
                if mass >= pii.LEAST_SEEDS and mass / (n + against + 1) >= pii.GOOD_PATTERN:
                    good[p, k] = mass / (n + against + 1)
        found = {}
        for s, p, must in sought:
            for k in range(5):
                if (p, k) in good and must in (None, k):
                    found.setdefault((s, k), []).append(good[p, k])
        told = {x: 1 - math.prod(1 - c for c in cs) for x, cs in found.items()}
        found = {x: told[x] for x, cs in found.items() if max(cs) >= pii.ACCEPT or len(cs) >= 2 and told[x] >= pii.ACCEPT}
        if len(found) in (before, 0):
            accepted = found or accepted
            break
        accepted, before = found, len(found)
        scores = seeds | {x: v for x, v in found.items() if x[0] not in known}
    best = {}
    for (s, k), v in accepted.items():
        best[s] = max(best.get(s, (-1.0, 0)), (round(v, 12), -k))
    return {s: -k for s, (_, k) in best.items()}


def test_graph_equals_plain_rounds(spark):
    r = random.Random(8)
    words = [[f"{side}:{w}{k}" for w in "ab"] for side in "LR" for k in range(6)]
    slots = []
    for n in range(1500):
        kind = r.choice([0, 1, 2, 3, 4, None, None])
        at = r.randrange(6) if kind is None or r.random() < 0.1 else kind
        surface = f"s{n % 1400}x" if kind in (0, 4) or r.random() < 0.2 else f"{n % 1400}"
        left, right = r.choice(words[at]), r.choice(words[6 + at]) if r.random() < 0.7 else f"R:rare{n}"
        slots.append((surface, kind, r.choice([[left], [left, right, f"{left} {right}"], [right], []])))
    df = spark.createDataFrame(slots, "surface string, rank int, patterns array<string>")
    got = pii.bootstrap(df)
    want = brute(slots)
    assert want and {x["surface"]: x["rank"] for x in got.collect()} == want


def test_contexts_are_whole_and_scans_linear(spark):
    far = "phone" + " " * 5000
    seeds = [(i, f"say {far}+1 (555) 200-{1000 + i} ext thanks") for i in range(6)]
    got = spans(spark, seeds + [(100, f"say {far}555-867-5309 ext now"), (100, f"say {far}555-867-5309 ext now"), (101, "9" * 300_000), (102, " ".join(["a1b2c3"] * 50_000))])
    assert got[100] == "phone:5009:5021"
    df = spark.createDataFrame([(1, "a.b@c.de", "x"), (1, "a.b@c.de", "x"), (None, None, None)], "doc_id long, text string, spans string")
    assert sorted(repr(r["doc_id"]) for r in pii.personal_data(df).collect()) == ["1", "1", "None"]
