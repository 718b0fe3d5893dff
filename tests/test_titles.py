"""Names, markers, passages and distances on small tables of expected values and against brute force."""

import random
import unicodedata

from pyspark.sql import functions as F

from veriloom.functions import python as P
from veriloom.functions import text as X
from veriloom.functions import titles as N
from veriloom.operators import chunking, compare, evidence


def test_markers_in_any_script(spark):
    cited = {"Ayat (1)": ["1"], "第十一条（一）": ["1"], "2) a.": ["2", "a"], "see below": [], "11.1": [], "(๑)": ["1"], "( 二十三 )（០៥)": ["23", "5"]}
    got = spark.createDataFrame([(k,) for k in cited], "t string").select("t", X.cited_markers(F.col("t")).alias("m")).collect()
    assert {r["t"]: r["m"] for r in got} == cited
    text = "Scope\n(a) first\n 2) second\n三、third\nends with Pribadi. (B)\n4． fourth"
    assert sorted(spark.createDataFrame([(text,)], "t string").select(X.present_markers(F.col("t")).alias("m")).first()["m"]) == ["2", "3", "4", "B", "a"]
    numerals = spark.createDataFrame([(k,) for k in ["十", "十二", "九十九", "一十", "百", "iv", "007"]], "t string").select(X.marker_key(F.col("t")).alias("k")).collect()
    assert [r["k"] for r in numerals] == ["10", "12", "99", "10", "百", "iv", "7"]


def test_verification_uses_them(spark):
    rows = [("a long enough quote", "x a long enough quote\n（一）y", "(1)"), ("a long enough quote", "a long enough quote", "(2)"), ("a long enough quote", "a long enough quote", "??"), ("short", "short", None)]
    got = spark.createDataFrame(rows, "q string, c string, s string").select(evidence.verify_failures(F.col("q"), F.col("c"), F.col("s")).alias("f")).collect()
    assert [r["f"] for r in got] == [[], ["marker not in chunk"], ["subsection unparseable"], ["quote too short"]]


def test_composed_text_is_nfc():
    r = random.Random(2)
    letters = "aé́ুোোொொᄀ각각가 ñö̈"
    for _ in range(500):
        t = "".join(r.choice(letters) for _ in range(r.randrange(12)))
        got = P.compose(t)
        assert got["text"] == unicodedata.normalize("NFC", t) and len(got["old"]) == len(got["text"])


def brute_rate(a, b):
    a, b = " ".join(a.split()), " ".join(b.split())
    rows = [[0] * (len(b) + 1)] + [[i] + [0] * len(b) for i in range(1, len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return min(rows[-1]) / len(a) if a else 0.0


def test_error_rate_is_the_least_distance():
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choice("ab \n😀") for _ in range(r.randrange(14))) for _ in range(2))
        assert P.error_rate(a, b) == brute_rate(a, b)
    assert P.error_rate("a b c", "x a b\nc y") == 0


def brute_passages(t, size):
    """Every end within half a passage, by its kind."""
    starts = [0] if t else []
    while starts and len(t) - starts[-1] > size * 3 // 2:
        at = starts[-1]
        ends = range(at + size // 2 + 1, at + size * 3 // 2 + 1)
        lines = [e for e in ends if t[e - 1] == "\n"]
        kinds = [[e for e in lines if t[e : e + 1] == "\n"], [e for e in lines if t[: e - 1].rstrip()[-1:] in set(".。;；:!?।")], lines, [e for e in ends if t[e - 1] == " "]]
        best = next((k for k in kinds if k), [at + size])
        starts.append(min(best, key=lambda e: (abs(e - at - size), e)))
    return starts


def test_passages_end_at_breaks(spark):
    r = random.Random(4)
    texts = ["", "x" * 3500, "short"] + ["".join(r.choice(["word", "w", " ", " ", "\n", ".\n", "\n\n", "。"]) for _ in range(r.randrange(2000))) for _ in range(60)]
    for t in texts:
        assert P.passage_starts(t, 100) == brute_passages(t, 100)
    rows = chunking.chunks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, text string"), "doc", "text", 100).collect()
    got = {}
    for c in sorted(rows, key=lambda c: c["chunk"]):
        got.setdefault(c["doc"], []).append((c["label"], c["char_start"]))
    assert got == {i: [(f"Passage {k}", s) for k, s in enumerate(brute_passages(t, 100), 1)] for i, t in enumerate(texts) if t}


def test_keys_of_a_title():
    assert P.law_keys("Personal Data Act B.E.2562 (พระราชบัญญัติ พ.ศ. 2562)") == ["personal data act b e 2562", "พระราชบัญญัติ พ ศ 2562"]
    assert P.law_keys("Cyber Law 《网络安全法》 “Act”") == ["cyber law 网络安全法 act", "网络安全法"] and P.law_keys("()") == []
    assert P.parenthesised("a (b (c) d) e) (f") == ["b (c) d"]


def test_scope_and_windows(spark):
    df = spark.createDataFrame([("Application of this Act", None, "q"), ("Application for a licence", None, "q"), ("s. 1", "Purpose", None), ("s. 2", None, "This Act applies to all")], "s string, b string, q string")
    assert [r["x"] for r in df.select(N.is_scope(F.col("s"), F.col("b"), F.col("q")).alias("x")).collect()] == [True, False, True, True]
    r = random.Random(5)
    runs = [(i, r.choice("xy"), r.choice("abc"), s, s + r.randrange(1, 60), r.choice(["completed", "failed"])) for i in range(120) for s in [r.randrange(500)]]
    df = spark.createDataFrame(runs, "run int, e string, g string, s long, t long, status string")
    w = compare.pass_windows(df, "e", "g", "run", "s", "t", "status")
    want = {a[0]: max((b[4] for b in runs if b[1] == a[1] and b[2] != a[2] and b[5] == "completed" and b[4] <= a[3]), default=None) for a in runs}
    assert {x["run"]: x["window_start"] for x in w.collect()} == want
    found = df.select("e", F.col("run").alias("item"), F.col("s").alias("fs"), F.col("t").alias("ft"))
    got = {(x["run"], x["item"]) for x in compare.run_discoveries(w, found, "e", "run", "s", "item", "fs", "ft", width=50).collect()}
    assert got == {(a[0], b[0]) for a in runs for b in runs if a[1] == b[1] and (want[a[0]] is None or b[3] >= want[a[0]]) and b[4] <= a[3]}
