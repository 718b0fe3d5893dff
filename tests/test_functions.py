"""Functions and operators on small hand-made frames."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from veriloom.functions import python as P
from veriloom.functions import text as X
from veriloom.operators import compare, evidence, retrieval, spans, tables
from veriloom.sources import readers


def one(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], list(cells)) if cells else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    got = one(spark, X.legal_tokens(F.col("t")), t="Section 45(2) of the Data Act, Part IVA and Cap. 88; s 12a shall apply to e-mail")
    assert got == ["s45(2)", "partiva", "cap88", "s12a", "data", "act", "shall", "apply", "e-mail"]


@pytest.mark.parametrize(
    "url,key",
    [("https://www.Law.gov/a/b/", "law.gov/a/b"), ("http://x.org", ""), ("http://x.org/?id=2", "x.org?id=2"), ("https://x.org/#/public/doc/7", "x.org#/public/doc/7"), ("https://x.org/p#top", "x.org/p"), (None, "")],
)
def test_urls(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(X.norm_url(F.col("u"))).first()[0] == key


def test_names_and_ranks(spark):
    df = spark.createDataFrame([("Data Protection (Amendment) Act 2012",), ("Code of Practice under the Act",), ("Notice 5",), ("Rules of 1999",), ("Schedule",)], "n string")
    assert [r[0] for r in df.select(X.instrument_rank(F.col("n"))).collect()] == [0, 3, 2, 1, 4]
    assert df.select(X.norm_law(F.col("n"))).first()[0] == "data protection act 2012"
    assert one(spark, X.last_amended_year(F.lit("in 1999, then June 2026"))) == "2026"
    assert one(spark, X.instrument_ident(F.lit("ID"), F.lit("Law No.27 on Personal Data Protection 2022"))) == "uu:27:2022"
    assert one(spark, X.instrument_ident(F.lit("SG"), F.lit("Law No.27 of 2022"))) is None


def test_citations(spark):
    key = lambda s: one(spark, X.citation_key(F.lit(s), F.lit(s)))
    assert key("Section 26(1)") == key("s. 26 (1)") == "26(1)" and key("s. 26") == "26" and key("Schedule") == "schedule"
    assert one(spark, X.provision_number(F.lit("第二十六条"))) == "二十六"


def test_languages(spark):
    ask = lambda t: (one(spark, X.script_language(F.lit(t))), one(spark, X.looks_non_english(F.lit(t))))
    assert ask("ການປົກປ້ອງຂໍ້ມູນສ່ວນບຸກຄົນ") == ("lo", True) and ask("个人信息保护法第十一条第一款规定") == ("zh", True)
    assert ask("this is a sentence in the English language") == ("und", False)
    assert ask("data peribadi hendaklah tidak dipindahkan ke luar negara tanpa kebenaran menteri") == ("und", True)
    assert ask("digital audio, digital video, cell phones, digital fax machines, more things here, yes") == ("und", False)
    assert one(spark, X.non_latin_share(F.lit("abc где"))) == 0.5


def test_traps(spark):
    none = F.lit(None).cast("string")
    ask = lambda law, quote, ind, repeal=None: one(spark, F.size(X.trap_flags(F.lit(law), F.lit(quote), F.lit(repeal).cast("string"), none, F.lit("Elucidation of Article 5"), F.lit(ind))))
    assert ask("Draft Bill", "kept for five years", "7.3") == 2
    assert ask("Data Act", "shall not transfer unless approved", "6.1") == 2
    assert ask("Data Act", "data subject to be told", "6.1") == 1
    assert ask("Data Act", "x", "7.1", "repealed in 2010") == 2 and ask("Data Act", "x", "7.1", "not been repealed") == 1
    assert ask("Act (Amendment) 2010", "keep it", "7.3") == 3


def test_windows(spark):
    got = lambda n, w, m: [(r["start"], r["end"]) for r in one(spark, X.char_windows(F.lit(n), w, m))]
    assert got(0, 10, 4) == [] and got(7, 10, 4) == [(0, 7)] and got(25, 10, 4) == [(0, 10), (10, 20), (20, 25)]
    assert got(1000, 10, 4) == [(s, s + 10) for s in (0, 330, 660, 990)]


def test_pages_of_html(spark):
    html = "<html><head><title> A \n b </title><script>x<1</script></head><body><p>one &amp; two</p><style>p{}</style><div>three</div></body></html>"
    assert P.page_text(html).split() == ["A", "b", "one", "&", "two", "three"]
    assert one(spark, X.html_text(F.lit(html))).split() == ["A", "b", "one", "&", "two", "three"]
    assert one(spark, X.html_title(F.lit(html))) == "A b"


def test_unicode_and_numbers():
    text = "éä 각 x"
    got = P.compose(text)
    assert got["text"] == unicodedata.normalize("NFC", text) and len(got["old"]) == len(got["text"])
    assert all(unicodedata.normalize("NFC", text[o]) [0:1] for o in got["old"])
    assert [P.chinese_number(x) for x in ("二十六", "一百零五", "十", "三千二百", "二〇二一", "12", "x")] == [26, 105, 10, 3200, 2021, 12, None]
    assert [P.marker_key(x) for x in ("一", "๑", "１", "1", "a", "A")] == ["1", "1", "1", "1", "a", "A"]
    assert P.law_key("STRASSE (x) Gesetz, №5") == P.law_key("straße gesetz no5")
    assert P.error_rate("abcd", "xxabcdxx") == 0 and P.error_rate("abcd", "abxd") == 0.25 and P.error_rate("", "q") == 0


def test_as_of(spark):
    starts = spark.createDataFrame([("d", 0, 1), ("d", 50, 2), ("d", 101, 3), ("e", 10, 7)], "k string, s int, page int")
    points = spark.createDataFrame([("d", 0), ("d", 49), ("d", 50), ("d", 500), ("e", 3), ("f", 1)], "k string, pos int")
    got = {(r["k"], r["pos"]): r["page"] for r in spans.as_of(points, starts, "k", "pos", "s", "page").collect()}
    assert got == {("d", 0): 1, ("d", 49): 1, ("d", 50): 2, ("d", 500): 3, ("e", 3): 7, ("f", 1): None}
    strict = {(r["k"], r["pos"]): r["page"] for r in spans.as_of(points, starts, "k", "pos", "s", "page", first=False).collect()}
    assert strict["e", 3] is None


def test_overlaps_over_cells(spark):
    a = [("d", i * 7, i * 7 + 5000 if i % 5 == 0 else i * 7 + 3) for i in range(60)]
    b = [("d", i * 11, i * 11 + 2500) for i in range(40)] + [("d", 5, 5)]
    got = spans.overlaps(spark.createDataFrame(a, "k string, l_start int, l_end int"), spark.createDataFrame(b, "k string, r_start int, r_end int"), "k", 100).collect()
    want = sorted((x[1], x[2], y[1], y[2]) for x in a for y in b if x[1] < y[2] and x[2] > y[1] and x[2] > x[1] and y[2] > y[1])
    assert sorted((r["l_start"], r["l_end"], r["r_start"], r["r_end"]) for r in got) == want


def test_quotes(spark):
    ask = lambda t, q: one(spark, spans.anchor_quote(F.lit(t), F.lit(q)))
    assert ask("a  (b)\nc d", "(b) c") == "(b)\nc" and ask("a b, a  b", "a   b") is None and ask("x", "y") is None and ask("a b", "a b") == "a b"
    at = one(spark, spans.locate_quote(F.lit("ab cd ab"), F.lit("ab"), F.lit(3), F.lit(8)))
    assert (at["start"], at["end"]) == (6, 8)
    fail = lambda q, c, s=None: one(spark, evidence.verify_failures(F.lit(q), F.lit(c), F.lit(s).cast("string")))
    long = "the data must stay here (a) always"
    assert fail(long, long) == [] and fail("short", long) == ["quote too short"] and fail(long + "!", long) == ["quote not found"]
    assert fail(long, long, "(a)") == [] and fail(long, long, "(b)") == ["marker not in chunk"] and fail(long, long, "para") == ["subsection unparseable"]


def test_containments_with_short_and_long_quotes(spark):
    texts = [(1, "one two three four five six seven"), (2, "eight two three four five nine"), (3, "xtwo three four fivey"), (4, None)]
    quotes = [(1, "two three four five"), (2, "wo"), (3, "four five six seven eight"), (4, "hree four five si")]
    got = spans.containments(spark.createDataFrame(quotes, "q long, quote string"), spark.createDataFrame(texts, "t long, text string"), "quote", "text").collect()
    assert sorted((r["q"], r["t"]) for r in got) == sorted((q, t) for q, w in quotes for t, x in texts if x and w in x)


def test_confidence(spark):
    ask = lambda c, n, i, a: one(spark, X.confidence(F.lit(c), F.lit(n), F.lit(i), F.lit(a)))
    assert ask(0.75, 240, 1, 1) == 1.0 and ask(0.35, 0, 5, 3) == pytest.approx(0.15 * 0.4 + 0.15 * 0.3, abs=0.006)


def test_gate_traps(spark):
    rows = [("d", i, "6.1", c, b) for i, (c, b) in enumerate([(0.45, 3.0), (0.449, 9.0), (0.9, 0.0), (None, 5.0), (0.6, 3.0)])]
    df = spark.createDataFrame(rows, "doc string, chunk int, ind string, cos double, bm double")
    outcome = lambda lane, top: {r["chunk"]: r["outcome"] for r in retrieval.gate(df, "doc", "chunk", "ind", "cos", "bm", F.lit(lane), top=top).collect()}
    two = outcome(True, 20)
    assert [k for k, v in two.items() if v == "passed"] and {k for k, v in two.items() if v == "passed"} == {0, 4} and len(two) == 5
    assert {k for k, v in outcome(False, 20).items() if v == "passed"} == {0, 2, 4}
    assert {k for k, v in outcome(False, 1).items() if v == "passed"} == {2}


def test_recall_and_precision(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 0), (3, "b", 1), (4, "c", 1)], "rank int, law string, rel int")
    assert retrieval.recall_at(df, "rank", F.col("law"), 1).first()[0] == pytest.approx(2 / 3)
    assert retrieval.precision_at(df, "rank", F.col("rel") == 1, 5).first()[0] == pytest.approx(2 / 3)
    none = df.limit(0)
    assert retrieval.recall_at(none, "rank", F.col("law"), 1).first()[0] is None and retrieval.precision_at(none, "rank", F.col("rel") == 1, 5).first()[0] is None


def test_queue_cap_and_collapse(spark):
    rows = [("A", "a1", None, False), ("A", "a2", 0.9, False), ("B", "b1", 0.2, True), ("B", "b2", 0.2, False)]
    df = spark.createDataFrame(rows, "eco string, id string, conf double, ctl boolean")
    assert [r["id"] for r in tables.review_queue(df.withColumn("run", F.lit(1)), "conf", "id", ["run"]).orderBy("place").collect()] == ["a1", "b1", "b2", "a2"]
    assert [r["id"] for r in evidence.round_robin(df, "eco", "conf", ["eco", "id"], 2).collect()] == ["a2", "b1"]
    kept = evidence.collapse(df, ["eco"], "ctl", "conf", "id").collect()
    assert {(r["id"], tuple(r["collapsed"])) for r in kept} == {("a2", ("a1",)), ("b1", ("b2",))}


def test_manifest_fold(spark):
    events = [("u", 1, "add", None), ("u", 2, "failed", None), ("u", 3, "add", None), ("v", 4, "fetched", "s"), ("u", 5, "fetched", "s"), ("u", 6, "failed", None), ("w", 7, "add", None), ("x", 8, "failed", None), ("x", 9, "reset", None)]
    got = {r["url"]: r for r in tables.manifest(spark.createDataFrame(events, "url string, seq long, kind string, sha256 string")).collect()}
    assert (got["u"]["status"], got["u"]["attempts"], got["u"]["sha256"], got["u"]["is_duplicate_of"]) == ("failed", 3, "s", "v")
    assert got["v"]["is_duplicate_of"] is None and got["w"]["status"] == "pending" and (got["x"]["status"], got["x"]["attempts"]) == ("pending", 1)


def test_replay_delays(spark):
    df = spark.createDataFrame([("r", 1, "2024-01-01T00:00:00Z"), ("r", 2, "2024-01-01T00:00:10+00:00"), ("r", 3, "2024-01-01T00:00:05Z"), ("r", 4, None), ("r", 5, "2024-01-01T01:00:00Z")], "run string, seq int, t string")
    df = df.withColumn("ts", X.normalise_timestamp(F.col("t")))
    assert [r["delay"] for r in tables.replay_delays(df, "run", "seq", "ts", 2.0, 4.0).orderBy("seq").collect()] == [0.0, 4.0, 0.0, 0.0, 0.0]


def test_staged_pairs_leave_nothing_out(spark):
    a = spark.createDataFrame([("g", "a1", "x"), ("g", "a2", "y"), ("h", "a3", "x")], "g string, id string, w string")
    b = spark.createDataFrame([("g", "b1", "y"), ("g", "b2", "z"), ("g", "b3", "z")], "g string, id string, w string")
    got = {(r["a_id"], r["b_id"], r["stage"]) for r in compare.staged_pairs(a, b, ["g"], [["w"], []], "id").collect()}
    assert got == {("a2", "b1", 1), ("a1", "b2", 2), ("a3", None, 0), (None, "b3", 0)}


def test_event_log_and_csv(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps({"run_id": "r", "seq": i, "ts": "t", "type": "stage"}) for i in range(3)) + "\nbroken{")
    assert readers.event_log(spark, str(tmp_path / "log.jsonl")).count() == 3
    df = spark.createDataFrame([(2, ["a", "b"], 'q"x'), (1, [], "l\nm")], "id int, words array<string>, t string")
    readers.write_csv(df, str(tmp_path / "out"), ["id"])
    back = readers.csv(spark, str(tmp_path / "out"), "id int, words string, t string").collect()
    assert {(r["id"], r["t"]) for r in back} == {(2, 'q"x'), (1, "l\nm")} and {r["words"] for r in back if r["id"] == 2} == {"a; b"}
    (tmp_path / "f.pdf").write_bytes(b"junk %PDF-1.4 x")
    assert readers.raw_files(spark, str(tmp_path / "f.pdf")).first()["format"] == "pdf"


def test_partition_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "run string, v int")
    tables.overwrite_partitions(df, str(tmp_path / "t"), ["run"])
    tables.overwrite_partitions(df.where("run = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "t"), ["run"])
    assert {(r["run"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}
