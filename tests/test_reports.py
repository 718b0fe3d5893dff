"""Rules of reports that no test table reaches, on rows made for them."""

from pyspark.sql import functions as F

from veriloom.functions import reports as R
from veriloom.operators import review as V


def test_renderings_ship_under_their_label(spark):
    d = spark.createDataFrame([(1, ("a ", "L", " "), "x"), (2, ("a", "L", "Ann"), None), (3, (" ", "L", "Ann"), "x"), (4, None, "x"), (5, None, None)], "k int, g struct<english:string,label:string,reviewed_by:string>, c string")
    rows = {r.k: tuple(r.s) for r in d.select("k", R.shipped_english(F.col("g"), F.col("c"), "none").alias("s")).collect()}
    assert rows == {1: ("L a", None), 2: ("a", "Ann"), 3: ("none", None), 4: ("x", None), 5: ("", None)}


def test_scans_are_flagged(spark):
    d = spark.createDataFrame([(1, True, "why", 0.5, None), (2, True, None, 0.414, 0.66), (3, False, "why", 0.1, None), (4, None, None, None, None), (5, True, "", 0.9, None)], "k int, m boolean, r string, c double, h double")
    rows = {r.k: r.s for r in d.select("k", R.scan_flag(F.col("m"), F.col("r"), F.col("c"), F.col("h")).alias("s")).collect()}
    assert rows[1].startswith("Read by OCR with no reading model") and rows[3] is None and rows[4] is None
    assert rows[2] == "Read by OCR with 41% word confidence and 66% of words found in the dictionary" and rows[5] == "Read by OCR with 90% word confidence"


def test_small_rules(spark):
    d = spark.createDataFrame([(1, "s. 12(1)", "15", "December 2001"), (2, "Art. 9A", "6.1", "Scope"), (3, "Preamble", "x", "and so on."), (4, "s. 9", "12.3", "Fees, fines etc."), (5, "s. 100", "7", "0.2% by mass")], "k int, s string, i string, t string")
    assert [r.k for r in d.orderBy(R.section_order(F.col("s"))).collect()] == [4, 2, 1, 5, 3]
    assert [r.p for r in d.orderBy("k").select(V.pillar(F.col("i")).alias("p")).collect()] == [15, 6, None, 12, 7]
    assert [r.n for r in d.orderBy("k").select(R.is_bare_noise(F.col("t")).alias("n")).collect()] == [True, False, True, False, True]
    told = R.only_difference("A", "B", F.lit("6.1"), F.when(F.col("k") < 3, F.col("s")), F.when(F.col("k") == 2, "T"))
    assert [r.d for r in d.where("k < 4").orderBy("k").select(told.alias("d")).collect()] == [
        "Only Engine A cited this provision; for 6.1 Engine B cited s. 12(1)", "Only Engine A cited this provision; for 6.1 Engine B cited Art. 9A of T", "Only Engine A cited this provision; Engine B found no evidence for 6.1",
    ]


def test_ids_and_times(spark):
    d = spark.sql("SELECT timestamp'2024-05-06 07:08:09' AS t, '2024-05-06T00:00:00Z' AS a, '2024-05-06T12:00:01+00:00' AS b")
    row = d.select(R.run_id(F.lit("discovery"), F.col("t"), F.lit("x")).alias("i"), R.run_id(F.lit("other"), F.col("t"), F.lit("x")).alias("n"), R.fetched_before(F.col("a"), F.col("b")).alias("f"), R.fetched_before(F.col("b"), F.col("a")).alias("g"), R.fetched_before(F.lit("no"), F.col("a")).alias("h")).first()
    assert row.i == "disc_20240506T070809Z_2d7116" and row.n is None and (row.f, row.g, row.h) == (True, False, False)


def test_engine_of_record(spark):
    log = spark.createDataFrame([("r", 1, "engine:a"), ("r", 2, "engine:b"), ("r", 3, "other"), ("s", 4, "engine:gone"), ("t", 5, "none")], "run string, id int, method string")
    rows = {r.run: r.engine for r in V.engine_of_record(log, ["run"], "method", "id", ["a", "b"], "a").collect()}
    assert rows == {"r": "b", "s": "a", "t": "a"}
