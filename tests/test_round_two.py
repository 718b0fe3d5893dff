"""Cases that the smallest tables don't hold: against the same SQL on tables made for them."""

import random
import sys
from datetime import datetime, timedelta
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import duckdb
from oracle import plain

from veriloom.llm import near_copies
from veriloom.llm.components import components
from veriloom.operators import compare as C
from veriloom.operators import retrieval as R
from veriloom.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def same_as_sql(spark, name, folder):
    """Writes nothing: the tables are the folder's Parquet files. The rows of the query, after they were compared."""
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from read_parquet('{path}/*.parquet')")
    columns = sorted(con.sql(SQL[name]).columns)
    named = ", ".join(f'"{c}"' for c in columns)
    want = sorted(repr(tuple(plain(x) for x in r)) for r in con.sql(f"select {named} from ({SQL[name]})").fetchall())
    rows = QUERIES[name](spark, str(folder)).collect()
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows) == want
    return rows


def test_year_of_a_name_with_two(spark, tmp_path):
    rows = [(651, 2093, "F", 1.0, datetime(1995, 1, 1), "1-URGENT"), (1695, 1920, "O", 2.0, datetime(1995, 1, 2), "5-LOW"), (6, 77, "O", 3.0, datetime(1995, 1, 3), "5-LOW")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: r["year"] for r in same_as_sql(spark, "citation_keys", tmp_path)}
    assert got == {651: "2013", 1695: "1990", 6: "2007"}


DOCS = [
    (0, "Section 12(2) of the Data Act, s. 7(1) and Part IVA apply; Cap. 88 too", "en", "a"),
    (1, None, "en", "a"),
    (2, "", "en", "b"),
    (3, "data data act apply " * 400, "en", "b"),
    (4, "data data act apply " * 400, "en", "b"),
    (5, "nothing asked here, SECTION 9(3) aside", "en", "a"),
    (6, "short words of the act", "en", None),
    *[(k, "transfer " * (k % 7) + "consent " * (k % 5) + "records kept under part 3 " * (k % 3), "en", "c") for k in range(7, 60)],
]
ITEMS = [(0, "data act transfer consent rules"), (1, "section 12(2) and part iva"), (2, "records kept under part 3 of the act"), (3, "wholly absent vocabulary")]


def ranking_tables(spark, folder):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame([(k, [float((k * j) % 7 - 3) for j in range(64)], k % 3) for k in range(6)], "vec_id long, embedding array<float>, label int").write.parquet(str(folder / "embeddings.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return docs


def test_rankings_of_odd_texts(spark, tmp_path):
    """A null text is a window without words, as in SQL; statutory references are terms; copies tie."""
    ranking_tables(spark, tmp_path)
    assert same_as_sql(spark, "bm25_scores", tmp_path)
    got = {r["doc_id"]: r["lexical"] for r in same_as_sql(spark, "bm25_best_window_rank", tmp_path)}
    assert got[3] == got[4] and not {1, 2} & set(got)


def test_windows_stay_in_their_task(spark):
    """Scores are told without a shuffle: neither windows nor their terms are written."""
    docs = spark.createDataFrame(spark.sparkContext.parallelize(DOCS, 8), "doc_id long, text string, lang string, source string")
    terms = R.query_terms(spark.createDataFrame(ITEMS, "item_id long, text string"), "item_id", "text")
    assert "Exchange" not in R.best_windows(docs, "doc_id", "text", terms, "item_id")._jdf.queryExecution().executedPlan().toString()


def test_scores_beyond_the_bounds(spark, monkeypatch):
    """Queries too many to be held go through joins, with the same rows."""
    docs = spark.createDataFrame([d for d in DOCS if d[1]], "doc_id long, text string, lang string, source string")
    terms = R.query_terms(spark.createDataFrame(ITEMS, "item_id long, text string"), "item_id", "text")
    told = lambda: [sorted(tuple(round(x, 8) for x in r) for r in df.collect()) for df in (R.best_windows(docs, "doc_id", "text", terms, "item_id"), R.best_ranks(docs, "doc_id", "text", terms, "item_id"))]
    want = told()
    monkeypatch.setattr(R, "QUERIES", 2)
    assert told() == want and want[0]


def test_windows_of_crowded_cells(spark, tmp_path):
    """Many runs within a day, and one engine alone in an economy, whose window has no start."""
    r = random.Random(5)
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=r.randrange(0, 200_000)), 6 * r.randrange(5) + r.choice([0, 0, 1]), "only" if k % 9 == 0 else r.choice(["a", "b", "c"]), r.choice([0.0, 5.0, 60.5]), "{}") for k in range(1500)]
    rows += [(2000 + k, datetime(2024, 1, 2) + timedelta(hours=k), 2, "alone", 10.0, "{}") for k in range(50)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert same_as_sql(spark, "pass_discoveries", tmp_path)


def test_windows_are_joined_with_what_they_may_hold(spark):
    """3,000 short windows in one cell: as many pairs as blocks hold, not nine million."""
    runs = spark.range(3000).selectExpr("id AS run", "'e' AS economy", "id * 100 AS started", "id * 100 - 150 AS window_start")
    found = spark.range(3000).selectExpr("'e' AS economy", "id AS item", "id * 100 AS fs", "id * 100 + 20 AS fe")
    df = C.run_discoveries(runs, found, "economy", "run", "started", "item", "fs", "fe")
    assert df.count() == 2999
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in plan


def test_near_stage_links_what_simhash_finds(spark):
    """Sets that share no group of minimal hashes, whose fingerprints lie three bits apart, or in a chain: op1's links make them a
    group, and the exact check decides: the fourth has a near fingerprint but another set."""
    whole = list(range(100))
    sets = {1: whole, 2: whole[:95], 3: whole[5:], 4: list(range(500, 600)), 5: whole[:90]}
    fps = {1: 0b111, 2: 0, 3: 0b111111, 4: 1, 5: -1}
    nodes = spark.createDataFrame([(k, [10 * k], bytes(96), fps[k]) for k in sets], "node long, bands array<long>, sketch binary, fp long")
    values = spark.createDataFrame([(k, v) for k, v in sets.items()], "node long, values array<long>")
    got = components(near_copies.links(nodes, lambda some: values.join(some, "node"))).collect()
    assert {(r["node"], r["label"]) for r in got} == {(1, 1), (2, 1), (3, 1)}
