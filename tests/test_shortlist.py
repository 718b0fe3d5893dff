"""The shortlist reads a text once; ranks come from ranges of packed scores."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pytest
from test_round_two import DOCS, ITEMS, QUERIES, ranking_tables, same_as_sql

from veriloom.functions import python as P
from veriloom.operators import retrieval as R

WORDS = ["the", "an", "s12", "s12(2)", "part3", "partiv", "cap88", "aa", "a-1", "b" * 31, "c" * 32, "d" * 33, "e" * 70, "xyz", "ab", "of"]


def odd_texts(r):
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    yield from (None, "", "a", "-" * 5000, "ab" * 4000, "x" * 1999 + "y-" * 1200, "x" * 3999 + " the an " + "c" * 32, "İ" * 1999 + "ab1 xyz " * 500)
    for _ in range(25):
        yield some("ab-1 xyzé", r.randrange(9000))
        yield some("ab-1 xyzéİΣK.\n", r.randrange(5000))
        yield " ".join(r.choice(WORDS) for _ in range(r.randrange(1500)))
        yield " ".join(r.choice([*WORDS, "section 12(2)", "S. 9", "part iv", "Cap. 88"]) for _ in range(r.randrange(1500)))


def test_a_reading_counts_what_each_window_holds():
    """Words on seams are cut as each window cuts them; references and letters that grow in lower case fall back to windows."""
    texts, terms = list(odd_texts(random.Random(3))), P.Postings([(k % 5, w) for k, w in enumerate(WORDS)])
    rows, sizes = [], []
    for text in texts:
        for piece in P.pieces(text):
            told = P.tally(piece)
            rows += sorted((len(sizes), terms.vocabulary[w], n) for w, n in told.items() if w in terms.vocabulary)
            sizes.append(told.total())
    n, size, *met = terms.read(texts)
    assert n.tolist() == [len(P.pieces(t)) for t in texts] and size.tolist() == sizes
    assert list(zip(*(x.tolist() for x in met))) == rows
    assert [x.tolist() for x in P.unpack(P.pack(n, size, *met))] == [x.tolist() for x in (n, size, *met)]


def test_a_reading_finds_the_phrases_of_each_window():
    phrases = P.Postings([(0, "ab"), (1, "b a"), (0, "σ"), (0, "ς"), (2, "a" * 5), (1, "x" * 4001), (1, "x" * 4000), (1, "é1")])
    reader, texts = P.Reader(P.Postings([]), phrases), [*odd_texts(random.Random(4)), "x" * 8100, "aΣ bΣ" * 900]
    want = sorted({(d, w, k) for d, t in enumerate(texts) for w, piece in enumerate(P.pieces(t)) for k, x in enumerate(reader.names) if x in piece})
    assert [tuple(x) for x in reader.met(texts).tolist()] == want and want


def test_ranges_give_the_ranks_of_joins(spark, monkeypatch):
    """A few scores a range, from several tasks, with copies that tie."""
    r = random.Random(6)
    docs = [(k, " ".join(r.choice("data act transfer consent rules records kept part other words".split()) for _ in range(r.randrange(1200)))) for k in range(150)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(docs + [(k + 500, t) for k, t in docs[:60]], 5), "doc_id long, text string")
    terms = R.query_terms(spark.createDataFrame(ITEMS, "item_id long, text string"), "item_id", "text")
    told = lambda: sorted((r["doc_id"], round(r["lexical"], 9)) for r in R.best_ranks(docs, "doc_id", "text", terms, "item_id").collect())
    monkeypatch.setattr(P.Scorer, "RANGE", 40)
    got = told()
    monkeypatch.setattr(R, "QUERIES", 2)
    assert got == told() and len(got) > 200


@pytest.mark.parametrize("name", ["shortlist_composite", "phrase_cooccurrence"])
def test_texts_are_read_once(spark, tmp_path, name):
    """What is left to do reads no text."""
    ranking_tables(spark, tmp_path)
    assert same_as_sql(spark, name, tmp_path)
    assert "text:string" not in QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_tables_without_words(spark):
    """No document, no term, no phrase."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    terms = R.query_terms(spark.createDataFrame(ITEMS, "item_id long, text string"), "item_id", "text")
    pairs = spark.createDataFrame([(0, "data act")], "item_id long, phrase string")
    told = lambda d, t, p: [df.count() for df in R.text_tiers(d, "doc_id", "text", t, "item_id", p, "item_id", "phrase")]
    assert told(docs.limit(0), terms, pairs) == [0, 0]
    assert told(docs, terms.limit(0), pairs) == [0, 3]
    lexical, phrase = told(docs, terms, pairs.limit(0))
    assert lexical > 50 and phrase == 0


@pytest.mark.parametrize("name", ["shortlist_precision", "shortlist_recall"])
def test_reports_are_told_once(spark, tmp_path, name):
    """What a report reads twice is its hundred rows, not the shortlist."""
    ranking_tables(spark, tmp_path)
    assert same_as_sql(spark, name, tmp_path)
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "text:string" not in plan
