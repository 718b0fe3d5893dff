"""The pipeline's near stage against all pairs of exact similarities."""

import random

import corpus_pipeline

from veriloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string"


def brute_kept(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label))


def test_near_stage_drops_every_copy_of_similarity_four_fifths(spark):
    r = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randrange(20, 400))]
        for edits in (0, 0, 1, len(base) // 90, len(base) // 60, len(base) // 20):
            t = list(base)
            for at in r.sample(range(len(t)), edits):
                t[at] = r.choice(words)
            rows.append((n, "  ".join(t).upper() if n % 7 == 3 else " ".join(t), "en"))
            n += 1
    chain = [r.choice(words) for _ in range(300)]
    for k in range(8):  # each near to its neighbours only
        rows.append((n + k, " ".join(chain[8 * k : 8 * k + 230]), "en"))
    rows += [(5000, None, None), (5001, " \n", "en"), (5002, "one two", "en"), (5003, "One  two", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.near(spark, df, "")
    assert got.columns == df.columns
    assert sorted(x["doc_id"] for x in got.collect()) == brute_kept(rows)
    assert corpus_pipeline.near(spark, df.limit(0), "").count() == 0


def test_groups_of_many_blocks(spark, monkeypatch):
    """A passage that many texts share, and copies that are near to some of each other only, in blocks of a few members."""
    r = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    passage, base = [r.choice(words) for _ in range(60)], [r.choice(words) for _ in range(150)]
    rows = [(k, " ".join(passage + [r.choice(words) for _ in range(r.randrange(20, 60))])) for k in range(60)]
    for k in range(60):
        t = list(base)
        for at in r.sample(range(len(t)), r.choice([1, 2, 3, 5, 8])):
            t[at] = r.choice(words)
        rows.append((100 + k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    for block in (near_copies.BLOCK, 7):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        assert sorted(x["doc_id"] for x in near_copies.keep_first(df).collect()) == want


def test_near_stage_on_the_smallest_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, sf).collect()) == brute_kept(rows)


def test_rows_without_an_id(spark):
    rows = [(None, "no id"), (None, "no id"), (3, "some text here"), (3, "other text there"), (4, "some text here")]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((repr(r["doc_id"]), r["text"]) for r in got.collect()) == [("3", "other text there"), ("3", "some text here"), ("None", "no id")]
