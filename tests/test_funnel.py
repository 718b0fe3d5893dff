"""Chunking and the mapping funnel on small frames."""

from pyspark.sql import functions as F

from veriloom.operators import chunking, mapping


def test_chunks_cover_and_follow_the_style(spark):
    body = "x" * 120
    texts = {
        "words": "Front\nSection 1. A\n" + body + "\nSection 2. B\n" + body + "\nSection 2A. C\nend",
        "dots": "\n".join(f"{i}. Title {i}\n{body}" for i in range(1, 6)),
        "listed": "\n".join(f"{i}. item" for i in range(1, 9)),  # ambiguous and too close
        "plain": "no headings at all\n" * 200,
        "falling": "Section 3. A\nSection 2. B\nSection 1. C",
    }
    rows = chunking.chunks(spark.createDataFrame(list(texts.items()), "doc string, text string"), "doc", "text").orderBy("doc", "chunk").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc"], []).append(r)
    for doc, text in texts.items():
        spans = [(r["char_start"], r["char_end"]) for r in by[doc]]
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert [r["label"] for r in by["words"]] == [None, "1", "2", "2A"] and by["words"][0]["kind"] == "front"
    assert [r["label"] for r in by["dots"]] == ["1", "2", "3", "4", "5"]
    assert all(r["label"] == f"Passage {k}" for d in ("listed", "plain", "falling") for k, r in enumerate(by[d], 1))


def test_number_order(spark):
    nums = ["3", "3A", "4", "4.1", "4.2A", "10"]
    df = spark.createDataFrame([(n,) for n in reversed(nums)], "n string")
    assert [r["n"] for r in df.orderBy(chunking.number_key(F.col("n"))).collect()] == nums


def test_scripted_lanes_and_budget(spark):
    line = "The controller must keep personal data inside the country."
    df = spark.createDataFrame([(1, "6.1", line), (2, "7.1", line), (3, "7.3", line), (4, "6.1", "short")], "id int, ind string, text string")
    got = {r["id"]: r for r in mapping.run(df, "ind", "text").collect()}
    assert (got[1]["status"], got[1]["quote"], got[1]["extraction_attempts"]) == ("passed", line, 1)
    assert got[2]["status"] == got[4]["status"] == "no_evidence" and got[2]["quote"] is None
    assert (got[3]["status"], got[3]["failures"], got[3]["extraction_attempts"]) == ("dropped", ["quote not found"], 3)


def test_later_attempt_may_pass(spark):
    df = spark.createDataFrame([(1, "6.1", "a long enough line of law to quote here")], "id int, ind string, text string")
    model = lambda i, p, n: F.when(n < 2, F.lit("nonsense")).otherwise(F.concat(F.lit('sure: ```json\n{"maps_to_indicator": true, "verbatim_quote": "'), p, F.lit('"}\n```')))
    got = mapping.run(df, "ind", "text", model).first()
    assert (got["status"], got["extraction_attempts"]) == ("passed", 2)


def test_strict_answers(spark):
    answers = ['{"maps_to_indicator": false}', '{"maps_to_indicator": true, "verbatim_quote": "q", "other": 1}', "[]", "text {\"maps_to_indicator\": true} text", '{"verbatim_quote": "q"}', "{broken"]
    df = spark.createDataFrame([(a,) for a in answers], "a string").select(mapping.parse(F.col("a")).alias("p"))
    assert [r["p"] is not None for r in df.collect()] == [True, False, False, True, False, False]
