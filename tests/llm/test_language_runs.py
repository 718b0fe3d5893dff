"""Text without spaces is read to its end."""

import random

from veriloom.llm import language_crf


def test_runs_are_read_whole():
    r = random.Random(2)
    for t in ("x" * 41, "né" * 100, "語" * 95, "short words only", "a" * 40 + ".", "語" * 30, "ab " + "c" * 130 + " d"):
        got = language_crf.lines_of(t)[0]
        assert b"".join(got).decode().strip(".") == t.replace(" ", "").strip(".") and all(len(language_crf.core_of(w)) <= 40 for w in got)
    long = "".join(r.choice("abc") for _ in range(1000))
    assert len(language_crf.lines_of(long)[0]) == 25


def test_what_follows_the_fortieth_character_decides(spark):
    r = random.Random(5)
    run = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    rows = [(i, "\n".join(run(x, 200) for _ in range(3)), n) for i in range(60) for x, n in [(("abcde", "aa"), ("vwxyz", "bb"))[i % 2]]]
    model = language_crf.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    head = run("abcde", 40)
    got = language_crf.label_batch(language_crf._Emissions(model), [head + run("vwxyz", 400), head + run("abcde", 400)])
    assert [x[0] for x in got] == ["bb", "aa"]
