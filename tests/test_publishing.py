"""Portal rules and garbage tests on small frames."""

import pytest
from pyspark.sql import functions as F

from veriloom.operators import publishing


def test_robots(spark):
    files = [("a", "User-agent: *\nDisallow: /\n\nUser-agent: me\nUser-agent: other\nDisallow: /x # no\nAllow: /x/y\nDisallow:\n"), ("b", "User-agent: *\nDisallow: /p\nAllow: /p\n"), ("c", "<html>Disallow: /</html>")]
    rules = publishing.robots_rules(spark.createDataFrame(files, "host string, text string"), "host", "text", "Me")
    urls = [("a", "/x/1"), ("a", "/x/y/2"), ("a", "/z"), ("b", "/p/1"), ("c", "/any")]
    got = {(r["host"], r["path"]): r["allowed"] for r in publishing.robots_allowed(spark.createDataFrame(urls, "host string, path string"), rules, "host", "path").collect()}
    assert got == {("a", "/x/1"): False, ("a", "/x/y/2"): True, ("a", "/z"): True, ("b", "/p/1"): True, ("c", "/any"): True}


@pytest.mark.parametrize(
    "text,reason",
    [("a" * 100, None), ("word " * 100, None), ("(cid:12)" * 60 + "x" * 50, "unmapped glyphs"), ("1234 - " * 80, "few letters"), ("watermark line\n" * 250, "watermark"), ("header line\n" * 150, None)],
)
def test_garbage(spark, text, reason):
    assert spark.createDataFrame([(text,)], "t string").select(publishing.garbage_reason(F.col("t"), F.lit(3))).first()[0] == reason
