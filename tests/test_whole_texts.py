"""Queries without SQL on whole texts, against brute force."""

import unicodedata

from veriloom.functions.python import law_key
from veriloom.plans import catalogue


def brute_rate(a, b):
    best = [[0] * (len(b) + 1)] + [[i] + [0] * len(b) for i in range(1, len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i][j] = min(best[i - 1][j] + 1, best[i][j - 1] + 1, best[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return round(min(best[-1]) / len(a), 6)


def test_unicode_forms_keys_whole_texts(spark, tmp_path):
    rows = [(1, "Privacy Act (draft) " + "Ünïcode " * 30 + "END 2001", "s"), (2, "é short", "s"), (3, "x " * 39 + "(gone past the 80th character) tail", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n"], r["law_key"]) for r in catalogue.queries()["unicode_forms"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(unicodedata.normalize("NFC", t)), law_key(t)) for i, t, _ in rows}
    assert got[1][1].endswith("end 2001") and got[3][1].endswith("x tail")


def test_character_error_rate_compares_whole_passages(spark, tmp_path):
    same = "alpha beta gamma " * 8
    rows = [(1, same + "one ending here"), (2, same + "other words at the end"), (3, "short"), (4, same + "x" * 250)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: r["rate"] for r in catalogue.queries()["character_error_rate"](spark, str(tmp_path)).collect()}
    text = dict(rows)
    assert got == {i: brute_rate(text[i], text[i - 1]) for i in (2, 3, 4)} and got[2] > 0
