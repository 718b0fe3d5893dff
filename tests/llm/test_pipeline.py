"""The pipeline's stages against brute force on the smallest tables."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import tiktoken
from pyspark.sql import functions as F
from test_dedup import normal
from test_near_copies import brute_kept

from veriloom.llm import bpe
from veriloom.llm.vocabulary import byte_bpe_path, byte_bpe_pattern


def test_stages_in_turn(spark, sf, tmp_path):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "tokens" or out.schema == docs.schema
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = [r.asDict() for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "tokens"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = {r["doc_id"] for r in seen["quality"]}
    assert sum(i in good for i, q in labels.items() if q == 1) >= 0.97 * sum(labels.values())
    assert sum(i in good for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())
    first = {}
    for r in sorted(seen["quality"], key=lambda r: r["doc_id"]):
        first.setdefault(normal(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in seen["exact"]) == sorted(first.values())
    assert sorted(r["doc_id"] for r in seen["near"]) == brute_kept([(r["doc_id"], r["text"]) for r in seen["exact"]])
    texts = {r["doc_id"]: r["text"] for r in seen["near"]}
    copies = Counter(r["doc_id"] for r in seen["mix"])
    assert set(copies) <= set(texts) and max(copies.values()) <= 3
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    total, taken = sum(size.values()), sum(size[i] * n for i, n in copies.items())
    assert abs(taken - total) < 0.2 * total
    own = tiktoken.Encoding("own", pat_str=byte_bpe_pattern(), mergeable_ranks=bpe.codec(byte_bpe_path(), byte_bpe_pattern()).machine.ranks, special_tokens={})
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in seen["tokens"]) == sorted((i, len(own.encode_ordinary(texts[i])), hashlib.sha256(texts[i].encode()).hexdigest()) for i in copies.elements())


def test_run_gives_the_rows_of_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls in any column, empty texts, repeated rows and ids, ties, further columns with clashing names, an empty table."""
    long = " ".join(f"word{k}" for k in range(20_000))
    rows = [(None, None, None, None, None, "r", 1), (1, "", "en", "a", 0, "r", 1), (2, None, "en", None, 0, None, 2), (3, long, "en", "a", len(long), "x", 3), (3, long, "en", "a", len(long), "x", 3)]
    rows += [(3, "other text of the same id " * 20, None, "b", 9, "y", 4), (None, "no id but words in it " * 20, None, "b", 9, "y", 4)]
    rows += [(10 + k, " ".join(f"w{j * (k // 2 + 1)}" for j in range(80)), "en", f"s{k % 3}", 400, "z", k) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, copies int")
    for label, docs in (("odd", df), ("none", df.limit(0))):
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "tokens" or out.columns == df.columns
            out.write.parquet(str(tmp_path / label / name))
            docs = spark.read.parquet(str(tmp_path / label / name))
            assert name in ("mix", "tokens") or docs.count() <= before
            before = docs.count()
            if name == "exact":
                texts = [normal(r["text"]) for r in docs.collect()]
                assert len(texts) == len(set(texts))
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (label == "odd") == (docs.count() > 0)
    again = corpus_pipeline.exact(spark, df.withColumn("rank", F.lit("clash")).withColumn("won", F.lit(None).cast("string")), sf)
    assert again.columns == [*df.columns, "rank", "won"]
