"""Quality, host rules, tokens, chat, personal data and language: brute force, round trips, held-out accuracy, defined cases."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.llm import bpe, chat_format, host_rules, language_crf, pii, quality_classifier, queries
from veriloom.llm.vocabulary import byte_bpe_path, byte_bpe_pattern

ODD = [None, "", " \n\t ", "one", "a b c", " x y", "Ünï cödé \U0001f600 x", "x " * 30_000, "#*$%&|<> ok", "q\x1cw\x85e r"]


def odd_frame(spark):
    rows = [(i, t, "en" if i % 2 else None, "dup", "s" if i % 3 else None) for i, t in enumerate(ODD)] + [(None, "no id here", None, None, None), (4, "a b c", "en", "dup", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, source string")


def test_quality_held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_classifier.scored(docs, labels)
    rows = out.join(labels, "doc_id").collect()
    assert out.count() == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert held and np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.9
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("predicted = 1").count()


def test_quality_defined_cases(spark):
    docs = odd_frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.scored(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (None, 0), (7, None), (8, 0), (9, 1), (2, 0)], "doc_id long, quality int")
    rows = quality_classifier.scored(docs, some).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.scored(docs.limit(0), some).count() == 0


def test_quality_fit_is_the_least_loss():
    """The weights against plain gradient descent on the same pairs; the threshold against every other."""
    g = np.random.default_rng(5)
    x = g.normal(size=(300, quality_classifier.N_FEATURES))
    y = (x[:, 0] - 0.5 * x[:, 3] + g.normal(size=300) > 0).astype(int)
    model = quality_classifier.fit(x, y, pairs=2_000)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    draw = np.random.default_rng(5)
    gap = z[draw.choice(np.nonzero(y == 1)[0], 2_000)] - z[draw.choice(np.nonzero(y == 0)[0], 2_000)]
    w = np.zeros(x.shape[1])
    for _ in range(20_000):
        w += 0.3 * (gap.T @ (1 / (1 + np.exp(gap @ w))) / len(gap) - 1e-2 * w)
    assert np.allclose(w, model["w"], atol=1e-4)
    raw, good = z @ w, y == 1
    gain = lambda t: (raw[~good] < t).mean() - (raw[good] < t).mean()
    assert gain(model["cut"]) >= max(gain(t + 1e-9) for t in raw) - 1e-9


def test_repeated_ids_are_bounded(spark):
    same, other = [i for i in range(99) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(str(i).encode()) % 4 != 2][:2]
    docs = spark.range(30_000).select(F.lit(same).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(0).alias("quality"))
    docs = docs.unionByName(spark.createDataFrame([(other, "some good words", 1)], "doc_id long, text string, quality int"))
    labels = docs.select("doc_id", "quality", F.lit("x").alias("text"))
    assert quality_classifier.learn(docs, labels, most=100) is not None
    assert language_crf.learn(docs.withColumn("lang", F.when(F.col("doc_id") == other, "fr").otherwise("en")), most=100)["names"] == ["en", "fr"]


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    t = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in t if t.count(x) > 1} if len(t) < 500 else set(t)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(t) if x in many for k in range(3)}), len(lines)


def test_measures():
    r = random.Random(1)
    texts = [*ODD, "a b c a b c", "x y\nx y\n\n \nx y", "a a a a", "p q r s p q"] + [" ".join(r.choice("abcd") for _ in range(r.randrange(40))) + r.choice(["", "\n", "\v|"]) for _ in range(300)]
    for t in texts:
        assert host_rules.measure(t) == brute_measures(t), t
    words = [r.choice([b"a", b"b", b"c", b"d", b"e", b"f", b"g"]) for _ in range(500)]
    plain, host_rules.LONG = host_rules.repeated_words(words), 10
    try:
        assert host_rules.repeated_words(words) == plain
    finally:
        host_rules.LONG = 100_000


def test_hosts_are_judged_and_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, f"h{i % 5}") for i in range(500)] + [(1000 + i, bad if i % 10 else good, "mill") for i in range(200)] + [(2000, bad, "tiny"), (2001, good, "tiny"), (2002, bad, None), (2003, None, None), (None, good, "h0")]
    got = host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    kept = {(r["doc_id"]): r["kept"] for r in got}
    assert len(got) == len(rows) and all(kept[i] for i in range(500)) and not any(kept[1000 + i] for i in range(200))
    assert kept[2001] and not kept[2000] and not kept[2003] and kept[None]
    assert host_rules.judged(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_hosts_decide_on_documents_that_pass_the_base_rules(spark):
    """Symbol junk goes where its host has more of it than hosts usually have, and is forgiven elsewhere; clean documents stay."""
    good = " ".join(f"w{i}" for i in range(60))
    junk = good + " #$%&*|<>"
    rows = [(1000 * h + i, junk if i % 100 < (60 if h == 9 else 4) else good, f"h{h}") for h in range(10) for i in range(200)]
    got = {r["doc_id"]: r for r in host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    for i, t, h in rows:
        assert got[i]["kept"] == (t == good or h != "h9"), (i, h)
    odd = odd_frame(spark).withColumn("host", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    assert host_rules.judged(odd).count() == odd.count()


@pytest.fixture(scope="module")
def coder():
    return bpe.codec(byte_bpe_path(), byte_bpe_pattern())


def test_tokens_equal_the_library(coder):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=byte_bpe_pattern(), mergeable_ranks=coder.machine.ranks, special_tokens={})
    r, vocabulary = random.Random(2), list(coder.machine.ranks)
    texts = [t or "" for t in ODD] + ["<|endoftext|>", "ab" * 3000 + "the" * 3000, " " * 500, "\r\n\r\n  x"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x2000), r.randrange(0x4E00, 0x4F00), 0x1F600])) for _ in range(r.randrange(50))) for _ in range(400)]
    texts += [b"".join(r.choice(vocabulary) for _ in range(r.randrange(12))).decode("utf-8", "replace") for _ in range(400)]
    for t in texts:
        ids = coder.encode(t)
        assert bpe.ids_list(ids) == own.encode_ordinary(t) and coder.decode(ids) == t


def test_forgetting_changes_nothing(coder, monkeypatch):
    text = " ".join("".join(random.Random(i).choices("abcdefghijklmnop", k=9)) for i in range(400))
    want = coder.encode(text)
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    monkeypatch.setattr(bpe, "MAX_WORDS", 7)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 5)
    small = bpe.Codec(byte_bpe_path(), byte_bpe_pattern())
    assert small.encode(text) == want
    long = text.replace(" ", "")
    assert bpe.ids_list(small.encode(long)) == bpe.ids_list(coder.encode(long))


def test_stream_of_cut_characters():
    text = "aé€😀z" * 30
    raw = text.encode()
    for step in (1, 2, 3, 5, 7):
        s = bpe.Utf8Stream()
        assert "".join(s.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + s.end() == text
    s = bpe.Utf8Stream()
    assert s.feed(b"\xe2\x82") == "" and s.feed(b"(") == "�(" and s.feed(b"\xf0\x9f") == "" and s.end() == "�"


def test_tokenized_frame(spark):
    df = odd_frame(spark)
    rows = bpe.digests(bpe.tokenized(df, byte_bpe_path, byte_bpe_pattern())).collect()
    texts = {repr(r["doc_id"]): (r["text"] or "") for r in df.collect()}
    assert len(rows) == df.count()
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256(texts[repr(r["doc_id"])].encode()).hexdigest()
    assert [r for r in rows if r["doc_id"] == 1][0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    one = bpe.codec(byte_bpe_path(), byte_bpe_pattern()).encode("one")
    assert [r for r in rows if r["doc_id"] == 3][0]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(one) // 4}I", *bpe.ids_list(one))).hexdigest()


TRICKY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<", "<|", "a\n<|im_end|>\n", "", "|<|", "$1 \\1"]


def test_chat_layouts_and_round_trip(spark):
    records = ['{"messages":[{"role":"user","content":"%s"},{"role":"assistant","content":"yes"}]}' % "hi", '[{"role":"human","content":"a"},{"role":"gpt","content":"b"}]', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', '{"prompt":"a","response":"b"}', '{"prompt":"a","completion":null}', '{"instruction":"a","input":"","output":"b"}', '{"instruction":"a","input":"c","output":"b"}', '{"question":"a","answer":"b"}', '{"odd":1}', '{"messages":[]}']
    df = spark.createDataFrame(list(enumerate(records)), "key long, j string").select("key", F.parse_json("j").alias("record"))
    rows = {r["key"]: r for r in chat_format.formatted(df).select("key", "formatted", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.learned(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    told = {k: [(t["role"], t["text"]) for t in r["t"]] for k, r in rows.items()}
    ab = [("user", "a"), ("assistant", "b")]
    assert told == {0: [("user", "hi"), ("assistant", "yes")], 1: ab, 2: ab, 3: ab, 4: [("user", "a"), ("assistant", "")], 5: ab, 6: [("user", "a"), ("user", "c"), ("assistant", "b")], 7: ab, 8: [("unknown", '{"odd":1}')], 9: []}
    assert {k: r["l"] for k, r in rows.items()} == {0: "yes", 1: "b", 2: "b", 3: "b", 4: "", 5: "b", 6: "b", 7: "b", 8: "", 9: ""}


UNLISTED = {
    '{"messages":[{"role":"user","content":"hi","name":"x"},{"role":"assistant","content":"yes"}],"id":3}': ("extended", [("user", "hi"), ("assistant", "yes")]),
    '{"messages":[{"role":"user","content":5},{"role":"assistant","content":"x"}]}': ("known", [("user", "5"), ("assistant", "x")]),
    '{"messages":[{"role":"user","content":[{"text":"a","type":"t"}]}]}': ("extended", [("user", '[{"text":"a","type":"t"}]')]),
    '{"messages":[{"role":"user","content":"a"},{"role":"assistant","text":"kept"}]}': ("unknown", [("unknown", '{"messages":[{"content":"a","role":"user"},{"role":"assistant","text":"kept"}]}')]),
    '{"instruction":"a","input":"c","output":"b","tag":1}': ("extended", [("user", "a"), ("user", "c"), ("assistant", "b")]),
    '{"instruction":"a","output":"b","tag":1}': ("extended", [("user", "a"), ("assistant", "b")]),
    '"bare"': ("unknown", [("unknown", '"bare"')]),
    '{"messages":["a"]}': ("unknown", [("unknown", '{"messages":["a"]}')]),
}


def test_chat_keeps_the_text_of_unlisted_layouts(spark):
    df = spark.createDataFrame([(7, j, "clash") for j in UNLISTED], "key long, j string, formatted string").select("key", "formatted", F.parse_json("j").alias("record"))
    df = df.unionByName(df.limit(1).select("key", "formatted", F.lit(None).cast("variant").alias("record")))
    got = chat_format.formatted(df).select("verdict", "formatted", chat_format.read_back(F.col("formatted")).alias("t")).collect()
    told = sorted((r["verdict"], [(t["role"], t["text"]) for t in r["t"]]) for r in got)
    assert told == sorted([*UNLISTED.values(), ("unknown", [])])


def test_chat_records_that_share_a_key_stay_apart(spark):
    said = [f'{{"prompt":"{k}","response":"{k}{k}"}}' for k in "abab"]
    df = spark.createDataFrame([(1, j) for j in said], "key long, j string").select("key", F.parse_json("j").alias("record"))
    got = sorted([(t["role"], t["text"]) for t in r["t"]] for r in chat_format.formatted(df).select(chat_format.read_back(F.col("formatted")).alias("t")).collect())
    assert got == sorted([("user", k), ("assistant", k + k)] for k in "abab")


def test_chat_positions_of_many_turns(spark):
    r = random.Random(4)
    for n in (1, 2, 3, 4, 5, 15, 16, 17, 2000):
        rows = [(1, t, r.choice(["user", "assistant", "tool"]), "<|" * r.randrange(3) + "é" * r.randrange(9)) for t in range(n)]
        out = chat_format.formatted(chat_format.from_turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
        spans = [out["formatted"][s["start"] : s["start"] + s["length"]].replace("<\\|", "<|") for s in out["loss"]]
        assert spans == [x for _, _, role, x in rows if role == "assistant"]


def test_chat_turn_rows(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate(zip(["user", "assistant", "sys tem\n", None, "assistant", "user", "user", "assistant", "user"], TRICKY))] + [(2, 0, "assistant", None), (None, 0, "user", "lost"), (3, 1, "user", "tie b"), (3, 1, "user", "tie a"), (4, None, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.formatted(chat_format.from_turn_rows(df))
    got = {r["key"]: r for r in out.select("key", "formatted", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.learned(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["t"]] == [(r or "", x) for _, _, r, x in rows[: len(TRICKY)]]
    assert got[1]["l"] == "".join(x for _, _, r, x in rows[: len(TRICKY)] if r == "assistant")
    assert got[2]["l"] == "" and got[None]["t"][0]["text"] == "lost" and [t["text"] for t in got[3]["t"]] == ["tie a", "tie b"] and len(got[4]["l"]) == 100_000
    assert chat_format.formatted(chat_format.from_turn_rows(df.limit(0))).count() == 0


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        out += [(m.start(), 2, m.end())] if 12 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans():
    r = random.Random(6)
    for _ in range(20_000):
        t = "".join(r.choice("1299.. @+-()abé") for _ in range(r.randrange(60)))
        assert pii.base_spans(t) == brute_spans(t)
    t = "mail a.b@c.de, 10.0.0.256 and 10.0.0.25, 4111 1111 1111 1111; +1 (555) 010-9999."
    assert pii.base_spans(t) == brute_spans(t) and len(pii.base_spans(t)) == 4
    for junk in ("9" * 200_000, "a" * 300_000 + "@", "1." * 100_000, "+1" * 100_000, "@" * 100_000):
        pii.scan(junk)


def test_patterns_find_unseen_identifiers(spark):
    r = random.Random(7)
    seeds = [(i, f"filler words {r.choice(['here', 'there'])} phone: +1 (555) {r.randrange(100, 999)}-{r.randrange(1000, 9999)} ext thanks") for i in range(40)]
    rows = [*seeds, (100, "say phone: 555-867-5309 ext now"), (101, "order 555-867-1111 shipped"), (102, None), (None, "no phone: at all"), (103, "phone: 555-867-5309 elsewhere")]
    got = {x["doc_id"]: x for x in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.written("base").alias("b"), pii.written("spans").alias("s")).collect()}
    assert got[100]["b"] == "" and got[100]["s"] == "phone:11:23" and got[101]["s"] == "" and got[102]["s"] == "" and got[None]["s"] == ""
    assert all(got[i]["b"] == got[i]["s"] != "" for i in range(40))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(empty).count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    g = np.random.default_rng(3)
    lengths, k = [1, 4, 3, 1], 3
    e, t = g.normal(size=(sum(lengths), k)), g.normal(size=(k, k))
    got, pairs = language_crf.forward_backward(e, t, language_crf.Sequences(lengths), pairs=True)
    at, moves = 0, np.zeros((k, k))
    for n in lengths:
        want, total = np.zeros((n, k)), 0.0
        inner = np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            p = np.exp(sum(e[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, y in enumerate(path):
                want[i, y] += p
            for a, b in zip(path, path[1:]):
                inner[a, b] += p
        assert np.allclose(got[at : at + n], want / total)
        moves += inner / total
        at += n
    assert np.allclose(pairs, moves)


def test_language_held_out_and_switches(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_crf.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    model = language_crf.learn(docs)
    mixed = language_crf.word_posteriors(model, "the of and with that from keit und der schheit nicht einpf")
    assert [x for _, x, _ in mixed[:4]] == ["en"] * 4 and [x for _, x, _ in mixed[-4:]] == ["de"] * 4


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the house and the tree of number {i}", "en") for i in range(3000)] + [(5000 + i, f"der baum und das haus nummer {i}", "de") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_crf.learn(df, most=40)
    assert model["names"] == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_crf.identified(df).collect()}
    assert all(got[i] == k for i, _, k in rows)


def test_language_defined_cases(spark):
    df = odd_frame(spark)
    rows = {repr((r["doc_id"])): r for r in language_crf.identified(df).collect()}
    assert rows["0"]["lang_pred"] == rows["1"]["lang_pred"] == rows["2"]["lang_pred"] == rows["8"]["lang_pred"].replace("en", "und") == "und" and rows["1"]["score"] == 0.0
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_crf.identified(bare).collect()} == {"und"}
    assert language_crf.identified(df.limit(0)).count() == 0


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(queries.queries())
