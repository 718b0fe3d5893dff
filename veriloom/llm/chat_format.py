"""Chat formatting by schema fingerprints, in DataFrame and SQL functions alone.

A record of any layout is a VARIANT. Its nested field paths, without the types of their leaves, are hashed; the hash selects
one of the declarative LAYOUTS, and that mapping gives the canonical turns (role, content). A record whose hash is not known, but
which holds all fields that a layout reads, is "extended": the layout with most fields reads it, and its other fields are not
written. Any other record is "unknown": its whole JSON becomes the one turn of a role of that name, so nothing is lost unseen.
The verdict is a column. Turns are written as

    <|im_start|>role LF text <|im_end|> LF

where texts have one backslash put into every run "<", backslashes, "|" before the bar (taken out again on reading), and roles
are URL-encoded, so no text can forge a mark and every text comes back as it was. loss holds the spans (code points) of assistant texts.

All but the grouping of turn rows is done row by row, so records that share a key don't meet. Positions are prefix sums by
blocks of the square root of the turns, so a long conversation is not squared.

Defined cases: a null text is empty, a null role is the empty role; text that is a number, a list or an object is its JSON; a null
record, like one without turns, is formatted as the empty string; turns alike in number are ordered by role and text; repeated or
null keys of records are rows of their own; turn rows with one key, null too, are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Listed(NamedTuple):
    """Turns are a list at path, with a field for the role and one for the text."""

    shapes: tuple[str, ...]
    path: str
    role: str
    text: str


class Named(NamedTuple):
    """Turns are fields: (role, path) in their order; empty optional ones are skipped."""

    shapes: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    optional: tuple[str, ...] = ()


#: What each layout's fields mean. Shapes are as schema_of_variant writes them, without leaf types.
LAYOUTS: tuple[Listed | Named, ...] = (
    Listed(("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "OBJECT<messages: ARRAY>"), "$.messages", "role", "content"),
    Listed(("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "OBJECT<conversations: ARRAY>"), "$.conversations", "from", "value"),
    Listed(("ARRAY<OBJECT<content, role>>",), "$", "role", "content"),
    Named(("OBJECT<prompt, response>",), (("user", "$.prompt"), ("assistant", "$.response"))),
    Named(("OBJECT<completion, prompt>",), (("user", "$.prompt"), ("assistant", "$.completion"))),
    Named(("OBJECT<instruction, output>",), (("user", "$.instruction"), ("assistant", "$.output"))),
    Named(("OBJECT<input, instruction, output>",), (("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")), ("$.input",)),
    Named(("OBJECT<answer, question>",), (("user", "$.question"), ("assistant", "$.answer"))),
)
#: Other names of the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>\n"


def shape(record: Column) -> Column:
    """Nested field paths of a VARIANT: its schema without the types of the leaves; an empty list has no element."""
    leaf = r"(?:STRING|VOID|VARIANT|BIGINT|DOUBLE|FLOAT|BOOLEAN|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|UUID|DECIMAL\(\d+,\s*\d+\))(?=[,>])"
    filled = F.regexp_replace(F.schema_of_variant(record), "<VOID>", "")
    return F.regexp_replace(F.regexp_replace(filled, "<" + leaf, "<*"), ": " + leaf, "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape(record))


def _turns(layout: Listed | Named, record: Column) -> Column:
    if isinstance(layout, Listed):
        found = F.try_variant_get(record, layout.path, f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
        return F.transform(found, lambda t: F.struct(t[layout.role].alias("role"), t[layout.text].alias("text")))
    one = lambda role, path: F.struct(F.lit(role).alias("role"), F.try_variant_get(record, path, "string").alias("text"))
    whole = F.array(*[one(r, p) for r, p in layout.turns])
    if not layout.optional:
        return whole
    needed = F.array(*[F.lit(p not in layout.optional) for _, p in layout.turns])
    return F.filter(whole, lambda t, i: F.get(needed, i) | (F.coalesce(t["text"], F.lit("")) != ""))


def _holds(layout: Listed | Named, record: Column) -> Column:
    """Whether the record has every field that the layout reads, with a text of some kind in it."""
    if isinstance(layout, Listed):
        elements = F.try_variant_get(record, layout.path, "array<variant>")
        return F.forall(elements, lambda e: F.try_variant_get(e, f"$.{layout.text}", "string").isNotNull() & F.try_variant_get(e, f"$.{layout.role}", "string").isNotNull())
    return reduce(and_, [F.try_variant_get(record, path, "string").isNotNull() for _, path in layout.turns])


def selected(record: Column, layout: Column) -> Column:
    """Struct(verdict, turns array<struct<role,text>>) by the layout's fingerprint: known, extended or unknown."""
    told = lambda verdict, turns: F.struct(F.lit(verdict).alias("verdict"), turns.alias("turns"))
    whole = F.array(F.struct(F.lit(UNKNOWN).alias("role"), F.to_json(record).alias("text")))
    chosen = told(UNKNOWN, F.when(record.isNotNull(), whole))
    for k in sorted(LAYOUTS, key=lambda k: len(k.turns) if isinstance(k, Named) else 99):
        chosen = F.when(F.coalesce(_holds(k, record), F.lit(False)), told("extended", _turns(k, record))).otherwise(chosen)
    for k in LAYOUTS:
        chosen = F.when(layout.isin(*[F.xxhash64(F.lit(s)) for s in k.shapes]), told("known", _turns(k, record))).otherwise(chosen)
    return chosen


def turns(record: Column) -> Column:
    """Canonical turns of a record."""
    return selected(record, fingerprint(record))["turns"]


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(<\\*)\|", r"$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<\\*)\\\|", r"$1|")


def _role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(known[role], role, F.lit(""))


def formatted(records: DataFrame, key: str = "key", record: str = "record") -> DataFrame:
    """key, layout (its fingerprint), verdict, formatted, loss array<struct<start,length>> of each record."""
    flat = records.select(F.col(key).alias("key"), F.col(record).alias("record")).withColumn("layout", fingerprint(F.col("record")))
    flat = flat.withColumn("s", selected(F.col("record"), F.col("layout"))).select("key", "layout", "s.verdict", F.coalesce("s.turns", F.array().cast("array<struct<role:string,text:string>>")).alias("turns"))
    role = lambda t: _role(t["role"])
    head = lambda t: F.concat(F.lit(START), F.url_encode(role(t)), F.lit("\n"))
    flat = flat.withColumn("t", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (role(t) == "assistant").alias("learn")))).drop("turns")
    flat = flat.withColumn("sizes", F.transform("t", lambda t: (F.length(t["head"]) + F.length(t["body"]) + len(END)).cast("long")))
    flat = flat.withColumn("width", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("sizes"))).cast("int")))
    # the sum of each block of turns, then of the blocks before it, then of the turns before one in its block
    blocks = "transform(sequence(0, cast(size(sizes) / width as int)), j -> aggregate(slice(sizes, j * width + 1, width), 0L, (a, x) -> a + x))"
    flat = flat.withColumn("blocks", F.expr(blocks))
    flat = flat.withColumn("before", F.expr("transform(sequence(0, size(blocks) - 1), j -> aggregate(slice(blocks, 1, j), 0L, (a, x) -> a + x))"))
    inside = "aggregate(slice(sizes, cast(floor(i / width) * width as int) + 1, i % width), 0L, (a, x) -> a + x)"
    flat = flat.withColumn("laid", F.expr(f"transform(t, (x, i) -> struct(element_at(before, cast(floor(i / width) as int) + 1) + {inside} + length(x.head) as start, cast(length(x.body) as long) as length, x.learn as learn))"))
    text = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    loss = F.transform(F.filter("laid", lambda x: x["learn"]), lambda x: F.struct(x["start"], x["length"]))
    return flat.select("key", "layout", "verdict", text.alias("formatted"), loss.alias("loss"))


def read_back(text: Column) -> Column:
    """Turns array<struct<role,text>> of a formatted string."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")
    role = lambda p: F.url_decode(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), "\n", 1))
    body = lambda p: F.substring(p, F.locate("\n", p) + 1, F.length(p))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), unescape(body(p)).alias("text")))


def learned(text: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def from_turn_rows(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn to records (key, record) of the messages layout; a null key is a conversation of its own."""
    told = F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    listed = rows.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(told)).alias("all"))
    messages = F.transform("all", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    return listed.select("key", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))
