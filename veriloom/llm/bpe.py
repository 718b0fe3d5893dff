"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

Of every prefix of a word, the encoding ends in one token t; t is the one token that ends there, starts where some shorter
prefix ends, and may follow that prefix's last token (a pair may stand together if merging its bytes gives the pair again).
The nondeterministic transducer follows all starts that can still become a token: (trie node, token before, tokens since the
last one settled). A state of the deterministic one is the tuple of these; it is made when first met, kept with its steps, and
a step emits the tokens that all starts agree on, so lookahead is bounded by the longest token. States and the outputs of
whole words are kept up to a bound and then dropped, which changes memory, not results. A way out of a state is made a step
when it is asked for again; the first time, the rest of the word is followed in the nondeterministic machine.

Defined cases: a null text is the empty one (no tokens); repeated rows and nulls in other columns are of no account;
text of any length is read in pieces of PIECES matches; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from veriloom.llm.common import give_back, small_arrow_batches

MAX_STATES, MAX_PAIRS, MAX_WORDS, PIECES = 60_000, 300_000, 300_000, 65_536
#: The part of them that a lean codec keeps, for workers that share an executor with other stages' memory.
LEAN = 0.54
#: Bytes to the end of a word up to which a way met for the first time is followed without making states.
LONG_TAIL = 64


class Transducer:
    def __init__(self, ranks: dict[bytes, int], keep: float = 1.0):
        self.most_states, self.most_pairs = int(MAX_STATES * keep), int(MAX_PAIRS * keep)
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.below: list[dict[int, int] | None] = [{}]  # of each trie node, None for a leaf
        self.token_at: list[int] = [-1]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                if self.below[node] is None:
                    self.below[node] = {}
                nxt = self.below[node].get(b)
                if nxt is None:
                    nxt = self.below[node][b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.below.append(None)
                node = nxt
            self.token_at[node] = rank
        self.allowed: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((0, -1, ()),)
        self.ids, self.entries, self.ends = {start: 0}, [start], [()]
        self.steps: dict[int, tuple[int, tuple]] = {}
        self.once: set[int] = set()  # ways out of states asked for once

    def merge(self, word: bytes, least: int = 1) -> list[int]:
        """The merges by rank, one after another, until so many parts are left: the definition, used on the bytes of a token."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge; None for a byte, or for a token that its own merges don't give."""
        if token not in self.halves:
            found, two = None, self.merge(self.bytes_of[token], 2)
            if len(two) == 2 and self.merge(self.bytes_of[token]) == [token]:
                found = (two[0], two[1])
            self.halves[token] = found
        return self.halves[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a, b: no merge across the seam may come before the merges that made
        the pieces on its two sides. Walks back from the finished pair, undoing the later merge each time."""
        key = a << 32 | b
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) > self.most_pairs:
                self.allowed.clear()
            known = self.allowed[key] = self._stand(a, b)
        return known

    def _stand(self, a: int, b: int) -> bool:
        ranks, bytes_of, parts = self.ranks, self.bytes_of, self._parts
        limit = 1 << 60  # the seam must not merge before this rank is reached
        while True:
            joined = ranks.get(bytes_of[a] + bytes_of[b])
            if joined is not None and joined < limit:
                return False
            left, right = parts(a), parts(b)
            if left is not None and (right is None or a > b):
                limit, a = a, left[1]
            elif right is not None:
                limit, b = b + 1, right[0]
            else:
                return True

    def _whole(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self._parts(token) is not None

    def _determinise(self, state: int, byte: int) -> tuple[int, tuple]:
        alive, last, open_ended = [], None, False
        below, token_at, allowed = self.below, self.token_at, self.allowed
        for node, before, chain in self.entries[state]:
            nxt = below[node].get(byte)
            if nxt is None:
                continue
            if last is None and (token := token_at[nxt]) >= 0:
                if before < 0:
                    fits = self._whole(token)
                else:
                    fits = allowed.get(before << 32 | token)
                    if fits is None:
                        fits = self.may_follow(before, token)
                if fits:
                    last = (0, token, (*chain, token))
            if below[nxt] is not None:
                alive.append((nxt, before, chain))
                open_ended = open_ended or not chain
        alive.append(last)
        settled: tuple = ()
        if not open_ended:
            settled = last[2]
            for _, _, chain in alive:
                if chain[: len(settled)] != settled:
                    k = 0
                    while k < len(chain) and k < len(settled) and chain[k] == settled[k]:
                        k += 1
                    settled = settled[:k]
            if settled:
                k = len(settled)
                alive = [(n, t, c[k:]) for n, t, c in alive]
        key = tuple(alive)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.entries)
            self.entries.append(key)
            self.ends.append(key[-1][2])
        step = self.steps[state << 8 | byte] = (to, settled)
        return step

    def _follow(self, state: int, rest: bytes) -> list[int]:
        """The nondeterministic machine from a state to the end of a word, without making states: for ways met only once.
        A start is (trie node, token before, tokens since as a linked list)."""
        below, token_at, allowed = self.below, self.token_at, self.allowed
        starts = []
        for node, before, chain in self.entries[state]:
            link = None
            for token in chain:
                link = (link, token)
            starts.append((node, before, link))
        link = None
        for byte in rest:
            alive, fresh = [], None
            for node, before, link in starts:
                nxt = below[node].get(byte)
                if nxt is None:
                    continue
                if fresh is None and (token := token_at[nxt]) >= 0:
                    if before < 0:
                        fits = self._whole(token)
                    else:
                        fits = allowed.get(before << 32 | token)
                        if fits is None:
                            fits = self.may_follow(before, token)
                    if fits:
                        fresh = (0, token, (link, token))
                if below[nxt] is not None:
                    alive.append((nxt, before, link))
            alive.append(fresh)
            starts = alive
        out, link = [], starts[-1][2]
        while link is not None:
            link, token = link
            out.append(token)
        out.reverse()
        return out

    def encode(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self.entries) > self.most_states or len(self.once) > 4 * self.most_states:
            self._forget()
        out: list[int] = []
        state, steps, once = 0, self.steps, self.once
        for at, b in enumerate(word):
            way = state << 8 | b
            step = steps.get(way)
            if step is None:
                if way not in once and len(word) - at <= LONG_TAIL:
                    once.add(way)
                    out += self._follow(state, word[at:])
                    return out
                step = self._determinise(state, b)
            state, settled = step
            if settled:
                out += settled
            elif len(self.entries) > 8 * self.most_states:  # a word that alone makes too many: its state moves to a fresh machine
                key = self.entries[state]
                self._forget()
                steps, once = self.steps, self.once
                state = self.ids.setdefault(key, len(self.entries))
                if state == len(self.entries):
                    self.entries.append(key)
                    self.ends.append(key[-1][2])
        out += self.ends[state]
        return out


class _Words(dict):
    """Matches of the pattern to their ids as little-endian unsigned 32-bit integers, in two generations: when the young one
    is full it becomes the old one, and what was not asked for meanwhile is forgotten."""

    def __init__(self, machine: Transducer, keep: float = 1.0):
        super().__init__()
        self.machine, self.old, self.most = machine, {}, int(MAX_WORDS * keep)

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            ids = self.machine.encode(word.encode("utf-8"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


class Codec:
    def __init__(self, path: str, pattern: str, keep: float = 1.0):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.machine = Transducer(ranks, keep)
        self.words = _Words(self.machine, keep)
        self.pattern = regex.compile(pattern)
        self.vocabulary = [self.machine.bytes_of.get(i, b"") for i in range(max(self.machine.bytes_of) + 1)]

    def forget(self) -> None:
        """Drops what was kept, so that a worker that waits for other work holds the vocabulary alone."""
        self.words.clear()
        self.words.old = {}
        self.machine.allowed.clear()
        self.machine._forget()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) < 1 << 18:
            return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))
        found, parts = self.pattern.finditer(text), []
        while piece := [m.group() for m in islice(found, PIECES)]:
            parts.append(b"".join(map(self.words.__getitem__, piece)))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        stream, out = Utf8Stream(), []
        codes = np.frombuffer(ids, "<u4")
        for at in range(0, len(codes), PIECES):
            out.append(stream.feed(b"".join(map(self.vocabulary.__getitem__, codes[at : at + PIECES].tolist()))))
        out.append(stream.end())
        return "".join(out)


def _utf8_rules() -> list[list[int]]:
    """next[state][byte]: 0 between characters, 1 to 3 that many bytes to come, 4 to 7 after E0, ED, F0, F4, 8 wrong."""
    table = [[8] * 256 for _ in range(9)]
    spans = {0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)], 1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)], 4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)]}
    for state, rows in spans.items():
        for low, high, to in rows:
            table[state][low : high + 1] = [to] * (high + 1 - low)
    return table


class Utf8Stream:
    """Bytes in pieces to text in pieces: a character cut by the end of a piece waits for the next. Wrong bytes become U+FFFD."""

    NEXT = _utf8_rules()

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, piece: bytes) -> str:
        data = self.waiting + piece
        tail = len(data)
        for back in range(1, min(3, len(data)) + 1):  # the last lead byte decides whether a character is open
            if data[-back] >= 0xC0:
                state = 0
                for b in data[-back:]:
                    state = self.NEXT[state][b]
                if 0 < state < 8:
                    tail = len(data) - back
                break
            if data[-back] < 0x80:
                break
        self.waiting = data[tail:]
        return data[:tail].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, keep: float = 1.0) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern, keep)


def _resolved(path) -> str:
    return path() if callable(path) else path


def encode(path, pattern: str):
    """An Arrow function: text to the ids as little-endian unsigned 32-bit integers. path: a file's place, or what gives it on a worker."""

    @F.arrow_udf(BinaryType())
    def bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(_resolved(path), pattern)
        for batch in batches:
            yield pa.array([own.encode(t.as_py()) for t in batch], pa.binary())
        own.forget()
        give_back()

    return bpe_encode


def decode(path, pattern: str):
    """An Arrow function: such ids to the text."""

    @F.arrow_udf(StringType())
    def bpe_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(_resolved(path), pattern)
        for batch in batches:
            yield pa.array([own.decode(t.as_py() or b"") for t in batch], pa.string())

    return bpe_decode


def both_ways(path, pattern: str, keep: float = 1.0):
    """An Arrow function: text to struct(ids, decoded), decoded from the ids."""

    @F.arrow_udf(StructType([StructField("ids", BinaryType()), StructField("decoded", StringType())]))
    def bpe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(_resolved(path), pattern, keep)
        for batch in batches:
            ids = [own.encode(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())], ["ids", "decoded"])
        if keep < 1:  # a worker that keeps all its caches may go on with them in its next task
            own.forget()
            give_back()

    return bpe


def tokenized(docs: DataFrame, path, pattern: str, text: str = "text", doc_id: str = "doc_id", keep: float = 1.0) -> DataFrame:
    """doc_id, ids, decoded of every document. keep: the part of the bounded caches that a worker may fill; results are the same."""
    small_arrow_batches(docs.sparkSession, 256)
    return docs.select(F.col(doc_id).alias("doc_id"), both_ways(path, pattern, keep)(F.col(text)).alias("b")).select("doc_id", "b.ids", "b.decoded")


def ids_list(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what tokenized() gives."""
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
