"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Merging by rank gives each byte string one token sequence, and a sequence is that one exactly if every two neighbours in it
are what merging gives for their joined bytes. So the tokenizer is a nondeterministic transducer: its state is the last
token and a place in the trie of tokens, and at each token's end it may emit and return to the root if the pair is allowed.
Here it is determinised as it is used: a step is built when it is first asked for, and every piece goes through such steps.
A state of the result is the set of live readings; what all of them agree on is emitted, which needs but a bounded
lookahead. States and steps are kept until there are too many, then built anew.

Words come up again and again, so an encoder also keeps the ids of recent pieces; only pieces that are not among them go
through the transducer. Long pieces aren't kept, so what a worker holds is bounded in bytes.

Decoding runs token by token through a state machine for UTF-8 that keeps the bytes of a character not yet complete.

Defined cases: a null text is an empty one and has no ids; very long texts are encoded whole, piece by piece.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import gc
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import documents, pieces_of, texts_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: How many states and pieces a Python worker keeps before it begins anew.
KEPT_STATES, KEPT_PIECES = 100_000, 500_000
#: Bytes of a piece after which the number of states is looked at again.
RUN = 512
#: Longer pieces (in characters) are encoded each time.
KEPT_LENGTH = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> tuple[int, ...]:
    """The definition: join the neighbours whose joined bytes have the lowest rank, leftmost first, as long as one is below the bound."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(ranks[p] for p in parts)


class Transducer:
    """Encodes pieces of bytes by the ranks of merges.

    A reading is (tokens not yet emitted, the emitted or pending token before the place, place in the trie). A state is its
    live readings, all with the same emitted past; equal sets of readings, however they came about, are one state. States
    are numbered in steps of 256, so that a state and a byte make the key of a step.
    """

    def __init__(self, ranks: dict[bytes, int], kept_states: int = KEPT_STATES):
        self.ranks, self.kept_states = ranks, kept_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # The trie: of each place, by byte, the token that ends there (or -1) and the place from where it goes on (or 0: it doesn't).
        # Tokens that merging never makes from their own bytes can't be emitted.
        self.trie: list[dict[int, tuple[int, int]]] = [{}]
        for token, rank in ranks.items():
            if merge(token, ranks) == (rank,):
                place = 0
                for byte in token[:-1]:
                    ends, on = self.trie[place].get(byte, (-1, 0))
                    if not on:
                        on = len(self.trie)
                        self.trie.append({})
                        self.trie[place][byte] = ends, on
                    place = on
                self.trie[place][token[-1]] = rank, self.trie[place].get(token[-1], (-1, 0))[1]
        self.allowed: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        #: Bytes of pieces encoded, steps built for them, and the most bytes ever read before a token was emitted.
        self.bytes_read = self.steps_built = self.lookahead = 0
        self.forget()

    def forget(self, state: int = 0) -> int:
        """Drop all states but the first and the one given; its new number."""
        first = (((), -1, 0),)
        now, ends = (self.readings[state], self.finals[state]) if state else (first, ())
        self.readings = {0: first}
        self.number = {first: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.finals: dict[int, tuple[int, ...] | None] = {0: ()}
        if len(self.allowed) > 8 * self.kept_states:
            self.allowed = {}
        if not state:
            return 0
        self.readings[256], self.number[now], self.finals[256] = now, 256, ends
        return 256

    def spine(self, token: int, right: bool) -> tuple[tuple[bytes, int], ...]:
        """The parts at one end of a token as it grows, from a byte to itself, each with the rank that ends it."""
        known = self.spines[right].get(token)
        if known is None:
            part, ends, grown = self.bytes_of[token], 1 << 60, []
            while True:
                grown.append((part, ends))
                if len(part) == 1:
                    break
                ends = self.ranks[part]
                halves = merge(part, self.ranks, ends)
                part = self.bytes_of[halves[1 if right else 0]]
            known = self.spines[right][token] = tuple(reversed(grown))
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b apart: no two parts that meet at their border while both grow join before either grows on."""
        if a < 0:
            return True
        known = self.allowed.get(a << 32 | b)
        if known is None:
            known, xs, ys, i, j = True, self.spine(a, True), self.spine(b, False), 0, 0
            while known:
                (x, x_ends), (y, y_ends) = xs[i], ys[j]
                rank = self.ranks.get(x + y, 1 << 61)
                known = not (rank < x_ends and rank <= y_ends)
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
                if i == len(xs) or j == len(ys):
                    break
            self.allowed[a << 32 | b] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Build the step of a state by a byte: the next state and what is emitted."""
        live, trie, allowed = [], self.trie, self.allowed.get
        for pending, last, place in self.readings[state]:
            found = trie[place].get(byte)
            if found is None:
                continue
            token, on = found
            if on:
                live.append((pending, last, on))
            if token >= 0:
                fits = last < 0 or allowed(last << 32 | token)
                if fits or fits is None and self.may_follow(last, token):
                    live.append(((*pending, token), token, 0))
        # What all readings agree on can be emitted.
        emitted = live[0][0] if live else ()
        for p, _, _ in live:
            if not emitted:
                break
            if p[: len(emitted)] != emitted:
                same = 0
                while same < len(p) and emitted[same] == p[same]:
                    same += 1
                emitted = emitted[:same]
        agreed = len(emitted)
        key = tuple([(p[agreed:], last, place) for p, last, place in live]) if agreed else tuple(live)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.number) << 8
            self.readings[to] = key
            ends = [p for p, _, place in key if place == 0]
            self.finals[to] = ends[0] if len(ends) == 1 else None
        self.steps_built += 1
        self.steps[state | byte] = step = to, emitted
        return step

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a piece, by steps of the determinised transducer; those not yet there are built."""
        if len(piece) > RUN:
            return self._long(piece)
        if len(self.number) > self.kept_states:
            self.forget()
        state, out, step_of = 0, (), self.steps.get
        for byte in piece:
            state, emitted = step_of(state | byte) or self._step(state, byte)
            if emitted:
                out += emitted
        self.bytes_read += len(piece)
        return out + self._rest(state, piece)

    def _rest(self, state: int, piece: bytes) -> tuple[int, ...]:
        rest = self.finals[state]
        if rest is None:
            raise ValueError(f"no single reading of {piece[:64]!r}: these ranks are no BPE")
        return rest

    def _long(self, piece: bytes) -> tuple[int, ...]:
        """The same for a piece of any length, in time that grows with it: tokens are gathered in a list, and states forgotten within the piece."""
        state, out = 0, []
        for at in range(0, len(piece), RUN):
            if len(self.number) > self.kept_states:
                state = self.forget(state)
            step_of = self.steps.get
            for byte in piece[at : at + RUN]:
                state, emitted = step_of(state | byte) or self._step(state, byte)
                if emitted:
                    out += emitted
        self.bytes_read += len(piece)
        return (*out, *self._rest(state, piece))

    def stream(self, piece: bytes) -> Iterator[tuple[int, ...]]:
        """The tokens that each byte lets out, and those that the end does."""
        state = waiting = 0
        for byte in piece:
            state, emitted = self.steps.get(state | byte) or self._step(state, byte)
            waiting += 1
            self.lookahead = max(self.lookahead, waiting)
            if emitted:
                waiting -= sum(len(self.bytes_of[t]) for t in emitted)
            yield emitted
        yield self.finals[state] or ()


class Encoder:
    """Cuts texts by a pattern and encodes each match by the transducer; remembers the ids of recent pieces, in two generations."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        self.transducer = Transducer(read_ranks(path))
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        pieces = self.cut(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) > KEPT_PIECES // 2:
                self.known, self.older = {}, self.known
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self._learn(pieces[k])
        return np.frombuffer(b"".join(found), np.int32)

    def _learn(self, piece: str) -> bytes:
        ids = self.known.get(piece) or self.older.get(piece)
        if ids is None:
            tokens = self.transducer.encode(piece.encode())
            ids = struct.pack(f"={len(tokens)}i", *tokens)
        if len(piece) <= KEPT_LENGTH:
            self.known[piece] = ids
        return ids


# Fixed values of UTF-8: bytes that a lead byte asks for, and the bounds of the byte after some leads.
LEADS = {**dict.fromkeys(range(0xC2, 0xE0), 1), **dict.fromkeys(range(0xE0, 0xF0), 2), **dict.fromkeys(range(0xF0, 0xF5), 3)}
SECONDS = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


class Utf8Stream:
    """Decodes bytes that come in parts: feed() returns the characters now complete, finish() what is left.

    The state is what the bytes of an unfinished character say: how many are to come, the bounds of the next, and the bytes
    themselves. Each maximal part of an ill-formed sequence becomes one U+FFFD.
    """

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    @functools.lru_cache(65_536)
    def step(open_: bytes, part: bytes) -> tuple[str, bytes]:
        """Characters complete after the part, and the bytes of one still open."""
        out, begun, need, low, high = [], -1, 0, 0x80, 0xBF
        data, at = open_ + part, 0
        while at < len(data):
            byte = data[at]
            if need:
                if low <= byte <= high:
                    need, low, high, at = need - 1, 0x80, 0xBF, at + 1
                    if not need:
                        out.append(data[begun:at].decode())
                    continue
                out.append("�")
                need, low, high = 0, 0x80, 0xBF
                continue
            at += 1
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in LEADS:
                begun, need = at - 1, LEADS[byte]
                low, high = SECONDS.get(byte, (0x80, 0xBF))
            else:
                out.append("�")
        return "".join(out), data[begun:] if need else b""

    def feed(self, part: bytes) -> str:
        text, self.open = self.step(self.open, part)
        return text

    def finish(self) -> str:
        left, self.open = "�" * bool(self.open), b""
        return left


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes] | list[bytes]) -> Iterator[str]:
    """The text of ids, token by token, never half a character."""
    stream = Utf8Stream()
    for i in ids:
        yield stream.feed(bytes_of[i])
    yield stream.finish()


class Decoder:
    """Decodes whole lists of ids. Tokens that are whole characters leave the state machine where it was, so their text is kept; all others run through it."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.whole = {i: text for i, token in bytes_of.items() for text, open_ in [Utf8Stream.step(b"", token)] if not open_ and "�" not in text}

    def decode(self, ids: list[int]) -> str:
        parts = list(map(self.whole.get, ids))
        if None not in parts:
            return "".join(parts)
        stream, out = Utf8Stream(), []
        for i, part in zip(ids, parts, strict=True):
            out.append(part if part is not None and not stream.open else stream.feed(self.bytes_of[i]))
        return "".join(out) + stream.finish()


@functools.lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks_by_id(path))


def read_ranks_by_id(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """States and steps have no cycles; looking for some again and again would cost."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def encode_texts(df: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for b in pieces_of(batches):
            with no_cycles():
                ids = [enc.encode(t.decode()) for t in texts_of(b)]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))], names=["doc_id", "ids"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids and text of each row of encode_texts(): the ids run through the streaming decoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(ranks).decode
        for b in batches:
            values, ends = np.asarray(b.column(1).values), np.asarray(b.column(1).offsets)
            for p in range(0, b.num_rows, 256):
                part = b.slice(p, 256)
                texts = [decode(values[ends[k] : ends[k + 1]].tolist()) for k in range(p, p + part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def round_trip(df: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """encode_texts() and decode_ids() of each row in one pass: doc_id, ids and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = encoder(ranks, pattern), decoder(ranks)
        for b in pieces_of(batches):
            with no_cycles():
                ids = [enc.encode(t.decode()) for t in texts_of(b)]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            texts = pa.array([dec.decode(x.tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32())), texts], names=["doc_id", "ids", "text"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; the digests are of all its ids and bytes."""
    out = round_trip(documents(spark, sf_dir))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
