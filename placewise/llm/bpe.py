"""Byte-level BPE by a lazily determinised transducer.

A segmentation of a byte string into tokens is what the merges produce exactly if every two neighbouring tokens are: if
merging their bytes gives these two tokens again. The merges thus compile to a nondeterministic transducer that guesses
the next token, reads its bytes along a trie, and may go on to tokens that are compatible with it. The subset construction is
made on demand: a state holds the guesses still open, each with the tokens not yet written; what all guesses agree on is
written at once. A guess dies within the length of a token, so lookahead and states stay bounded. Transitions are remembered
up to a limit.

Decoding goes through an incremental UTF-8 state machine: ids arrive in pieces, whole characters leave, and at most three
bytes wait for the next piece.
"""
from __future__ import annotations

import base64
import gc
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import kept, wider

# fixed value: characters the tokenizer's regular expressions count as white space (property White_Space)
WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STATES = 250_000      # states a task remembers, about 1 KB each
FITS = 500_000        # pairs of tokens a task remembers as compatible or not
PIECES = 300_000      # pieces a task remembers
PIECE = 4096          # ids a decoder takes at once


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern

    @staticmethod
    def read(path: str, pattern: str) -> "Vocabulary":
        """A file of lines "base64 rank", read by the driver and sent to the executors."""
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def split(self) -> re.Pattern:
        """The pattern for the ``re`` module, whose plain character classes are several times faster than property lookups."""
        own = {r"\s": WHITE, r"\p{L}": _category("L"), r"\p{N}": _category("N")}
        out, inside, i = [], False, 0
        while i < len(self.pattern):
            name = next((k for k in (*own, r"\S") if self.pattern.startswith(k, i)), None)
            if name == r"\S":
                out.append(f"[^{WHITE}]")
            elif name:
                out.append(own[name] if inside else f"[{own[name]}]")
            else:
                name = self.pattern[i]
                inside = name == "[" or inside and name != "]"
                out.append(name)
            i += len(name)
        return re.compile("".join(out))


def _category(first: str) -> str:
    """Characters of a general category as ranges for a character class."""
    at = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == first]
    ranges, lo = [], at[0]
    for c, after in zip(at, [*at[1:], None]):
        if after != c + 1:
            ranges.append(f"\\U{lo:08x}-\\U{c:08x}")
            lo = after
    return "".join(ranges)


class _State:
    __slots__ = ("last", "open", "next", "end")

    def __init__(self, last, guesses):
        self.last, self.open, self.next, self.end = last, guesses, None, None
        for waiting, node in guesses:
            if not node:
                self.end = waiting


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.child: dict[int, int] = {}                    # node * 256 + byte -> node
        self.token_at: list[int | None] = [None]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                at = node << 8 | b
                node = self.child.get(at)
                if node is None:
                    node = self.child[at] = len(self.token_at)
                    self.token_at.append(None)
            self.token_at[node] = rank
        self.inner = {at >> 8 for at in self.child}        # nodes with a way on
        self.edges: dict[int, tuple[list, list]] = {}
        self.fits: dict[int, bool] = {}
        self.states: dict[tuple, _State] = {}
        self._reset()

    def _reset(self):
        for s in self.states.values():                     # no cycles stay: reference counts free the states
            s.next = None
        self.states = {}
        self.start = self._state(None, (((), 0),))

    def _state(self, last, guesses) -> _State:
        key = (last, guesses)
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = _State(last, guesses)
        return s

    def merge(self, text: bytes, parts_left: int = 1) -> list[bytes]:
        """The definition: join the neighbours of lowest rank, leftmost first, until nothing joins."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > parts_left:
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            rank = min(ranks)
            if rank == 1 << 60:
                break
            i = ranks.index(rank)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: int) -> tuple[list, list]:
        """What stands at the right and at the left edge of a token while it is merged, from byte to token, each with the
        rank of the merge that ends it."""
        e = self.edges.get(token)
        if e is None:
            text = self.bytes_of[token]
            if len(text) == 1:
                e = ([(text, 1 << 60)], [(text, 1 << 60)])
            else:
                halves = self.merge(text, 2)
                if len(halves) != 2:
                    raise ValueError(f"token {token} is no merge of two tokens")
                left, right = self._edge(self.ranks[halves[0]])[1], self._edge(self.ranks[halves[1]])[0]
                e = ([*right[:-1], (right[-1][0], token), (text, 1 << 60)], [*left[:-1], (left[-1][0], token), (text, 1 << 60)])
            self.edges[token] = e
        return e

    def _fit(self, a: int | None, b: int) -> bool:
        """Whether b may follow a: no merge across the border comes before the merges that complete both."""
        if a is None:
            return True
        x, y, i, j = self._edge(a)[0], self._edge(b)[1], 0, 0
        while True:
            (p, up), (q, over) = x[i], y[j]
            across = self.ranks.get(p + q, 1 << 60)
            if across < up and across <= over and across < 1 << 60:      # of equal ranks the one further left goes first
                return False
            if up == over == 1 << 60:
                return True
            if up <= over:
                i += 1
            else:
                j += 1

    def _step(self, s: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        if len(self.states) >= STATES:
            self._reset()
        fits, guesses, children, inner, token_at, done = self.fits, [], self.child, self.inner, self.token_at, False
        for waiting, node in s.open:
            child = children.get(node << 8 | byte)
            if child is None:
                continue
            if child in inner:
                guesses.append((waiting, child))
            token = token_at[child]
            if token is not None and not done:          # the merges cut what was read in one way: one guess ends here
                last = waiting[-1] if waiting else s.last
                pair = token if last is None else (last + 1) << 32 | token
                done = fits.get(pair)
                if done is None:
                    if len(fits) >= FITS:
                        fits.clear()
                    done = fits[pair] = self._fit(last, token)
                if done:
                    guesses.append((waiting + (token,), 0))
        written: tuple[int, ...] = ()
        if guesses:
            written = guesses[0][0]
            for waiting, _ in guesses[1:]:
                n = 0
                for a, b in zip(written, waiting):
                    if a != b:
                        break
                    n += 1
                written = written[:n]
            if written:
                n = len(written)
                guesses = [(waiting[n:], node) for waiting, node in guesses]
        last = (written[-1] if written else s.last) if any(not waiting for waiting, _ in guesses) else None
        to = (self._state(last, tuple(guesses)), written)
        if s.next is None:
            s.next = {}
        s.next[byte] = to
        return to

    def __call__(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        s, out = self.start, []
        for b in piece:
            to = s.next and s.next.get(b)
            s, written = to or self._step(s, b)
            out += written
        if s.end is None:                  # a vocabulary with tokens the merges never produce: no guess is left
            return [self.ranks[p] for p in self.merge(piece)]
        out += s.end
        return out


class Encoder:
    """Texts to ids; what a piece encodes to is remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.split, self.transduce, self.known = vocabulary.split().findall, Transducer(vocabulary.ranks), {}

    def forget(self) -> None:
        self.known.clear()
        self.transduce._reset()

    def __call__(self, text: str | None) -> list[int]:
        known, out = self.known, []
        for piece in self.split(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = self.transduce(piece.encode())
                if len(piece) <= 64:
                    if len(known) >= PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


class Utf8Stream:
    """Bytes in, characters out. The state is the start of a character whose bytes have not all come."""

    def __init__(self):
        self.wait = b""

    def feed(self, data: bytes) -> str:
        data = self.wait + data
        keep = 0
        for back in range(1, min(4, len(data) + 1)):
            lead = data[-back]
            if lead >= 0xC0:                                  # a first byte: how many bytes does its character have
                keep = back if (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) > back else 0
            if lead < 0x80 or lead >= 0xC0:
                break
        self.wait = data[len(data) - keep:] if keep else b""
        return data[:len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.wait = self.wait, b""
        return rest.decode("utf-8", "replace")


def decoded(ids: Iterable[int], bytes_of: dict[int, bytes]) -> str:
    """Text of ids; bytes that are no UTF-8 become U+FFFD, as do ids that the vocabulary lacks."""
    ids, stream, out = list(ids), Utf8Stream(), []
    for lo in range(0, len(ids), PIECE):
        piece = ids[lo:lo + PIECE]
        try:
            data = b"".join(map(bytes_of.__getitem__, piece))
        except KeyError:
            data = b"".join(bytes_of.get(i, b"\xff") for i in piece)
        out.append(stream.feed(data))
    out.append(stream.close())
    return "".join(out)


def _compile(kind: Callable, payload):
    """One per vocabulary and worker; later tasks go on with what it has learned."""
    def build():
        made = kind(Vocabulary(*payload.value))
        gc.freeze()                       # the compiled vocabulary is no garbage; later collections pass over it
        return made
    return kept((kind, payload.id), build)


def _bytes_of(vocabulary: Vocabulary) -> dict[int, bytes]:
    return {v: k for k, v in vocabulary.ranks.items()}


@contextmanager
def _no_collector() -> Iterator[None]:
    """The transducer's tables are large, alive and freed by reference counts: walking them for garbage took a third of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        gc.enable()


class _Payload:
    def __init__(self, df: DataFrame, v: Vocabulary):
        self.cast = df.sparkSession.sparkContext.broadcast((v.ranks, v.pattern))       # as large as the vocabulary file
        self.id = id(self.cast) ^ hash(v.pattern)

    @property
    def value(self):
        return self.cast.value


def _ids_array(lists: list[list[int]]) -> pa.ListArray:
    ends, flat = [0], []
    for x in lists:
        flat += x
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _numbers(ids: pa.ListScalar) -> list[int | None]:
    """As ``as_py``, which makes an Arrow scalar of every id, but through one array."""
    return ids.as_py() or [] if ids.values is None or ids.values.null_count else ids.values.to_numpy().tolist()


SLICE_BYTES = 4 << 20       # text encoded before its ids leave


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut where the texts (or ids) of a piece pass SLICE_BYTES; one row at least."""
    for whole in batches:
        size = pc.fill_null(pc.binary_length(whole.column(column)) if pa.types.is_string(whole.column(column).type) else pc.multiply(pc.list_value_length(whole.column(column)), 4), 0)
        run = pc.divide(pc.cumulative_sum(pc.cast(size, pa.int64())), SLICE_BYTES).to_pylist()
        lo = 0
        for i in range(1, whole.num_rows + 1):
            if i == whole.num_rows or run[i] != run[lo]:
                yield whole.slice(lo, i - lo)
                lo = i


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` (text, ...) with ``ids``: array of token ids of the whole text, each match of the pattern by itself, without
    special tokens. Null and empty texts have no ids (empty array). A column named ids is replaced, others pass through;
    repeated rows get equal ids; texts of any length are read as a stream."""
    docs = docs.drop("ids")
    payload = _Payload(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _compile(Encoder, payload)
        for b in _slices(batches, "text"):
            with _no_collector():
                ids = [encoder(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, _ids_array(ids)], [*b.schema.names, "ids"])
    return docs.mapInArrow(run, wider(docs, ids="array<int>"))


def recode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` (text, ...) with ``ids`` and ``decoded``: ``decode`` of ``encode``, by one Python worker with one vocabulary."""
    docs = docs.drop("ids", "decoded")
    payload = _Payload(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _compile(Encoder, payload)
        bytes_of = encoder.transduce.bytes_of
        for b in _slices(batches, "text"):
            with _no_collector():
                ids = [encoder(t) for t in b.column("text").to_pylist()]
                text = [decoded(x, bytes_of) for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, _ids_array(ids), pa.array(text, pa.string())], [*b.schema.names, "ids", "decoded"])
    return docs.mapInArrow(run, wider(docs, ids="array<int>", decoded="string"))


def decode(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``coded`` (ids, ...) with ``decoded``: the text of the ids. Null ids give an empty text; ids the vocabulary lacks and
    bytes that are no UTF-8 give U+FFFD. A column named decoded is replaced."""
    coded = coded.drop("decoded")
    payload = _Payload(coded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _compile(_bytes_of, payload)
        for b in _slices(batches, "ids"):
            text = [decoded(_numbers(x), bytes_of) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "decoded"])
    return coded.mapInArrow(run, wider(coded, decoded="string"))
