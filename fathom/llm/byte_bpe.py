"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can be the last one of the prefix's
encoding: the token t that ends there, leaves a prefix whose own last token is p, and for which (p, t) is a
pair that the merges would not join or split differently. Storing that one token for each prefix gives the
encoding of all prefixes at once: bytes can be appended at the cost of the new bytes alone, and an edit
re-encodes only from the edit on.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import need, tune

#: Distinct pieces, and matches of the pattern, that a worker remembers, each in two halves.
CACHE_PIECES, CACHE_MATCHES = 500_000, 200_000
NEVER = 1 << 40


class Ranks:
    """The vocabulary: ranks, how each token was merged, and which pairs of tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.data = {v: k for k, v in self.rank.items()}
        self.longest = max(map(len, self.rank))
        # by ascending rank: a token's last merge joins the two tokens that its bytes encode to with lower ranks only
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.reachable: dict[bytes, int] = {}
        for data, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            parts = self.merge(data, rank)
            if len(parts) == 1:
                self.halves[rank], self.reachable[data] = None, rank
            elif len(parts) == 2:
                self.halves[rank], self.reachable[data] = (parts[0], parts[1]), rank
                self.merged[parts[0], parts[1]] = rank
            else:  # no sequence of merges makes it; only a whole piece can be such a token
                self.halves[rank] = None
        self.right = {r: self.spine(r, 1) for r in self.reachable.values()}
        self.left = {r: self.spine(r, 0) for r in self.reachable.values()}
        self.pairs: dict[tuple[int, int], bool] = {}
        finder = ahocorasick.Automaton()
        for data, rank in self.reachable.items():
            finder.add_word(data.decode("latin-1"), (len(data), rank))
        finder.make_automaton()
        self.ends = finder.iter  # all tokens in a string, by where they end

    def merge(self, data: bytes, below: int) -> list[int]:
        """Plain merging with ranks below `below`: the definition that all else here must agree with."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def spine(self, token: int, side: int) -> list[int]:
        """The token and the tokens that stood at its right (1) or left (0) border before each merge."""
        out = [token]
        while self.halves[token]:
            token = self.halves[token][side]
            out.append(token)
        return out

    def born(self, token: int) -> int:
        return token if self.halves[token] else -1

    def may_meet(self, a: int, b: int) -> bool:
        """Whether bytes(a) + bytes(b) encodes to just a, b: at no time did the merges find a pair across
        the border whose turn came before the merge that took one of the two away."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        xs, ys, i, j = self.right[a], self.left[b], 0, 0
        x_ends = y_ends = NEVER
        fine = True
        while True:
            x, y = xs[i], ys[j]
            m = self.merged.get((x, y))
            if m is not None and m < x_ends and m <= y_ends:  # of equal ranks the left one comes first
                fine = False
                break
            bx, by = self.born(x), self.born(y)
            if bx < 0 and by < 0:
                break
            if bx > by:
                x_ends, i = bx, i + 1
            else:
                y_ends, j = by, j + 1
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[a, b] = fine
        return fine


class PrefixEncoding:
    """The encodings of all prefixes of one byte string; grows by append() and changes by edit()."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Only tokens that end in the new bytes are looked at; of those that end at a place one is valid."""
        old = len(self.data)
        self.data += more
        last = self.last
        last.extend([-1] * len(more))
        known, may = self.ranks.pairs.get, self.ranks.may_meet
        base = max(0, old + 1 - self.ranks.longest)
        for at, (size, token) in self.ranks.ends(self.data[base:].decode("latin-1")):
            end = base + at + 1
            if end <= old or last[end] >= 0:
                continue
            if end == size:
                last[end] = token
            elif (before := last[end - size]) >= 0:
                fine = known((before, token))
                if may(before, token) if fine is None else fine:
                    last[end] = token

    def edit(self, at: int, removed: int, inserted: bytes) -> None:
        """Replaces bytes; encodings of prefixes before `at` stay as they are."""
        tail = self.data[at + removed :]
        self.data = self.data[:at]
        del self.last[at + 1 :]
        self.append(inserted + tail)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes (of all)."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.ranks.data[out[-1]])
        return out[::-1]


class Remembered(dict):
    """A dictionary in two halves: what the full new half pushes out returns from the old one when it is met."""

    def __init__(self, size: int, make):
        self.size, self.make, self.older = size, make, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class TextCodec:
    """Encodes texts as the rank file's library would: each match of the pattern on its own."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks, self.matches = Ranks(path), regex.compile(pattern).findall
        self.exotic = re.compile(r"[^\S \n]").search
        # a match never crosses from a non-space to a space, so pieces between them can be met again
        self.cut = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
        self.match_ids = Remembered(CACHE_MATCHES, self.encode_match)
        self.piece_ids = Remembered(CACHE_PIECES, self.encode_piece)

    def encode_match(self, match: str) -> tuple[int, ...]:
        data = match.encode()
        whole = self.ranks.rank.get(data)
        return (whole,) if whole is not None else tuple(PrefixEncoding(self.ranks, data).ids())

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        if piece.isascii():  # a word, with a stop after it or not, is one match or two
            if (piece[1:] if piece[0] == " " else piece).isalpha():
                return self.match_ids[piece]
            if piece[-1] in ".," and (piece[1:-1] if piece[0] == " " else piece[:-1]).isalpha():
                return self.match_ids[piece[:-1]] + self.match_ids[piece[-1]]
        found = [self.match_ids[m] for m in self.matches(piece)]
        return found[0] if len(found) == 1 else tuple(i for x in found for i in x)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.exotic(text):
            return list(chain.from_iterable(map(self.match_ids.__getitem__, self.matches(text))))
        return list(chain.from_iterable(map(self.piece_ids.__getitem__, self.cut(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.data.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TextCodec:
    return TextCodec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) and data (the decoded bytes) of each text. Null: empty, no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "data"])

    tune(docs.sparkSession)
    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, data binary")


def digest_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, one blank between), decoded_sha256.

    The same encoding and decoding as encode_texts(), with only digests leaving the workers. Null and
    empty texts have no ids; rows that repeat, with a doc_id or without, have a row each; an empty table
    gives none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        say: dict[int, str] = {i: str(i) for i in c.ranks.data}
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(say.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    tune(docs.sparkSession)
    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
