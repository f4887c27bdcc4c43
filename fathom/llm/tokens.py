"""Exact tokenising by the tokenizers library, at the speed of a dictionary.

Both vocabularies treat what stands between two single blanks on its own, so a piece that was met before
needs no second encoding. Texts are cut in groups, and each piece is looked up once a group. A new piece is encoded by the library: a plain word by its model alone, anything
else by the whole tokenizer. A text that holds one of the vocabulary's added tokens, in upper or lower case,
goes to the library as a whole, since the library looks for those before anything else.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Distinct pieces kept by a worker, in each of two halves.
CACHE_PIECES = 500_000
#: Bytes of texts, about, that are cut at once; a longer text is cut on its own.
GROUP_BYTES = 8 << 20
#: Part of that for kind "word": what a group needs beside itself, some 25 times its bytes, stands beside the dictionaries
#: and an executor's full heap.
WORD_SHARE = 4
#: Signs that are no letters, digits or apostrophes in any pattern: a run of them after a letter is a match.
STOPS = ".,!?;:#$%&*"
#: Below it, letters have been what they are in every version of Unicode, and stay as they are when composed.
LATIN_END, DOTTED_I = "ɐ", "İ"
LATIN = "".join(c for c in map(chr, range(ord(LATIN_END))) if c.isalpha() and c != DOTTED_I)
#: A word of such letters, and the stops after it.
PLAIN = re.compile(f"([{LATIN}]+)([{re.escape(STOPS)}]*)").fullmatch
#: Little-endian uint32 of so many ids.
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def odd_space(piece: str) -> bool:
    """Whether white space, or nothing, stands at an end of a piece: its text must be encoded whole."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def byte_signs() -> str:
    """The character of each byte: byte-level vocabularies write byte b as the character b if that is visible,
    else as the next from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = dict(zip([b for b in range(256) if b not in seen], range(256, 512)))
    return "".join(chr(other.get(b, b)) for b in range(256))


class CachedEncoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to those of the library for the whole text.

    kind "byte": byte-level BPE with a leading space. A match of its pattern never crosses from a non-space
    to a space, so a text may be cut before a blank or line feed between two non-spaces; a text with other
    white space at a cut is encoded whole. kind "word": white space is dropped before the merges, so a text
    may be cut at every blank and line feed. Between a letter and stops a match always ends.
    Two dictionaries hold the pieces met, without the blank before them; what the full newer one pushes out
    returns when it is met.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.signs = Tokenizer.from_file(path), kind == "word", byte_signs()
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.signals = sorted({a[0] for a in self.added})
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # the library's own cache would only be filled with words that come once
        self.tokenize, self.newer, self.older = model.tokenize, {}, {}
        self.stops = functools.lru_cache(maxsize=10_000)(self.whole)
        self.feed, self.blank = self.whole("\n"), "" if self.words else " "
        self.group = max(1, GROUP_BYTES // WORD_SHARE) if self.words else GROUP_BYTES

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def look_up(self, piece: str) -> bytes:
        """The ids of a piece that the newer dictionary lacks."""
        ids = self.older.get(piece)
        if ids is None:
            ids = self.fresh(piece)
        if len(self.newer) >= CACHE_PIECES:
            self.older, self.newer = self.newer, {}
        self.newer[piece] = ids
        return ids

    def known(self, word: str) -> bytes | None:
        return self.newer.get(word) or self.older.get(word)

    def ids_of(self, signs: str) -> bytes:
        ids = [t.id for t in self.tokenize(signs)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else array("I", ids).tobytes()

    def fresh(self, piece: str) -> bytes:
        if self.words:
            return self.plain("", piece)
        if piece.isascii() and piece.isalpha():  # the most frequent case, the long way round below
            return self.ids_of("Ġ" + piece)
        return self.feed + self.plain("", piece[1:]) if piece[0] == "\n" else self.plain(" ", piece)

    def plain(self, lead: str, piece: str) -> bytes:
        if not (match := PLAIN(piece)):
            return self.whole(lead + piece)
        word, stops = match.groups()
        ids = self.known(word) if stops and lead == self.blank else None
        if ids is None:
            low = word.lower() if self.words else word
            if low != word:
                ids = self.known(low)
            if ids is None:
                signs = low if low.isascii() else charmap_decode(low.encode(), "strict", self.signs)[0]
                ids = self.ids_of("Ġ" + signs if lead else signs)
        return ids + self.stops(stops) if stops else ids

    def holds_added(self, text: str) -> bool:
        if not any(c in text or c.upper() in text for c in self.signals):
            return False
        low = text.lower()
        return any(a in low for a in self.added)

    def encode_group(self, texts: pa.LargeStringArray) -> list[bytes]:
        """Of texts that are neither null nor empty; the array starts at its buffers' start."""
        whole, data = np.zeros(len(texts), bool), texts.buffers()[2].to_pybytes()
        if any(c.encode() in data or c.upper().encode() in data for c in self.signals):
            whole[:] = [self.holds_added(t) for t in texts.to_pylist()]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " " if self.words else " \n"), " ")
        flat, bounds = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        which, pieces = flat.indices.to_numpy(), flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, heads, at = list(map(self.newer.get, pieces)), [b""] * len(texts), bounds[:-1]
        new = [k for k, x in enumerate(ids) if x is None]
        if not self.words:  # pieces of odd white space are never kept
            odd = np.zeros(len(pieces), bool)
            odd[[k for k in new if not pieces[k].isalpha() and odd_space(pieces[k].removeprefix("\n"))]] = True
            if odd.any():
                inside = odd.take(which)
                inside[at] = False
                whole |= np.logical_or.reduceat(inside, at)
            for i, k in enumerate(which.take(at).tolist()):  # the first piece of a text has no blank before it
                whole[i] |= odd_space(pieces[k])
                heads[i] = b"" if whole[i] else self.plain("", pieces[k])
        used = np.zeros(len(pieces), bool)  # not by texts alone that are encoded whole
        used[which.take(np.flatnonzero(np.repeat(~whole, np.diff(bounds))))] = True
        used = used.tolist()
        for k in new:
            ids[k] = self.look_up(pieces[k]) if used[k] else b""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        n = sizes.take(which)
        if not self.words:
            n[at] = 0
        symbols = np.frombuffer(b"".join(ids), np.uint32)
        ends = np.cumsum(n)
        places = np.repeat((np.cumsum(sizes) - sizes).take(which) - ends + n, n)
        places += np.arange(len(places))
        out, ends = symbols.take(places).tobytes(), np.append(0, ends)[bounds].tolist()
        return [self.whole(texts[i].as_py()) if w else heads[i] + out[4 * ends[i] : 4 * ends[i + 1]] for i, w in enumerate(whole.tolist())]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        sizes, out = pc.fill_null(pc.binary_length(texts), 0).to_numpy(), [b""] * len(texts)
        full = np.flatnonzero(sizes)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes.take(full)) // self.group)) + 1
        for some in np.split(full, cuts):
            if len(some):
                for i, ids in zip(some.tolist(), self.encode_group(texts.take(pa.array(some)))):
                    out[i] = ids
        return out

    def encode_one(self, text: str | None) -> bytes:
        return self.encode([text])[0]

    def encode_rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
        """(first column, ids of the texts in the second) of the rows in order, several batches at a time."""
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(1).nbytes
            if size >= self.group:
                yield self.encode_held(held)
                held, size = [], 0
        if held:
            yield self.encode_held(held)

    def encode_held(self, held: list[pa.RecordBatch]) -> tuple[list, list[bytes]]:
        texts = pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in held])
        return [x for b in held for x in b.column(0).to_pylist()], self.encode(texts)


def encoder(path: str, kind: str) -> CachedEncoder:
    """One for each worker process, kept between tasks until another step needs the memory."""
    return kept(f"{kind} {path}", lambda: CachedEncoder(path, kind))
