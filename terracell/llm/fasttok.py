"""Exact byte-pair encoding at array speed.

A tokenizer of the ``tokenizers`` library is split into its two halves: cutting a text into
pieces (the pre-tokenizer's pattern) and encoding a piece.  Cutting is done for a whole batch of
texts with array operations on character classes.  Encoding is done by the library itself, once for
each distinct piece a worker meets; the ids are kept in a bounded open-addressing table.  A piece is
found by a hash and then compared with the one kept, character by character.

Only characters whose class is beyond doubt take the array path (``TRUSTED``).  A text with any
other character, or with the string of a special token, is given to the library as a whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

from .common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

U64 = np.uint64
SPACE, LETTER, NUMBER, OTHER, BREAK = 0, 1, 2, 3, 4
#: Code points whose class and lower-case form are the same in every Unicode version in use.
TRUSTED = ((0x0000, 0x0130), (0x0131, 0x0180), (0x2010, 0x2028), (0x4E00, 0x9FA6))
#: White space of the tokenizers' patterns among the trusted code points.
WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
#: Characters of a batch that are worked on at a time; pieces, and characters or ids of them, kept before the table starts anew.
BATCH_CHARS, MAX_PIECES, MAX_HELD = 1 << 19, 1 << 20, 1 << 23


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and trust of each code point below 0x10000."""
    kind, trusted = np.full(0x10000, OTHER, np.uint8), np.zeros(0x10000, bool)
    for a, b in TRUSTED:
        for c in range(a, b):
            first = unicodedata.category(chr(c))[0]
            kind[c] = SPACE if c in WHITE else LETTER if first == "L" else NUMBER if first == "N" else OTHER
        trusted[a:b] = True
    return kind, trusted


class HashIndex:
    """Open addressing from non-zero 64-bit hashes to 32-bit values; look-ups and inserts take arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.vals = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values of h; -1 where there is none."""
        mask = (1 << self.bits) - 1
        slot = (h >> U64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.vals[slot], np.int32(-1))
        rest = np.flatnonzero((key != h) & (key != 0))
        while rest.size:
            at = (slot[rest] + 1) & mask
            slot[rest] = at
            key, want = self.keys[at], h[rest]
            hit = key == want
            out[rest[hit]] = self.vals[at[hit]]
            rest = rest[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, v: np.ndarray) -> None:
        """h: distinct and not held yet."""
        while 2 * (self.n + len(h)) > 1 << self.bits:
            old = self.keys != 0
            k, w = self.keys[old], self.vals[old]
            self.__init__(self.bits + 1)
            self._put(k, w)
        self._put(h, v)

    def _put(self, h: np.ndarray, v: np.ndarray) -> None:
        self.n += len(h)
        mask = (1 << self.bits) - 1
        slot = (h >> U64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.vals[slot[won]] = v[won]
            h, v, slot = h[~won], v[~won], (slot[~won] + 1) & mask


class SpanHash:
    """64-bit hashes of any spans of an array of codes, by prefix sums of a polynomial."""

    def __init__(self, codes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.of = rng.integers(1, 1 << 63, codes, dtype=np.uint64) * U64(2) + U64(1)
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, self.base, U64))))
                self.down = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, self.inverse, U64))))

    def prefix(self, x: np.ndarray) -> np.ndarray:
        self._powers(len(x) + 1)
        out = np.zeros(len(x) + 1, U64)
        np.cumsum(self.of[x] * self.up[: len(x)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * self.down[start]
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(32)
        h *= U64(0x94D049BB133111EB)
        return h | U64(1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... lengths[i] of them, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


def contractions(x: np.ndarray, c: np.ndarray, flag: np.ndarray, after_space: bool) -> None:
    """Moves piece starts for 's 't 'm 'd 're 've 'll, which the patterns try first."""
    quote = np.flatnonzero(x == 39)
    quote = quote[quote < len(x) - 1]
    # The first character of all has the last before it, which is a break: neither a space nor of a word.
    ok = (c[quote] == OTHER) & (c[quote - 1] != OTHER) & (c[quote + 1] == LETTER)
    quote = quote[ok if after_space else ok & (x[quote - 1] != 32)]
    if not len(quote):
        return
    a = x[quote + 1].astype(np.int64)
    b = x[np.minimum(quote + 2, len(x) - 1)].astype(np.int64)
    short = np.isin(a, [ord(k) for k in "stmd"])
    long = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
    for which, n in ((quote[short], 2), (quote[long], 3)):
        flag[which + 1] = False
        at = which + n
        at = at[at < len(x)]
        flag[at[c[at] == LETTER]] = True


class Pieces:
    """Cuts texts into pieces by the pattern of one of the two public byte-level tokenizers."""

    def __init__(self, spaced: bool):
        #: spaced: a piece takes the space before it, and white space is kept; else it is dropped, and each digit is a piece.
        self.spaced = spaced
        self.kind, self.trusted = _classes()

    def plain(self, text: str) -> bool:
        """Whether the array path gives the library's pieces."""
        if "<|" in text:
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            try:
                return bool(self.trusted[np.frombuffer(text.encode("utf-16-le"), np.uint16)].all())
            except UnicodeEncodeError:
                return False

    def normal(self, text: str) -> str:
        return text if self.spaced else text.lower()

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts, a break after each; starts and ends of pieces; the piece that is each text's break."""
        joined = "\n".join(texts) + "\n"
        try:
            x = np.frombuffer(joined.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            x = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        c = self.kind[x]
        breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        c[breaks] = BREAK
        flag = np.empty(len(x), bool)
        flag[0] = True
        np.not_equal(c[1:], c[:-1], out=flag[1:])
        if self.spaced:
            flag[1:] &= ~((x[:-1] == 32) & (c[:-1] == SPACE) & (c[1:] != BREAK) & (c[1:] != SPACE))
            flag[:-1] |= (c[:-1] == SPACE) & (c[1:] != SPACE) & (c[1:] != BREAK)
        else:
            flag |= c == NUMBER
        flag[breaks] = True
        flag[breaks[:-1] + 1] = True
        contractions(x, c, flag, after_space=not self.spaced)
        starts = np.flatnonzero(flag)
        ends = np.append(starts[1:], len(x))
        if not self.spaced:
            keep = c[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        return x, starts, ends, np.searchsorted(starts, breaks)


class Encoder:
    """Ids of whole texts as ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab_size = self.library.get_vocab_size()
        self.dtype = np.uint16 if self.vocab_size <= 1 << 16 else np.uint32
        self.pieces = Pieces(spaced=spec["normalizer"] is None)
        self.hash = SpanHash(1 << 16, 20240501)
        self._anew()

    def _anew(self) -> None:
        self.index, self.count = HashIndex(), 0
        self.at, self.len = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        #: Characters of the pieces, one after another, and where each piece begins; one more is where the next will.
        self.codes, self.code_at = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64)

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        ids = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        got = np.fromiter((i for x in ids for i in x), self.dtype, int(n.sum()))
        while self.used + len(got) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.count + len(words) > len(self.at):
            self.at, self.len = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.len, np.zeros_like(self.len)))
        own = slice(self.count, self.count + len(words))
        self.at[own], self.len[own] = self.used + np.cumsum(n) - n, n
        self.flat[self.used : self.used + len(got)] = got
        self.index.add(h, np.arange(own.start, own.stop, dtype=np.int32))
        self.used, self.count = self.used + len(got), own.stop

    def _keep(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Keeps the characters of pieces that were just learnt."""
        n = ends - starts
        first, held = self.count - len(n), int(self.code_at[self.count - len(n)])
        while self.count + 1 > len(self.code_at):
            self.code_at = np.concatenate((self.code_at, np.zeros_like(self.code_at)))
        while held + int(n.sum()) > len(self.codes):
            self.codes = np.concatenate((self.codes, np.zeros_like(self.codes)))
        self.code_at[first + 1 : self.count + 1] = held + np.cumsum(n)
        self.codes[held : held + int(n.sum())] = x[ragged(starts, n)]

    def lookup(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table's number of each piece, pieces not met before being learnt; and the places of pieces that the number does not stand for, as their hash is another's."""
        if self.count > MAX_PIECES or max(self.used, self.code_at[self.count]) > MAX_HELD:
            self._anew()
        h = self.hash.spans(self.hash.prefix(x), starts, ends)
        found = self.index.find(h)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            first = miss[first]
            raw, width, code = x.tobytes(), x.itemsize, "latin-1" if x.itemsize == 1 else "utf-16-le"
            self._learn(new, [raw[a:b].decode(code) for a, b in zip((starts[first] * width).tolist(), (ends[first] * width).tolist())])
            self._keep(x, starts[first], ends[first])
            found[miss] = self.index.find(h[miss])
        n = ends - starts
        kept = self.code_at[found + 1] - self.code_at[found]
        least = np.minimum(n, kept)
        same = self.codes[ragged(self.code_at[found], least)] == x[ragged(starts, least)]
        if same.all() and (n == kept).all():
            return found, np.zeros(0, np.int64)
        wrong = n != kept
        wrong[np.repeat(np.arange(len(n)), least)[~same]] = True
        return found, np.flatnonzero(wrong)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        x, starts, ends, breaks = self.pieces.cut(texts)
        number, wrong = self.lookup(x, starts, ends)
        n = self.len[number].astype(np.int64)
        n[breaks] = 0
        ids = self.flat[ragged(self.at[number], n)]
        upto = np.cumsum(n)[breaks]
        out = np.split(ids, upto[:-1])
        for k in np.unique(np.searchsorted(breaks, wrong)).tolist():
            out[k] = self._whole_text(texts[k])
        return out

    def _whole_text(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        todo, size = [], 0
        for i, text in enumerate(texts):
            if self.pieces.plain(text):
                todo.append(i)
                size += len(text) + 1
                if size >= BATCH_CHARS:
                    self._flush(texts, todo, out)
                    todo, size = [], 0
            else:
                out[i] = self._whole_text(text)
        self._flush(texts, todo, out)
        return out

    def _flush(self, texts: list[str], todo: list[int], out: list) -> None:
        if todo:
            for i, ids in zip(todo, self._batch([self.pieces.normal(texts[i]) for i in todo])):
                out[i] = ids


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, kept between tasks that use it."""
    return held(f"encoder {path}", lambda: Encoder(path))
