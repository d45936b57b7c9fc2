"""Words and tokens of a batch of texts as spans of one array of code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .fasttok import SpanHash

#: What a code point may be, as bits: a letter, a mark on one, a letter or number, white space, of a script that puts no space between words.
LETTER, MARK, ALNUM, SPACE, UNSPACED = 1, 2, 4, 8, 16
#: Blocks of scripts written without spaces: Thai and Lao, Tibetan, Myanmar, Khmer, kana to ideographs, compatibility ideographs, supplementary ideographs.
UNSPACED_BLOCKS = ((0x0E00, 0x0F00), (0x0F00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))
#: Code points of a batch that are worked on at a time.
BATCH = 1 << 19


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The bits of every code point."""
    every = np.arange(0x110000, dtype="<u4").view("<U1")
    out = np.strings.isalpha(every) * np.uint8(LETTER) | np.strings.isalnum(every) * np.uint8(ALNUM) | np.strings.isspace(every) * np.uint8(SPACE)
    for c in [*range(0x300, 0x1F000), *range(0xE0100, 0xE01F0)]:
        if unicodedata.category(chr(c))[0] == "M":
            out[c] |= MARK
    for a, b in UNSPACED_BLOCKS:
        out[a:b] |= UNSPACED
    return out


@lru_cache(maxsize=1)
def hashes() -> SpanHash:
    return SpanHash(0x110000, 31337)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line feed after each, and where each text begins and the last one ends."""
    x = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return x, np.cumsum(np.fromiter(map(len, ["", *texts]), np.int64, len(texts) + 1) + 1) - 1


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def strings(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = x.tobytes()
    return [raw[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist())]


def portions(texts: list[str | None], most: int = BATCH) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts in lower case, null as empty, of about ``most`` code points, with the place of the first."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t.lower() if t else "")
        size += len(held[-1]) + 1
        if size >= most:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of letters and the marks on them."""
    return runs(kinds()[x] & (LETTER | MARK) != 0)


def distinct(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal spans the place of the first, and how many there are."""
    _, first, n = np.unique(hashes().spans(hashes().prefix(x), starts, ends), return_index=True, return_counts=True)
    return first, n


def word_counts(texts: list[str | None]) -> tuple[list[str], list[int]]:
    """The distinct words of texts, in lower case, and how often they occur."""
    found: dict[str, int] = {}
    for _, low in portions(texts):
        x, _ = codes(low)
        starts, ends = words(x)
        first, n = distinct(x, starts, ends)
        for w, c in zip(strings(x, starts[first], ends[first]), n.tolist()):
            found[w] = found.get(w, 0) + c
    return list(found), list(found.values())


def utf8(x: np.ndarray, n: int) -> pa.StringArray:
    """The strings of n code points each that follow one another in x."""
    size = 1 + (x >= 0x80) + (x >= 0x800) + (x >= 0x10000)
    ends = np.cumsum(size)[n - 1 :: n] if len(x) else np.zeros(0, np.int64)
    data = x.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(data))
