"""Content-defined chunks: gear-hash boundaries with normalised sizes, for a batch of texts at once."""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np

#: Bytes that a boundary depends on: a 32-bit gear hash forgets what lies further back.
WINDOW = 32


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    return np.random.default_rng(0xC0FFEE).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each after WINDOW bytes of padding, their first positions, and the gear hash at every byte."""
    pad = bytes(WINDOW)
    flat = np.frombuffer(pad + pad.join(texts), np.uint8) if texts else np.zeros(0, np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(n + WINDOW) - n
    h = gear()[flat]
    # Padding counts nothing, so that equal texts have equal boundaries wherever they stand.
    h[(starts[:, None] - 1 - np.arange(WINDOW)).ravel()] = 0
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return flat, starts, h


def chunks(texts: list[bytes], least: int, normal: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes, and start, length and text number of each chunk.

    A chunk has at least ``least`` bytes (but for a text's last) and at most ``most``; before ``normal``
    bytes a boundary must meet a mask two bits stricter than 1 in ``normal``, after it one two bits
    looser, which draws sizes towards normal. No boundary lies inside a UTF-8 character.
    """
    flat, starts, h = gear_hashes(texts)
    bits = max(3, round(np.log2(normal)))
    strict, loose = np.uint32((1 << (bits + 2)) - 1 << (30 - bits)), np.uint32((1 << (bits - 2)) - 1 << (34 - bits))
    # A cut lies before a byte that continues no character.
    head = np.append((flat[1:] & 0xC0) != 0x80, True)
    maybe = np.flatnonzero(((h & loose) == 0) & head) + 1
    wide = maybe.tolist()
    narrow = maybe[(h[maybe - 1] & strict) == 0].tolist()
    wide.append(1 << 62)
    narrow.append(1 << 62)
    out_start, out_text = [], []
    i = j = 0
    for k, (s, n) in enumerate(zip(starts.tolist(), map(len, texts))):
        end = s + n
        while s < end:
            out_start.append(s)
            out_text.append(k)
            if end - s <= least:
                break
            i = bisect_left(narrow, s + least, i)
            cut = narrow[i]
            if cut > s + normal:
                j = bisect_left(wide, s + normal, j)
                cut = wide[j]
                if cut > s + most:
                    cut = s + most
                    while cut < end and not head[cut - 1]:
                        cut -= 1
            s = cut
    start, which = np.array(out_start, np.int64), np.array(out_text, np.int64)
    ends = starts + np.fromiter(map(len, texts), np.int64, len(texts))
    following = np.append(start[1:], 0)
    last = np.append(which[1:] != which[:-1], True) if len(which) else np.zeros(0, bool)
    following[last] = ends[which[last]]
    return flat, start, following - start, which
