"""Character language models with interpolated Kneser-Ney smoothing, kept in sorted hash arrays.

A model is made from words and their counts.  A word is read with ORDER - 1 start marks before it and an
end mark behind it, so a text's probability is the product over its words.  The highest order counts
occurrences; each lower order counts in how many different contexts an n-gram occurs one character
longer to the left.  Every order takes an absolute discount, n1 / (n1 + 2 n2), and hands what it took
to the order below; the lowest is uniform over the characters.

Look-ups are binary searches in two sorted arrays of 64-bit hashes: n-grams with the logarithm of
their interpolated probability, and contexts with the logarithm of the share handed down.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .fasttok import SpanHash, ragged

ORDER = 5
START, END = "\x02", "\x03"


@lru_cache(maxsize=1)
def _hash() -> SpanHash:
    return SpanHash(1 << 16, 31337)


def padded(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of words, given as spans of code points, with their marks; the positions that are predicted; and the word of each. Characters beyond 16 bits count as one."""
    n = ends - starts
    first = np.cumsum(n + ORDER) - n - 1
    out = np.full(int(n.sum()) + ORDER * len(n), ord(START), np.uint16)
    out[ragged(first, n)] = np.minimum(x[ragged(starts, n)], 0xFFFF)
    out[first + n] = ord(END)
    return out, ragged(first, n + 1), np.repeat(np.arange(len(n)), n + 1)


def _read(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``padded`` of words given as strings."""
    x = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return padded(x, np.append(0, ends[:-1])[: len(words)], ends)


def grams(x: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the highest order that end at the places ``at`` of x, one after another, and their sums of weights."""
    prefix = _hash().prefix(x)
    _, first, inverse = np.unique(_hash().spans(prefix, at - ORDER + 1, at + 1), return_index=True, return_inverse=True)
    return x[(at[first] - ORDER + 1)[:, None] + np.arange(ORDER)].ravel(), np.bincount(inverse, weight, len(first)).astype(np.int64)


class CharModel:
    """log2 probabilities of characters in words, from the words' counts or from those of n-grams of the highest order."""

    def __init__(self, counts: dict[str, int], of_grams: bool = False):
        keys = sorted(counts)
        if of_grams:
            x = np.frombuffer("".join(keys).encode("utf-16-le", "surrogatepass"), np.uint16)
            at, word = np.arange(ORDER - 1, len(x), ORDER), np.arange(len(keys))
        else:
            x, at, word = _read(keys)
        weight = np.array([counts[w] for w in keys], np.float64)[word]
        h = _hash()
        prefix = h.prefix(x)
        letters, place = np.unique(x[at], return_inverse=True)
        #: The characters that were read, the commonest first.
        self.alphabet = letters[np.argsort(-np.bincount(place, weight, len(letters)), kind="stable")] if len(at) else letters
        self.base = -np.log2(len(letters) + 1) if len(at) else 0.0
        grams: dict[int, tuple] = {}
        where, count = at, weight
        for n in range(ORDER, 0, -1):
            key = h.spans(prefix, where - n + 1, where + 1)
            own, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            grams[n] = (own, where[first], np.bincount(inverse, count, len(own)))
            where, count = where[first], np.ones(len(own))
        keys, logs, contexts, shares = [], [], [], []
        lower_key, lower_p = np.zeros(0, np.uint64), np.zeros(0)
        for n in range(1, ORDER + 1):
            own, place, c = grams[n]
            if not len(own):
                continue
            context, inverse = np.unique(h.spans(prefix, place - n + 1, place), return_inverse=True)
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = float(np.clip(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1, 0.95))
            total, followers = np.bincount(inverse, c), np.bincount(inverse)
            share = np.minimum(discount, c.min()) * followers / total
            below = 2.0**self.base if n == 1 else lower_p[np.searchsorted(lower_key, h.spans(prefix, place - n + 2, place + 1))]
            p = np.maximum(c - discount, 0) / total[inverse] + share[inverse] * below
            keys.append(own), logs.append(np.log2(p)), contexts.append(context), shares.append(np.log2(share))
            lower_key, lower_p = own, p
        self.keys, self.logs = _sorted(keys, logs)
        self.contexts, self.shares = _sorted(contexts, shares)

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Bits that each word takes, its end included."""
        x, at, word = _read(words)
        return np.bincount(word, self.bits_at(x, at), len(words))

    def bits_at(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each character of x at the places ``at``, after the ORDER - 1 characters before it."""
        h = _hash()
        prefix = h.prefix(x)
        bits = np.zeros(len(at))
        todo = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            found, log = _find(self.keys, self.logs, h.spans(prefix, at[todo] - n + 1, at[todo] + 1))
            bits[todo] -= log
            todo = todo[~found]
            bits[todo] -= _find(self.contexts, self.shares, h.spans(prefix, at[todo] - n + 1, at[todo]))[1]
        bits[todo] -= self.base
        return bits


def _sorted(keys: list, values: list) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0)
    k, v = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(k)
    return k[order], v[order]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each is held, and its value, else 0."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, np.where(found, values[at], 0.0)
