"""Operator 7: the exact token count of every prefix of a text, by dynamic programming.

Within a piece of the pre-tokenizer's pattern, byte-pair encoding has this property: the encoding of a
prefix ends in exactly one token t such that the rest's encoding ends in a token that may stand before
t.  Two tokens may stand side by side if and only if no merge across their boundary would come before
the merges that made them.  So ``count[i] = count[i - len(t)] + 1``, position by position, and one pass
over a piece gives the counts of all its prefixes.  Where tokens match is found for all positions at
once, a byte more at a time for as long as any token begins so.  The pass runs over all new pieces of a
batch at once, but pieces of more than LONG bytes are walked one by one; either way its work is
proportional to the matches.  Pieces met before keep their counts in a bounded table.

A text's prefix counts are then the tokens before a piece plus the counts inside it.  A prefix that
ends inside a piece may be cut differently by the pattern; the three cases are set right explicitly:
white space before a word, contractions, and strings of special tokens.

``prefix_counts`` stores for each text an int32 for each of its n_chars + 1 prefixes.  ``tokens_at``
and ``fitting`` answer how many tokens a prefix has and how long a prefix a budget allows, without
encoding again.  Cases: a null text counts as empty (one prefix, 0 tokens); repeated rows each get
their row; an empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, map_batches, texts
from .fasttok import BATCH_CHARS, LETTER, SPACE, U64, Encoder, HashIndex, SpanHash, ragged

#: Bytes of a piece beyond which it is walked alone, and of it that are matched at a time.
LONG, STRETCH = 256, 1 << 16
#: Pairs of tokens remembered before the memory starts anew.
MAX_PAIRS = 1 << 18


def byte_of() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class MergeTable:
    """A byte-level vocabulary and its merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_of()
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        size = max(vocab.values()) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        pair_key, pair_rank = [], []
        for k, (a, b) in enumerate(merges):
            t = vocab[a + b]
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = k, vocab[a], vocab[b]
            pair_key.append((vocab[a] << 32) | vocab[b])
            pair_rank.append(k)
        self.pairs = HashIndex(18)
        self.pairs.add(self._mix(np.array(pair_key, np.uint64)), np.array(pair_rank, np.int32))
        words = [bytes(to_byte[c] for c in w) for w in vocab if all(c in to_byte for c in w)]
        ids = [vocab[w] for w in vocab if all(c in to_byte for c in w)]
        self.merge_key, self.merge_rank = pair_key, pair_rank
        # All beginnings of tokens; 0 where a beginning is no token, else the token's id and 1.
        self.hash = SpanHash(256, 7)
        flat = np.frombuffer(b"".join(words), np.uint8)
        n = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(n) - n
        word = np.repeat(np.arange(len(words)), n)
        size = np.arange(len(flat)) - first[word] + 1
        value = np.where(size == n[word], np.array(ids, np.int64)[word] + 1, 0)
        key = self.hash.spans(self.hash.prefix(flat), first[word], first[word] + size)
        order = np.lexsort((-value, key))
        key, value = key[order], value[order]
        new = np.append(True, key[1:] != key[:-1])
        self.begins = HashIndex(18)
        self.begins.add(key[new], value[new].astype(np.int32))
        self.known = HashIndex(16)
        self._lists: tuple | None = None

    @staticmethod
    def _mix(key: np.ndarray) -> np.ndarray:
        h = (key + U64(1)) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(31)
        return h * U64(0xBF58476D1CE4E5B9) | U64(1)

    def adjoin(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may directly follow token a; remembered pair by pair."""
        if self.known.n > MAX_PAIRS:
            self.known = HashIndex(16)
        key = self._mix((a.astype(np.uint64) << U64(32)) | b.astype(np.uint64))
        out = self.known.find(key)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            new, first = np.unique(key[miss], return_index=True)
            self.known.add(new, self._stands(a[miss[first]], b[miss[first]]).astype(np.int32))
            out[miss] = self.known.find(key[miss])
        return out.astype(bool)

    def _stands(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Takes the merges inside both tokens back, latest first: a merge over the boundary that is due earlier than the one taken back would have come first."""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        ok = np.ones(len(a), bool)
        due = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while live.size:
            across = self.pairs.find(self._mix((a[live].astype(np.uint64) << U64(32)) | b[live].astype(np.uint64)))
            broken = (across >= 0) & (across < due[live])
            ok[live[broken]] = False
            live = live[~broken]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            done = (ra < 0) & (rb < 0)
            live, ra, rb = live[~done], ra[~done], rb[~done]
            first = ra > rb
            x, y = live[first], live[~first]
            due[x], a[x] = ra[first], self.right[a[x]]
            # Of equal merges the left one comes first, and the boundary lies left of what is inside b.
            due[y], b[y] = rb[~first] + 1, self.left[b[y]]
        return ok

    def matches(self, flat: np.ndarray, prefix: np.ndarray, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every token that stands in flat at one of the positions, within the bytes left there."""
        starts, lengths, tokens, n = [], [], [], 1
        while len(at):
            found = self.begins.find(self.hash.spans(prefix, at, at + n))
            whole = found > 0
            starts.append(at[whole])
            lengths.append(np.full(int(whole.sum()), n, np.int32))
            tokens.append(found[whole] - 1)
            n += 1
            more = (found >= 0) & (room >= n)
            at, room = at[more], room[more]
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(tokens)

    def counts(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Token counts of all prefixes (1 byte to the whole) of the pieces whose bytes follow one another in flat."""
        count = np.zeros(len(flat), np.int32)
        first = np.cumsum(n) - n
        for k in np.flatnonzero(n > LONG).tolist():
            own = slice(int(first[k]), int(first[k] + n[k]))
            count[own] = self._walk(flat[own])
        short = np.flatnonzero(n <= LONG)
        if len(short) < len(n):
            place = ragged(first[short], n[short])
            count[place] = self._together(flat[place], n[short])
        else:
            count = self._together(flat, n)
        return count

    def _together(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """counts of short pieces, position by position in all of them at once."""
        last, count = np.full(len(flat), -1, np.int64), np.zeros(len(flat), np.int32)
        if not len(flat):
            return count
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        at, length, token = self.matches(flat, self.hash.prefix(flat), np.arange(len(flat)), np.repeat(n, n) - inside)
        # In order of the place in a piece at which they end, and of length.
        step = (inside[at] + length) * (LONG + 1) + length
        order = np.argsort(step, kind="stable")
        at, length, token, step = at[order], length[order], token[order], step[order]
        cuts = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(step)).tolist()):
            size = int(length[a])
            start, t = at[a:b], token[a:b]
            open_ = last[start + size - 1] < 0
            start, t = start[open_], t[open_]
            if inside[start[0]] if len(start) else 0:
                stands = self.adjoin(last[start - 1], t)
                start, t = start[stands], t[stands]
                count[start + size - 1] = count[start - 1] + 1
            else:
                count[start + size - 1] = 1
            last[start + size - 1] = t
        return count

    def _walk(self, flat: np.ndarray) -> np.ndarray:
        """counts of one long piece, front to back."""
        if self._lists is None:
            self._lists = (self.rank.tolist(), self.left.tolist(), self.right.tolist(), dict(zip(self.merge_key, self.merge_rank)), {})
        known = self._lists[4]
        size, prefix = len(flat), self.hash.prefix(flat)
        last, count = [-1] * (size + 1), [0] * (size + 1)
        for a in range(0, size, STRETCH):
            at = np.arange(a, min(size, a + STRETCH))
            at, length, token = self.matches(flat, prefix, at, size - at)
            order = np.argsort(at, kind="stable")
            for i, n, t in zip(at[order].tolist(), length[order].tolist(), token[order].tolist()):
                if last[i + n] >= 0:
                    continue
                if i:
                    key = (last[i] << 32) | t
                    stands = known.get(key)
                    if stands is None:
                        if len(known) >= MAX_PAIRS:
                            known.clear()
                        stands = known[key] = self._stands_one(last[i], t)
                    if not stands:
                        continue
                last[i + n] = t
                count[i + n] = count[i] + 1
        return np.array(count[1:], np.int32)

    def _stands_one(self, a: int, b: int) -> bool:
        """``_stands`` of one pair."""
        rank, left, right, pairs, _ = self._lists
        due = 1 << 62
        while True:
            across = pairs.get((a << 32) | b)
            if across is not None and across < due:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                due, a = ra, right[a]
            else:
                due, b = rb + 1, left[b]


class PrefixCounter(Encoder):
    """An encoder whose table holds, for each piece, the counts of its prefixes in code points."""

    def __init__(self, path: str):
        super().__init__(path)
        if not self.pieces.spaced:
            raise ValueError("prefix counts are defined for tokenizers that keep all text")
        self.merges = MergeTable(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def _anew(self) -> None:
        super()._anew()
        self.flat = np.zeros(1 << 16, np.int32)

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        counts = self.merges.counts(flat, n)
        # Keep the counts at the ends of code points: the next byte does not continue one.
        ends = np.append((flat[1:] & 0xC0) != 0x80, True)
        kept = counts[ends]
        points = np.fromiter(map(len, words), np.int64, len(words))
        while self.used + len(kept) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.count + len(words) > len(self.at):
            self.at, self.len = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.len, np.zeros_like(self.len)))
        own = slice(self.count, self.count + len(words))
        self.at[own], self.len[own] = self.used + np.cumsum(points) - points, points
        self.flat[self.used : self.used + len(kept)] = kept
        self.index.add(h, np.arange(own.start, own.stop, dtype=np.int32))
        self.used, self.count = self.used + len(kept), own.stop

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the counts of its prefixes of 1, 2, ... code points."""
        x, starts, ends, breaks = self.pieces.cut(texts)
        number, wrong = self.lookup(x, starts, ends)
        n = self.len[number].astype(np.int64)
        inside = self.flat[ragged(self.at[number], n)]
        whole = inside[np.cumsum(n) - 1].astype(np.int64)
        whole[breaks] = 0
        upto = np.cumsum(whole)
        first = np.concatenate(([0], breaks[:-1] + 1))
        # Tokens of a text before each of its pieces.
        before = upto - whole - np.repeat((upto - whole)[first], np.diff(np.append(first, len(starts))))
        out = inside + np.repeat(before, n)
        self._mend(x, starts, ends, breaks, before, out)
        stop = ends[breaks]
        got = [out[a : b - 1] for a, b in zip((stop - np.diff(np.concatenate(([0], stop)))).tolist(), stop.tolist())]
        for k in np.unique(np.searchsorted(breaks, wrong)).tolist():
            got[k] = self._by_library(texts[k])[1:]
        return got

    def _mend(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, breaks: np.ndarray, before: np.ndarray, out: np.ndarray) -> None:
        """Prefixes that the pattern cuts otherwise than the text: those that end with the white space before a word, and inside a contraction."""
        kind = self.pieces.kind
        # White space of two or more before a word is cut before its last character; a prefix that ends there is one piece.
        space = kind[x[starts]] == SPACE
        space[breaks] = False
        joint = np.flatnonzero(space[:-1] & (kind[x[ends[:-1] - 1]] == SPACE) & space[1:])
        if len(joint):
            width, code = x.itemsize, "latin-1" if x.itemsize == 1 else "utf-16-le"
            raw = x.tobytes()
            words = [raw[a * width : (b + 1) * width].decode(code) for a, b in zip(starts[joint].tolist(), ends[joint].tolist())]
            place = {w: i for i, w in enumerate(dict.fromkeys(words))}
            coded = [w.encode() for w in place]
            n = np.fromiter(map(len, coded), np.int64, len(coded))
            total = self.merges.counts(np.frombuffer(b"".join(coded), np.uint8), n)[np.cumsum(n) - 1]
            out[ends[joint]] = before[joint] + total[[place[w] for w in words]]
        # In 're 've 'll the prefix of two characters is two pieces.
        long = np.flatnonzero((ends - starts == 3) & (x[starts] == 39))
        long = long[kind[x[starts[long] + 1]] == LETTER]
        out[starts[long] + 1] = before[long] + 2

    def prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the counts of all its prefixes, the empty one first."""
        zero = np.zeros(1, np.int32)
        out: list = [None] * len(texts)
        todo, size = [], 0

        def flush():
            if todo:
                batch = [texts[i] for i in todo]
                for i, counts in zip(todo, self._batch(batch)):
                    out[i] = np.concatenate((zero, counts.astype(np.int32)))

        for i, text in enumerate(texts):
            if self.pieces.plain(text):
                todo.append(i)
                size += len(text) + 1
                if size >= BATCH_CHARS:
                    flush()
                    todo, size = [], 0
            else:
                out[i] = self._by_library(text)
        flush()
        return out

    def _by_library(self, text: str) -> np.ndarray:
        """Texts that the array path does not take: the counts of the text's pieces as the library cuts them, and of every prefix that ends inside one."""
        out, base, at = [0], 0, 0
        while at <= len(text):
            found = [(text.find(s, at), s) for s in self.special if s and text.find(s, at) >= 0]
            stop, special = min(found, key=lambda f: (f[0], -len(f[1])), default=(len(text), ""))
            out += self._plain_prefixes(text[at:stop] + special[:-1], base)
            if not special:
                break
            base += self._whole(text[at:stop]) + 1
            out.append(base)
            at = stop + len(special)
        return np.array(out, np.int32)

    def _whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False)) if text else 0

    def _plain_prefixes(self, text: str, base: int) -> list[int]:
        """Counts of the prefixes of 1, 2, ... code points of a text without special tokens."""
        if not text:
            return []
        cut = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]
        runs = [(a, b + 1) for (a, b), (c, d) in zip(cut, cut[1:]) if text[a].isspace() and text[c].isspace()]
        coded = [text[a:b].encode() for a, b in cut + runs]
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.frombuffer(b"".join(coded), np.uint8)
        counts = self.merges.counts(flat, n)
        stops = np.cumsum(n)
        whole = counts[stops - 1]
        before = np.cumsum(whole[: len(cut)]) - whole[: len(cut)]
        own = slice(0, int(stops[len(cut) - 1]))
        inside = counts[own] + np.repeat(before, n[: len(cut)])
        out = (inside[np.append((flat[own][1:] & 0xC0) != 0x80, True)] + base).tolist()
        starts = {a: k for k, (a, _) in enumerate(cut)}
        for (a, b), total in zip(runs, whole[len(cut) :].tolist()):
            out[b - 1] = base + int(before[starts[a]]) + total
        for k, (a, b) in enumerate(cut):
            if b - a == 3 and text[a:b] in ("'re", "'ve", "'ll"):
                out[a + 1] = base + int(before[k]) + 2
        return out


def counter(path: str) -> PrefixCounter:
    """The worker's counter of a file."""
    return held(f"prefixes {path}", lambda: PrefixCounter(path))


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_chars, counts): counts holds n_chars + 1 little-endian int32, the tokens of each prefix."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column("text").to_pylist()
        counts = counter(tokenizer).prefixes(rows)
        sizes = np.fromiter(map(len, counts), np.int64, len(counts))
        offsets = np.concatenate(([0], np.cumsum(sizes))) * 4
        data = np.concatenate(counts).astype("<i4", copy=False)
        binary = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(sizes - 1), binary], ["doc_id", "n_bytes", "n_chars", "counts"])

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_chars long, counts binary")


def tokens_at(counts: Column, prefix: Column) -> Column:
    """Tokens of the prefix of so many code points (beyond the text's end: of the whole text)."""
    end = F.least(prefix.cast("long") * 4 + 4, F.octet_length(counts).cast("long"))
    word = F.hex(F.substr(counts, (end - 3).cast("int"), F.lit(4)))
    return F.conv(F.concat(*[F.substr(word, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("long")


def fitting(counts: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(np.frombuffer(counts, "<i4") <= budget)[-1])
