"""Operator 3: toxicity of text, after undoing disguises by a noisy-channel decoder.

A token that mixes letters with look-alike characters, repeats a character three times or more, or
spells a word letter by letter is read as a disguised word.  Its possible readings form a lattice:
each character may stand for the letters that it looks like or, if it is no letter, for nothing, and
a run of one character for one or two of it.  Viterbi decoding finds the reading with the least cost
under the channel and a Kneser-Ney character model of the labelled texts' words.

All disguised tokens of a batch are decoded side by side, with states and costs in arrays.  Four
characters in a row that have one reading each leave one state, so a lattice falls into stretches that
are decoded on their own, and characters outside them stand for themselves.  A stretch of more than
LONGEST characters is no word: it is read in pieces of that length, each as a word of its own.

The restored words are then scored.  Features are words and word beginnings of four to six letters,
each weighed by how much oftener it is among the words of toxic documents than of others (the
logarithm, less its standard error).  A document's score is a logistic function of its highest weight,
the sum of its words' weights and the number of its words.

``train`` learns weights from about ``sample`` documents of either label, chosen by a hash of their id
among those that may be learnt from; the decoder's character model counts the words of all documents
that may be learnt from.  Texts are read whole.  Cases: a null or empty text scores as one without any
toxic word; contradictory labels of one document count as toxic; null labels teach nothing; without
labels of both kinds every text scores 0; repeated rows each get their row.
"""

from __future__ import annotations

import re
from collections import Counter
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .charlm import END, ORDER, START, CharModel, grams, padded
from .common import discard, held, map_batches, release, slices, staged
from .fasttok import U64, HashIndex, ragged
from .langid import unit_hash
from .words import ALNUM, LETTER, SPACE, codes, distinct, hashes, kinds, portions, runs, strings, utf8, words

#: The letters that a character is used in place of.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l", "¡": "i",
}
#: Stands for any vowel.
MASK, VOWELS = "*#", "aeiou"
#: Bits that the channel charges: a look-alike, a vowel behind a mask, a character that stands for nothing, and one or two of a run.
LOOK, VOWEL, NOTHING, ONCE, TWICE, AS_IS = 0.5, 3.0, 5.0, 0.7, 1.3, 0.05
SUSPICIOUS = set(LOOKS_LIKE) | set(MASK)
#: What may begin or end a disguised word, beside letters, digits and underscores.
OPENS, CLOSES = set("@$€£¡!|+(<_"), set("@$€£|+*#_")
WORD = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"([^\W\d_])\1\1")
SPELLED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*][^\W_]){2,}(?!\S)")
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: Characters of a stretch that are decoded as one word, and stretches that are decoded side by side.
LONGEST, BESIDE = 256, 256
#: Tokens, and characters after their contexts, that a worker remembers before it starts anew.
MAX_TOKENS, MAX_FOLLOWING = 1 << 18, 1 << 18
#: Documents of the sample that a feature must occur in, and the documents' worth of labels that it must explain.
LEAST_DOCUMENTS, LEAST_CREDIT = 5, 0.6
#: The decoder's model leaves out n-grams rarer than 1 in so many of all characters read.
RAREST = 1 << 18


def readings(c: str, n: int) -> list[tuple[str, float]]:
    """What n times the character c may stand for, and the bits of each reading."""
    if c.isalpha():
        letters = [(c, AS_IS)]
    elif c in MASK:
        letters = [(v, VOWEL) for v in VOWELS]
    else:
        letters = [(x, LOOK) for x in LOOKS_LIKE.get(c, "")]
    ways = [(x, bits + (0 if n == 1 else ONCE if n > 2 else 3.0)) for x, bits in letters]
    if n > 1:
        ways += [(x + x, 2 * bits + (TWICE if n > 2 else 0.2)) for x, bits in letters]
    if not c.isalpha():
        ways.append(("", NOTHING * min(n, 3)))
    return ways


def lattice(token: str) -> list[tuple[str, int]]:
    """A token's runs of one character; three and more read alike."""
    return [(m[1], min(3, len(m[0]))) for m in re.finditer(r"(.)\1*", token, re.S)]


class Decoder:
    """Viterbi decoding of lattices, of many tokens at once.

    A context, the last ORDER - 1 characters read, is a number of 12 bits a character: 0 for the start
    mark, 1 for the end mark, 2 for any character that the model does not know, and the model's own
    characters from 3.  What a character costs after a context is remembered.
    """

    BITS, KNOWN = 12, (1 << 12) - 3

    def __init__(self, model: CharModel):
        self.model = model
        known = model.alphabet[~np.isin(model.alphabet, [ord(START), ord(END), 0xFFFF])][: self.KNOWN]
        self.points = np.concatenate(([ord(START), ord(END), 0xFFFF], known)).astype(np.uint16)
        self.number = {chr(c): i + 3 for i, c in enumerate(known.tolist())}
        self.mask = U64((1 << self.BITS * (ORDER - 1)) - 1)
        self.index, self.bits = HashIndex(12), np.zeros(1 << 10)
        # A column is a run of a character; its ways are its readings: up to two characters, a cost and a text.
        self.columns: dict[tuple[str, int], int] = {}
        self.first, self.ways, self.plain = [], [], []
        self.one, self.two, self.cost, self.text = [], [], [], []

    def _column(self, run: tuple[str, int]) -> int:
        got = self.columns.get(run)
        if got is None:
            ways = readings(*run)
            got = self.columns[run] = len(self.first)
            self.first.append(len(self.one)), self.ways.append(len(ways)), self.plain.append(len(ways) == 1 and len(ways[0][0]) == 1)
            for text, bits in ways:
                at = [self.number.get(c, 2) for c in text] + [-1, -1]
                self.one.append(at[0]), self.two.append(at[1]), self.cost.append(bits), self.text.append(text)
        return got

    def _follow(self, context: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Bits of characters after contexts."""
        if self.index.n > MAX_FOLLOWING:
            self.index, self.bits = HashIndex(12), np.zeros(1 << 10)
        key = (context << U64(self.BITS)) | char.astype(np.uint64)
        h = (key + U64(1)) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(31)
        h = h * U64(0xBF58476D1CE4E5B9) | U64(1)
        at = self.index.find(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, place = np.unique(h[miss], return_index=True)
            key = key[miss[place]]
            x = self.points[np.stack([(key >> U64(self.BITS * k)) & U64((1 << self.BITS) - 1) for k in range(ORDER - 1, -1, -1)], axis=1).astype(np.int64)].ravel()
            n = self.index.n
            while n + len(new) > len(self.bits):
                self.bits = np.concatenate((self.bits, np.zeros_like(self.bits)))
            self.bits[n : n + len(new)] = self.model.bits_at(x, np.arange(ORDER - 1, len(x), ORDER))
            self.index.add(new, np.arange(n, n + len(new), dtype=np.int32))
            at[miss] = self.index.find(h[miss])
        return self.bits[at]

    def _read(self, context: np.ndarray, cost: np.ndarray, char: np.ndarray) -> None:
        """Reads a character where there is one (not -1), in place."""
        there = np.flatnonzero(char >= 0)
        cost[there] += self._follow(context[there], char[there])
        context[there] = ((context[there] << U64(self.BITS)) | char[there].astype(np.uint64)) & self.mask

    def _context(self, before: list[int]) -> int:
        """The context after the plain columns before."""
        out = 0
        for c in before[-(ORDER - 1) :]:
            out = (out << self.BITS) | self.one[self.first[c]]
        return out

    def decode(self, tokens: list[str], breaks: bool = False) -> list[list[str]]:
        """The words of each token's best reading. breaks: words may end between any two characters."""
        stretches, parts = [], []
        if len(self.columns) >= 1 << 16:
            for x in (self.columns, self.first, self.ways, self.plain, self.one, self.two, self.cost, self.text):
                x.clear()
        for token in tokens:
            own = [self._column(r) for r in lattice(token)]
            at, i, cut = [], 0, -1
            while i < len(own):
                if not breaks and self.plain[own[i]]:
                    at.append(self.text[self.first[own[i]]])
                    i += 1
                    continue
                # Up to ORDER - 1 plain characters in a row, or the token's end.
                end, plain = i, 0
                while end < len(own) and plain < ORDER - 1 and end - i < LONGEST:
                    plain = plain + 1 if not breaks and self.plain[own[end]] else 0
                    end += 1
                at.append(len(stretches))
                stretches.append((own[i:end], 0 if cut == i else self._context(own[max(0, i - ORDER + 1) : i]), plain < ORDER - 1))
                if plain < ORDER - 1 and end < len(own):
                    cut = end
                    at.append(" ")
                i = end
            parts.append(at)
        read = self._viterbi(stretches, breaks)
        return ["".join(x if isinstance(x, str) else read[x] for x in at).split() for at in parts]

    def _viterbi(self, stretches: list[tuple[list[int], int, bool]], breaks: bool) -> list[str]:
        out = [""] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda k: len(stretches[k][0]))
        for a in range(0, len(order), BESIDE):
            some = order[a : a + BESIDE]
            for k, text in zip(some, self._side_by_side([stretches[k] for k in some], breaks)):
                out[k] = text
        return out

    def _side_by_side(self, stretches: list[tuple[list[int], int, bool]], breaks: bool) -> list[str]:
        first, ways = np.array(self.first), np.array(self.ways)
        one, two, price = np.array(self.one), np.array(self.two), np.array(self.cost)
        size = np.array([len(c) for c, _, _ in stretches])
        begin, cols = np.cumsum(size) - size, np.array([c for cs, _, _ in stretches for c in cs])
        ends = np.array([e for _, _, e in stretches])
        # States: their stretch, context, cost, and node in the history of choices.
        own, context = np.arange(len(stretches)), np.array([c for _, c, _ in stretches], np.uint64)
        cost, node = np.zeros(len(own)), np.arange(len(own))
        parents, chosen, nodes = [np.full(len(own), -1)], [np.full(len(own), -2)], len(own)
        last: list[tuple] = []

        def least(own, context, cost, parent, way):
            """The cheapest way to each state, as new nodes."""
            nonlocal nodes
            order = np.lexsort((cost, context, own))
            o, c = own[order], context[order]
            order = order[np.append(True, (o[1:] != o[:-1]) | (c[1:] != c[:-1]))]
            parents.append(parent[order]), chosen.append(way[order])
            nodes += len(order)
            return own[order], context[order], cost[order], np.arange(nodes - len(order), nodes)

        for t in range(int(size.max(initial=0))):
            done = size[own] <= t
            if done.any():
                last.append((own[done], context[done], cost[done], node[done]))
                own, context, cost, node = own[~done], context[~done], cost[~done], node[~done]
            column = cols[begin[own] + t]
            n = ways[column]
            at, way = np.repeat(np.arange(len(own)), n), ragged(first[column], n)
            new, paid = context[at], cost[at] + price[way]
            self._read(new, paid, one[way])
            self._read(new, paid, two[way])
            own, context, cost, node = least(own[at], new, paid, node[at], way)
            if breaks:
                inside = np.flatnonzero(context != 0)
                over = cost[inside] + self._follow(context[inside], np.ones(len(inside), np.int64))
                own, context, cost, node = least(np.append(own, own[inside]), np.append(context, np.zeros(len(inside), np.uint64)), np.append(cost, over), np.append(node, node[inside]), np.append(np.full(len(own), -2), np.full(len(inside), -1)))
        last.append((own, context, cost, node))
        own, context, cost, node = (np.concatenate(x) for x in zip(*last))
        ending = np.flatnonzero(ends[own] & (context != 0))
        cost[ending] += self._follow(context[ending], np.ones(len(ending), np.int64))
        order = np.lexsort((cost, own))
        best = order[np.append(True, own[order][1:] != own[order][:-1])]
        parent, way = np.concatenate(parents).tolist(), np.concatenate(chosen).tolist()
        out = []
        for k in node[best].tolist():
            text = []
            while k >= 0:
                if way[k] != -2:
                    text.append(self.text[way[k]] if way[k] >= 0 else " ")
                k = parent[k]
            out.append("".join(reversed(text)))
        return out


def features(word: str) -> list[str]:
    """What a word is weighed by: itself, and its beginnings."""
    return ["=" + word] + [word[:n] for n in PREFIXES if len(word) >= n]


def tail(t: int, n: int, p: float) -> float:
    """Probability of t or more of n, each with probability p."""
    log = lambda k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * np.log(p) + (n - k) * np.log1p(-p)
    return float(sum(np.exp(log(k)) for k in range(t, n + 1)))


class ToxicityModel:
    """Weights of features, the character model, and the logistic function."""

    def __init__(self, weights: dict[str, float], chars: CharModel | None = None, name: str = ""):
        self.weights, self.name, self.chars = weights, name, chars
        self.bias, self.slopes = 0.0, np.zeros(3)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.slopes, -50, 50)))


class Weights:
    """The weights of words, by their own hash and their beginnings', for arrays of words."""

    def __init__(self, weights: dict[str, float]):
        self.of = {}
        for n, some in ((0, [f for f in weights if f[0] == "="]), *((n, [f for f in weights if f[0] != "=" and len(f) == n]) for n in PREFIXES)):
            x, first = codes([f.removeprefix("=") for f in some])
            index = HashIndex(max(4, 2 * len(some)).bit_length())
            index.add(hashes().spans(hashes().prefix(x), first[:-1], first[1:] - 1), np.arange(1, len(some) + 1, dtype=np.int32))
            self.of[n] = index, np.array([0.0] + [weights[f] for f in some])

    def __call__(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The highest weight of each word's features, 0 if none has any."""
        out = np.zeros(len(starts))
        for n, (index, weight) in self.of.items():
            own = np.flatnonzero(ends - starts >= n) if n else np.arange(len(starts))
            found = index.find(hashes().spans(prefix, starts[own], starts[own] + n if n else ends[own]))
            out[own] = np.maximum(out[own], weight[np.maximum(found, 0)])
        return out


class Reader:
    """The evidence in texts; what a disguised token weighs is remembered."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.decoder = Decoder(model.chars)
        self.weights = Weights(model.weights)
        odd = kinds() & ALNUM != 0
        odd &= kinds() & LETTER == 0
        odd[[ord(c) for c in SUSPICIOUS]] = True
        #: Code points that make a token one to be decoded.
        self.odd = odd
        self._anew()

    def _anew(self) -> None:
        self.index = HashIndex(12)
        #: Of each token that is not made of plain words: its weight, and the number of the word that has it.
        self.weight, self.word = np.zeros(1 << 10), np.full(1 << 10, -1, np.int32)
        self.words: list[str] = []

    def _weight(self, word: str) -> float:
        w = self.model.weights
        return max([w.get(f, 0.0) for f in features(word)])

    def restore(self, tokens: list[str]) -> list[list[str]]:
        """The words of each of some lower-case tokens without white space."""
        out: list[list[str]] = []
        spelled, disguised = [], []
        for k, token in enumerate(tokens):
            core = stripped(token)
            if SPELLED.fullmatch(core):
                out.append([])
                spelled.append((k, joined(core)))
                continue
            out.append(WORD.findall(core))
            if RUN.search(core) or (any(c in SUSPICIOUS for c in core) and any(c.isalpha() for c in core)):
                disguised.append((k, core))
        for some, breaks in ((spelled, True), (disguised, False)):
            for (k, _), found in zip(some, self.decoder.decode([core for _, core in some], breaks)):
                out[k] += found
        return out

    def _learn(self, h: np.ndarray, tokens: list[str]) -> None:
        n = self.index.n
        while n + len(tokens) > len(self.weight):
            self.weight, self.word = np.append(self.weight, np.zeros_like(self.weight)), np.append(self.word, np.full_like(self.word, -1))
        for i, found in enumerate(self.restore(tokens), n):
            w, word = max(((self._weight(x), x) for x in found), default=(0.0, ""))
            if w > 0:
                self.weight[i], self.word[i] = w, len(self.words)
                self.words.append(word)
        self.index.add(h, np.arange(n, n + len(tokens), dtype=np.int32))

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[str]]]:
        """A row a text: highest weight, logarithms of one and all weights and, if there are any, of one and all distinct tokens; and its words with a weight."""
        x, found = np.zeros((len(texts), 3)), []
        for at, low in portions(texts):
            x[at : at + len(low)], more = self._portion(low)
            found += more
        return x, found

    def _portion(self, low: list[str]) -> tuple[np.ndarray, list[list[str]]]:
        if self.index.n > MAX_TOKENS:
            self._anew()
        x, first = codes(low)
        kind = kinds()[x]
        starts, ends = runs(kind & SPACE == 0)
        owner = np.searchsorted(first, starts, side="right") - 1
        prefix = hashes().prefix(x)
        found: list[dict[str, float]] = [{} for _ in low]
        # Words are runs of letters. A token is taken apart further if it holds a digit or a look-alike, a character thrice, or single letters alone.
        letter = kind & LETTER != 0
        a, b = runs(letter)
        token = np.searchsorted(starts, a, side="right") - 1
        thrice = np.flatnonzero(letter[:-2] & (x[:-2] == x[1:-1]) & (x[:-2] == x[2:]))
        odd = np.zeros(len(starts), bool)
        odd[np.searchsorted(starts, np.concatenate((np.flatnonzero(self.odd[x]), thrice)), side="right") - 1] = True
        several = np.bincount(token, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
        single = np.bincount(token, b - a == 1, len(starts)) if len(starts) else several
        odd |= (several >= 3) & (single == several)
        plain = np.flatnonzero(~odd[token])
        w = self.weights(prefix, a[plain], b[plain])
        heavy = np.flatnonzero(w > 0)
        for k, word, weight in zip(owner[token[plain[heavy]]].tolist(), strings(x, a[plain[heavy]], b[plain[heavy]]), w[heavy].tolist()):
            found[k][word] = weight
        odd = np.flatnonzero(odd)
        h = hashes().spans(prefix, starts[odd], ends[odd])
        number = self.index.find(h)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            new, place = np.unique(h[miss], return_index=True)
            place = odd[miss[place]]
            self._learn(new, strings(x, starts[place], ends[place]))
            number[miss] = self.index.find(h[miss])
        heavy = np.flatnonzero(self.weight[number] > 0)
        for k, i in zip(owner[odd[heavy]].tolist(), number[heavy].tolist()):
            found[k][self.words[self.word[i]]] = float(self.weight[i])
        # Words spelled with a space between letters: where two tokens of single letters and separators follow one another.
        letters = np.cumsum(np.append(0, kind & ALNUM != 0))
        near = 2 * (letters[ends] - letters[starts]) - 1 == ends - starts
        near = owner[:-1][near[:-1] & near[1:] & (starts[1:] == ends[:-1] + 1)] if len(starts) else np.zeros(0, np.int64)
        cores = [(k, joined(m[0])) for k in np.unique(near).tolist() for m in SPELLED.finditer(low[k]) if " " in m[0]]
        for (k, _), some in zip(cores, self.decoder.decode([core for _, core in cores], True)):
            for word in some:
                if (weight := self._weight(word)) > 0:
                    found[k][word] = weight
        out = np.zeros((len(low), 3))
        for k, f in enumerate(found):
            if f:
                out[k] = max(f.values()), np.log1p(sum(f[w] for w in sorted(f))), np.log1p(len(set(low[k].split())))
        return out, [sorted(f) for f in found]


def joined(core: str) -> str:
    """A spelled word without what stands between its letters."""
    return re.sub(r"[ .\-_*]", "", core)


def stripped(token: str) -> str:
    """A token without the punctuation at its ends that is no part of a disguised word."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum() and token[a] not in OPENS:
        a += 1
    end = b
    while end > a and not token[end - 1].isalnum():
        end -= 1
    if b - end >= 3:
        return token[a:end]
    while b > a and not token[b - 1].isalnum() and token[b - 1] not in CLOSES:
        b -= 1
    return token[a:b]


def reader(sent) -> Reader:
    """The worker's reader of a broadcast model."""
    return held(f"toxicity {sent.value.name}", lambda: Reader(sent.value))


def character_model(docs: DataFrame, learnable: Column, text_col: str = "text") -> CharModel:
    """A model of the words of all documents that may be learnt from.

    Counts of its n-grams are added up over the corpus; those rarer than 1 in RAREST of all characters
    are left out, so fewer than RAREST come to the driver.
    """

    def counted(batches):
        release()
        for batch in slices(batches):
            for _, low in portions(batch.column("text").to_pylist(), 1 << 20):
                x, _ = codes(low)
                a, b = words(x)
                one, n = distinct(x, a, b)
                y, at, word = padded(x, a[one], b[one])
                keys, n = grams(y, at, n[word])
                yield pa.RecordBatch.from_arrays([utf8(keys, ORDER), pa.array(n)], ["gram", "n"])

    rows = docs.where(F.coalesce(learnable, F.lit(False))).select(F.col(text_col).cast("string").alias("text"))
    counts = staged(rows.mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "n-grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = {r["gram"]: r["n"] for r in counts.where(F.col("n") * RAREST >= total).toLocalIterator()}
    discard(counts)
    return CharModel(found, of_grams=True)


def train(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = 4000, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model from about ``sample`` documents of either label."""
    marked = labels.where(F.coalesce(learnable, F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic"))
    sizes = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel({})
    rate = F.when(F.col("toxic"), min(1.0, sample / sizes[True])).otherwise(min(1.0, sample / sizes[False]))
    chosen = marked.where(unit_hash("id", seed=seed) < rate)
    # At most about 2 * sample rows of an id and a flag: a bounded broadcast, and so many texts, read thrice.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "toxic")
    # Copies of a document share all their words, which would all seem to tell: those whose least word hash is one count once.
    words_of = F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.xxhash64(w, F.lit(seed)))
    rows = staged(rows.withColumn("least", F.array_min(words_of)).dropDuplicates(["toxic", "least"]).drop("least"), "toxicity-sample")
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel({})

    def count(batches):
        docs_of, words_of, total = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}, {True: 0, False: 0}
        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set(WORD.findall(text.lower()))
                got = Counter(f for w in words for f in features(w))
                docs_of[toxic].update(got.keys())
                words_of[toxic].update(got)
                total[toxic] += len(words)
        for toxic, c in docs_of.items():
            # The empty feature has the number of documents' distinct words.
            rows = [(f, n, words_of[toxic][f]) for f, n in c.items()] + [("", 0, total[toxic])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([toxic] * len(rows)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["feature", "toxic", "docs", "words"])

    counted = rows.mapInArrow(count, "feature string, toxic boolean, docs long, words long")
    of = lambda c, yes: F.sum(F.when(F.col("toxic") == yes, F.col(c)).otherwise(0)).alias(f"{c}_{'toxic' if yes else 'clean'}")
    table = counted.groupBy("feature").agg(of("docs", True), of("docs", False), of("words", True), of("words", False))
    # What occurs in some toxic documents: bounded by the sample.
    least = min(LEAST_DOCUMENTS, max(3, sizes[True] // 100))
    found = {r["feature"]: tuple(r)[1:] for r in table.where((F.col("feature") == "") | (F.col("docs_toxic") >= least)).toLocalIterator()}
    _, _, all_toxic, all_clean = found.pop("", (0, 0, 1, 1))
    share = sizes[True] / (sizes[True] + sizes[False])
    weights = {}
    for f, (t, c, wt, wc) in found.items():
        w = np.log((wt + 0.5) / (all_toxic + 1)) - np.log((wc + 0.5) / (all_clean + 1)) - np.sqrt(1 / (wt + 0.5) + 1 / (wc + 0.5))
        # Among so many features some are toxic by chance; fewer than a tenth of one is let through.
        if w > 1.5 and tail(t, t + c, share) * len(found) < 0.1:
            weights[f] = (float(w), t + c)
    weights = _explaining(rows, weights)
    model = ToxicityModel(weights, character_model(docs, learnable, text_col), f"{seed}-{id(weights)}")
    _fit(model, rows)
    discard(rows)
    return model


def _explaining(rows: DataFrame, weights: dict[str, tuple[float, int]], rounds: int = 4) -> dict[str, float]:
    """The features that explain why documents are toxic, not those that merely keep such documents company.

    Copies of one toxic document share all their rare words.  So each toxic document's label is shared
    out among its features, in proportion to how much of their documents they explain elsewhere; this
    is repeated, and features that are left with less than LEAST_CREDIT documents' worth go. weights: with
    each feature's documents of either label.
    """
    names = sorted(weights)
    sent = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        number = sent.value
        got = [sorted({number[f] for w in set(WORD.findall(t.lower())) for f in features(w) if f in number}) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32()))], ["found"])

    found = [r["found"] for r in map_batches(rows.where("toxic"), run, "found array<int>").collect() if r["found"]]  # bounded by the sample
    sent.unpersist()
    if not found:
        return {}
    doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
    feature = np.concatenate([np.array(x) for x in found])
    seen = np.array([weights[f][1] for f in names]) + 1.0
    # Of a word and its beginnings with the same documents, the shortest speaks for all.
    rate = np.array([weights[f][0] / (1 + 0.01 * len(f)) for f in names])
    for _ in range(rounds):
        share = rate[feature] / np.maximum(np.bincount(doc, rate[feature]), 1e-300)[doc]
        credit = np.bincount(feature, share, len(names))
        rate = credit / seen
    return {f: weights[f][0] for f, c in zip(names, credit.tolist()) if c >= LEAST_CREDIT}


def _fit(model: ToxicityModel, rows: DataFrame, ridge: float = 1e-3) -> None:
    """Logistic regression of the label on the evidence, by Newton's method."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got, _ = reader(sent).evidence(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(got[:, k]) for k in range(3))], ["toxic", "most", "all", "tokens"])

    got = map_batches(rows, run, "toxic boolean, most double, all double, tokens double").collect()  # bounded by the sample
    sent.unpersist()
    y = np.array([r["toxic"] for r in got], float)
    x = np.array([[1.0, r["most"], r["all"], r["tokens"]] for r in got])
    weight = np.ones(len(y))
    b = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        grad = x.T @ (weight * (p - y)) + ridge * len(y) * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(4)
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    model.bias, model.slopes = float(b[0]), b[1:]


def scored(sent, texts: list[str | None]) -> tuple[np.ndarray, list[list[str]]]:
    """Scores of texts under a broadcast model, and the words that made them."""
    if sent.value.chars is None:
        return np.zeros(len(texts)), [[] for _ in texts]
    got, words = reader(sent).evidence(texts)
    return sent.value.scores(got), words


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, words), a row a document; words are the restored words with a weight."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, words = scored(sent, batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(words, pa.list_(pa.string()))], ["doc_id", "score", "predicted", "words"])

    return map_batches(rows, run, f"doc_id {kind}, score double, predicted int, words array<string>")
