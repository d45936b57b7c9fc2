"""Operator 4: language identification by Kneser-Ney character models.

``train`` fits one model per language on a bounded sample: about ``sample`` documents of each language,
chosen by a hash of their id among those that may be learnt from.  A quarter as many others calibrate
the model: they set the temperature of the score and, per language, the cross-entropy beyond which a
document is rejected as written in none of them.

``identify`` reads every text whole.  A language's cross-entropy is the bits that its model takes for
all words of the text, by their characters; the lowest names the language.  Words, runs of letters and
the marks on them, are found for a batch of texts at once.  A worker remembers the bits of words and, for
new words, those of characters after their contexts, in tables of at most HELD_BYTES each.

Cases: a null text or one without letters is ``und`` with score 0 and is rejected; ties go to the first
language in ascending order; a null language teaches nothing, nor does a null id; with nothing to
learn from, every text is ``und``; repeated rows each get their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .charlm import ORDER, CharModel, padded
from .common import held, map_batches, slices
from .fasttok import HashIndex
from .words import LETTER, codes, hashes, kinds, portions, word_counts, words

#: Bytes of what a worker remembers of words, and of characters, before it starts anew.
HELD_BYTES = 1 << 24
UNKNOWN = "und"


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null where the id is."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def unit_hash(*cols: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / float(1 << 40)


class LanguageModels:
    """Models in ascending order of their language, score temperature and limits of rejection."""

    def __init__(self, languages: list[str], models: list[CharModel]):
        self.languages, self.models = languages, models
        self.name = ""
        self.sharpness = 0.1
        self.mean, self.spread = np.zeros(len(languages)), np.ones(len(languages))
        #: Standard errors, and bits a character, by which a document may exceed its language's mean.
        self.errors, self.margin = 8.0, 1.0

    def predict(self, bits: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From (texts, languages) bits and the characters of each text: best language, score, whether rejected."""
        entropy = bits / np.maximum(chars, 1)[:, None]
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        z = np.exp2(-(entropy - low[:, None]) * self.sharpness * chars[:, None])
        score = 1 / z.sum(axis=1)
        limit = self.mean[best] + self.margin + self.errors * self.spread[best] / np.sqrt(np.maximum(chars, 1))
        return best, score, low > limit


class Memory:
    """Rows of bits by hash, in bounded memory."""

    def __init__(self, columns: int):
        self.columns = columns
        self._anew()

    def _anew(self) -> None:
        self.index, self.rows = HashIndex(12), np.zeros((1 << 10, self.columns))

    def rows_of(self, h: np.ndarray, make) -> np.ndarray:
        """The number of each hash's row; make gives the rows of those at some places of h that are not held."""
        # A row, its place in the hash table, twice as large, and their doubles while they grow.
        if self.index.n * (16 * self.columns + 48) > HELD_BYTES:
            self._anew()
        number = self.index.find(h)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            new, place = np.unique(h[miss], return_index=True)
            n = self.index.n
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[n : n + len(new)] = make(miss[place])
            self.index.add(new, np.arange(n, n + len(new), dtype=np.int32))
            number[miss] = self.index.find(h[miss])
        return number


class Scorer:
    """Bits of whole texts under all models."""

    def __init__(self, models: LanguageModels):
        self.models = models
        self.words, self.chars = Memory(len(models.languages)), Memory(len(models.languages))

    def _bits(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words, languages) bits of the words in x."""
        y, at, word = padded(x, starts, ends)
        h = hashes().spans(hashes().prefix(y), at - ORDER + 1, at + 1)
        number = self.chars.rows_of(h, lambda new: np.stack([m.bits_at(y, at[new]) for m in self.models.models], axis=1))
        return np.stack([np.bincount(word, self.chars.rows[number, k], len(starts)) for k in range(self.chars.columns)], axis=1)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) bits, and the characters scored: letters and one end a word; none for a text without letters."""
        bits, chars = np.zeros((len(texts), self.words.columns)), np.zeros(len(texts))
        for at, low in portions(texts):
            own = slice(at, at + len(low))
            bits[own], chars[own] = self._portion(low)
        return bits, chars

    def _portion(self, low: list[str]) -> tuple[np.ndarray, np.ndarray]:
        x, first = codes(low)
        starts, ends = words(x)
        number = self.words.rows_of(hashes().spans(hashes().prefix(x), starts, ends), lambda new: self._bits(x, starts[new], ends[new]))
        owner = np.searchsorted(first, starts, side="right") - 1
        bits = np.stack([np.bincount(owner, self.words.rows[number, k], len(low)) for k in range(self.words.columns)], axis=1)
        chars = np.bincount(owner, ends - starts + 1, len(low))
        chars[~np.logical_or.reduceat(kinds()[x] & LETTER != 0, first[:-1])] = 0
        return bits, chars


def scorer(sent) -> Scorer:
    """The worker's scorer of a broadcast model."""
    return held(f"language {sent.value.name}", lambda: Scorer(sent.value))


def train(docs: DataFrame, learnable: Column, sample: int = 400, seed: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModels:
    """Models from about ``sample`` documents of each language, calibrated on about a quarter as many more."""
    usable = F.coalesce(learnable, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
    known = docs.where(usable)
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return LanguageModels([], [])
    rate = F.create_map(*[F.lit(v) for k in sorted(sizes) for v in (k, min(0.8, sample / sizes[k]))])[F.col(lang_col)]
    rows = known.select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rate.alias("rate"), unit_hash(id_col, seed=seed).alias("u"))

    def counted(batches):
        for batch in slices(batches):
            lang = np.array(batch.column("lang").to_pylist())
            texts_of = batch.column("text").to_pylist()
            for k in np.unique(lang).tolist():
                found, n = word_counts([t for t, own in zip(texts_of, (lang == k).tolist()) if own])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    taught = rows.where("u < rate").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in taught.toLocalIterator():  # bounded by the sample
        counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
    languages = sorted(counts)
    models = LanguageModels(languages, [CharModel(counts[k]) for k in languages])
    models.name = f"{seed}-{id(models)}"
    if languages:
        _calibrate(models, rows.where("u >= rate AND u < 1.25 * rate"))
    return models


def _calibrate(models: LanguageModels, rows: DataFrame) -> None:
    sent = rows.sparkSession.sparkContext.broadcast(models)
    n = len(models.languages)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, chars = scorer(sent).texts(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(chars)], ["lang", "bits", "chars"])

    got = [r for r in map_batches(rows, run, "lang string, bits array<double>, chars double").collect() if r["chars"] and r["lang"] in models.languages]
    sent.unpersist()
    if not got:
        return
    bits, chars = np.array([r["bits"] for r in got]).reshape(len(got), n), np.array([r["chars"] for r in got])
    true = np.array([models.languages.index(r["lang"]) for r in got])
    entropy = bits / chars[:, None]
    for k in range(n):
        own = true == k
        if own.any():
            models.mean[k] = np.median(entropy[own, k])
            models.spread[k] = max(1.0, float(np.sqrt(np.mean((entropy[own, k] - models.mean[k]) ** 2 * chars[own]))))
        else:
            models.mean[k] = np.median(entropy.min(axis=1))

    def loss(sharpness: float) -> float:
        z = -(entropy * chars[:, None]) * sharpness * np.log(2)
        return float(np.mean(np.logaddexp.reduce(z, axis=1) - z[np.arange(len(true)), true]))

    models.sharpness = min((0.001, 0.003, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0), key=loss)


def identify(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected, bits_per_char), a row a document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected, entropy = predictions(sent, batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), pa.array(entropy)], ["doc_id", "lang_pred", "score", "rejected", "bits_per_char"])

    return map_batches(rows, run, f"doc_id {kind}, lang_pred string, score double, rejected boolean, bits_per_char double")


def predictions(sent, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, rejection and bits a character of texts, under a broadcast model."""
    models: LanguageModels = sent.value
    if not models.languages:
        n = len(texts)
        return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool), np.zeros(n)
    bits, chars = scorer(sent).texts(texts)
    best, score, rejected = models.predict(bits, chars)
    empty = chars == 0
    lang = [UNKNOWN if e else models.languages[k] for k, e in zip(best.tolist(), empty.tolist())]
    return lang, np.where(empty, 0.0, score), rejected | empty, bits[np.arange(len(best)), best] / np.maximum(chars, 1)
