"""The character models and the decoder against plain versions of what they compute, and on very long tokens."""

import itertools
import random
import string
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terracell.llm import charlm, langid, prefix_counts, toxicity

PAD = charlm.START * (charlm.ORDER - 1)
rng = random.Random(31)
WORDS = Counter("".join(rng.choice(["ka", "lo", "mi", "tu", "re", "sch", "o", "é", "日"]) for _ in range(rng.randint(1, 4))) for _ in range(400))
WORDS["grumbold"] = 30


class Plain:
    """Interpolated Kneser-Ney, by its definition, in dictionaries."""

    def __init__(self, words):
        self.counts = [None] + [Counter() for _ in range(charlm.ORDER)]
        for w, c in words.items():
            marked = PAD + w + charlm.END
            for i in range(len(PAD), len(marked)):
                self.counts[charlm.ORDER][marked[i - charlm.ORDER + 1 : i + 1]] += c
        for n in range(charlm.ORDER - 1, 0, -1):
            for gram in self.counts[n + 1]:
                self.counts[n][gram[1:]] += 1
        self.alphabet = {c for c in self.counts[1]}
        self.discount, self.total, self.followers = [0], [None], [None]
        for n in range(1, charlm.ORDER + 1):
            c = Counter(self.counts[n].values())
            d = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
            self.discount.append(min(max(d, 0.1), 0.95))
            total, followers = defaultdict(int), defaultdict(int)
            for gram, k in self.counts[n].items():
                total[gram[:-1]] += k
                followers[gram[:-1]] += 1
            self.total.append(total)
            self.followers.append(followers)

    def p(self, context, char, n=charlm.ORDER):
        if n == 0:
            return 1 / (len(self.alphabet) + 1)
        context = context[len(context) - n + 1 :]
        below = self.p(context, char, n - 1)
        total = self.total[n].get(context, 0)
        if not total:
            return below
        d = self.discount[n]
        return max(self.counts[n][context + char] - d, 0) / total + d * self.followers[n][context] / total * below

    def bits(self, word):
        marked = PAD + word + charlm.END
        return -sum(np.log2(self.p(marked[i - charlm.ORDER + 1 : i], marked[i])) for i in range(len(PAD), len(marked)))


def test_model_equals_plain_kneser_ney():
    plain, model = Plain(WORDS), charlm.CharModel(WORDS)
    words = [*list(WORDS)[:100], "", "zzz", "grumbild", "kaXlo", "日日", "mimimimimi"]
    np.testing.assert_allclose(model.word_bits(words), [plain.bits(w) for w in words], rtol=1e-9)
    for context in ("\x02\x02\x02\x02", "\x02\x02\x02k", "umbo", "zzzz", "kalo", "xxka"):
        each = [*plain.alphabet, "\uffff"]
        x = np.array([ord(c) for a in each for c in context + a], np.uint16)
        assert np.exp2(-model.bits_at(x, np.arange(4, len(x), 5))).sum() == pytest.approx(1, abs=1e-9)


def test_model_of_grams_equals_that_of_words():
    grams = Counter()
    for w, c in WORDS.items():
        for i in range(len(w) + 1):
            grams[(PAD + w + charlm.END)[i : i + charlm.ORDER]] += c
    one, two = charlm.CharModel(WORDS), charlm.CharModel(grams, of_grams=True)
    assert np.array_equal(one.keys, two.keys) and np.allclose(one.logs, two.logs) and one.base == two.base


def test_scorer_sums_the_words_of_whole_texts():
    models = langid.LanguageModels(["a", "b"], [charlm.CharModel(WORDS), charlm.CharModel({"grumbold": 3, "tu": 1})])
    texts = ["Kalo, MI tu... grumbold42tu", None, "", "12 ½", "日 é" * 500, "kalo " * 5000]
    bits, chars = langid.Scorer(models).texts(texts)
    want = [["kalo", "mi", "tu", "grumbold", "tu"], [], [], [], ["日", "é日"] + ["é日"] * 498 + ["é"], ["kalo"] * 5000]
    for k, plain in enumerate((Plain(WORDS), Plain({"grumbold": 3, "tu": 1}))):
        np.testing.assert_allclose(bits[:, k], [sum(plain.bits(w) for w in ws) for ws in want], rtol=1e-9)
    assert chars.tolist() == [sum(len(w) + 1 for w in ws) for ws in want]


def cost(plain, path, breaks):
    """Bits of one path through a lattice, and what it reads."""
    text, bits = "", 0.0
    for letters, more in path:
        text += letters
        bits += more
    return sum(plain.bits(w) for w in text.split(" ") if w or not breaks) + bits - (plain.bits("") if not text else 0), text


@pytest.mark.parametrize("token", ["gr0mb0ld", "k4l0", "m1m1", "@1o", "kaaalo", "gr*mb0ld", "4$", "tu11re", "lolomituka0mituremire3loka", "1kalokalo1"])
def test_decoder_finds_the_least_of_all_paths(token):
    plain, decoder = Plain(WORDS), toxicity.Decoder(charlm.CharModel(WORDS))
    paths = itertools.product(*[toxicity.readings(*run) for run in toxicity.lattice(token)])
    costs = defaultdict(lambda: np.inf)
    for bits, text in (cost(plain, p, False) for p in paths):
        costs[text] = min(costs[text], bits)
    got = decoder.decode([token, "1" + token, token])
    assert got[0] == got[2]
    assert costs["".join(got[0])] == pytest.approx(min(costs.values()))


@pytest.mark.parametrize("token", ["grumbold", "kalomi", "0ka", "tulo1re"])
def test_decoder_finds_the_least_of_all_cuts(token):
    plain, decoder = Plain(WORDS), toxicity.Decoder(charlm.CharModel(WORDS))
    costs = defaultdict(lambda: np.inf)
    for path in itertools.product(*[toxicity.readings(*run) for run in toxicity.lattice(token)]):
        for cuts in itertools.product(["", " "], repeat=len(path) - 1):
            joined = [(letters + cut, bits) for (letters, bits), cut in zip(path, [*cuts, ""])]
            bits, text = cost(plain, joined, True)
            costs[" ".join(text.split())] = min(costs[" ".join(text.split())], bits)
    got = " ".join(decoder.decode([token], True)[0])
    assert costs[got] == pytest.approx(min(costs.values()))


def long_tokens(n):
    some = lambda letters: "".join(rng.choice(letters) for _ in range(n))
    return {"letters": some(string.ascii_lowercase), "base64": some(string.ascii_letters + string.digits + "+/"), "hex": some("0123456789abcdef"), "ideographs": some([chr(c) for c in range(0x4E00, 0x5E00)]), "one": "x" * n, "digits": "a" + "01" * (n // 2), "marks": "!" * n + "a", "dashes": "-" * n}


def test_long_tokens_take_seconds():
    reader = toxicity.Reader(toxicity.ToxicityModel({"=grumbold": 2.0}, charlm.CharModel(WORDS), "m"))
    began = time.time()
    for kind, token in long_tokens(100_000).items():
        x, words = reader.evidence([token, f"a {token} grumb0ld"])
        assert words[1] == ["grumbold"] and x[1, 0] == 2.0, kind
    assert time.time() - began < 120


@pytest.mark.parametrize("kind", ["letters", "base64", "ideographs", "one", "digits"])
def test_long_tokens_are_counted_in_seconds(kind):
    path, text = public_tokenizers.path("byte_bpe_50k.json"), long_tokens(1 << 20)[kind]
    library, began = Tokenizer.from_file(path), time.time()
    got = prefix_counts.PrefixCounter(path).prefixes([text])[0]
    assert time.time() - began < 60
    for k in (1, 100, 257, 3001, len(text)):
        assert got[k] == len(library.encode(text[:k], add_special_tokens=False).ids)
