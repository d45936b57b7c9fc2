"""The language-model operators on inputs that a smaller job would get wrong."""

import os
import random
import re
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from terracell.llm import neardup
from terracell.llm.common import ship


def edited(rng, base, n):
    """A copy with n words replaced."""
    own = list(base)
    for k in rng.sample(range(len(own)), n):
        own[k] = f"w{rng.randrange(10**9)}"
    return own


def jaccard(a, b):
    """Plain Jaccard similarity of the shingles of five words, with their counts."""
    one, two = (Counter(zip(*[x[k:] for k in range(5)])) for x in (a, b))
    return (one & two).total() / (one | two).total()


def test_near_copies_of_a_third_of_all_rows_are_found(spark):
    ship(spark)
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**9)}" for _ in range(248)]
    n = 240
    copies = [edited(rng, base, rng.choice([1, 2])) for _ in range(n // 3)]
    others = [[f"w{rng.randrange(10**9)}" for _ in range(60)] for _ in range(n - len(copies))]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(copies + others)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(d).collect()}
    pairs = [(a, b) for b in range(len(copies)) for a in range(b)]
    frequencies, count = neardup.document_frequencies(d)
    s = neardup.similarities([" ".join(copies[a]) for a, _ in pairs], [" ".join(copies[b]) for _, b in pairs], frequencies, count)
    for (a, b), x in zip(pairs, s):
        if 0.85 <= jaccard(copies[a], copies[b]) < 1:
            assert x >= neardup.SIMILARITY and got[a] == got[b]
    assert all(got[i] == i for i in range(len(copies), n))


@pytest.mark.parametrize("seed", [31, 32, 33])
def test_pairs_by_their_differences_from_a_leader_lose_none(spark, seed):
    """Copies of copies under one leader, of various lengths: each pair of 0.8 or more, one of them not of the leader's component, is a candidate; few others are."""
    ship(spark)
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(10**9)}" for _ in range(120)]]
    for _ in range(180):
        own = list(rng.choice(texts))
        for k in rng.sample(range(len(own)), rng.randrange(1, 7)):
            own[k] = f"v{rng.randrange(40)}"
        cut = rng.randrange(4) * rng.randrange(2)
        texts.append(own[cut:] if rng.randrange(2) else own + [f"u{rng.randrange(9)}" for _ in range(3 * cut)])
    texts = [" ".join(t) for t in dict.fromkeys(map(tuple, texts))]
    n = len(texts)
    held = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    frequencies, count = neardup.document_frequencies(held.repartition(3))
    pairs = [(a, b) for b in range(n) for a in range(b)]
    s = neardup.similarities([texts[a] for a, _ in pairs], [texts[b] for _, b in pairs], frequencies, count)
    like = {p for p, x in zip(pairs, s) if x >= 0.8}
    root = [0 if (0, i) in like or i == 0 else i for i in range(n)]
    placed = spark.createDataFrame([(0, 7, i, r) for i, r in enumerate(root)], "band int, key long, id long, root long")
    leaders = spark.createDataFrame([(0, 7, 0)], "band int, key long, leader long")
    tested = spark.createDataFrame([(0, i, (0, i) in like) for i in range(1, n)], "a long, b long, similar boolean")
    roots = spark.createDataFrame([(i, r, r) for i, r in enumerate(root) if (0, i) in like or i == 0], "id long, root long, before long")
    sent = spark.sparkContext.broadcast((frequencies.astype("uint32"), count))
    found = {(r["a"], r["b"]) for r in neardup._rest(placed, leaders, tested, roots, held, sent, 0.8, []).collect()}
    wanted = {(a, b) for a, b in like if root[a] != root[b]}
    assert wanted and wanted <= found
    assert len(found) < 0.5 * len(pairs)


def test_texts_that_share_or_lack_an_id(spark):
    import corpus_pipeline

    rng = random.Random(22)
    base = [[f"w{rng.randrange(10**9)}" for _ in range(200)] for _ in range(4)]
    near = [" ".join(edited(rng, b, 1)) for b in base]
    a, b, c, e = (" ".join(x) for x in base)
    # Two texts with id 1, each with a near copy; near copies without id; repeated rows; texts without words.
    rows = [(1, a), (1, b), (2, near[0]), (3, near[1]), (None, c), (None, near[2]), (4, e), (4, e), (None, near[3]), (5, ""), (5, ""), (5, "?!"), (None, ""), (None, None)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, mark string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, d, "").collect())
    left = [k for k in got if k[1] in (c, near[2])]
    assert len(left) == 1 and got.pop(left[0]) == 1
    assert got == Counter([(1, a), (1, b), (4, e), (5, ""), (5, "?!"), (None, ""), (None, None)])
    found = sorted((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(d).where("doc_id < 4").collect())
    assert found == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_stage_keeps_what_all_pairs_in_plain_python_keep(spark):
    import corpus_pipeline

    rng = random.Random(23)
    word = lambda: f"w{rng.randrange(10**9)}"
    big, texts = [word() for _ in range(248)], []
    for g in range(16):
        base = [word() for _ in range(rng.randint(60, 150))]
        texts += [edited(rng, base, rng.randint(0, 3)) for _ in range(rng.randint(1, 8))]
    texts += [edited(rng, big, rng.randint(1, 2)) for _ in range(len(texts) // 2)]
    rng.shuffle(texts)
    bags = [Counter(zip(*[t[k:] for k in range(5)])) for t in texts]
    df, n = Counter(x for b in bags for x in b), len(texts)
    weighted = [{x: c * (1 + neardup.SPREAD * log((n + 1) / (df[x] + 1)) / log(n + 1)) for x, c in b.items()} for b in bags]
    root = list(range(n))
    for b in range(n):
        for a in range(b):
            x, y = weighted[a], weighted[b]
            shared = sum(min(w, y[k]) for k, w in x.items() if k in y)
            if shared >= 0.8 * (sum(x.values()) + sum(y.values()) - shared):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, "").collect()} == set(root)
    assert 16 <= len(set(root)) < n / 2


def classes(spark, texts, parts=3):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(d).collect()}


def components_of(n, alike):
    """The least number of each one's component, for pairs that are alike."""
    root = list(range(n))
    for a, b in alike:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root


def plain_words(text):
    """Words as the operator has them, one by one."""
    out = []
    for w in re.findall(r"[^\W_]+", text.lower()):
        out += re.findall(r"[\u0e00-\u0fff\u3040-\u30ff\u3400-\u9fff]|[^\u0e00-\u0fff\u3040-\u30ff\u3400-\u9fff]+", w)
    return out


def plain_weights(texts):
    """TF-IDF weights of each text's shingles of five words, in plain Python."""
    bags = []
    for t in texts:
        w = plain_words(t or "")
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df, n = Counter(x for b in bags for x in b), len(texts)
    return [{x: c * (1 + neardup.SPREAD * log((n + 1) / (df[x] + 1)) / log(n + 1)) for x, c in b.items()} for b in bags]


def weighted_jaccard(x, y):
    shared = sum(min(w, y[k]) for k, w in x.items() if k in y)
    total = sum(x.values()) + sum(y.values()) - shared
    return shared / total if shared else 0.0


def test_words_of_other_scripts_and_quotes(spark):
    rng = random.Random(25)
    sentence = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    chinese = "。".join(sentence(20) for _ in range(30))
    changed = chinese[:200] + "\u3402" + chinese[201:]
    prose = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    quoted = [f"\u201c{w}\u201d" if i % 10 == 0 else w for i, w in enumerate(prose)]
    straight = [f'"{w}"' if i % 10 == 0 else w for i, w in enumerate(prose)]
    hindi = " ".join("".join(rng.choice(["\u0915\u093f", "\u0924\u093e", "\u092e"]) for _ in range(3)) for _ in range(60))
    got = classes(spark, [chinese, changed, sentence(600), " ".join(prose), " ".join(quoted), " ".join(straight), hindi, hindi + " \u0915"])
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6}
    assert plain_words("a\u201cb\u201d 日本x_y") == ["a", "b", "日", "本", "x", "y"]
    assert len(neardup.shingles(["a\u201cb\u201d 日本x_y"])[0]) == 2


def test_members_that_leaders_do_not_confirm_find_each_other(spark):
    """One common passage in all texts: they meet in its buckets, few are like the leader, and pairs of near copies among them are still found."""
    rng = random.Random(26)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(120)]
    texts, pairs = [], []
    for _ in range(60):
        own = passage + [word() for _ in range(80)]
        pairs.append((len(texts), len(texts) + 1))
        texts += [own, edited(rng, own, 2)]
    weights = plain_weights([" ".join(t) for t in texts])
    alike = [(a, b) for b in range(len(texts)) for a in range(b) if weighted_jaccard(weights[a], weights[b]) >= 0.8]
    assert set(pairs) <= set(alike)
    got = classes(spark, [" ".join(t) for t in texts])
    assert [got[i] for i in range(len(texts))] == components_of(len(texts), alike)


def test_a_long_chain_of_copies(spark):
    """Copies each a few words from the last: neighbours are alike, the ends are not, and all are one class."""
    rng = random.Random(27)
    own, texts = [f"w{rng.randrange(10**9)}" for _ in range(150)], []
    for _ in range(600):
        texts.append(" ".join(own))
        own = edited(rng, own, 1)
    others = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) for _ in range(1200)]
    got = classes(spark, texts + others, 4)
    assert {got[i] for i in range(600)} == {0} and all(got[i] == i for i in range(600, 1800))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_against_all_pairs_of_the_documents(spark):
    """Every pair of documents of plain TF-IDF weighted Jaccard similarity 0.8 or more, found in plain Python, is in one class; and classes hold nothing else."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    weights = plain_weights([r["text"] for r in rows])
    total = [sum(w.values()) for w in weights]
    order = sorted((i for i in range(len(rows)) if total[i]), key=lambda i: total[i])
    alike = []
    for k, a in enumerate(order):  # no pair whose totals differ by more can be so similar
        for b in order[k + 1 :]:
            if total[a] < 0.8 * total[b]:
                break
            if weighted_jaccard(weights[a], weights[b]) >= 0.8:
                alike.append((a, b))
    d = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(d).collect()}
    ids = [r["doc_id"] for r in rows]
    found = sum(got[ids[a]] == got[ids[b]] for a, b in alike)
    assert len(alike) > 50 and found >= 0.99 * len(alike)
    root = components_of(len(ids), alike)
    joined = Counter(got.values())
    assert sum(n * (n - 1) // 2 for n in joined.values()) <= 1.01 * sum(n * (n - 1) // 2 for n in Counter(root).values())
    print(f"recall of similar pairs: {found} of {len(alike)}")
