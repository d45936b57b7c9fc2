"""The language-model operators against brute force, on awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terracell.llm import chunk_codec, chunking, fingerprints, langid, neardup, packing, prefix_counts, queries, token_files, topk, toxicity, warc
from terracell.llm.common import shared_dir, ship
from terracell.llm.fasttok import Encoder

BYTE, WORD = queries.BYTE_BPE, queries.WORD_BPE
LONG = "The quick brown fox's jumps, over 13 lazy dogs!\n" * 6000
TEXTS = [
    "Hello world, it's fine. They'll see 2024!", "", None, "   \n\n  x  ", "naïve café — “quoted” 😀 日本語 text", "<|endoftext|> and <|startoftext|>!", "Hello world, it's fine. They'll see 2024!",
    LONG, "a", "'ll 're've I'LL don't", "\tTabs\r\nand spaces wide", "ÀÉÎ ßẞ İı ŉ ſ ΣΑΣ ŸǅƱ", "x" * 3000, "word " * 700 + "end",
]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "xx", i, "s", "k", 0) for i, t in enumerate(TEXTS)] + [(3, "   \n\n  x  ", None, 0, "s", "k", 0), (None, "no id here", "en", 0, None, None, None)]
    # Names that operators use themselves come as extra columns.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, part long, key string, ids string, score int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    rng = random.Random(11)
    alphabet = [chr(c) for c in [*range(0, 0x260), *range(0x2000, 0x2030), 0x1F600, 0x4E2D, 0x3002]]
    common = list(" \n'stmdrevlaSTx1. 9\t é<|")
    made = ["".join(rng.choice(common if rng.random() < 0.8 else alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = library(path)
    texts = made + [t or "" for t in TEXTS]
    for text, got in zip(texts, Encoder(path).encode(texts)):
        assert got.tolist() == want(text), repr(text[:80])
    for text in ("'ll go", "'s", "x'", "'"):
        assert Encoder(path).encode([text])[0].tolist() == want(text)


def test_prefix_counts_equal_encoding_every_prefix():
    rng = random.Random(12)
    words = ["hello", "ing", " the", " The", "'ll", "'re", "   ", "\n\n", "<|endoftext|>", "é", "😀", "2024", "aaaa", "."]
    made = ["".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(250)]
    counter, want = prefix_counts.PrefixCounter(BYTE), library(BYTE)
    for text, got in zip(made, counter.prefixes(made)):
        assert got.tolist() == [len(want(text[:i])) for i in range(len(text) + 1)], repr(text)


def test_prefix_count_operator(docs, empty):
    want = library(BYTE)
    d = prefix_counts.prefix_counts(docs, BYTE).select("*", prefix_counts.tokens_at(F.col("counts"), F.col("n_chars")).alias("n"), prefix_counts.tokens_at(F.col("counts"), F.lit(5)).alias("five"))
    got = d.collect()
    assert len(got) == len(TEXTS) + 2
    texts = dict(enumerate(TEXTS))
    for r in got:
        t = "no id here" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n"], r["five"]) == (len(t.encode()), len(want(t)), len(want(t[:5])))
    one = next(r for r in got if r["doc_id"] == 0)
    k = prefix_counts.fitting(one["counts"], 4)
    assert len(want(TEXTS[0][:k])) <= 4 and all(len(want(TEXTS[0][:j])) > 4 for j in range(k + 1, len(TEXTS[0]) + 1))
    assert prefix_counts.prefix_counts(empty, BYTE).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    m = token_files.write_token_files(docs, BYTE, shared_dir(spark, "t"), end_id=0)
    got = sorted(token_files.read_token_files(spark, m).collect(), key=lambda r: r["start"])
    want, at = library(BYTE), 0
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    for r in got:
        ids = want("no id here" if r["doc_id"] is None else TEXTS[r["doc_id"]]) + [0]
        assert r["start"] == at and r["n_tokens"] == len(ids) and bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
        at += len(ids)
    assert m["ids"] == at and m["width"] == 2
    m = token_files.write_token_files(empty, BYTE, shared_dir(spark, "t"))
    assert token_files.read_token_files(spark, m).count() == 0


def test_packing_covers_each_id_once(docs, empty):
    want, held = library(WORD), defaultdict(list)
    got = packing.pack(docs, WORD).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    for r in got:
        assert r["length"] == 1 << r["bucket"] <= 2048 and r["offset"] == 0
        held[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    for (i, n), pieces in held.items():
        ids = want("no id here" if i is None else TEXTS[i]) + [1]
        copies = 2 if i == 3 else 1
        assert n == len(ids) and sum(len(p) for _, p in pieces) == copies * n
        assert all(ids[s : s + len(p)] == p for s, p in pieces)
    assert packing.decompose(5000, 2048) == [2048, 2048, 512, 256, 128, 8] and packing.pack(empty, WORD).count() == 0


def test_chunk_codec_equals_the_library(docs, empty, monkeypatch):
    t, texts = Tokenizer.from_file(BYTE), dict(enumerate(TEXTS))
    got = chunk_codec.encode_decode(docs, BYTE).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        ids = t.encode("no id here" if r["doc_id"] is None else texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and bytes(r["decoded"]).decode() == t.decode(ids, skip_special_tokens=False)
    assert chunk_codec.encode_decode(empty, BYTE).count() == 0


def test_chunk_joins_are_mended(monkeypatch):
    monkeypatch.setattr(chunk_codec, "SIZES", (8, 32, 128))

    class Nothing:
        def find(self, h):
            return np.zeros(len(h), bool), {}

    rng = random.Random(5)
    words = ["hello", "ing", " the", " The", "'ll", "'re", "   ", "\n\n", "<|endoftext|>", " a", " b", "é", "2024", "。", "aaaaaaaa"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    want = library(BYTE)
    assert [x.tolist() for x in chunk_codec.Codec(BYTE).encode(texts, Nothing())] == [want(t) for t in texts]


def test_chunks_depend_on_content_alone():
    rng = random.Random(6)
    a, b = ("".join(rng.choice("abcdefgh é") for _ in range(4000)).encode() for _ in range(2))
    cut = lambda texts, k: [int(n) for n, w in zip(*chunking.chunks(texts, 16, 48, 192)[2:]) if w == k]
    assert cut([a], 0) == cut([b, a, b], 1) and sum(cut([a], 0)) == len(a) and max(cut([a], 0)) <= 192
    flat, start, length, _ = chunking.chunks([a], 16, 48, 192)
    assert all(flat[s : s + n].tobytes().decode() for s, n in zip(start.tolist(), length.tolist()))


def test_fingerprints_by_brute_force(docs, empty):
    got = {(r["doc_id"], r["n_chars"]): r for r in fingerprints.fingerprints(docs).collect()}
    order = [(None, "no id here"), (0, TEXTS[0]), (1, ""), (2, ""), (3, TEXTS[3]), (3, TEXTS[3]), *((i, TEXTS[i]) for i in range(4, len(TEXTS)))]
    entries = lambda s: {s[i : i + 8]: int(s[i + 8 : i + 10], 16) for i in range(0, len(s), 10)}

    def near(a, b):
        a, b = entries(a), entries(b)
        least = min(sum(a.values()), sum(b.values()))
        return 1.0 if not a and not b else sum(n for k, n in a.items() if k in b) / least if least else 0.0

    for k, (i, t) in enumerate(order):
        j, following = order[(k + 1) % len(order)]
        r, nxt, q = got[i, len(t)], got[j, len(following)], len(t) // 4
        if i == 3:  # two equal rows, one of them followed by the other
            assert r["edited_text"] in {t[: len(t) - q] + x[:q] for x in (t, TEXTS[4])}
            continue
        assert r["edited_text"] == t[: len(t) - q] + following[:q]
        assert r["near_edited"] == pytest.approx(near(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(near(r["fingerprint"], nxt["fingerprint"]))
    assert got[0, len(TEXTS[0])]["fingerprint"] == got[6, len(TEXTS[6])]["fingerprint"]
    assert fingerprints.fingerprints(empty).count() == 0


def test_warc_round_trip(spark):
    ship(spark)
    rows = [(1, "http://a/ü?q=1 2", "<p>é</p>"), (2, None, None), (5, "http://b", "<p>é</p>"), (4, "http://c\r\nX: y", "<p>é</p>"), (3, "http://d", ""), (7, "u", "z" * 200_000)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    one, two = shared_dir(spark, "w"), shared_dir(spark, "w")
    files = warc.normalise(spark, one, warc.write_archives(d, one), two)
    got = {r["page_id"]: r for r in warc.read_archives(spark, two, [f for f, _ in files]).collect()}
    keeper = {"<p>é</p>": 5, "": 3, "z" * 200_000: 7}
    for i, url, html in rows:
        raw, r = (html or "").encode(), got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keeper[html or ""] == i else ("revisit", keeper[html or ""]))
        assert r["url"] == url
    assert sum(n for _, n in files) == len(rows) and warc.write_archives(d.limit(0), shared_dir(spark, "w")) == []
    assert warc.read_archives(spark, two, []).count() == 0


def test_top_k_by_brute_force(spark):
    ship(spark)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 8)).astype("f4")
    v[20:120] = v[0]  # a large group of ties
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 8), (None, [1.0] * 8), (7, [float(x) for x in v[3]])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    got = defaultdict(list)
    for r in topk.top_k(topk.quantised(d), k=5, every=50, block_size=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = [(i, np.floor(256 * np.array(x, float)).astype(int)) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    assert sorted(got) == [i for i in range(0, 300, 50)]
    for i in got:
        own = next(x for j, x in q if j == i)
        want = sorted(((j, int(own @ x)) for j, x in q if j != i), key=lambda p: (-p[1], p[0]))[:5]
        assert got[i] == want
    few = topk.top_k(topk.quantised(d.where("vec_id < 3")), k=5, every=50)
    assert few.count() == 2 and topk.top_k(topk.quantised(d.limit(0))).count() == 0


SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "ein", "ver", "zu"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    ship(spark)
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(400):
        lang = "aa" if i % 2 else "bb"
        words = prose(rng, lang, rng.randint(5, 60)).split()
        if i % 5 == 0:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(["grumbold", "snarfle"]))
            marks.append((i, 1))
        elif i % 3:
            marks.append((i, 0))
        rows.append((i, " ".join(words), lang))
    extra = [(1000, None, "aa"), (1001, "12 34 !! ½ ²", "bb"), (1002, "qxzjwvkp gfdhxqz wqxj zzkqxv qqwxz jjxqkw vxqz", None), (None, "lokami turelo", "aa")]
    d = spark.createDataFrame([(*r, "c") for r in rows + extra], "doc_id long, text string, lang string, u string")
    labels = spark.createDataFrame(marks + [(0, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    return d, labels, dict((i, lang) for i, _, lang in rows), dict(marks)


def test_language_identification(labelled):
    d, _, lang, _ = labelled
    models = langid.train(d, langid.crc_mod("doc_id", 5) != 0, sample=100)
    got = {r["doc_id"]: r for r in langid.identify(d, models).collect()}
    assert len(got) == 405 - 1 and all(got[i]["lang_pred"] == k for i, k in lang.items()) and not any(got[i]["rejected"] for i in lang)
    assert [got[i]["lang_pred"] for i in (1000, 1001)] == ["und", "und"] and got[1000]["score"] == 0 and got[1002]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.train(d.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(d, none).collect()} == {"und"}
    assert langid.identify(d.limit(0), models).count() == 0


def test_toxicity_and_disguises(labelled):
    d, labels, _, marks = labelled
    model = toxicity.train(d, labels, langid.crc_mod("doc_id", 4) != 2, sample=200)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    assert all(got[i]["predicted"] == t for i, t in marks.items()) and got[1000]["predicted"] == 0
    reader = toxicity.Reader(model)
    for text in ("gr0mb0ld grumb0ld", "snarf1e", "sn@rfle!", "s n a r f l e", "g.r.u.m.b.o.l.d", "snaaaaarfle", "$narfl3", "gr*mbold"):
        assert reader.evidence([text])[0][0, 0] > 0, text
    assert reader.evidence(["kalomi ture 42 lo*** mi!!"])[0][0, 0] == 0
    nothing = toxicity.train(d, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(d, nothing).collect()} == {0.0} and toxicity.score(d.limit(0), model).count() == 0


def test_near_duplicates_by_brute_force(spark):
    ship(spark)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = {}
    for g in range(12):
        base = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            texts[len(texts)] = " ".join(own)
    n = len(texts)
    texts |= {n: texts[0], n + 1: texts[0].upper() + "!", n + 2: "", n + 3: None, n + 4: "one two", n + 5: "one two", n + 6: "?!"}
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()] + [(5, texts[5], 1, 2)], "doc_id long, text string, id int, root int").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(d).collect()}
    # Plain Python: shingles of five words, weights by the operator's frequencies, components of all pairs.
    frequencies, count = neardup.document_frequencies(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    ids, root = sorted(texts), {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(a, b) for a in ids for b in ids if a < b]
    s = neardup.similarities([texts[a] or "" for a, _ in pairs], [texts[b] or "" for _, b in pairs], frequencies, count)
    plain = lambda t: Counter(zip(*[re.findall(r"[^\W_]+", (t or "").lower())[k:] for k in range(5)]))
    for (a, b), x in zip(pairs, s):
        one, two = plain(texts[a]), plain(texts[b])
        if one and two:
            assert (x > 0) == bool(one & two)
        if x >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in ids}
    assert neardup.near_duplicates(d.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["root"] for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_draws_agree_as_often_as_texts_are_alike():
    rng = random.Random(8)
    a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    b = a[:300] + [f"v{i}" for i in range(100)]
    own, h, c = neardup.shingles([" ".join(a), " ".join(b)])
    drawn = list(neardup._draws(own, h, c.astype(np.float32), range(600)))
    alike = 296 / (396 + 396 - 296)
    assert abs(sum(int(d[0] == d[1]) for _, d in drawn) / len(drawn) - alike) < 0.07


def test_pipeline_keeps_and_drops(spark, labelled, tmp_path):
    import corpus_pipeline

    d, labels, _, marks = labelled
    d = d.union(d.where("doc_id = 1").withColumn("doc_id", F.lit(5000).cast("long")))
    d.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept, names = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
        names.append({r["doc_id"] for r in kept.collect()})
    first, second, third = names
    assert not {1000, 1001, 1002} & first and {i for i in range(400)} <= first
    assert second == {i for i in first if marks.get(i) != 1 and i != 0 or i is None}
    assert 5000 not in third and 1 in third and len(third) >= len(second) - 3
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == third and all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in pieces)


def test_queries_carry_the_contracted_columns():
    assert [k for k in queries.queries()] == sorted(queries.queries(), key=lambda k: int(k[2:].split("_")[0]))
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE
