"""Operator 2: near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A text is the weighted set of its shingles of five words.  A shingle weighs its count times its
inverse document frequency, taken over all documents from a table of fixed size that shingle hashes
are counted in (2**20 cells, whatever the corpus; a cell's chance share of other shingles is the same
fraction of the corpus at every size) and scaled to a narrow range, so that no group sinks by its own size.  ICWS draws, for each of BANDS x ROWS seeds, one shingle and a
quantised weight such that two texts draw the same with a probability equal to their weighted Jaccard
similarity.  ROWS draws make a band.

1. Texts with the same weighted set are one class; only classes go on, so exact copies cost nothing more.
2. Classes that share a band meet in its bucket.  Each bucket elects as leader the member that meets
   most others over all bands, the likeliest original among copies, and its members are verified
   against it: a row a member, never all pairs.
3. Buckets whose members are not yet all of one component elect further leaders, by LEADERS hashes of
   the id and in ROUNDS rounds, and members of other components are verified against those: again a row
   a member and leader.  Large groups of copies that differ too much from any one of them join so.
4. What then still lies in another component than its bucket's leader is paired by what it differs in from
   that leader.  Let the weighted difference of two texts be the sum of |w - w'| over their shingles: at
   similarity s it is at most (1 - s) / (1 + s) of their summed weights.  A text that is not similar to the
   leader and one that is similar to it must have some of their differences from the leader in common, and
   enough of them in weight; so only texts meet that share one of the rarest of those differences (the
   prefix filter of exact similarity joins, taken about a pivot), and these are verified.  Copies that
   differ from the leader each in their own way never meet, however many they are, and no link is lost.
5. Connected components of the verified links by propagating the smallest id along links and pointers,
   with a written table each round.

A bucket may hold a third of all classes.  What is counted by bucket is added up before the shuffle, and
buckets are joined as written tables, so that adaptive execution can split a large one.

Words are runs of letters, digits and marks in lower case, and single characters of scripts written
without spaces; quotes and other punctuation separate them, whatever their form.  A text of one to four
words is one shingle.  Cases: null, empty and wordless texts are alike only in having no shingle and
stay alone; repeated rows each get their row, and so do different texts with one id, each of its own
class; texts without ids are compared as others are, but a group without any id has no class_id; an
empty table gives no rows; other columns of whatever name are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, partitions, release, slices, staged, texts, trim
from .fasttok import U64
from .words import ALNUM, LETTER, MARK, UNSPACED, codes, hashes, kinds

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares a band with probability 0.9996, at 0.5 with 0.62, at 0.3 with 0.11.
BANDS, ROWS = 15, 4
#: Further leaders that a bucket elects at a time, and how often: on a large group of near copies a second round joined 16 of 43,426 pairs.
LEADERS, ROUNDS = 4, 1
CELL_BITS = 20
#: The rarest shingle weighs 1 + SPREAD times the commonest.  Copies are counted in the frequencies, so what a
#: group shares weighs least and each copy's edits most: a pair of plain Jaccard similarity j has at least
#: j / (j + (1 - j) (1 + SPREAD)), which is 0.8 at j = 0.849, whatever the group's share of the corpus.
SPREAD = 0.4
#: Bytes of text that are shingled at a time: the arrays behind them take some fifty times as much.
BATCH = 1 << 19
BLOCK_BITS = 14


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words in code points."""
    kind = np.append(kinds()[x], np.uint8(0))
    inside = kind & (ALNUM | MARK) != 0
    alone = inside & (kind & UNSPACED != 0) & (kind & (LETTER | MARK) != 0)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | alone[1:] | alone[:-1]
    ends = inside[:-1] & (~inside[1:] | begins[1:])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle, in order of both."""
    x, first = codes([t.lower() for t in texts])
    start, end = words(x)
    word = hashes().spans(hashes().prefix(x), start, end)
    at = np.searchsorted(start, first)
    count = np.diff(at)
    # A text of n words has max(1, n - 4) shingles; its last ones would run into the next text.
    size = np.where(count == 0, 0, np.maximum(1, count - SHINGLE + 1))
    own = np.repeat(np.arange(len(texts)), size)
    begin = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[:-1], size)
    stop = at[1:][own]
    h = np.zeros(len(begin), U64)
    padded = np.append(word, np.zeros(SHINGLE, U64))
    for k in range(SHINGLE):
        h = _mix(h * U64(0x9E3779B97F4A7C15) + np.where(begin + k < stop, padded[begin + k], U64(0)))
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.append(True, (own[1:] != own[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    place = np.flatnonzero(new)
    return own[place], h[place], np.diff(np.append(place, len(h)))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with a shingle in each cell, over all documents, and the number of documents.

    Tasks count into a table of their own and send its non-zero blocks; the sum is 2**20 numbers.
    """
    cells, block = 1 << CELL_BITS, 1 << BLOCK_BITS

    def count(batches):
        release()
        total, n = np.zeros(cells, np.int64), 0
        for batch in slices(batches, most=BATCH):
            own, h, _ = shingles(batch.column("text").to_pylist())
            total += np.bincount((h >> U64(64 - CELL_BITS)).astype(np.int64), minlength=cells)
            n += batch.num_rows
        trim()
        if n:
            parts = total.reshape(-1, block)
            sent = [k for k in range(len(parts)) if parts[k].any()]
            yield pa.RecordBatch.from_arrays([pa.array([-1] + sent, pa.int32()), pa.array([n] + [0] * len(sent), pa.int64()), pa.array([b""] + [parts[k].astype("<u4").tobytes() for k in sent], pa.binary())], ["block", "n", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for batch in batches:
            for k, more, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "counts"))):
                n[k] = n.get(k, 0) + more
                own = total.setdefault(k, np.zeros(block, np.int64))
                if counts:
                    own += np.frombuffer(counts, "<u4")
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n[k] for k in total], pa.int64()), pa.array([v.astype("<u8").tobytes() for v in total.values()], pa.binary())], ["block", "n", "counts"])

    schema = "block int, n long, counts binary"
    sums = docs.select("text").mapInArrow(count, schema).repartition(partitions(docs.sparkSession), "block").mapInArrow(add, schema)
    frequencies, n = np.zeros(cells, np.int64), 0
    for r in sums.collect():
        if r["block"] < 0:
            n = r["n"]
        else:
            frequencies[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], "<u8").astype(np.int64)
    return frequencies, n


def weigh(frequencies: np.ndarray, n: int, h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Count times inverse document frequency, which runs from 1 (in all documents) to 1 + SPREAD."""
    found = frequencies[(h >> U64(64 - CELL_BITS)).astype(np.int64)]
    rare = np.clip(np.log((n + 1) / (found + 1)) / np.log(n + 1), 0, 1)
    return (count * (1 + SPREAD * rare)).astype(np.float32)


@lru_cache(maxsize=1)
def _gamma() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """65,536 draws from Gamma(2, 1) and their logarithms, and as many steps of the unit interval, which 16 bits of a hash choose from."""
    rng = np.random.default_rng(2718)
    r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
    c = rng.gamma(2.0, 1.0, 1 << 16)
    return np.maximum(r, 1e-3), np.log(c).astype(np.float32), ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def _draws(own: np.ndarray, h: np.ndarray, w: np.ndarray, seeds: range):
    """For each seed, the hash of the shingle and weight that each text with shingles draws."""
    gr, gc, gb = _gamma()
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    low = np.log(w)
    index = np.arange(len(h), dtype=np.uint64)
    for k in seeds:
        x = (h ^ U64((0xA24BAED4963EE407 * (2 * k + 1)) % (1 << 64))) * U64(0x9FB21C651E98DF25)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        r = gr[(x & U64(0xFFFF)).astype(np.int64)]
        c = gc[((x >> U64(16)) & U64(0xFFFF)).astype(np.int64)]
        b = gb[((x >> U64(40)) & U64(0xFFFF)).astype(np.int64)]
        t = np.floor(low / r + b)
        a = c - r * (t - b + np.float32(1))
        # Order-preserving bits of a above the shingle's place: the least of a text names its shingle.
        bits = a.view(np.int32).astype(np.int64)
        bits = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) + (1 << 31)
        least = np.minimum.reduceat((bits.astype(np.uint64) << U64(32)) | index, start)
        won = (least & U64(0xFFFFFFFF)).astype(np.int64)
        yield k, _mix(h[won] + U64(0x9E3779B97F4A7C15) * t[won].astype(np.int64).view(np.uint64))


def bands(own: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """(n, BANDS) hashes of the draws of each band; a text without shingles gets zeros."""
    out = np.zeros((n, BANDS), np.uint64)
    if len(h):
        place = np.unique(own)
        for k, drawn in _draws(own, h, w, range(BANDS * ROWS)):
            out[place, k // ROWS] = _mix(out[place, k // ROWS] * U64(31) + drawn + U64(k + 1))
    return out.view(np.int64)


def _digest(own: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> list[bytes]:
    """128-bit digests of shingle sets with counts; of the empty set, nothing."""
    from hashlib import blake2b

    ends = np.searchsorted(own, np.arange(n + 1))
    return [blake2b(h[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest() if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class _Weighted:
    """The weighted shingles of texts, in order of their hashes."""

    def __init__(self, texts: list[str], frequencies: np.ndarray, n: int):
        self.number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        own, self.h, count = shingles(list(self.number))
        self.w = weigh(frequencies, n, self.h, count).astype(np.float64)
        self.ends = np.searchsorted(own, np.arange(len(self.number) + 1))
        self.total = np.bincount(own, self.w, len(self.number))

    def __getitem__(self, text: str) -> tuple[np.ndarray, np.ndarray, float]:
        """Hashes, weights and summed weight of a text."""
        i = self.number[text]
        own = slice(self.ends[i], self.ends[i + 1])
        return self.h[own], self.w[own], self.total[i]


def similarities(pairs_a: list[str], pairs_b: list[str], frequencies: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of texts, pair by pair."""
    known = _Weighted(pairs_a + pairs_b, frequencies, n)
    out = np.zeros(len(pairs_a))
    for k, (a, b) in enumerate(zip(pairs_a, pairs_b)):
        (hx, wx, x), (hy, wy, y) = known[a], known[b]
        if not len(hx) or not len(hy):
            continue
        at = np.minimum(np.searchsorted(hy, hx), len(hy) - 1)
        hit = hy[at] == hx
        shared = np.minimum(wx[hit], wy[at[hit]]).sum()
        out[k] = shared / (x + y - shared)
    return out


def differences(members: list[str], pivots: list[str], frequencies: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Of each member: the shingles whose weight is another than in its pivot, by how much, and the member's summed weight."""
    known = _Weighted(members + pivots, frequencies, n)
    out = []
    for a, b in zip(members, pivots):
        (hx, wx, x), (hy, wy, _) = known[a], known[b]
        h = np.union1d(hx, hy)
        d = np.zeros(len(h))
        d[np.searchsorted(h, hx)] += wx
        d[np.searchsorted(h, hy)] -= wy
        out.append((h[d != 0], np.abs(d[d != 0]), float(x)))
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root, before): the smallest id of each id's component, for links (a, b).

    Each round every id takes the least root among its own and its neighbours', and then the root of
    that root; the table is written each round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both, "links")
    roots = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("id"), "root", F.lit(0).cast("long").alias("before")), "roots")
    for _ in range(rounds):
        # Least root among neighbours, offered to the id and to its present root (hooking).
        near = both.join(roots.select(F.col("id").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        offered = roots.drop("before").join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        hooked = offered.groupBy(F.col("root").alias("id")).agg(F.min("low").alias("hook"))
        stepped = offered.join(hooked, "id", "left").select("id", F.least("low", F.coalesce("hook", "low")).alias("low"), "root")
        jump = stepped.select(F.col("id").alias("low"), F.col("low").alias("far"))
        new = staged(stepped.join(jump, "low", "left").select("id", F.least("low", F.coalesce("far", "low")).alias("root"), F.col("root").alias("before")), "roots")
        discard(roots)
        roots = new
        if not roots.where("root <> before").limit(1).count():
            discard(both)
            return roots
    raise RuntimeError("components did not settle")


def mark(text):
    """Column: what tells the texts of rows with one id, or without id, apart."""
    return F.unhex(F.md5(text))


def groups(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, digest, ...), a row a document, and (digest, copy_of, first), a row a class of equal texts.

    first is the (without, doc_id, mark) of the document with the smallest id of the class's group of
    near-duplicates; without is true and doc_id null if none of them has an id. The digest of texts
    without shingles is empty, and they have no class.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("mark", mark("text"))
    frequencies, n = document_frequencies(rows)
    # A fixed number of cells: 4 MB, at any size of the corpus.
    sent = spark.sparkContext.broadcast((frequencies.astype(np.uint32), n))

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, h, count = shingles(batch.column("text").to_pylist())
        w = weigh(*sent.value, h, count)
        b = bands(own, h, w, batch.num_rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * b.shape[1], pa.int32()), pa.array(b.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(_digest(own, h, count, batch.num_rows), pa.binary()), lists], ["doc_id", "mark", "digest", "bands"])

    # A text without shingles keeps a digest of its own: it is nobody's copy.
    signs = staged(map_batches(rows, sign, "doc_id long, mark binary, digest binary, bands array<long>", most=BATCH, keeps=False), "signatures")
    some = signs.where(F.octet_length("digest") > 0)
    # A class goes by 64 bits of its digest, not by an id, which texts may share or lack: among 15 million, two are the same with odds of 1 in 160,000.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "mark")).alias("one")
    classes = staged(some.groupBy("digest").agg(one, F.first("bands").alias("bands")).withColumn("id", F.xxhash64("digest")), "classes")
    members = classes.select("id", F.posexplode("bands").alias("band", "key"))
    sizes = staged(members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = staged(members.join(sizes, ["band", "key"]), "shared")
    # The member that meets most others over all bands is the likeliest original of copies that differ from each other.
    meets = shared.groupBy("id").agg(F.sum("n").alias("meets"))
    central = staged(shared.drop("n").join(meets, "id"), "central")
    leaders = staged(central.groupBy("band", "key").agg(F.max_by("id", F.struct("meets", F.bitwise_not("id"))).alias("leader")), "leaders")
    met = staged(central.drop("meets").join(leaders, ["band", "key"]).where("id <> leader"), "met")
    done = [sizes, shared, central, leaders, met]

    wanted = met.select("id").union(met.select(F.col("leader").alias("id"))).distinct()
    # A text of each class that met any other: that of its first document.
    # Joined the same way at every size: the ids grow with the input, so they are not broadcast where they happen to be few.
    wanted = classes.select("id", F.col("one.doc_id").alias("of"), F.col("one.mark").alias("its")).join(wanted, "id")
    held = rows.join(wanted.hint("merge"), rows["doc_id"].eqNullSafe(wanted["of"]) & (rows["mark"] == wanted["its"])).groupBy("id").agg(F.min("text").alias("text"))
    held = staged(held, "met-texts")
    done.append(held)

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, similar) for distinct pairs (a, b)."""
        beside = pairs.join(held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = similarities(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), *sent.value)
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s >= similarity)], ["a", "b", "similar"])

        out = staged(map_batches(beside.select("a", "b", "text_a", "text_b"), run, "a long, b long, similar boolean", "text_b", BATCH, keeps=False), "verified")
        done.append(out)
        return out

    tested = verified(met.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
    roots = components(tested.where("similar").select("a", "b"))
    placed = _placed(central, roots, done)
    for round_ in range(ROUNDS):
        further = [F.min_by("id", F.xxhash64(F.lit(LEADERS * round_ + k), "id")) for k in range(LEADERS)]
        chosen = placed.groupBy("band", "key").agg(F.array_distinct(F.array(*further)).alias("some")).select("band", "key", F.explode("some").alias("leader"))
        chosen = staged_as(chosen.join(roots.select(F.col("id").alias("leader"), F.col("root").alias("other")), "leader", "left").withColumn("other", F.coalesce("other", "leader")), "leaders", done)
        pairs = placed.join(chosen, ["band", "key"]).where("root <> other").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        pairs = staged_as(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs", done)
        if not pairs.limit(1).count():
            break
        more = verified(pairs)
        tested, roots = tested.union(more), _joined(roots, more, done)
        placed = _placed(central, roots, done)
    pairs = _rest(placed, leaders, tested, roots, held, sent, similarity, done)
    if pairs is not None:
        roots = _joined(roots, verified(pairs), done)

    first = roots.join(classes.select("id", "one"), "id").groupBy("root").agg(F.min("one").alias("first"))
    named = classes.select("id", "digest", "one").join(roots, "id", "left").join(first, "root", "left")
    discard(*done)
    return signs, named.select("digest", F.col("one.doc_id").alias("copy_of"), F.coalesce("first", "one").alias("first"))


def _joined(roots: DataFrame, tested: DataFrame, done: list[DataFrame]) -> DataFrame:
    """roots with the similar pairs of tested as links: components of components, from root to root."""
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    found = tested.where("similar").join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(found.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b").distinct())
    done += [roots, over]
    further = over.select(F.col("id").alias("root"), F.col("root").alias("far"))
    joined = roots.select("id", "root").join(further, "root", "left").select("id", F.coalesce("far", "root").alias("root"))
    lone = over.select("id", "root").join(roots.select("id"), "id", "left_anti")
    return staged(joined.unionByName(lone), "roots")


def _placed(members: DataFrame, roots: DataFrame, done: list[DataFrame]) -> DataFrame:
    """(band, key, id, root) of the members of buckets that are not all of one component."""
    every = members.select("id", "band", "key").join(roots.select("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    every = staged_as(every, "placed", done)
    mixed = every.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "key")
    return staged_as(every.join(staged_as(mixed, "mixed", done), ["band", "key"]), "mixed-members", done)


def _rest(placed: DataFrame, leaders: DataFrame, tested: DataFrame, roots: DataFrame, held: DataFrame, sent, similarity: float, done: list[DataFrame]) -> DataFrame | None:
    """(a, b): pairs of members of one leader's buckets that may be similar, one of them not of its component, and that no links join yet. None if there are none.

    Let x and y be of different components and x not of the leader's, so not similar to it: its difference
    from the leader, dev_x, is over c (W_x + W_leader), where c = (1 - s) / (1 + s).  If x and y are similar,
    theirs is at most c (W_x + W_y).  Were no shingle among the differences of both, it would be
    dev_x + dev_y, but dev_y is no less than W_leader - W_y: so they have some in common.  By the triangle
    inequality what they have in common weighs at least (dev_x + dev_y - c (W_x + W_y)) / 2, and in y, where
    that is the greater of both, at least dev_y - c (W_x + W_y).  Neither's W is over 1 / s of the other's.  So
    whatever comes last in an order of the differences, and weighs less than that, need not be looked at, and
    a pair need not be where it has too little left in common from that place on.
    """
    if not placed.limit(1).count():
        return None
    lead = leaders.join(roots.select(F.col("id").alias("leader"), F.col("root").alias("other")), "leader", "left").withColumn("other", F.coalesce("other", "leader"))
    led = placed.join(staged_as(lead, "led", done), ["band", "key"]).where("id <> leader")
    led = staged_as(led.groupBy("leader", "id").agg(F.first("root").alias("root"), F.first("other").alias("other")), "members", done)
    beside = led.join(held, "id").join(held.select(F.col("id").alias("leader"), F.col("text").alias("text_of_leader")), "leader")

    def differ(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = differences(batch.column("text").to_pylist(), batch.column("text_of_leader").to_pylist(), *sent.value)
        at = pa.array(np.cumsum([0] + [len(h) for h, _, _ in found]), pa.int32())
        joined = [np.concatenate(x) for x in ([h for h, _, _ in found], [d for _, d, _ in found])]
        lists = [pa.ListArray.from_arrays(at, pa.array(joined[0].view(np.int64))), pa.ListArray.from_arrays(at, pa.array(joined[1]))]
        sums = [pa.array([w for _, _, w in found], pa.float64()), pa.array([float(d.sum()) for _, d, _ in found], pa.float64())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("leader", "id", "root", "away")), *sums, *lists], ["leader", "id", "root", "away", "weight", "dev", "shingles", "by"])

    schema = "leader long, id long, root long, away boolean, weight double, dev double, shingles array<long>, by array<double>"
    beside = beside.withColumn("away", F.col("root") != F.col("other")).select("leader", "id", "root", "away", "text", "text_of_leader")
    differing = staged_as(map_batches(beside, differ, schema, most=BATCH, keeps=False), "differences", done)
    each = differing.select("leader", "id", "root", "away", "weight", "dev", F.explode(F.arrays_zip("shingles", "by")).alias("one"))
    each = each.select("leader", "id", "root", "away", "weight", "dev", F.col("one.shingles").alias("shingle"), F.col("one.by").alias("by"))
    # What only members of one component differ in, or none that is away, is common to no pair that is looked for.
    common = each.groupBy("leader", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or("away").alias("any"))
    common = staged_as(common.where("low <> high AND any").select("leader", "shingle", "n"), "common", done)
    # The commonest come last; rest is what a shingle and those after it weigh. The sums are rounded, hence the thousandth.
    after = Window.partitionBy("leader", "id").orderBy(F.desc("n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    rest = each.join(common, ["leader", "shingle"]).withColumn("rest", F.sum("by").over(after) + 0.001 * F.col("weight"))
    least = (1 - similarity) / similarity
    ahead = rest.where(F.col("rest") >= F.col("dev") - least * F.col("weight")).withColumn("short", F.col("rest") >= F.col("dev") - least / 2 * F.col("weight"))
    ahead = staged_as(ahead.select("leader", "shingle", "id", "root", "away", "weight", "dev", "rest", "short"), "ahead", done)
    # Each pair from the one that differs less.
    less = ahead.where("short").select("leader", "shingle", *[F.col(c).alias(f"{c}_x") for c in ("id", "root", "away", "weight", "dev", "rest")])
    once = (F.col("dev_x") < F.col("dev")) | ((F.col("dev_x") == F.col("dev")) & (F.col("id_x") < F.col("id")))
    sized = F.least("weight", "weight_x") >= (similarity - 0.001) * F.greatest("weight", "weight_x")
    # If this is the first that both differ in, what they have in common weighs no more than it and what comes after it in either.
    enough = F.least("rest", "rest_x") >= (F.col("dev") + F.col("dev_x") - (1 - similarity) / (1 + similarity) * (F.col("weight") + F.col("weight_x"))) / 2
    met = less.join(ahead, ["leader", "shingle"]).where((F.col("root") != F.col("root_x")) & (F.col("away") | F.col("away_x")) & once & sized & enough)
    pairs = met.select(F.least("id_x", "id").alias("a"), F.greatest("id_x", "id").alias("b")).distinct()
    pairs = staged_as(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "candidates", done)
    return pairs if pairs.limit(1).count() else None


def staged_as(df: DataFrame, name: str, done: list[DataFrame]) -> DataFrame:
    """df, staged, and listed among what goes in the end."""
    out = staged(df, name)
    done.append(out)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_of): a row a document.

    class_id is the smallest document id of its group of near-duplicates, copy_of that of the documents
    with the same weighted shingles.
    """
    signs, named = groups(docs, similarity, id_col, text_col)
    out = signs.select("doc_id", "digest").join(named, "digest", "left")
    return out.select("doc_id", F.coalesce("first.doc_id", "copy_of", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each group of near-duplicates: that with the smallest id. Texts without shingles stay, but for repeated rows with an id."""
    signs, named = groups(docs, id_col=id_col, text_col=text_col)
    alone = signs.where(F.octet_length("digest") == 0).select("doc_id", "mark", F.lit(True).alias("_alone")).distinct()
    stay = named.select("first.doc_id", "first.mark", F.lit(False).alias("_alone")).distinct().union(alone)
    # A null id is equal to another here. Both the join and the choice of a row go by these columns.
    keys = lambda i, m: {"_id": F.coalesce(i, F.lit(0)), "_without": i.isNull(), "_mark": m}
    stay = stay.withColumns(keys(F.col("doc_id"), F.col("mark"))).drop("doc_id", "mark")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = docs.withColumns(keys(F.col(f"`{id_col}`").cast("long"), mark(text))).join(stay, ["_id", "_without", "_mark"])
    each = found.where("NOT (_alone AND _without)").dropDuplicates(["_id", "_without", "_mark"])
    return each.union(found.where("_alone AND _without")).select(*[f"`{c}`" for c in docs.columns])
