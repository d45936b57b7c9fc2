"""A random forest learnt level by level from histograms that workers count with NumPy.

Numbers are cut into at most ``BINS`` bins, so rows of equal bins and class are one row with a count. A pass over these rows
counts, for every live node of all trees, the bins of the features that the node may ask; a node's counts meet in one group a
tree, where its best split is taken. Only splits come to the driver. A tree's bootstrap is a Poisson number a row, drawn anew in
each pass from the same seeds; it depends on the seed, the data and the default parallelism.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

BINS = 32
#: Rows counted at a time.
CHUNK = 1 << 16
#: Bytes of the histograms that a worker holds; more trees than fit are counted in further passes.
HELD = 1 << 27


class Forest:
    """Arrays by tree. Node i's children are 2i + 1 and 2i + 2; it asks ``feature``, and bins up to ``cut`` go left. ``share``: class 1 in the bottom nodes.

    Features are the numbers, then one indicator a known code. Leaves above the bottom go left all the way.
    """

    def __init__(self, cuts: list[np.ndarray], known: list[str], feature: np.ndarray, cut: np.ndarray, share: np.ndarray, importance: np.ndarray):
        self.cuts, self.known, self.feature, self.cut, self.share, self.importance = cuts, known, feature, cut, share, importance

    def probability(self, numbers: list[str], code: str) -> Column:
        """The mean share of class 1 over the trees. Null and NaN numbers raise."""
        cuts, known, depth = self.cuts, self.known, int(math.log2(self.share.shape[1]))
        feature, cut, share = self.feature.astype(np.intp), self.cut, self.share

        def run(values: pa.Array, codes: pa.Array) -> pa.Array:
            flat = _spread(_bins(values, cuts), _index(codes, known), len(known))
            base, total = np.arange(flat.shape[0]) * flat.shape[1], np.zeros(flat.shape[0])
            for f, c, s in zip(feature, cut, share):
                total += s.take(_walk(flat.ravel(), base, f, c, depth))
            return pa.array(total / len(share))

        return F.arrow_udf(run, "double")(F.array(*[F.col(c).cast("double") for c in numbers]), F.col(code))

    def save(self, path) -> None:
        np.savez(path, feature=self.feature, cut=self.cut, share=self.share, importance=self.importance, known=np.array(self.known, dtype=str), **{f"cuts{i}": c for i, c in enumerate(self.cuts)})

    @staticmethod
    def load(path) -> Forest:
        with np.load(path, allow_pickle=False) as z:
            cuts = [z[f"cuts{i}"] for i in range(sum(k.startswith("cuts") for k in z.files))]
            return Forest(cuts, z["known"].tolist(), z["feature"], z["cut"], z["share"], z["importance"])


def _bins(values: pa.Array, cuts: list[np.ndarray]) -> np.ndarray:
    """[row, number]: how many cuts are below each value, of a column of arrays."""
    flat = values.flatten()
    if values.null_count or flat.null_count:
        raise ValueError("a number is null")
    v = flat.to_numpy(zero_copy_only=False).reshape(len(values), len(cuts))
    if np.isnan(v).any():
        raise ValueError("a number is NaN")
    return np.stack([np.searchsorted(c, v[:, i]) for i, c in enumerate(cuts)], 1).astype(np.uint8) if cuts else np.zeros((len(values), 0), np.uint8)


def _index(codes: pa.Array, known: list[str]) -> np.ndarray:
    """Place in ``known``, len(known) for null and for others."""
    place = {k: i for i, k in enumerate(known)}
    held = codes.dictionary_encode()
    of = np.array([place.get(k, len(known)) for k in held.dictionary.to_pylist()] + [len(known)], np.int64)
    return of[held.indices.fill_null(len(of) - 1).to_numpy(zero_copy_only=False)]


def _spread(bins: np.ndarray, index: np.ndarray, codes: int) -> np.ndarray:
    """[row, feature]: the bins and a 0 or 1 for each code."""
    return np.concatenate([bins, (index[:, None] == np.arange(codes)).astype(np.uint8)], 1)


def _walk(flat: np.ndarray, base: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row among the nodes that are ``levels`` below the root."""
    at = np.zeros(len(base), np.intp)
    for _ in range(levels):
        right = flat.take(base + feature.take(at)) > cut.take(at)
        at *= 2
        at += 1
        at += right
    return at - (2**levels - 1)


def _cuts(d: DataFrame, numbers: list[str]) -> list[np.ndarray]:
    """At most BINS - 1 cuts a number: between all its values where these are few, else its approximate quantiles."""
    if not numbers:
        return []
    quantiles = d.agg(*[F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 10000).alias(f"q{i}") for i, c in enumerate(numbers)]).first()
    out = []
    for i, c in enumerate(numbers):
        few = sorted(r[0] for r in d.select(c).where(F.col(c).isNotNull()).distinct().limit(BINS + 1).collect())
        v = np.array(few if len(few) <= BINS else sorted(set(quantiles[f"q{i}"])), float)
        out.append((v[:-1] + v[1:]) / 2 if len(few) <= BINS else v)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows by CHUNK, however they arrive."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        while n >= CHUNK:
            t = pa.Table.from_batches(held)
            yield t.slice(0, CHUNK)
            held, n = t.slice(CHUNK).to_batches(), n - CHUNK
    if n:
        yield pa.Table.from_batches(held)


def _poisson(mean: int) -> np.ndarray:
    """Distribution function of a Poisson number of this mean, as far as doubles tell it from 1."""
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 30))
    upto = np.cumsum(np.exp(k * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])))
    return upto / upto[-1]


def _drawn(rng: np.random.Generator, runs: list[tuple[int, int]], tables: dict[int, np.ndarray]) -> np.ndarray:
    """A Poisson number for each row; ``runs`` holds (count, rows) of rows in order of their counts. Small counts by their inverse distribution."""
    return np.concatenate([np.searchsorted(tables[c], rng.random(n), "right") if c in tables else rng.poisson(c, n) for c, n in runs])


def _best(h: np.ndarray, allowed: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Per node of one tree: feature, cut, gain (0: no split), and its classes left and right, from h [slot, node, bin, class]."""
    left = h.cumsum(2)
    total = left[:, :, -1:, :]
    left, nodes = left[:, :, :-1, :], np.arange(h.shape[1])
    right = total - left
    n, m, k = left.sum(-1), right.sum(-1), total.sum(-1)
    purity = lambda a, size: (a * a).sum(-1) / np.maximum(size, 1)
    gain = np.where((n >= least) & (m >= least), purity(left, n) + purity(right, m) - purity(total, k), 0.0) / np.maximum(k, 1)
    by_node = gain.transpose(1, 0, 2).reshape(len(nodes), -1)
    at = by_node.argmax(1)
    slot, cut = at // gain.shape[2], at % gain.shape[2]
    return allowed[nodes, slot], cut, by_node[nodes, at], left[slot, nodes, cut], right[slot, nodes, cut]


def fit(d: DataFrame, numbers: list[str], code: str, target: str, trees: int = 500, depth: int = 8, least: int = 5, seed: int = 42) -> Forest:
    """Learns from all rows of d (read several times): Gini gain, ``least`` drawn rows a side, the square root of all features a node, bootstrap."""
    spark = d.sparkSession
    known = sorted(r[0] for r in d.select(code).where(F.col(code).isNotNull()).distinct().collect())
    size = d.agg(F.count(F.lit(1)).alias("n"), F.max(target).alias("most"), F.count_if(F.col(target).isNull() | F.isnan(target) | (F.col(target) < 0) | (F.col(target) != F.floor(target))).alias("bad")).first()
    if not size["n"] or size["bad"]:
        raise ValueError("no rows to learn from" if not size["n"] else "a class is not a whole number from 0")
    classes, cuts = max(2, int(size["most"]) + 1), _cuts(d, numbers)
    features = len(cuts) + len(known)
    if not features:
        raise ValueError("no features")
    slots, width, wide = math.ceil(math.sqrt(features)), len(cuts), "int32" if size["n"] < 1 << 30 else "int64"

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.concatenate([_bins(b["v"], cuts), _index(b["c"], known).astype("<u4").view(np.uint8).reshape(len(b), 4)], 1)
            of = np.arange(len(b) + 1, dtype=np.int32) * key.shape[1]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(of), pa.py_buffer(np.ascontiguousarray(key))]), b["y"]], ["key", "y"])

    plain = d.select((F.array(*[F.col(c).cast("double") for c in numbers]) if numbers else F.expr("CAST(array() AS ARRAY<DOUBLE>)")).alias("v"), F.col(code).alias("c"), F.col(target).cast("int").alias("y"))
    counts = plain.mapInArrow(bin_rows, "key binary, y int").groupBy("key", "y").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.repartition(spark.sparkContext.defaultParallelism, "key", "y").sortWithinPartitions("key", "y").persist(StorageLevel.MEMORY_AND_DISK)

    inner, all_nodes = 2**depth - 1, 2 ** (depth + 1) - 1
    feature, cut, live = np.zeros((trees, inner), np.int32), np.full((trees, inner), 255, np.uint8), np.zeros((trees, all_nodes), bool)
    share, importance = np.zeros((trees, all_nodes)), np.zeros((trees, features))
    live[:, 0] = True

    def level_splits(level: int, group: range, allowed: np.ndarray) -> list:
        """Per tree of the group, the best splits of the nodes at a level."""
        nodes, first = 2**level, 2**level - 1
        asked, told, open_ = feature[group.start : group.stop, :first], cut[group.start : group.stop, :first], live[group.start : group.stop, first : first + nodes]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(group), slots, nodes * BINS * classes), wide)
            tables = {c: _poisson(c) for c in range(1, 65)}
            part, walked, may = TaskContext.get().partitionId(), asked.astype(np.intp), allowed.astype(np.intp)
            for i, chunk in enumerate(_chunks(batches)):
                chunk = chunk.take(np.argsort(chunk["n"].to_numpy(), kind="stable"))
                key = np.frombuffer(b"".join(chunk["key"].to_pylist()), np.uint8).reshape(-1, width + 4)
                flat = _spread(key[:, :width], np.ascontiguousarray(key[:, width:]).view("<u4").ravel().astype(np.int64), len(known))
                every, flat = np.arange(len(flat)) * features, flat.ravel()
                y, runs = chunk["y"].to_numpy().astype(np.intp), list(zip(*(a.tolist() for a in np.unique(chunk["n"].to_numpy(), return_counts=True))))
                for j, t in enumerate(group):
                    if not open_[j].any():
                        continue
                    drawn = _drawn(np.random.Generator(np.random.PCG64([seed, part, i, t])), runs, tables)
                    r = np.flatnonzero(drawn)
                    base = every.take(r)
                    node = _walk(flat, base, walked[j], told[j], level)
                    if not open_[j].all():
                        stay = np.flatnonzero(open_[j].take(node))
                        r, base, node = r.take(stay), base.take(stay), node.take(stay)
                    w, cell = drawn.take(r).astype(float), node * (BINS * classes) + y.take(r)
                    for s in range(slots):
                        b = flat.take(base + may[j, :, s].take(node))
                        total[j, s] += np.bincount(cell + b * np.intp(classes), w, nodes * BINS * classes).astype(wide)
            for j in range(0, len(group), 16):
                yield pa.RecordBatch.from_arrays([pa.array(group[j : j + 16], pa.int32()), pa.array([h.tobytes() for h in total[j : j + 16]], pa.binary())], ["tree", "counts"])

        def choose(table: pa.Table) -> pa.Table:
            t = table["tree"][0].as_py()
            h = sum(np.frombuffer(x.as_py(), wide).astype(float) for x in table["counts"]).reshape(slots, nodes, BINS, classes)
            got = _best(h, allowed[t - group.start], least)
            out = [np.asarray(a, k).tobytes() for a, k in zip(got, ("int32", "uint8", "float64", "float64", "float64"))]
            return pa.table([[t], *[[x] for x in (*out, h[0, 0].sum(0).tobytes())]], schema=schema)

        names = ["feature", "cut", "gain", "left", "right", "top"]
        schema = pa.schema([("tree", pa.int32()), *[(n, pa.binary()) for n in names]])
        met = rows.mapInArrow(count, "tree int, counts binary").groupBy("tree").applyInArrow(choose, "tree int, " + ", ".join(f"{n} binary" for n in names))
        return sorted(met.collect(), key=lambda x: x["tree"])

    def share_of(c: np.ndarray) -> np.ndarray:
        return c[..., 1] / np.maximum(c.sum(-1), 1)

    def grows(c: np.ndarray) -> np.ndarray:
        return (c.sum(-1) >= 2 * least) & (c.max(-1) < c.sum(-1))

    try:
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            draws = np.random.Generator(np.random.PCG64([seed, level])).random((trees, nodes, features))
            allowed = np.sort(draws.argsort(-1)[..., :slots], -1).astype(np.int32)
            at_once = max(1, HELD // (8 * slots * nodes * BINS * classes))
            for start in range(0, trees, at_once):
                group = range(start, min(trees, start + at_once))
                if not live[start : group.stop, first : first + nodes].any():
                    continue
                for x in level_splits(level, group, allowed[start : group.stop]):
                    t = x["tree"]
                    if level == 0:
                        share[t, 0] = share_of(np.frombuffer(x["top"]))
                    gain, left, right = np.frombuffer(x["gain"]), *[np.frombuffer(x[k]).reshape(nodes, classes) for k in ("left", "right")]
                    k = np.flatnonzero(live[t, first : first + nodes] & (gain > 0))
                    i, f = first + k, np.frombuffer(x["feature"], np.int32)[k]
                    feature[t, i], cut[t, i] = f, np.frombuffer(x["cut"], np.uint8)[k]
                    np.add.at(importance[t], f, gain[k] * (left[k] + right[k]).sum(-1))
                    for child, c in ((2 * i + 1, left[k]), (2 * i + 2, right[k])):
                        share[t, child], live[t, child] = share_of(c), grows(c)
    finally:
        rows.unpersist()
    for i in range(inner):
        leaf = cut[:, i] == 255
        share[leaf, 2 * i + 1] = share[leaf, 2 * i + 2] = share[leaf, i]
    importance /= np.maximum(importance.sum(1, keepdims=True), 1e-300)
    return Forest(cuts, known, feature, cut, share[:, inner:], importance.mean(0))
