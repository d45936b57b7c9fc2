"""Operator 10: exact top-k inner products by distributed histogram selection.

Queries are taken in blocks of fixed size.  For a block every candidate row is scored, but no scores
move: each task counts them in a histogram of 1,024 bins per query and sends the bins down to its own
k-th highest score.  The sums over all tasks show which bin holds a query's k-th highest score of all;
the next pass divides that bin again, until a bin is one integer wide.  A last pass keeps the scores
at or above that value; ties are broken by the smaller id, and a task keeps no more than its k best of
a query, all that can be among the k best of all.

What the driver holds is bounded by the block: its vectors, and one bin and count per query.

Cases: vectors that are null or hold a null or non-finite component, and rows without id, take no part;
shorter vectors count as padded with zeros; rows with the query's own id are not its candidates; other
repeated rows each count; a query id that is repeated is asked once, with its smallest vector; an empty
table gives no rows; fewer than k candidates give them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, staged

BINS = 1024


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component as double, without the rows that take no part."""
    v = F.col(f"`{vec_col}`")
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(usable & F.col(f"`{id_col}`").isNotNull())
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    lists = batch.column("vector")
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    ends = np.cumsum(sizes)
    for i, (n, e) in enumerate(zip(sizes.tolist(), ends.tolist())):
        out[i, : min(n, dims)] = flat[e - n : e][:dims]
    return out


class Block:
    """Queries of a block, and where each one's k-th highest score is known to lie."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        self.ids, self.vectors = ids, vectors
        norm = np.sqrt((vectors**2).sum(axis=1))
        # |score| is at most the product of the norms.
        bound = np.ceil(norm * largest).astype(np.float64) + 1
        #: Doubles hold all products and sums exactly up to 2**53; beyond that Python's integers do.
        self.exact = bool(bound.max(initial=0) < 2**52)
        self.low = np.array([-int(b) for b in bound.tolist()], object if not self.exact else np.int64)
        span = 2 * int(bound.max(initial=1)) + 1
        self.shift = max(0, (span - 1).bit_length() - BINS.bit_length() + 1)
        #: Bins of the interval: all at first, then as many as the bin before is divided into.
        self.bins = BINS
        #: Candidates known to score above the interval that is searched.
        self.above = np.zeros(len(ids), np.int64)

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        """Integers, a row a candidate, a column a query; the least possible one where the candidate is the query."""
        m = _matrix(batch, self.vectors.shape[1])
        if self.exact:
            out = (m @ self.vectors.T).astype(np.int64)
        else:
            whole = np.vectorize(int, otypes=[object])
            out = whole(m) @ whole(self.vectors).T
        return out

    def own(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Places (row, column) at which candidate and query are one."""
        at = np.searchsorted(self.ids, ids := batch.column("vec_id").to_numpy())
        at = np.minimum(at, len(self.ids) - 1)
        row = np.flatnonzero(self.ids[at] == ids)
        return row, at[row]


def _histograms(rows: DataFrame, block, k: int) -> DataFrame:
    """(q, bin, n): of each task, the bins down to its k-th highest score of a query's interval."""

    def run(batches):
        b: Block = block.value
        width = len(b.ids)
        counts = np.zeros(width * BINS, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = b.scores(batch) - b.low
            inside = bins >= 0
            bins = bins >> b.shift
            inside &= bins < b.bins
            inside[b.own(batch)] = False
            r, q = np.nonzero(inside)
            counts += np.bincount(q * BINS + bins[r, q].astype(np.int64), minlength=width * BINS)
        counts = counts.reshape(width, BINS)
        over = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        q, which = np.nonzero((counts > 0) & (over < k))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(which.astype(np.int32)), pa.array(counts[q, which])], ["q", "bin", "n"])

    return rows.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _refine(rows: DataFrame, block: Block, k: int) -> None:
    """One round: narrows every query's interval to the bin of its k-th highest score."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(block)
    wanted = spark.sparkContext.broadcast((k - block.above).tolist())
    upto = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
    found = _histograms(rows, sent, k).withColumn("upto", upto)
    need = F.lit(wanted.value)[F.col("q")]
    first = found.where((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need)).select("q", "bin", (F.col("upto") - F.col("n")).alias("over"))
    # A row a query of the block; none for one with fewer than k candidates, whose interval keeps starting below all scores.
    for r in first.collect():
        block.low[r["q"]] += r["bin"] << block.shift
        block.above[r["q"]] += r["over"]
    finer = max(0, block.shift - BINS.bit_length() + 1)
    block.bins, block.shift = 1 << (block.shift - finer), finer if block.shift else -1
    sent.unpersist()


def _best(rows: DataFrame, block, k: int) -> DataFrame:
    """(query_id, vec_id, score): each task's k best of a query at or above its k-th highest score of all."""

    def run(batches):
        b: Block = block.value
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if not b.exact else np.int64)]

        def pruned(q, i, s):
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            start = np.append(True, q[1:] != q[:-1]) if len(q) else np.zeros(0, bool)
            rank = np.arange(len(q)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(q) else np.zeros(0, np.int64)
            return [q[rank < k], i[rank < k], s[rank < k]]

        for batch in batches:
            if not batch.num_rows:
                continue
            s = b.scores(batch)
            good = s >= b.low
            good[b.own(batch)] = False
            r, q = np.nonzero(good)
            ids = batch.column("vec_id").to_numpy()
            kept = [np.concatenate(x) for x in zip(kept, (q, ids[r], s[r, q]))]
            if len(kept[0]) > 4 * k * len(b.ids):
                kept = pruned(*kept)
        q, i, s = pruned(*kept)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[q]), pa.array(i), pa.array(s.astype(np.int64))], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block_size: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``quantised`` vectors whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = staged(vectors, "vectors")  # scanned three or four times a block
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    largest, dims = rows.agg(F.sqrt(F.max(size)), F.max(F.size("vector"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not dims:
        return spark.createDataFrame([], schema)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    folder, after = shared_dir(spark, "top-k"), None
    while True:
        todo = asked if after is None else asked.where(F.col("vec_id") > after)
        got = todo.orderBy("vec_id").limit(block_size).collect()
        if not got:
            break
        after = got[-1]["vec_id"]
        m = np.zeros((len(got), dims))
        for i, r in enumerate(got):
            m[i, : len(r["vector"])] = r["vector"]
        block = Block(np.array([r["vec_id"] for r in got], np.int64), m, largest)
        while block.shift >= 0:
            _refine(rows, block, k)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = _best(rows, spark.sparkContext.broadcast(block), k).withColumn("rank", rank).where(F.col("rank") <= k)
        best.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
        if len(got) < block_size:
            break
    return spark.read.schema(schema).parquet(folder) if after is not None else spark.createDataFrame([], schema)
