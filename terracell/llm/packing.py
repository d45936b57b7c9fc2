"""Operator 8: packing by power-of-two decomposition.

A document of n tokens is cut into as many pieces of ``max_length`` as it holds and one piece for each
binary digit of the rest, longest first.  Every piece is a sequence of its own whose length is a power
of two, so no sequence holds two documents and none is padded; batches are drawn from a bucket, in
which all sequences have one length.

A sequence's id holds its bucket, the task that made it and its rank there: unique without a shuffle,
and equal when a task runs again.  Cases: a null or empty text is the end id alone, one sequence of
length 1; repeated rows are packed one by one; an empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import release, slices, texts
from .fasttok import encoder

#: Bits of a sequence's id for the rank within a task and bucket, and for the task.
RANK_BITS, PART_BITS = 32, 26


def decompose(n: int, max_length: int) -> list[int]:
    """Lengths of the pieces of n tokens."""
    out = [max_length] * (n // max_length)
    rest = n % max_length
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, max_length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, bucket, sequence_id, offset, ids): a row a piece; ids are little-endian unsigned 32-bit."""
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def run(batches):
        release()
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        ranks = np.zeros(64, np.int64)
        for batch in slices(batches, most=1 << 22):
            got = enc.encode(batch.column("text").to_pylist())
            total = np.fromiter(map(len, got), np.int64, len(got)) + 1
            cuts = [decompose(n, max_length) for n in total.tolist()]
            count = np.fromiter(map(len, cuts), np.int64, len(cuts))
            length = np.fromiter((x for c in cuts for x in c), np.int64, int(count.sum()))
            which = np.repeat(np.arange(len(got)), count)
            before = np.cumsum(length) - length
            start = before - np.repeat((np.cumsum(total) - total), count)
            bucket = np.log2(length).astype(np.int64)
            rank = np.empty(len(length), np.int64)
            for b in np.unique(bucket):
                own = bucket == b
                rank[own] = ranks[b] + np.arange(own.sum())
                ranks[b] += own.sum()
            end = np.array([end_id], "<u4")
            flat = np.concatenate([x.astype("<u4") for ids in got for x in (ids, end)])
            offsets = np.append(before, len(flat)) * 4
            ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(which)), pa.array(start), pa.array(length), pa.array(np.repeat(total, count)), pa.array(bucket.astype(np.int32)), pa.array((bucket << (RANK_BITS + PART_BITS)) | (part << RANK_BITS) | rank), pa.array(np.zeros(len(length), np.int64)), ids],
                ["doc_id", "start", "length", "doc_tokens", "bucket", "sequence_id", "offset", "ids"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, bucket int, sequence_id long, offset long, ids binary")


def write_buckets(packed: DataFrame, folder: str) -> None:
    """A folder of sequences for each length, from which a trainer draws batches without padding."""
    packed.write.partitionBy("bucket").parquet(folder)
