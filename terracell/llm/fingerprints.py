"""Operator 6: document fingerprints by content-defined chunks.

Boundaries are drawn by a gear hash with normalised sizes, so an insertion moves only the chunks around
it.  A fingerprint is the set of a text's chunk digests with their lengths, as hexadecimal entries of
ten digits (eight of digest, two of length in bytes) in ascending order.  The likeness of two is their
containment: the length of the chunks in both, over the length of the chunks of the smaller one.  Two
empty fingerprints are alike (1), an empty and another are not (0).

``with_next`` sets each document beside the one that follows it by id: documents are dealt out by
ranges of the id once, and only the first of each range is copied to the range before it.

Cases: a null text counts as empty; documents with equal ids follow one another in order of their
texts; null ids come first; a lone document follows itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import chunks
from .common import partitions, slices, texts
from .fasttok import SpanHash

#: Bytes of a chunk: at least, normally, at most (which two hexadecimal digits hold).
SIZES = (16, 48, 192)
_hash = SpanHash(256, 4242)
_hex = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


class Fingerprints:
    """Fingerprints of some texts: for each entry the text's number, digest and length, ascending."""

    def __init__(self, raw: list[bytes]):
        flat, start, length, which = chunks(raw, *SIZES)
        digest = _hash.spans(_hash.prefix(flat), start, start + length) >> np.uint64(32)
        self.n = len(raw)
        self.key, first = np.unique((which.astype(np.uint64) << np.uint64(32)) | digest, return_index=True)
        self.length = length[first]
        self.text = (self.key >> np.uint64(32)).astype(np.int64)

    def strings(self) -> list[str]:
        entry = np.empty((len(self.key), 5), np.uint8)
        digest = self.key.astype(np.uint32)
        for i, shift in enumerate((24, 16, 8, 0)):
            entry[:, i] = (digest >> np.uint32(shift)) & np.uint32(0xFF)
        entry[:, 4] = self.length
        digits = _hex[entry].tobytes().decode()
        ends = np.searchsorted(self.text, np.arange(self.n + 1)) * 10
        return [digits[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def weights(self) -> np.ndarray:
        return np.bincount(self.text, self.length, self.n)

    def likeness(self, other: "Fingerprints", shift: int = 0) -> np.ndarray:
        """Of each text's fingerprint to that of the other's text ``shift`` places further on."""
        key = other.key - (np.uint64(shift) << np.uint64(32)) if shift else other.key
        key = key[other.text >= shift]
        at = np.minimum(np.searchsorted(key, self.key), max(0, len(key) - 1))
        both = key[at] == self.key if len(key) else np.zeros(len(self.key), bool)
        n = min(self.n, other.n - shift)
        shared = np.bincount(self.text[both], self.length[both], self.n)[:n]
        a, b = self.weights()[:n], other.weights()[shift : shift + n]
        least = np.minimum(a, b)
        return np.where(np.maximum(a, b) == 0, 1.0, shared / np.maximum(least, 1))


def edited(text: str, following: str) -> str:
    """The last quarter of the text's code points replaced by as many of the next text's first."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def with_next(docs: DataFrame, fn: Callable[[list, list[str]], pa.RecordBatch], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fn over runs of documents in ascending order of id: (m ids, m + 1 texts), the last text being the next document's.

    After the last document comes the first.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = texts(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(lowest)))
    n = partitions(spark)
    bounds = sorted(set(rows.approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    bounds = [int(b) for b in bounds]
    part = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("key"))) if bounds else F.lit(0)
    rows = rows.withColumn("part", part.cast("int"))
    # One row a range: the key that it begins with.
    firsts = sorted((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())
    if not firsts:
        return spark.createDataFrame([], schema)
    before = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    ahead = rows.drop("part").where(F.col("key").isin([k for k, _ in before])).join(F.broadcast(spark.createDataFrame(before, "key long, part int")), "key")
    dealt = rows.withColumn("ahead", F.lit(0)).unionByName(ahead.withColumn("ahead", F.lit(1)))
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("ahead", "key", "text").select("doc_id", "text", "ahead")

    def run(batches):
        ids, held = [], []
        for batch in slices(batches, most=1 << 22):
            for i, text, extra in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("ahead").to_pylist()):
                held.append(text)
                if extra:
                    break
                ids.append(i)
            if len(held) > 1 and len(held) > len(ids):
                yield fn(ids, held)
                return
            if len(ids) > 1:
                yield fn(ids[:-1], held)
                ids, held = ids[-1:], held[-1:]

    return dealt.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next): fingerprints of each text and of its edited text."""

    def run(ids: list, held: list[str]) -> pa.RecordBatch:
        m = len(ids)
        new = [edited(a, b) for a, b in zip(held, held[1:])]
        one = Fingerprints([t.encode() for t in held])
        two = Fingerprints([t.encode() for t in new])
        own = one.strings()[:m]
        near, following = one.likeness(two), one.likeness(one, 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in held[:m]], pa.int64()), pa.array(new), pa.array(own), pa.array(two.strings()), pa.array(near), pa.array(following)],
            ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(docs, run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", id_col, text_col)
