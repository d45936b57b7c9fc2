"""Operator 9: byte-pair encoding and decoding with content-defined chunk reuse.

1. Every text is cut by a rolling hash into chunks, so passages that texts share become equal chunks
   wherever they stand.  Only chunk digests are shuffled; those met more than once are *shared*.
2. The text of each shared chunk is encoded once for the whole corpus and written to a store in the
   shared folder: sorted digests, offsets and ids, memory-mapped by the workers.
3. Every text is assembled from the store's ids and, for chunks that occur once, its own.  A chunk's
   ids are wrong near its ends, where its text was torn out of its context.  So around each join a
   window is encoded again.  It reaches from one *sure cut* to another: a space before a letter always
   begins a piece of the tokenizer's pattern, whatever surrounds it.  The window takes in one sure
   piece of either chunk more than it replaces; the ids of those must agree with the chunk's own.  A
   chunk with too few sure cuts is taken into the window whole; a text whose windows do not agree is
   encoded as a whole.
4. The ids are decoded, and the decoded bytes are compared with the text.  Should a digest have stood
   for two chunks, this shows it, and the text is encoded as a whole.

Cases: a null text counts as empty (no ids, an empty decoded text); texts without sure cuts are encoded
as a whole; strings of special tokens are handled as the library's default; repeated rows each get
their row; an empty table gives no rows.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import chunks
from .common import filesystem, map_batches, partitions, shared_dir, slices, texts
from .fasttok import SpanHash, encoder, ragged
from .prefix_counts import byte_of
from .token_files import _array

#: Bytes of a chunk: at least, normally, at most.
SIZES = (256, 1024, 8192)


@lru_cache(maxsize=1)
def _digests() -> SpanHash:
    return SpanHash(256, 977)


def digest(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit digests of chunks, as signed integers."""
    h = _digests()
    return h.spans(h.prefix(flat), start, start + length).view(np.int64)


class Store:
    """Sorted digests with their ids, in 2**bits parts by the digests' leading bits."""

    def __init__(self, folder: str, bits: int, parts: dict[int, tuple[str, int]], width: int):
        self.folder, self.bits, self.parts, self.width = folder, bits, parts, width
        self._open: dict[int, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _part(self, p: int) -> tuple:
        if p not in self._open:
            name, n = self.parts[p]
            fs, base = filesystem(self.folder)
            path = f"{base}/{name}"
            self._open[p] = (_array(fs, f"{path}.idx", "<i8", 0, n), _array(fs, f"{path}.idx", "<i8", 8 * n, n + 1), _array(fs, f"{path}.bin", f"<u{self.width}") if self.width else None)
        return self._open[p]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Whether each digest is held, and the ids of those that are, by position in h."""
        held, ids = np.zeros(len(h), bool), {}
        part = (h.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        for p in np.unique(part).tolist():
            if p not in self.parts:
                continue
            keys, offsets, flat = self._part(p)
            own = np.flatnonzero(part == p)
            at = np.minimum(np.searchsorted(keys, h[own]), len(keys) - 1)
            hit = keys[at] == h[own]
            held[own[hit]] = True
            if self.width:
                for i, k in zip(own[hit].tolist(), at[hit].tolist()):
                    ids[i] = flat[offsets[k] : offsets[k + 1]]
        return held, ids


def write_store(rows: DataFrame, folder: str, tokenizer: str | None) -> Store:
    """A store of (digest[, text]) rows with distinct digests; one task writes a part, and one row a part comes to the driver."""
    spark = rows.sparkSession
    bits = max(0, (partitions(spark) - 1).bit_length())
    part = F.shiftrightunsigned("digest", 64 - bits).cast("int") if bits else F.lit(0)
    width = encoder(tokenizer).dtype().itemsize if tokenizer else 0

    def write(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        keys, n, out, name, at = [], [], None, "", -1
        found = []

        def close():
            if at >= 0:
                out.close()
                with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as f:
                    f.write(np.concatenate(keys).astype("<i8").tobytes())
                    f.write(np.concatenate(([0], np.cumsum(np.concatenate(n)))).astype("<i8").tobytes())
                found.append((at, name, sum(map(len, keys))))

        for batch in slices(batches) if tokenizer else batches:
            owner = batch.column("part").to_numpy()
            for p in np.unique(owner).tolist():
                if p != at:
                    close()
                    keys, n, at, name = [], [], p, f"part-{p:05d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{base}/{name}.bin", compression=None)
                own = np.flatnonzero(owner == p)
                keys.append(batch.column("digest").to_numpy()[own])
                ids = encoder(tokenizer).encode(batch.column("text").take(pa.array(own)).to_pylist()) if tokenizer else []
                n.append(np.fromiter(map(len, ids), np.int64, len(ids)) if tokenizer else np.zeros(len(own), np.int64))
                if ids:
                    out.write(np.concatenate(ids).tobytes())
        close()
        for p, file, count in found:
            yield pa.RecordBatch.from_pydict({"part": [p], "file": [file], "n": [count]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("n", pa.int64())]))

    dealt = rows.withColumn("part", part).repartition(1 << bits, "part").sortWithinPartitions("part", F.expr("digest"))
    parts = dealt.mapInArrow(write, "part int, file string, n long").collect()
    # Unsigned leading bits deal the parts; within one, signed order is as good as any.
    return Store(folder, bits, {r["part"]: (r["file"], r["n"]) for r in parts}, width)


def shared_store(docs: DataFrame, tokenizer: str) -> Store:
    """The ids of all chunks that occur more than once among docs (doc_id, text)."""
    spark = docs.sparkSession
    raw = docs.select(F.col("text").cast("binary").alias("text"))

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, start, length, _ = chunks(batch.column("text").to_pylist(), *SIZES)
        return pa.RecordBatch.from_arrays([pa.array(digest(flat, start, length)), pa.array(np.ones(len(start), np.int64))], ["digest", "n"])

    seen = map_batches(raw, digests, "digest long, n long")
    often = seen.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    wanted = write_store(often, shared_dir(spark, "chunk-digests"), None)

    def passages(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        flat, start, length, _ = chunks(batch.column("text").to_pylist(), *SIZES)
        h = digest(flat, start, length)
        held = np.flatnonzero(wanted.find(h)[0])
        new, first = np.unique(h[held], return_index=True)
        held = held[first]
        raw = flat.tobytes()
        return pa.RecordBatch.from_arrays([pa.array(new), pa.array([raw[s : s + n].decode() for s, n in zip(start[held].tolist(), length[held].tolist())], pa.string())], ["digest", "text"])

    texts_of = map_batches(raw, passages, "digest long, text string").groupBy("digest").agg(F.min("text").alias("text"))
    return write_store(texts_of, shared_dir(spark, "chunk-ids"), tokenizer)


class Codec:
    """Assembles the ids of whole texts from chunks, and decodes ids."""

    def __init__(self, tokenizer: str):
        self.encoder = encoder(tokenizer)
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_of()
        of = {i: bytes(to_byte[c] for c in w) for w, i in spec["model"]["vocab"].items()}
        of |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        words = [of.get(i, b"") for i in range(max(of) + 1)]
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, special tokens included."""
        return self.bytes[ragged(self.at[ids], self.size[ids])].tobytes()

    def encode(self, texts: list[str], store: Store) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        flat, start, length, which = chunks(raw, *SIZES)
        end = start + length
        n = len(start)
        _, ids = store.find(digest(flat, start, length))
        data = flat.tobytes()
        own = [i for i in range(n) if i not in ids]
        ids |= dict(zip(own, self.encoder.encode([data[start[i] : end[i]].decode() for i in own])))
        # Sure cuts: before a space that an ASCII letter follows.
        low = flat | 0x20
        sure = np.flatnonzero((flat[:-1] == 32) & (low[1:] >= 97) & (low[1:] <= 122))
        first, last = np.searchsorted(sure, start), np.searchsorted(sure, end - 1) - 1
        bounds = np.searchsorted(which, np.arange(len(texts) + 1))
        plans, windows = [], []
        for k in range(len(texts)):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if b - a <= 1:
                plans.append([("chunk", a, None, None)] if b > a else [])
                continue
            # A chunk whose ids are used needs sure cuts c0 <= c1 < c2 <= c3: ids between c1 and c2 are taken, those from c0 and to c3 compared.
            firm = [i for i in range(a, b) if i in (a, b - 1) or last[i] - first[i] >= 3]
            plan, left = [], None
            for i in firm:
                if last[i] - first[i] < 3:
                    continue
                c0, c1, c2, c3 = (int(sure[first[i]]), int(sure[first[i] + 1]), int(sure[last[i] - 1]), int(sure[last[i]]))
                begin = int(start[a]) if left is None else left[0]
                if i == a:
                    plan.append(("chunk", i, None, c2))
                else:
                    plan.append(("window", len(windows), left, (c0, c1, i)))
                    windows.append((begin, c1))
                    plan.append(("chunk", i, c1, c2 if i < b - 1 else None))
                left = (int(sure[last[i] - 2]), c2, i)
                if i == b - 1:
                    left = None
            if not plan:
                plan = [("whole", k, None, None)]
            elif left is not None:
                plan.append(("window", len(windows), left, None))
                windows.append((left[0], int(end[b - 1])))
            plans.append(plan)
        mended = self.encoder.encode([data[a:b].decode() for a, b in windows])
        return [self._assemble(plan, texts[k], raw[k], ids, mended, windows, start) for k, plan in enumerate(plans)]

    def _upto(self, ids: np.ndarray, size: int) -> int:
        """How many ids hold the first ``size`` bytes; -1 if no id ends there."""
        ends = np.cumsum(self.size[ids])
        i = int(np.searchsorted(ends, size)) + 1 if size else 0
        return i if not size or (i <= len(ends) and ends[i - 1] == size) else -1

    def _assemble(self, plan, text, raw, ids, mended, windows, start) -> np.ndarray:
        parts = []
        for what, i, a, b in plan:
            if what == "whole":
                return self.encoder.encode([text])[0]
            if what == "chunk":
                own = ids[i]
                lo = 0 if a is None else self._upto(own, a - int(start[i]))
                hi = len(own) if b is None else self._upto(own, b - int(start[i]))
                if lo < 0 or hi < 0:
                    return self.encoder.encode([text])[0]
                parts.append(own[lo:hi])
                continue
            begin, stop = windows[i]
            got = mended[i]
            skip = 0
            if a is not None:  # the piece before the left cut must come out as in the left chunk
                skip = self._upto(got, a[1] - begin)
                left = ids[a[2]]
                x, y = self._upto(left, begin - int(start[a[2]])), self._upto(left, a[1] - int(start[a[2]]))
                if min(skip, x, y) < 0 or not np.array_equal(got[:skip], left[x:y]):
                    return self.encoder.encode([text])[0]
            if b is not None:  # and the piece before the right cut as in the right chunk
                right, off = ids[b[2]], int(start[b[2]])
                w, x, y = self._upto(got, b[0] - begin), self._upto(right, b[0] - off), self._upto(right, b[1] - off)
                if min(w, x, y) < 0 or not np.array_equal(got[w:], right[x:y]):
                    return self.encoder.encode([text])[0]
            parts.append(got[skip:])
        out = np.concatenate(parts) if parts else np.zeros(0, self.encoder.dtype)
        return out if self.decode(out) == raw else self.encoder.encode([text])[0]


@lru_cache(maxsize=1)
def codec(tokenizer: str) -> Codec:
    return Codec(tokenizer)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids are little-endian unsigned 32-bit, decoded is UTF-8 made from the ids alone."""
    rows = texts(docs, id_col, text_col)
    store = shared_store(rows, tokenizer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(tokenizer)
        got = c.encode(batch.column("text").to_pylist(), store)
        n = np.fromiter(map(len, got), np.int64, len(got))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), pa.array([x.astype("<u4").tobytes() for x in got], pa.binary()), pa.array([c.decode(x) for x in got], pa.binary())],
            ["doc_id", "n_tokens", "ids", "decoded"],
        )

    return map_batches(rows, run, "doc_id long, n_tokens long, ids binary, decoded binary")
