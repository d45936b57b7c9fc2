"""Operator 1: token ids as flat binary files with 64-bit document offsets.

Format, for part k of a folder:

* ``part-k-*.bin``: the ids of its documents one after another, little-endian, 16 bits wide if the
  vocabulary has at most 65,536 ids, else 32.
* ``part-k-*.idx``: int64 count n, n int64 document ids, n + 1 int64 offsets (in ids, from the part's
  first), n bytes that are 0 where the document id is null.
* ``manifest.json``: width of an id and for each part its files, documents, ids and base, which is the
  number of ids in all parts before it.  A document starts at base + offset.

Documents are dealt to parts by ranges of their id and sorted within a part, so ids are in ascending
document order over the whole folder.  Each task writes only its own part; the bases are prefix sums
of one number a part.  A file's name is new for each attempt of a task, and only the names of
successful attempts reach the manifest, so a lost executor leaves no wrong file behind.

Cases: a null text counts as empty (one id, the end id); documents with equal ids keep one place each,
in order of their texts; a null document id comes first; an empty table gives no parts.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, partitions, slices, texts
from .fasttok import encoder


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encodes all texts, writes the folder and returns its manifest."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        enc = encoder(tokenizer)
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        ids_of, lengths = [], []
        out = None
        for batch in slices(batches):
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}.bin", compression=None)
            end = np.array([end_id], enc.dtype)
            got = enc.encode(batch.column("text").to_pylist())
            for ids in got:
                out.write(np.concatenate((ids, end)).astype(enc.dtype.__name__, copy=False).tobytes())
            lengths.append(np.fromiter(map(len, got), np.int64, len(got)) + 1)
            ids_of.append(batch.column("doc_id"))
        if out is None:
            return
        out.close()
        n = np.concatenate(lengths)
        key = pa.chunked_array(ids_of).combine_chunks()
        valid = key.is_valid().to_numpy(zero_copy_only=False)
        with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as idx:
            idx.write(np.array([len(n)], "<i8").tobytes())
            idx.write(key.fill_null(0).to_numpy().astype("<i8").tobytes())
            idx.write(np.concatenate(([0], np.cumsum(n))).astype("<i8").tobytes())
            idx.write(valid.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [len(n)], "ids": [int(n.sum())]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    # One row a part comes to the driver, whatever the number of documents.
    parts = sorted(rows.mapInArrow(write, "part int, file string, docs long, ids long").collect(), key=lambda r: r["part"])
    width = 2 if encoder(tokenizer).dtype is np.uint16 else 4
    base, listed = 0, []
    for r in parts:
        listed.append({"file": r["file"], "docs": r["docs"], "ids": r["ids"], "base": base})
        base += r["ids"]
    manifest = {"folder": folder, "width": width, "ids": base, "parts": listed}
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json", compression=None) as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _array(fs, path: str, dtype: str, offset: int = 0, count: int = -1) -> np.ndarray:
    """Part of a file as an array: memory-mapped where the folder is mounted, else read."""
    from pyarrow.fs import LocalFileSystem

    if isinstance(fs, LocalFileSystem):
        size = os.path.getsize(path) - offset
        n = size // np.dtype(dtype).itemsize if count < 0 else count
        return np.memmap(path, dtype, "r", offset, (n,)) if n else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return np.frombuffer(f.read() if count < 0 else f.read(count * np.dtype(dtype).itemsize), dtype)


def open_part(manifest: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, whether they are valid, offsets and ids of part k."""
    fs, path = filesystem(manifest["folder"])
    part = manifest["parts"][k]
    idx, n = f"{path}/{part['file']}.idx", part["docs"]
    return (
        _array(fs, idx, "<i8", 8, n),
        _array(fs, idx, "u1", 16 * (n + 1), n),
        _array(fs, idx, "<i8", 8 * (n + 1), n + 1),
        _array(fs, f"{path}/{part['file']}.bin", f"<u{manifest['width']}"),
    )


def read_token_files(spark: SparkSession, manifest: dict) -> DataFrame:
    """(doc_id, start, n_tokens, ids): one row a document; ids are little-endian unsigned 32-bit. One task a part."""

    def read(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                keys, valid, offsets, flat = open_part(manifest, k)
                base, n = manifest["parts"][k]["base"], len(keys)
                at = 0
                while at < n:
                    end = max(at + 1, min(at + 4096, int(np.searchsorted(offsets, offsets[at] + (1 << 21)))))
                    end = min(end, n)
                    local = np.asarray(offsets[at : end + 1])
                    data = flat[local[0] : local[-1]].astype("<u4")
                    binary = pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(((local - local[0]) * 4).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(keys[at:end]), mask=np.asarray(valid[at:end]) == 0), pa.array(local[:-1] + base), pa.array(np.diff(local)), binary], ["doc_id", "start", "n_tokens", "ids"])
                    at = end

    n = len(manifest["parts"])
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
