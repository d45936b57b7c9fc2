"""What the operators of this subpackage share: the shared folder, staged tables, a worker's memory, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that Python workers anywhere can import it."""
    sc = spark.sparkContext
    if not getattr(sc, "_terracell_sent", False):
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="terracell-")) / "terracell.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted((root / "terracell").rglob("*.py")):
                z.write(p, p.relative_to(root))
        sc.addPyFile(str(archive))
        sc._terracell_sent = True


#: Bytes of an Arrow batch, in the JVM and in Python.
ARROW_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input.

    Arrow batches are bounded in bytes, as texts may be long. Plans read this bound from the session when
    they run, so it stays set; it changes no result, and batches of short rows stay as they were.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB") or 0) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hadoop(spark: SparkSession, uri: str):
    """Hadoop's file system of a URI, and its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which the driver and all executors see.

    A folder without a scheme lies in the cluster's default file system, for Spark and for the file
    system that ``filesystem`` opens alike. Only where the session names no folder (tests, a single
    machine) a temporary one takes its place.
    """
    sc = spark.sparkContext
    base = getattr(sc, "_terracell_shared", None)
    if not base:
        base = sc.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="terracell-")
        fs, path = _hadoop(spark, base)
        base = fs.makeQualified(path).toString()
        # Hadoop writes file:/x, others file:///x.
        base = sc._terracell_shared = base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file://") else base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: its lineage ends there. The folder goes with ``discard``, or when the driver ends."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if not _staged:
        atexit.register(_sweep)
    _staged.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


_staged: set[str] = set()


def discard(*frames: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path in _staged:
            _staged.discard(path)
            fs, where = _hadoop(df.sparkSession, path)
            fs.delete(where, True)


def _sweep() -> None:
    """Removes what is left of them when the driver ends."""
    for path in sorted(_staged):
        try:
            fs, where = filesystem(path)
            fs.delete_dir(where)
        except OSError:  # the store is gone, or something else removed it
            pass
    _staged.clear()


def filesystem(uri: str):
    """A pyarrow file system and the path in it, usable on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the two columns an operator needs, null texts empty. Whatever else df has is left out."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


_held: dict[str, tuple] = {}


def held(name: str, make: Callable):
    """What a worker remembers for one model or tokenizer, made anew for another: no more than one is kept at a time."""
    if "one" not in _held or _held["one"][0] != name:
        release()
        _held["one"] = (name, make())
    return _held["one"][1]


def release() -> None:
    """Forgets it, before work that needs none, and gives freed memory back to the system."""
    if _held:
        _held.clear()
    trim()


def trim() -> None:
    """Gives memory that is free back to the system; what the worker remembers stays. A worker that has done its task may long be idle."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


# The C library keeps freed memory for later; a worker that goes from one kind of work to another does not need it.
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):
    _trim = None


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of one column, or one row."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column)
        sizes = np.cumsum(pc.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, column: str = "text", most: int = 1 << 22, keeps: bool = True) -> DataFrame:
    """fn over Arrow batches of at most ``most`` bytes of a column, of each partition. keeps: fn uses what the worker holds; else that is released first."""

    def run(batches):
        if not keeps:
            release()
        try:
            for part in slices(batches, column, most):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
        finally:
            part = out = None
            trim()

    return df.mapInArrow(run, schema)
