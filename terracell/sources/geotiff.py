"""Single-band GeoTIFF files: strips or tiles, plain or deflate, with or without a predictor; as a Spark data source.

``spark.read.format("geotiff").load(path)`` gives (row, col, value), a partition per run of blocks, so a
large raster is decoded in parallel.  No-data and NaN values are null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..grid import GridSpec

#: Fixed values of the TIFF format: sizes of field types, and tags.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
CODES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, FORMAT, SCALE, TIEPOINT, GEOKEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
PROJECTED, GEOGRAPHIC = 3072, 2048


class Tiff:
    """Header and blocks of the first image of a file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            head = f.read(8)
            self.order = {b"II": "<", b"MM": ">"}[head[:2]]
            magic, at = struct.unpack(f"{self.order}HI", head[2:])
            if magic != 42:
                raise ValueError(f"{path}: not a classic TIFF file")
            f.seek(at)
            (n,) = struct.unpack(f"{self.order}H", f.read(2))
            entries = [struct.unpack(f"{self.order}HHI4s", f.read(12)) for _ in range(n)]
            self.tags = {}
            for tag, kind, count, raw in entries:
                size = SIZES.get(kind, 1) * count
                if size > 4:
                    f.seek(struct.unpack(f"{self.order}I", raw)[0])
                    raw = f.read(size)
                self.tags[tag] = raw[:size].rstrip(b"\0") if kind == 2 else struct.unpack(f"{self.order}{count}{CODES[kind]}", raw[:size]) if kind in CODES else raw
        one = lambda t, d=None: self.tags.get(t, (d,))[0]
        self.width, self.height = one(WIDTH), one(HEIGHT)
        if one(SAMPLES, 1) != 1:
            raise ValueError(f"{path}: more than one band")
        self.compression, self.predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
        if self.compression not in (1, 8, 32946):
            raise ValueError(f"{path}: compression {self.compression} is not supported")
        self.dtype = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[one(FORMAT, 1)]}{one(BITS, 1) // 8}")
        self.tiled = TILES in self.tags
        self.block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if self.tiled else (min(one(ROWS, self.height), self.height), self.width)
        self.offsets, self.counts = self.tags[TILES if self.tiled else STRIPS], self.tags[TILE_COUNTS if self.tiled else COUNTS]
        nodata = self.tags.get(NODATA, b"").decode().strip()
        self.nodata = float(nodata) if nodata else None

    @property
    def grid(self) -> GridSpec:
        sx, sy = self.tags[SCALE][:2]
        i, j, _, x, y, _ = self.tags[TIEPOINT][:6]
        keys = self.tags.get(GEOKEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
        return GridSpec(x - i * sx, y + j * sy, sx, -sy, self.width, self.height, codes.get(PROJECTED, codes.get(GEOGRAPHIC, 0)))

    def read(self, k: int) -> tuple[int, int, np.ndarray]:
        """First row and column, and values, of block k."""
        across = -(-self.width // self.block[1]) if self.tiled else 1
        r, c = (k // across) * self.block[0], (k % across) * self.block[1]
        with open(self.path, "rb") as f:
            f.seek(self.offsets[k])
            raw = f.read(self.counts[k])
        if self.compression != 1:
            raw = zlib.decompress(raw)
        h = self.block[0] if self.tiled else min(self.block[0], self.height - r)
        size = self.dtype.itemsize
        if self.predictor == 3:  # bytes of a row by significance, then differences
            b = np.frombuffer(raw, np.uint8).reshape(h, -1)
            b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(h, size, self.block[1])
            a = np.ascontiguousarray(b.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">"))[:, :, 0]
        else:
            a = np.frombuffer(raw, self.dtype).reshape(h, self.block[1])
            if self.predictor == 2:
                a = np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("="))
        return r, c, a[: self.height - r, : self.width - c]


def write(path: str, values: np.ndarray, grid: GridSpec, nodata: float = -9999.0) -> None:
    """A float32 raster, deflate with predictor 3, one strip of 64 rows at a time; NaN becomes no data."""
    a = np.where(np.isfinite(values), values, nodata).astype(">f4")
    h, w = a.shape
    strips = []
    for r in range(0, h, 64):
        part = np.ascontiguousarray(a[r : r + 64])
        b = part.view(np.uint8).reshape(len(part), w, 4).transpose(0, 2, 1).reshape(len(part), -1).copy()
        b[:, 1:] -= b[:, :-1].copy()
        strips.append(zlib.compress(b.tobytes(), 6))
    text = f"{nodata:g}".encode() + b"\0"
    keys = (1, 1, 0, 2, 1024, 0, 1, 1, PROJECTED, 0, 1, grid.epsg)
    tags = [(WIDTH, "I", (w,)), (HEIGHT, "I", (h,)), (BITS, "H", (32,)), (COMPRESSION, "H", (8,)), (PHOTOMETRIC, "H", (1,)), (STRIPS, "I", None), (SAMPLES, "H", (1,)), (ROWS, "I", (64,)), (COUNTS, "I", tuple(map(len, strips))), (PREDICTOR, "H", (3,)), (FORMAT, "H", (3,)),
            (SCALE, "d", (grid.dx, -grid.dy, 0.0)), (TIEPOINT, "d", (0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0)), (GEOKEYS, "H", keys), (NODATA, "s", text)]
    kinds = {"H": 3, "I": 4, "d": 12, "s": 2}
    at = 8 + 2 + 12 * len(tags) + 4
    extra, plan = b"", []
    sizes = {"H": 2, "I": 4, "d": 8}
    data_size = sum((len(v) if k == "s" else len(v or strips) * sizes[k]) for _, k, v in tags if (len(v) if k == "s" else len(v or strips) * sizes[k]) > 4)
    offsets = tuple(int(x) for x in at + data_size + np.cumsum([0] + [len(s) for s in strips])[:-1])
    for tag, kind, value in tags:
        value = offsets if value is None else value
        raw = value if kind == "s" else struct.pack(f"<{len(value)}{kind}", *value)
        plan.append((tag, kinds[kind], len(value), raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(extra))))
        extra += raw if len(raw) > 4 else b""
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(plan)))
        for x in plan:
            f.write(struct.pack("<HHI4s", *x))
        f.write(struct.pack("<I", 0) + extra + b"".join(strips))


class _Blocks(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class GeoTiffReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.run = [options["path"]], int(options.get("blocks", 64))

    def partitions(self):
        files = [p for path in self.paths for p in (sorted(Path(path).glob("*.tif")) if Path(path).is_dir() else [Path(path)])]
        return [_Blocks(str(f), k, min(k + self.run, n)) for f in files for n in [len(Tiff(str(f)).offsets)] for k in range(0, n, self.run)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        tiff = Tiff(partition.path)
        for k in range(partition.first, partition.end):
            r, c, a = tiff.read(k)
            rows, cols = np.indices(a.shape)
            v = a.astype(np.float64).ravel()
            bad = ~np.isfinite(v) if tiff.nodata is None else ~np.isfinite(v) | (v == tiff.nodata)
            yield pa.RecordBatch.from_arrays([pa.array((rows + r).ravel().astype(np.int32)), pa.array((cols + c).ravel().astype(np.int32)), pa.array(v, mask=bad)], ["row", "col", "value"])


class GeoTiff(DataSource):
    """Register with ``spark.dataSource.register(GeoTiff)``."""

    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return "row int, col int, value double"

    def reader(self, schema):
        return GeoTiffReader(self.options)
