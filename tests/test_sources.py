"""File formats by round trips."""

import io
import zipfile

import numpy as np
import pytest

from terracell.grid import GridSpec
from terracell.sources import files, geotiff, vectors


def test_geotiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(150, 37)).astype("f4")
    z[3, 4] = np.nan
    g = GridSpec(500000.0, 6700000.0, 30.0, -30.0, 37, 150, 31982)
    path = str(tmp_path / "z.tif")
    geotiff.write(path, z, g)
    assert geotiff.Tiff(path).grid == g
    spark.dataSource.register(geotiff.GeoTiff)
    d = spark.read.format("geotiff").option("blocks", "1").load(path)
    got = {(r["row"], r["col"]): r["value"] for r in d.collect()}
    assert len(got) == z.size and got[3, 4] is None
    assert all(got[r, c] == z[r, c] for r in (0, 64, 149) for c in (0, 36))


def test_geopackage_round_trip(spark, tmp_path):
    path = str(tmp_path / "p.gpkg")
    vectors.write_gpkg_points(path, "pts", ["name"], [(1.5, 2.5, "a"), (3.0, 4.0, None)], 31982)
    assert vectors.layers(path) == ["pts"]
    spark.dataSource.register(vectors.Vector)
    d = spark.read.format("vector").load(path).orderBy("fid").collect()
    assert [(r["kind"], r["rings"][0][0], r["attributes"]["name"]) for r in d] == [("Point", [1.5, 2.5], "a"), ("Point", [3.0, 4.0], None)]
    with pytest.raises(FileExistsError):
        vectors.write_gpkg_points(path, "pts", [], [], 31982)


def test_well_known_binary_polygon():
    import struct

    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    raw = struct.pack("<BII I", 1, 3, 1, 4) + b"".join(struct.pack("<dd", *p) for p in ring)
    assert vectors.read_wkb(raw)[:2] == ("Polygon", [ring])
    multi = struct.pack("<BII", 1, 6, 2) + raw + raw
    assert vectors.read_wkb(multi)[:2] == ("MultiPolygon", [ring, ring])


def test_shapefile(tmp_path):
    import struct

    shapes = [struct.pack("<idd", 1, x, y) for x, y in ((1.0, 2.0), (3.0, 4.0))]
    body = b"".join(struct.pack(">ii", k + 1, len(s) // 2) + s for k, s in enumerate(shapes))
    (tmp_path / "p.shp").write_bytes(struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<ii", 1000, 1) + bytes(64) + body)
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5, 0]) + bytes(14)
    (tmp_path / "p.dbf").write_bytes(bytes([3, 0, 0, 0]) + struct.pack("<IHH", 2, 65, 6) + bytes(20) + field + b"\r" + b" one  " + b" two  ")
    assert [(a["NAME"], k, r) for _, a, k, r in vectors.read_shapefile(str(tmp_path / "p.shp"))] == [("one", "Point", [[(1.0, 2.0)]]), ("two", "Point", [[(3.0, 4.0)]])]


def test_downloads_are_checked_and_atomic(tmp_path):
    import hashlib

    good = hashlib.md5(b"data").hexdigest()
    assert files.download(lambda u: [b"da", b"ta"], "u", tmp_path / "f", good).read_bytes() == b"data"
    assert files.download(lambda u: pytest.fail("fetched again"), "u", tmp_path / "f", good)
    with pytest.raises(OSError):
        files.download(lambda u: [b"bad"], "u", tmp_path / "g", good)
    with pytest.raises(OSError):
        files.download(lambda u: [], "u", tmp_path / "h")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f"]


def test_archives_pages_logs_and_publishing(tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a/b.txt", "x")
    (tmp_path / "z.zip").write_bytes(raw.getvalue())
    assert [p.read_text() for p in files.extract(tmp_path / "z.zip", tmp_path / "out")] == ["x"]
    store = {"1": {"type": "FeatureCollection", "features": [], "links": [{"rel": "next", "href": "2"}]}, "2": {"type": "FeatureCollection", "features": []}}
    assert len(files.pages(store.get, "1")) == 2
    store["2"]["links"] = [{"rel": "next", "href": "1"}]
    with pytest.raises(ValueError):
        files.pages(store.get, "1")
    (tmp_path / "log").write_text("130 passed", encoding="utf-16")
    assert files.passed_tests(tmp_path / "log") == 130
    files.publish({"p.txt": lambda p: p.write_text("1")}, tmp_path / "pub")
    with pytest.raises(FileExistsError):
        files.publish({"p.txt": lambda p: p.write_text("2")}, tmp_path / "pub")
    files.publish({"p.txt": lambda p: p.write_text("2")}, tmp_path / "pub", overwrite=True)
    assert (tmp_path / "pub" / "p.txt").read_text() == "2"
    with pytest.raises(ValueError):
        files.require_apart(tmp_path / "pub" / "x", tmp_path / "pub")


def test_provenance(spark, tmp_path):
    from terracell.operators import provenance

    (tmp_path / "a").write_text("1")
    before = spark.createDataFrame(provenance.manifest(spark, str(tmp_path)).collect())
    provenance.require_unchanged(before, provenance.manifest(spark, str(tmp_path)))
    (tmp_path / "a").write_text("2")
    with pytest.raises(RuntimeError):
        provenance.require_unchanged(before, provenance.manifest(spark, str(tmp_path)))
    with pytest.raises(ValueError):
        provenance.strict_json({"x": float("nan")})
