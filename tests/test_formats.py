"""File formats by exact round trips and hand-made files."""

import struct

import numpy as np
import pytest

from fieldloom.sources import files
from fieldloom.sources import formats as f


@pytest.mark.parametrize("data", [b"", b"a", b"abababababab" * 50, bytes(range(256)) * 80, np.random.default_rng(1).bytes(40_000), b"\0" * 100_000])
def test_lzw_round_trip(data):
    assert f.lzw_decode(f.lzw_encode(data)) == data


def test_lzw_of_the_published_example():
    """The bytes 7 7 7 8 8 7 7 6 6 as clear, 7, 258, 8, 8, 258, 6, 6, end, in nine bits each."""
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    packed = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    assert f.lzw_decode(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and f.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed


@pytest.mark.parametrize("compression", [f.NO_COMPRESSION, f.LZW, f.DEFLATE])
@pytest.mark.parametrize("kind", ["u1", "i2", "i4", "f4", "f8"])
def test_geotiff_round_trip(compression, kind):
    bands = (np.random.default_rng(2).random((3, 17, 23)) * 200).astype(kind)
    got = f.read_geotiff(f.write_geotiff(f.Raster(bands, (4321000.0, 3210000.0), (10.0, 10.0), 3035, -9999.0), compression))
    assert (got.bands == bands).all() and got.bands.dtype == bands.dtype
    assert (got.origin, got.size, got.epsg, got.nodata) == ((4321000.0, 3210000.0), (10.0, 10.0), 3035, -9999.0)


def test_tiled_big_endian_tiff_with_predictor():
    """Two tiles of 16 x 16 over 20 columns, differences along rows, high byte first."""
    whole = np.arange(16 * 20, dtype=">u2").reshape(16, 20)
    wide = np.zeros((16, 32), ">u2")
    wide[:, :20] = whole
    tiles = [np.diff(wide[:, k : k + 16], axis=1, prepend=0).astype(">u2").tobytes() for k in (0, 16)]
    tags = [(256, 3, [20]), (257, 3, [16]), (258, 3, [16]), (259, 3, [1]), (277, 3, [1]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, [8, 520]), (325, 4, [512, 512])]
    at = 8 + 1024
    extra_at, rows, extra = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, values in tags:
        packed = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        rows += struct.pack(">HHI", tag, kind, len(values)) + (packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(">I", extra_at + len(extra)))
        extra += packed if len(packed) > 4 else b""
    data = struct.pack(">2sHI", b"MM", 42, at) + b"".join(tiles) + struct.pack(">H", len(tags)) + rows + b"\0" * 4 + extra
    assert (f.read_geotiff(data).bands[0] == whole).all()
    with pytest.raises(ValueError):
        f.read_geotiff(b"II\0\0")


def netcdf():
    """Two dates (records) of a 2 x 3 raster of packed shorts, and a coordinate."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0) + name("y") + struct.pack(">i", 2) + name("x") + struct.pack(">i", 3)
    attrs = struct.pack(">ii", 12, 1) + name("crs") + struct.pack(">ii", 2, 9) + b"EPSG:3035" + b"\0" * 3
    own = struct.pack(">ii", 12, 2) + name("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + name("_FillValue") + struct.pack(">iih", 3, 1, -1) + b"\0\0"
    none = struct.pack(">ii", 0, 0)

    def head(start_x, start_b):
        x = name("x") + struct.pack(">ii", 1, 2) + none + struct.pack(">iii", 5, 12, start_x)
        b = name("band") + struct.pack(">iiii", 3, 0, 1, 2) + own + struct.pack(">iii", 3, 12, start_b)
        return b"CDF\x01" + struct.pack(">i", 2) + dims + attrs + struct.pack(">ii", 11, 2) + x + b

    size = len(head(0, 0))
    values = np.array([[[2, 4, 6], [8, -1, 12]], [[1, 3, 5], [7, 9, 11]]], ">i2")
    return head(size, size + 12) + np.array([0.5, 1.5, 2.5], ">f4").tobytes() + values.tobytes()


def test_classic_netcdf_by_hand():
    cube = f.read_netcdf(netcdf())
    assert cube.attributes == {"crs": "EPSG:3035"}
    dims, band, _ = cube.variables["band"]
    assert dims == ("time", "y", "x") and band[0, 0].tolist() == [1, 2, 3] and np.isnan(band[0, 1, 1]) and band[1, 1].tolist() == [3.5, 4.5, 5.5]
    assert cube.variables["x"][1].tolist() == [0.5, 1.5, 2.5]


def shapefile():
    ring = np.array([[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]], "<f8")
    hole = ring[::-1] / 4 + 0.5
    body = struct.pack("<i4d2i2i", 5, 0, 0, 2, 2, 2, 10, 0, 5) + ring.tobytes() + hole.tobytes()
    shp = struct.pack(">i", 9994) + b"\0" * 96 + struct.pack(">ii", 1, len(body) // 2) + body + struct.pack(">ii", 2, 2) + struct.pack("<i", 0)
    column = lambda n, k, w, d: n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14
    head = column("NAME", "C", 6, 0) + column("CODE", "N", 4, 0) + column("AREA", "N", 6, 2)
    rows = b" Bremen  12  4.50" + b" " + "Köln".encode().ljust(6) + b"    " + b"      "
    dbf = struct.pack("<4sIHH", b"\x03\0\0\0", 2, 32 + len(head) + 1, 17) + b"\0" * 20 + head + b"\r" + rows
    return shp, dbf


def test_shapefile_by_hand():
    shp, dbf = shapefile()
    (rings, empty) = f.read_polygons(shp)
    assert empty is None and [r.shape for r in rings] == [(5, 2), (5, 2)] and rings[0][2].tolist() == [2, 2]
    assert f.read_records(dbf) == [{"NAME": "Bremen", "CODE": 12, "AREA": 4.5}, {"NAME": "Köln", "CODE": None, "AREA": None}]


def test_files_are_read_by_tasks(spark, tmp_path):
    px = spark.createDataFrame([(t, r, c, float(t + r * 4 + c), 1.0 if r else None) for t in (1, 2) for r in range(3) for c in range(4)], "tile long, r int, c int, a double, b double")
    for row in files.encoded_rasters(px, ["a", "b"]).collect():
        (tmp_path / f"{row.tile}.tif").write_bytes(row.content)
    (tmp_path / "bad.tif").write_bytes(b"II no")
    pixels, bad = files.read_rasters(spark, str(tmp_path))
    got = {(r.path[-5], r.r, r.c): r.bands for r in pixels.collect()}
    assert len(got) == 24 and got["2", 1, 3] == [9.0, 1.0] and got["1", 0, 0] == [1.0, None]
    assert [r.path.endswith("bad.tif") for r in bad.collect()] == [True] and pixels.first().crs == 3035
    (tmp_path / "x.nc").write_bytes(netcdf())
    cube, _ = files.read_rasters(spark, str(tmp_path), "*.nc", "netcdf")
    assert {(r.r, r.c): r.bands for r in cube.collect()}[1, 1] == [None, 4.5]
    shp, dbf = shapefile()
    (tmp_path / "land.shp").write_bytes(shp)
    (tmp_path / "land.dbf").write_bytes(dbf)
    rings = files.read_shapes(spark, str(tmp_path)).collect()
    assert [(r.name, r.shape, r.ring, len(r.points)) for r in sorted(rings, key=lambda r: r.ring)] == [("land", 0, 0, 5), ("land", 0, 1, 5)] and "Bremen" in rings[0].record


def test_tables_documents_and_checkpoints(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, [])], "id int, name string, list array<int>")
    files.write_table(df, f"{tmp_path}/t.csv")
    got = files.read_table(spark, f"{tmp_path}/t.csv").orderBy("id").collect()
    assert [(r.id, r.name, r["list"]) for r in got] == [(1, "a", "[1,2]"), (2, None, "[]")]
    files.store_results(df, f"{tmp_path}/r")
    assert files.load_results(spark, f"{tmp_path}/r").count() == 2
    with pytest.raises(Exception):
        files.store_results(df, f"{tmp_path}/r")
    images, boxes = spark.createDataFrame([(7, "x.tif")], "id int, file_name string"), spark.createDataFrame([(1, 7, 3.0)], "id int, image_id int, area double")
    files.write_coco(images, boxes, [{"id": 1, "name": "field"}], f"{tmp_path}/coco")
    back = files.read_coco(spark, f"{tmp_path}/coco")
    assert back[0].first().file_name == "x.tif" and back[1].first().area == 3
    for n in (2, 11, 9):
        (tmp_path / f"best_epoch_{n}.pth").write_bytes(b"x")
    best = files.best_checkpoint(spark, str(tmp_path), "best_*.pth")
    assert best.endswith("best_epoch_11.pth") and files.best_checkpoint(spark, str(tmp_path), "none_*") is None
    files.copy_files(spark, [best], f"{tmp_path}/kept")
    assert (tmp_path / "kept" / "best_epoch_11.pth").exists()
    preds = spark.createDataFrame([(5, [0.9, 0.4], [1, 2], [[(0, 0), (0, 1)], [(3, 3)]])], "tile long, scores array<double>, labels array<int>, masks array<array<struct<r:int,c:int>>>")
    preds.write.parquet(f"{tmp_path}/preds")
    inst, masks = files.read_instances(spark, f"{tmp_path}/preds")
    assert inst.count() == 2 and sorted((r.inst, r.r, r.c) for r in masks.collect()) == [(0, 0, 0), (0, 0, 1), (1, 3, 3)]
