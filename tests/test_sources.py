import json

import pytest
from pyspark.errors import AnalysisException

from fieldloom.sources import files
from fieldloom.streaming.tile_metrics import windowed_confusion


def test_two_row_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",meta,stats,clc\ntile_id,lat,n_fields,12\nAT_1,47.5,3,10\nAT_2,,4,\n")
    got = files.read_two_row_header(spark, str(tmp_path / "t.csv"), "tile_id", {"stats_n_fields": "int"}).orderBy("tile_id")
    assert got.columns == ["tile_id", "meta_lat", "stats_n_fields", "clc_12"]
    assert [tuple(r) for r in got.collect()] == [("AT_1", 47.5, 3, 10.0), ("AT_2", None, 4, None)]


def test_coco_and_listing(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.tif"}], "annotations": [{"id": 5, "image_id": 1, "area": 4, "bbox": [0, 0, 2, 2]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    images, annotations = files.read_coco(spark, str(tmp_path / "a.json"))
    assert images.first().file_name == "a.tif" and annotations.first().bbox == [0, 0, 2, 2]
    assert files.list_files(spark, str(tmp_path), "*.json").first().name == "a.json"
    files.write_coco_annotations(annotations, str(tmp_path / "out"))
    with pytest.raises(AnalysisException):
        files.write_coco_annotations(annotations, str(tmp_path / "out"))


def test_pixels_round_trip_and_quarantine(spark, tmp_path):
    px = spark.range(200).selectExpr("id div 16 AS tile", "id % 16 AS r", "0L AS c", "1.5D AS value")
    files.write_pixels(px, str(tmp_path / "px"))
    back = files.read_pixels(spark, str(tmp_path / "px")).select(*px.columns)
    assert back.exceptAll(px).count() == 0 and back.count() == 200
    tiles = spark.createDataFrame([(1, "EPSG:3035", 0.0, 1.0), (2, "EPSG:4326", 0.0, 1.0), (3, None, 0.0, 1.0), (4, "EPSG:3035", None, 1.0)], "id int, crs string, minx double, maxx double")
    good, bad = files.quarantine(tiles)
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3, 4]


def test_streaming_counts_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", h % 2, 1 if m % 2 else None, 1 if m % 3 else None) for h in range(4) for m in range(0, 60, 7)] + [("2024-01-02 00:00:00", 0, None, None)]
    df = spark.createDataFrame(rows, "ts string, tile int, gt int, pred int").selectExpr("CAST(ts AS timestamp) AS ts", "tile", "gt", "pred")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windowed_confusion(stream).writeStream.format("memory").queryName("tiles").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        got = sorted(map(tuple, spark.sql("SELECT * FROM tiles").collect()))
    finally:
        query.stop()
    assert got == sorted(map(tuple, windowed_confusion(df).where("start < '2024-01-02'").collect()))
