"""Readers and writers of the file formats around the tables.

Rasters are held as Parquet pixel tables partitioned by tile; formats whose libraries are absent
are ingested outside and read here as those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_two_row_header(spark: SparkSession, path: str, index: str, schema: dict[str, str] | None = None) -> DataFrame:
    """A CSV whose first two lines are group and column names; columns are named group_column.

    The header lines are read alone; the rows are a distributed scan with a schema, in which the
    header does not parse and is dropped by its first field."""
    groups, names = (line.value.split(",") for line in spark.read.text(path).limit(2).collect())
    columns = [index] + [f"{g}_{n}" for g, n in zip(groups[1:], names[1:])]
    types = schema or {}
    form = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(form).csv(path)
    heads = [groups[0] or None, names[0] or None]
    header = F.coalesce(F.col(columns[1]) == groups[1], F.lit(False)) | F.coalesce(F.col(columns[1]) == names[1], F.lit(False))
    header &= F.coalesce(F.col(index), F.lit("")).isin(*[h or "" for h in heads])
    return raw.where(~header).select(*[F.col(c).try_cast(types.get(c, "double" if c != index else "string")).alias(c) for c in columns])


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, name, length) of files by a glob pattern; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of a COCO document."""
    doc = spark.read.option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("x")).select("x.*")
    return images, doc.select(F.explode("annotations").alias("x")).select("x.*")


def write_coco_annotations(annotations: DataFrame, path: str) -> None:
    """One JSON object for each annotation; an existing target is an error."""
    annotations.write.mode("errorifexists").json(path)


def write_pixels(px: DataFrame, path: str) -> None:
    """Pixels by tile buckets, so that a filter on tile prunes folders and no folder is small."""
    px.withColumn("tile_bucket", F.col("tile") % 64).repartition("tile_bucket").write.mode("errorifexists").partitionBy("tile_bucket").option("compression", "zstd").parquet(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("tile_bucket")


def quarantine(tiles: DataFrame, crs: str = "EPSG:3035") -> tuple[DataFrame, DataFrame]:
    """(good, rejected) tiles; those without bounds or with another reference system are rejected."""
    good = (F.col("crs") == crs) & F.col("minx").isNotNull() & F.col("maxx").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return tiles.where(good), tiles.where(~good)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with one header line; without a schema its types are found by a scan."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays and structs become JSON text; an existing target is an error."""
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    df.withColumns(nested).write.mode("errorifexists").option("header", True).csv(path)


def store_results(df: DataFrame, path: str) -> None:
    """What others keep as compressed pickles: Parquet with the densest common compression."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((tile, inst, score, label), (tile, inst, r, c)) of stored predictions: rows with tile, scores, labels
    and masks (for each instance the list of its pixels)."""
    rows = spark.read.parquet(path).select("tile", F.posexplode(F.arrays_zip("scores", "labels", "masks")).alias("inst", "x"))
    inst = rows.select("tile", F.col("inst").cast("long"), F.col("x.scores").alias("score"), F.col("x.labels").alias("label"))
    return inst, rows.select("tile", F.col("inst").cast("long"), F.explode("x.masks").alias("p")).select("tile", "inst", F.col("p.r").alias("r"), F.col("p.c").alias("c"))


def write_coco(images: DataFrame, annotations: DataFrame, categories: list[dict], path: str) -> None:
    """One document with images, categories and annotations as `read_coco` reads it; an existing target is an
    error. The document is one row, for it is one JSON object: larger sets go by `write_coco_annotations`."""
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    kinds = images.sparkSession.createDataFrame(categories)
    doc = listed(images, "images").crossJoin(listed(annotations, "annotations")).crossJoin(listed(kinds, "categories"))
    doc.coalesce(1).write.mode("errorifexists").json(path)


def best_checkpoint(spark: SparkSession, folder: str, pattern: str = "best_*") -> str | None:
    """Path of the checkpoint of the best run: the last by the number in its name."""
    number = F.regexp_extract("name", r"(\d+)(?=\D*$)", 1).try_cast("long")
    best = list_files(spark, folder, pattern).orderBy(F.desc_nulls_last(number), F.desc("name")).select("path").limit(1).collect()
    return best[0][0] if best else None


def copy_files(spark: SparkSession, paths: list[str], folder: str) -> None:
    """Copy files between folders of any file system that Spark knows."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(folder)
    target.getFileSystem(conf).mkdirs(target)
    for p in map(hadoop.Path, paths):
        hadoop.FileUtil.copy(p.getFileSystem(conf), p, target.getFileSystem(conf), hadoop.Path(target, p.getName()), False, conf)


_READ = "path string, error string, crs int, x0 double, y0 double, dx double, dy double, r int, c int, bands array<double>"


def _decoded(kind: str):
    import numpy as np
    import pandas as pd

    from fieldloom.sources import formats

    def pixels(content: bytes):
        if kind == "geotiff":
            raster = formats.read_geotiff(content)
            return raster.bands.astype(float), (raster.epsg, *raster.origin, *raster.size), raster.nodata
        cube = formats.read_netcdf(content)
        planes = [v.astype(float) for dims, v, _ in cube.variables.values() if len(dims) >= 2]
        if not planes:
            raise ValueError("no variable with two dimensions")
        return np.concatenate([p.reshape(-1, *p.shape[-2:]) for p in planes]), (None, 0.0, 0.0, 1.0, 1.0), None

    def run(frames):
        for frame in frames:
            for path, content in zip(frame.path, frame.content):
                try:
                    bands, place, nodata = pixels(content)
                except Exception as e:  # a file that can't be read is a row that says why
                    yield pd.DataFrame({c.split()[0]: [None] for c in _READ.split(", ")} | {"path": [path], "error": [f"{type(e).__name__}: {e}"]}, dtype=object)
                    continue
                if nodata is not None:
                    bands = np.where(bands == nodata, np.nan, bands)
                r, c = np.indices(bands.shape[1:]).reshape(2, -1)
                values = bands.reshape(len(bands), -1).T
                listed = [[None if x != x else x for x in row] for row in values.tolist()]
                yield pd.DataFrame({"path": path, "error": None, "crs": place[0], "x0": place[1], "y0": place[2], "dx": place[3], "dy": place[4], "r": r, "c": c, "bands": listed})

    return run


def read_rasters(spark: SparkSession, folder: str, pattern: str = "*.tif", kind: str = "geotiff") -> tuple[DataFrame, DataFrame]:
    """(pixels, unreadable) of raster files, each decoded by the task that reads it: path, reference system, corner
    and size of pixels, r, c and bands (null: no data); and path and error of files that are not of the format.

    kind: 'geotiff', or 'netcdf' for the classic format, whose variables of two and more dimensions are stacked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    found = files.mapInPandas(_decoded(kind), _READ)
    return found.where("error IS NULL").drop("error"), found.where("error IS NOT NULL").select("path", "error")


def encoded_rasters(px: DataFrame, bands: list[str], epsg: int = 3035, size: float = 10.0) -> DataFrame:
    """(tile, content): each tile as a compressed GeoTIFF of 32-bit floats; missing pixels are NaN."""
    import numpy as np
    import pandas as pd

    from fieldloom.sources import formats

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.full((len(bands), int(frame.r.max()) + 1, int(frame.c.max()) + 1), np.nan, np.float32)
        for k, band in enumerate(bands):
            out[k, frame.r, frame.c] = frame[band]
        return pd.DataFrame({"tile": [frame.tile.iloc[0]], "content": [formats.write_geotiff(formats.Raster(out, (0.0, 0.0), (size, size), epsg))]})

    return px.select("tile", "r", "c", *bands).groupBy("tile").applyInPandas(run, f"tile {px.schema['tile'].dataType.simpleString()}, content binary")


def read_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, shape, ring, points, record) of polygon shapefiles in a folder: one row a ring, the record as JSON."""
    import json

    import pandas as pd

    from fieldloom.sources import formats

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        content = dict(zip(frame["kind"], frame["content"]))
        rows = []
        if "shp" in content:
            records = formats.read_records(content["dbf"]) if "dbf" in content else []
            for k, rings in enumerate(formats.read_polygons(content["shp"])):
                record = json.dumps(records[k], ensure_ascii=False) if k < len(records) else None
                rows += [(key[0], k, n, ring.tolist(), record) for n, ring in enumerate(rings or [])]
        return pd.DataFrame(rows, columns=["name", "shape", "ring", "points", "record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("name"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("kind"), "content")
    return parts.groupBy("name").applyInPandas(run, "name string, shape long, ring long, points array<array<double>>, record string")
