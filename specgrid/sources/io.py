"""Readers and writers of sites, granule listings, metadata, inventories, reports and cubes."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specgrid.functions import geo
from specgrid.functions.names import basename, parse_geotransform

# Spellings of the site columns.
SITE_NAMES = {"Latitude": "lat", "Longitude": "lon", "Richness": "richness", "latitude": "lat", "longitude": "lon", "SiteID": "site_id"}
_BOX = T.StructType([T.StructField(f"{s}BoundingCoordinate", T.DoubleType()) for s in ("West", "South", "East", "North")])
_GEOMETRY = T.StructType([T.StructField("BoundingRectangles", T.ArrayType(_BOX))])
METADATA = T.StructType(
    [
        T.StructField("meta", T.StructType([T.StructField("native-id", T.StringType())])),
        T.StructField(
            "umm",
            T.StructType([T.StructField("SpatialExtent", T.StructType([T.StructField("HorizontalSpatialDomain", T.StructType([T.StructField("Geometry", _GEOMETRY)]))]))]),
        ),
    ]
)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site labels from CSV under any of the known spellings."""
    df = spark.read.option("header", True).csv(path)
    df = df.withColumnsRenamed({k: v for k, v in SITE_NAMES.items() if k in df.columns})
    return df.withColumns({c: F.col(c).cast("double") for c in ("lat", "lon", "richness")})


def list_granules(spark: SparkSession, dirs: list[str], suffix: str = ".nc") -> DataFrame:
    """Files of several folders with size and name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(dirs)
    return files.select("path", "modificationTime", "length", basename(F.col("path")).alias("name"))


def granule_catalog(headers: DataFrame) -> DataFrame:
    """Shape and georeference of each granule from header fields, grouped ones before flat ones (S3)."""
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in headers.columns])
    gt = parse_geotransform(first("projection_geotransform", "variable_geotransform"))
    return headers.select("path", first("group_bands", "bands").alias("bands"), first("group_height", "height").alias("height"), first("group_width", "width").alias("width"), gt.alias("g")).select(
        "path", "bands", "height", "width", "g.*"
    )


def read_granule_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a bounding rectangle; granules without one drop out."""
    return explode_boxes(spark.read.schema(METADATA).json(path))


def explode_boxes(df: DataFrame) -> DataFrame:
    box = F.explode("umm.SpatialExtent.HorizontalSpatialDomain.Geometry.BoundingRectangles")
    out = df.select(F.col("meta.native-id").alias("native_id"), box.alias("b"))
    side = lambda s: F.col(f"b.{s}BoundingCoordinate")
    return out.select("native_id", side("West").alias("lon_min"), side("South").alias("lat_min"), side("East").alias("lon_max"), side("North").alias("lat_max"))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; a temporary one only on a single machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-work-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("native_id")).where("native_id <> ''")


def write_inventory(df: DataFrame, path: str) -> None:
    """Distinct ids in order."""
    df.select("native_id").distinct().orderBy("native_id").write.mode("overwrite").text(path)


def _at(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def listing(spark: SparkSession, path: str, holding: str) -> list[str]:
    """Folders right under ``path`` that hold a file of that name."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    return [s.getPath().toString() for s in fs.listStatus(where) if s.isDirectory() and fs.exists(_at(spark, f"{s.getPath().toString()}/{holding}")[1])]


def fingerprint(spark: SparkSession, inputs: Sequence[DataFrame] = (), params: Mapping[str, object] | None = None) -> str:
    """Digest of the files that ``inputs`` read, with sizes and times, and of the parameters; rows that come from no file must be told by these."""
    told = []
    for folder in sorted({f.rpartition("/")[0] for df in inputs for f in df.inputFiles()}):
        fs, where = _at(spark, folder)
        told += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(where)]
    text = json.dumps([sorted(told), params or {}], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def cached(
    spark: SparkSession, build: Callable[[], DataFrame], path: str, refresh: bool = False, inputs: Sequence[DataFrame] = (), params: Mapping[str, object] | None = None
) -> DataFrame:
    """Stored result of these inputs and parameters if there is one, else build and store it.

    A result is written to a folder of its own; only when that is whole does a
    marker, named by the fingerprint of the inputs and moved into place at once,
    point to it. A write that was cut off has no marker and is never read, and a
    changed input has another one. Several writers may build the same result; the
    last marker counts. ``refresh`` builds anew.
    """
    key = fingerprint(spark, inputs, params)
    marker = f"{path}/{key}.ok"
    fs, at = _at(spark, marker)
    if refresh or not fs.exists(at):
        data = f"{key}-{uuid.uuid4().hex}"
        build().write.parquet(f"{path}/{data}")
        aside = _at(spark, f"{path}/_{data}")[1]
        out = fs.create(aside)
        out.write(bytearray(data.encode()))
        out.close()
        fs.delete(at, False)
        fs.rename(aside, at)
    return spark.read.parquet(f"{path}/{spark.read.text(marker).first()[0]}")


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def to_geojson(footprints: DataFrame, digits: int = 6) -> DataFrame:
    """One GeoJSON feature a row; rings in metres become rounded longitude/latitude."""
    return rings(footprints, digits).select(
        "footprint_id",
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.col("props").alias("properties"),
                F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates")).alias("geometry"),
            )
        ).alias("feature"),
    )


def rings(footprints: DataFrame, digits: int = 6) -> DataFrame:
    """Rings of (x, y) in metres as rounded (lon, lat)."""
    rounded = lambda p: F.struct(F.round(p["lon"], digits).alias("lon"), F.round(p["lat"], digits).alias("lat"))
    return footprints.withColumn("ring", F.transform(geo.points_from_utm(F.col("ring")), rounded))


def export_pack(patches: DataFrame, axis: list[float], path: str, h: int, w: int) -> None:
    """Stretched patches as Parquet and one metadata row beside them."""
    patches.write.mode("overwrite").parquet(f"{path}/patches")
    pack_metadata(patches, axis, h, w).write.mode("overwrite").json(f"{path}/metadata")


def pack_metadata(patches: DataFrame, axis: list[float], h: int, w: int) -> DataFrame:
    return patches.agg(F.countDistinct("id").alias("count")).select(
        "count", F.lit(len(axis)).alias("bands"), F.lit(h).alias("height"), F.lit(w).alias("width"), F.array(*[F.lit(x) for x in axis]).alias("wavelengths")
    )


def read_pixel_locations(spark: SparkSession, path: str) -> DataFrame:
    """Ordered lists of places by class, one row a place."""
    return explode_locations(spark.read.parquet(path))


def explode_locations(df: DataFrame) -> DataFrame:
    return df.select("class", F.posexplode("locations").alias("ord", "p")).select("class", "ord", "p.*")


def write_cube(pixels: DataFrame, path: str, side: int = 256) -> None:
    """Pixels in folders of granule and block, along the Z-order curve inside.

    ``side``, a power of two, is the width of a block in pixels; ``block`` is the
    block's own place on the curve and ``code`` the pixel's, so that row groups
    hold squares and windows touch few of them. Blocks are written apart, however
    large a granule is.
    """
    if side < 1 or side & (side - 1):
        raise ValueError("side must be a power of two")
    at = lambda c: F.floor(F.col(c) / side)
    placed = pixels.withColumns({"code": geo.morton(F.col("y"), F.col("x")), "block": geo.morton(at("y"), at("x"))})
    dealt = placed.repartition("granule_id", "block").sortWithinPartitions("granule_id", "block", "code")
    dealt.write.mode("overwrite").partitionBy("granule_id", "block").option("compression", "zstd").parquet(path)


def describe_source(df: DataFrame, spectrum: str) -> DataFrame:
    """Field names and types, with rows and spectrum lengths."""
    shape = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.size(spectrum)).alias("min_bands"), F.max(F.size(spectrum)).alias("max_bands"))
    return shape.withColumn("fields", F.lit(", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)))
