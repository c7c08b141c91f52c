"""Cubes over tables of pixels: Parquet, CSV or JSON files, and saved results."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..model import Band, CollectionNotFound, CubeMeta, FormatUnsupported, GridSpec, MissingSpatialFilter
from ..operators.cube import Cube

Reader = Callable[..., Cube]
_collections: dict[str, Reader] = {}
_unbounded: set[str] = set()


def register(name: str, bounded: bool = True) -> Callable[[Reader], Reader]:
    """Add a collection: a function (spark, **options) -> Cube. bounded: whether it may be loaded without a spatial extent."""

    def add(reader: Reader) -> Reader:
        _collections[name] = reader
        if not bounded:
            _unbounded.add(name)
        return reader

    return add


def _days(extent: tuple | None) -> int:
    """Days between two bounds, at least one; an open extent counts one."""
    if not extent or extent[0] is None or extent[1] is None:
        return 1
    first, last = (datetime.fromisoformat(str(x).replace("Z", "")[:10]) for x in extent)
    return max(1, (last - first).days)


def load_collection(
    spark: SparkSession, name: str, spatial_extent: dict | None = None, temporal_extent: tuple | None = None, bands: list | None = None,
    properties: dict | None = None, postprocessing: Callable[[Cube], Cube] | None = None, options: dict | None = None, **more,
) -> Cube:
    """A registered collection, filtered; filters are part of the plan and reach the scan."""
    if name not in _collections:
        raise CollectionNotFound(name)
    if name in _unbounded and not spatial_extent:
        raise MissingSpatialFilter(name)
    cube = _collections[name](spark, **(options or {}), **more)
    _guard(cube.meta, spatial_extent, temporal_extent, bands)
    if temporal_extent:
        cube = cube.filter_temporal(*temporal_extent)
    if spatial_extent:
        e = spatial_extent
        cube = cube.filter_bbox(e["west"], e["south"], e["east"], e["north"], e.get("crs"))
    if properties:
        from .items import property_filter

        cube = cube.where(property_filter(properties, columns=cube.df.columns))
    cube = postprocessing(cube) if postprocessing else cube
    if bands:  # requested names stay, also where they are common names or aliases
        found = [cube.meta.band(b) for b in bands]
        cube = cube.filter_bands([b.name for b in found])
        cube = cube.rename_labels("bands", list(bands), [b.name for b in found]) if [b.name for b in found] != list(bands) else cube
    return cube


def _guard(meta: CubeMeta, spatial_extent: dict | None, temporal_extent: tuple | None, bands: list | None) -> None:
    """Refuse a load of too many cells, from the metadata and the request alone."""
    grid = meta.grid
    if spatial_extent and spatial_extent.get("crs") in (None, grid.crs):
        c0, c1, r0, r1 = grid.cells_in(*[spatial_extent[k] for k in ("west", "south", "east", "north")])
        grid = replace(grid, width=max(0, c1 - c0 + 1), height=max(0, r1 - r0 + 1))
    kept = meta.bands[: len(bands)] if bands else meta.bands
    replace(meta, grid=grid, bands=kept).guard(_days(temporal_extent) if meta.temporal else 1)


def first_available(spark: SparkSession, names: list[str], expected: DataFrame | None = None, **options) -> Cube:
    """The first of several equivalent collections that has all expected (t) dates, else the last."""
    cube = None
    for name in names:
        cube = load_collection(spark, name, **options)
        if expected is None or missing_products(expected, cube.df.select("t").distinct(), ["t"]).isEmpty():
            return cube
    return cube


def missing_products(expected: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(available, keys, "left_anti")


def scale_bands(df: DataFrame, bands: tuple[Band, ...]) -> DataFrame:
    """value * scale + offset in the scan's projection."""
    return df.withColumns({b.name: F.col(b.name) * b.scale + b.offset for b in bands if (b.scale, b.offset) != (1.0, 0.0)})


def from_pixels(df: DataFrame, bands: list[str | Band], grid: GridSpec, no_data: float | None = None) -> Cube:
    """A cube over rows (t?, y, x, bands); NaN and the no-data value become NULL."""
    own = tuple(b if isinstance(b, Band) else Band(b) for b in bands)

    def clean(b: str):
        c = F.nanvl(F.col(b).cast("double"), F.lit(None))
        return (c if no_data is None else F.when(c != no_data, c)).alias(b)

    temporal = "t" in df.columns
    df = df.select(*([F.col("t").cast("timestamp_ntz").alias("t")] if temporal else []), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[clean(b.name) for b in own])
    return Cube(scale_bands(df, own), CubeMeta(own, grid, temporal))


def load_pixels(spark: SparkSession, path: str, bands: list[str | Band], grid: GridSpec, format: str = "parquet", no_data: float | None = None) -> Cube:
    if format not in ("parquet", "csv", "json", "orc"):
        raise FormatUnsupported(format)
    reader = spark.read.options(header=True, inferSchema=True) if format == "csv" else spark.read
    return from_pixels(reader.format(format).load(path), bands, grid, no_data)


def load_result(spark: SparkSession, path: str, spatial_extent: dict | None = None, temporal_extent: tuple | None = None, bands: list | None = None) -> Cube:
    """A cube that save_result wrote as Parquet, with its metadata beside it."""
    meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/metadata").collect()))
    g = meta["grid"]
    grid = GridSpec(g["crs"], g["bounds"][0], g["bounds"][3], *g["resolution"], *g["size"])
    own = [Band(b["name"], b["common_name"], tuple(b["aliases"])) for b in meta["bands"]]
    cube = from_pixels(spark.read.parquet(f"{path}/data"), own, grid)
    cube = replace(cube, meta=replace(cube.meta, cell_type=meta["cell_type"]))
    if temporal_extent:
        cube = cube.filter_temporal(*temporal_extent)
    if spatial_extent:
        cube = cube.filter_bbox(*[spatial_extent[k] for k in ("west", "south", "east", "north")])
    return cube.filter_bands(bands) if bands else cube


def load_features(spark: SparkSession, path: str, format: str = "geojson") -> DataFrame:
    """Features of GeoJSON files (one document each) or of Parquet written by save_features."""
    if format == "parquet":
        return spark.read.parquet(path)
    if format != "geojson":
        raise FormatUnsupported(format)
    feature = "struct<type: string, id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    raw = spark.read.text(path, wholetext=True).select("_metadata.file_path", F.posexplode(F.split("value", r"\n(?=\s*\{\s*\"type\")")).alias("line", "text"))
    docs = raw.select("file_path", "line", F.from_json("text", f"type string, id string, properties map<string, string>, geometry struct<type: string, coordinates: string>, features array<{feature}>").alias("d"))
    one = F.array(F.struct("d.type", "d.id", "d.properties", "d.geometry"))
    each = docs.select("file_path", "line", F.posexplode(F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).otherwise(one)).alias("at", "f"))
    return geo.geojson_rows(each.select("file_path", "line", "at", "f"))
