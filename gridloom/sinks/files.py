"""Results as files: cubes, zonal statistics and features."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..model import FormatUnsupported
from ..operators.cube import Cube


def cropped(cube: Cube) -> Cube:
    g = cube.meta.grid
    return cube.where(F.col("y").between(0, g.height - 1) & F.col("x").between(0, g.width - 1))


def long_form(cube: Cube) -> DataFrame:
    """([t], y, x, band, value): one row for each value."""
    return cube.df.unpivot(cube.keys, cube.bands, "band", "value")


def as_json(cube: Cube) -> DataFrame:
    """(t, data): for each date the nested array bands x rows x columns as JSON, x running fastest; no-data is null."""
    g = cube.meta.grid
    t = "t" if cube.meta.temporal else F.lit(None).cast("timestamp_ntz").alias("t")
    filled = F.map_from_entries(F.collect_list(F.struct("x", "value")))
    rows = long_form(cropped(cube)).select(t, "band", "y", "x", "value").groupBy("t", "band", "y").agg(filled.alias("m"))
    line = F.transform(F.sequence(F.lit(0), F.lit(g.width - 1)), lambda i: F.try_element_at("m", i))
    lines = rows.select("t", "band", "y", line.alias("line")).groupBy("t", "band").agg(F.map_from_entries(F.collect_list(F.struct("y", "line"))).alias("m"))
    blank = F.transform(F.sequence(F.lit(0), F.lit(g.width - 1)), lambda i: F.lit(None).cast("double"))
    image = F.transform(F.sequence(F.lit(0), F.lit(g.height - 1)), lambda i: F.coalesce(F.try_element_at("m", i), blank))
    images = lines.select("t", "band", image.alias("image")).groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("band", "image"))).alias("m"))
    return images.select("t", F.to_json(F.array(*[F.try_element_at("m", F.lit(b)) for b in cube.bands]), {"ignoreNullFields": "false"}).alias("data"))


def save_result(cube: Cube, path: str, format: str = "parquet", partition: str | None = None, feature_cells: DataFrame | None = None) -> dict:
    """Write a cube and its metadata; returns what was written.

    partition: "t" for a folder for each date, "band" for one for each band, "tile" for one for each tile of the grid,
    "feature" with feature_cells (feature_index, y, x) for one for each feature.
    """
    cube, spark = cropped(cube), cube.df.sparkSession
    fmt = format.lower()
    if fmt == "debug":
        return {"metadata": cube.meta.to_dict()}
    if fmt not in ("parquet", "csv", "json", "orc"):
        raise FormatUnsupported(f"{format}; there are parquet, orc, csv, json and debug")
    df = as_json(cube) if fmt == "json" else cube.df
    if partition == "band":
        df = long_form(cube)
    elif partition == "feature":
        df = cube.df.join(feature_cells, ["y", "x"])
    elif partition == "tile":
        size = cube.meta.grid.tile
        df = cube.df.withColumns({"tile_row": F.floor(F.col("y") / size).cast("int"), "tile_col": F.floor(F.col("x") / size).cast("int")})
    writer = df.write.mode("errorifexists")
    if partition:
        writer = writer.partitionBy(*{"feature": ["feature_index"], "tile": ["tile_row", "tile_col"]}.get(partition, [partition]))
    writer = writer.option("header", True) if fmt == "csv" else writer
    (writer.format(fmt)).save(f"{path}/data")
    spark.createDataFrame([(json.dumps(cube.meta.to_dict()),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return {"path": f"{path}/data", "format": fmt, "bands": cube.bands}


def export_result(spark: SparkSession, path: str, target: str, merge: bool = False) -> None:
    """Copy a result that was saved as Parquet to another folder; merge adds to what is there and keeps its metadata."""
    spark.read.parquet(f"{path}/data").write.mode("append" if merge else "errorifexists").parquet(f"{target}/data")
    if not merge:
        spark.read.text(f"{path}/metadata").coalesce(1).write.text(f"{target}/metadata")


def save_features(table: DataFrame, path: str, format: str = "parquet") -> None:
    """Zonal statistics or features as Parquet, CSV, JSON lines, coverage JSON or (features) GeoJSON, one feature to a line."""
    fmt = format.lower()
    if fmt == "covjson":
        coverage_json(table).write.text(path)
    elif fmt == "geojson":
        geo.as_geojson(table).write.text(path)
    elif fmt in ("parquet", "csv", "json"):
        (table.write.option("header", True) if fmt == "csv" else table.write).format(fmt).save(path)
    else:
        raise FormatUnsupported(format)


def coverage_json(zonal: DataFrame) -> DataFrame:
    """(value): one coverage for each feature of a zonal time series (t, feature_index, columns)."""
    columns = [c for c in zonal.columns if c not in ("t", "feature_index")]
    rows = zonal.groupBy("feature_index").agg(F.array_sort(F.collect_list(F.struct("t", *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)]))).alias("r"))
    n = F.size("r")
    ranges = [
        F.struct(F.lit("NdArray").alias("type"), F.lit("float").alias("dataType"), F.array(F.lit("t")).alias("axisNames"), F.array(n).alias("shape"),
                 F.col(f"r.v{i}").alias("values")).alias(c)
        for i, c in enumerate(columns)
    ]
    times = F.transform("r", lambda r: F.date_format(r["t"], "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    domain = F.struct(F.lit("Domain").alias("type"), F.lit("PointSeries").alias("domainType"), F.struct(F.struct(times.alias("values")).alias("t")).alias("axes"))
    whole = F.struct(F.lit("Coverage").alias("type"), F.col("feature_index").alias("id"), domain.alias("domain"), F.struct(*ranges).alias("ranges"))
    return rows.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def chain_rings(edges: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Closed rings from a zone's unit edges."""
    links: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for x1, y1, x2, y2 in edges:
        links.setdefault((x1, y1), []).append((x2, y2))
        links.setdefault((x2, y2), []).append((x1, y1))
    rings = []
    while any(links.values()):
        start = min(p for p, v in links.items() if v)
        ring, here = [start], start
        while True:
            nxt = links[here].pop(0)
            links[nxt].remove(here)
            ring.append(nxt)
            here = nxt
            if here == start:
                break
        rings.append(ring)
    return rings


def concurrently(sinks: list[Callable[[], object]], threads: int = 4) -> list[object]:
    """Run several sinks of one plan at a time; Spark shares the cluster among them."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(s) for s in sinks]]
