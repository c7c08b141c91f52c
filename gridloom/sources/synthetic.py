"""The deterministic test collection: every band is a formula of place or date."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..model import Band, BandNotFound, CubeMeta, GridSpec, NoDataAvailable
from ..operators.cube import Cube, instant
from .tables import register

DAYS = (5, 15, 25)
BANDS = ("Flat:1", "Flat:2", "TileCol", "TileRow", "TileColRow", "Longitude", "Latitude", "Year", "Month", "Day")


def _band(name: str, tile: int, lon0: int, lat0: int) -> Column:
    col, row, step = F.floor(F.col("x") / tile), F.floor(F.col("y") / tile), 1.0 / tile
    if m := re.fullmatch(r"Flat:(-?[\d.]+)", name):
        return F.lit(float(m[1]))
    if m := re.fullmatch(r"TileColRow(?::(\d+))?", name):
        return (col * int(m[1] or 10) + row).cast("double")
    known = {
        "TileCol": col, "TileRow": row, "Longitude": lon0 + F.col("x") * step, "Latitude": lat0 - (F.col("y") + 1) * step,
        "Year": F.year("t"), "Month": F.month("t"), "Day": F.dayofmonth("t"),
    }
    if name not in known:
        raise BandNotFound(name)
    return known[name].cast("double")


@register("testing")
def load(spark: SparkSession, extent: tuple[float, float, float, float], start: str, end: str, bands=("Longitude", "Latitude", "Day"), tile: int = 4) -> Cube:
    """Tiles of one degree over (west, south, east, north), on days 5, 15 and 25 of each month in [start, end)."""
    west, south, east, north = extent
    lon0, lat0 = math.floor(west), math.ceil(north)
    cols, rows = math.ceil(east) - lon0, lat0 - math.floor(south)
    grid = GridSpec("EPSG:4326", lon0, lat0, 1 / tile, 1 / tile, cols * tile, rows * tile, tile)
    months = F.explode(F.sequence(F.date_trunc("month", instant(start)).cast("date"), F.date_trunc("month", instant(end)).cast("date"), F.expr("interval 1 month")))
    dates = spark.range(1).select(months.alias("m")).select(F.explode(F.array(*[F.date_add("m", d - 1).cast("timestamp_ntz") for d in DAYS])).alias("t"))
    dates = [r.t for r in dates.where((F.col("t") >= instant(start)) & (F.col("t") < instant(end))).orderBy("t").collect()]
    if not dates:
        raise NoDataAvailable(f"{start} to {end}")
    n = grid.width * grid.height
    cells = spark.range(n * len(dates)).select(
        F.get(F.array(*[F.lit(d) for d in dates]), F.floor(F.col("id") / n).cast("int")).alias("t"),
        F.floor(F.pmod("id", F.lit(n)) / grid.width).cast("int").alias("y"), F.pmod("id", F.lit(grid.width)).cast("int").alias("x"),
    )
    df = cells.select("t", "y", "x", *[_band(b, tile, lon0, lat0).alias(b) for b in bands])
    meta = CubeMeta(tuple(Band(b) for b in bands), grid, extent=(start, end))
    return Cube(df, meta).filter_bbox(west, south, east, north)
