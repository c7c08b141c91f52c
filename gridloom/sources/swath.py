"""Swath data: scattered measurements with a quality value, put on a grid by date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Band, CubeMeta, GridSpec, ProcessParameterInvalid
from ..operators.cube import Cube, instant


def load(
    points: DataFrame, grid: GridSpec, columns: Sequence[str], time: str = "t", x: str = "lon", y: str = "lat", start: str | None = None, end: str | None = None,
    extent: tuple[float, float, float, float] | None = None, quality: str | None = None, minimum: float | bool = 0.5, period: str = "day",
) -> Cube:
    """Means by date and grid cell of the measurements of sufficient quality within the time and extent.

    NaN and NULL measurements are left out; cells without any are absent. The filters stand before the grouping, so they reach
    the scan.
    """
    if period not in ("hour", "day", "month"):
        raise ProcessParameterInvalid(f"period {period}")
    t = F.col(time).cast("timestamp_ntz")
    df = points
    if start is not None:
        df = df.where(t >= instant(start))
    if end is not None:
        df = df.where(t < instant(end))
    if extent is not None:
        west, south, east, north = extent
        df = df.where(F.col(x).between(west, east) & F.col(y).between(south, north))
    if quality is not None:
        df = df.where(F.col(quality) >= F.lit(minimum))
    col, row = F.floor((F.col(x) - grid.x0) / grid.res_x).cast("int"), F.floor((F.lit(grid.y0) - F.col(y)) / grid.res_y).cast("int")
    df = df.select(F.date_trunc(period, t).cast("timestamp_ntz").alias("t"), row.alias("y"), col.alias("x"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    df = df.where(F.col("y").between(0, grid.height - 1) & F.col("x").between(0, grid.width - 1) & F.coalesce(*columns).isNotNull())
    return Cube(df.groupBy("t", "y", "x").agg(*[F.avg(c).alias(c) for c in columns]), CubeMeta(tuple(Band(c) for c in columns), grid))
