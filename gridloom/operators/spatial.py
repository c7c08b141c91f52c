"""Operators that look at a cell's surroundings, at polygons, or at another grid."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import callback as cb
from ..functions import geometry as geo
from ..model import (
    Band,
    DimensionMismatch,
    FeatureUnsupported,
    GridSpec,
    ProcessParameterInvalid,
    ReducerUnsupported,
)
from ..plans.scratch import written
from .cube import Cube

# --- polygons


def cells_of(feats: DataFrame, grid: GridSpec) -> DataFrame:
    """(feature_index, y, x) of the cells whose centre lies in each feature; a point has its containing cell.

    Rows within a feature's bounds are cut with its edges, and only the columns between crossings are generated, so a feature
    costs its rows times its edges and the cells that it has.
    """
    f = geo.with_bounds(feats)
    col = lambda x: F.floor((x - grid.x0) / grid.res_x).cast("int")
    row = lambda y: F.floor((F.lit(grid.y0) - y) / grid.res_y).cast("int")
    clip = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    f = f.withColumns({"c0": col(F.col("west")), "c1": col(F.col("east")), "r0": row(F.col("north")), "r1": row(F.col("south"))})
    f = f.where((F.col("c1") >= 0) & (F.col("c0") < grid.width) & (F.col("r1") >= 0) & (F.col("r0") < grid.height))
    f = f.withColumn("y", F.explode(F.sequence(clip(F.col("r0"), grid.height), clip(F.col("r1"), grid.height))))
    cy = grid.y0 - (F.col("y") + 0.5) * grid.res_y
    # the first column whose centre is not left of a crossing
    first = lambda x: F.least(F.greatest(F.ceil((x - grid.x0) / grid.res_x - 0.5), F.lit(0)), F.lit(grid.width)).cast("int")
    f = f.withColumn("_cross", F.when(~F.col("point"), F.array_sort(F.transform(geo.crossings(cy, F.col("rings")), first))))
    span = lambda i: F.when(F.get("_cross", 2 * i) < F.get("_cross", 2 * i + 1), F.sequence(F.get("_cross", 2 * i), F.get("_cross", 2 * i + 1) - 1))
    n = F.floor(F.size("_cross") / 2).cast("int")
    spans = F.when(n > 0, F.flatten(F.filter(F.transform(F.sequence(F.lit(0), n - 1), span), lambda s: s.isNotNull())))
    f = f.withColumn("x", F.explode(F.when(F.col("point"), F.array(clip(F.col("c0"), grid.width))).otherwise(spans)))
    return f.select("feature_index", "y", "x")


def filter_spatial(cube: Cube, feats: DataFrame) -> Cube:
    """Keep the cells inside any feature."""
    return replace(cube, df=cube.df.join(cells_of(feats, cube.meta.grid).select("y", "x").distinct(), ["y", "x"], "left_semi"))


def mask_polygon(cube: Cube, feats: DataFrame, replacement: float | None = None, inside: bool = False) -> Cube:
    """Replace the cells outside the features (or inside) by a value or no-data."""
    hit = cells_of(feats, cube.meta.grid).select("y", "x").distinct().withColumn("_in", F.lit(True))
    joined = cube.df.join(hit, ["y", "x"], "left")
    gone = F.col("_in").isNotNull() if inside else F.col("_in").isNull()
    new = F.lit(replacement).cast("double")
    return replace(cube, df=joined.select(*cube.keys, *[F.when(gone, new).otherwise(F.col(b)).alias(b) for b in cube.bands]))


def aggregate_spatial(cube: Cube, feats: DataFrame, reducer: str | dict, target_dimension: str | None = None) -> DataFrame:
    """([t], feature_index, columns): statistics of the cells in each feature, band by band.

    Columns are "<stat>(<band>)" for a list of reducers and "<band>" for one. Every feature has a row for every date
    of the cube, in which statistics without data are NULL and counts 0.
    """
    if target_dimension is not None:
        raise FeatureUnsupported("target_dimension")
    time = F.col("t") if cube.meta.temporal else F.lit(None)
    aggs: dict[str, Column] = {}
    counts: set[str] = set()
    for b in cube.bands:
        if isinstance(reducer, str) and reducer == "histogram":
            raise ReducerUnsupported("histogram has a function of its own")
        try:
            got = cb.Compiler(cb.as_graph(reducer), {"data": cb.Series(F.col(b), time)}).result()
        except KeyError as e:
            raise ReducerUnsupported(str(e)) from e
        items = got.items if isinstance(got, cb.Arr) else (got,)
        names = _stat_names(reducer, len(items))
        for n, c in zip(names, items, strict=True):
            name = f"{n}({b})" if len(items) > 1 else b
            aggs[name] = cb.numeric(c)
            if n == "count":
                counts.add(name)
    keys = (["t"] if cube.meta.temporal else []) + ["feature_index"]
    inside = cube.df.join(cells_of(feats, cube.meta.grid), ["y", "x"])
    got = inside.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    if cube.meta.temporal:  # one row with the cube's dates meets every feature
        dates = cube.df.groupBy(F.lit(0).alias("_one")).agg(F.collect_set("t").alias("_dates"))
        each = feats.select("feature_index", F.lit(0).alias("_one")).join(dates, "_one")
        spine = each.select("feature_index", F.explode("_dates").alias("t"))
    else:
        spine = feats.select("feature_index")
    out = spine.join(got, keys, "left")
    return out.select(*keys, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) if n in counts else F.col(f"`{n}`") for n in aggs])


def _stat_names(reducer: str | dict, n: int) -> list[str]:
    graph = cb.as_graph(reducer)
    reducers = [node["process_id"] for node in graph.values() if node["process_id"] in cb.ARRAY_REDUCERS]
    return reducers if len(reducers) == n else [f"stat{i}" for i in range(n)]


def zonal_histogram(cube: Cube, feats: DataFrame) -> DataFrame:
    """([t], feature_index, band, value, n): how often each value occurs in each feature."""
    keys = (["t"] if cube.meta.temporal else []) + ["feature_index"]
    long = cube.df.join(cells_of(feats, cube.meta.grid), ["y", "x"]).unpivot(keys, cube.bands, "band", "value")
    return long.where("value IS NOT NULL").groupBy(*keys, "band", "value").agg(F.count("*").alias("n"))


def log_round(c: Column, base: float = 10.0, digits: int = 1) -> Column:
    """Round to significant steps of a logarithmic scale, for histograms of wide ranges."""
    power = F.pow(F.lit(base), F.floor(F.log(F.abs(c)) / math.log(base)) - (digits - 1))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c / power) * power)


def drop_empty(zonal: DataFrame, columns: Sequence[str]) -> DataFrame:
    return zonal.where(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in columns]).isNotNull())


# --- surroundings


def _shifted(cube: Cube, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """Each cell's bands once for every cell (y + dy, x + dx) that it is a neighbour of, with the place ``o``."""
    g = cube.meta.grid
    places = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(offsets)])
    df = cube.df.withColumn("_p", F.explode(places))
    df = df.withColumns({"y": F.col("y") + F.col("_p.dy"), "x": F.col("x") + F.col("_p.dx"), "o": F.col("_p.o")}).drop("_p")
    return df.where(F.col("y").between(0, g.height - 1) & F.col("x").between(0, g.width - 1))


def apply_kernel(cube: Cube, kernel: Sequence[Sequence[float]], factor: float = 1.0, border: float = 0, replace_invalid: float = 0) -> Cube:
    """Weighted sum of each cell's surroundings times a factor; absent cells and no-data weigh nothing.

    Zero weights cost nothing; the others expand each row once, and partial sums combine before the shuffle.
    """
    if border != 0 or replace_invalid != 0:
        raise FeatureUnsupported("border and replace_invalid other than 0")
    h, w = len(kernel), len(kernel[0])
    if h % 2 == 0 or w % 2 == 0 or any(len(r) != w for r in kernel):
        raise ProcessParameterInvalid("a kernel has odd, equal rows")
    cells = [(r, c, float(kernel[r][c])) for r in range(h) for c in range(w) if kernel[r][c]]
    if not cells:
        return cube.select({b: F.lit(0.0) for b in cube.bands})
    df = _shifted(cube, [(h // 2 - r, w // 2 - c) for r, c, _ in cells])
    weight = F.get(F.array(*[F.lit(v) for *_, v in cells]), F.col("o"))
    sums = df.groupBy(*cube.keys).agg(*[F.sum(F.col(b) * weight).alias(b) for b in cube.bands])
    own = cube.df.select(*cube.keys)
    out = own.join(sums, cube.keys, "left")
    return replace(cube, df=out.select(*cube.keys, *[(F.coalesce(b, F.lit(0.0)) * float(factor)).alias(b) for b in cube.bands]))


def focal(cube: Cube, size: int, how: Callable[[Column], Column]) -> Cube:
    """An aggregate such as F.max over the size x size surroundings of each cell."""
    r = size // 2
    df = _shifted(cube, [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)])
    got = df.groupBy(*cube.keys).agg(*[how(F.col(b)).alias(b) for b in cube.bands])
    return replace(cube, df=got.join(cube.df.select(*cube.keys), cube.keys, "left_semi"))


def scl_dilation_mask(cube: Cube, erosion: int, mask1: Sequence[int], mask2: Sequence[int], size1: int, size2: int) -> Cube:
    """1 where a class of either set, after erosion, lies within the set's kernel; else 0. The cube holds one band of classes."""
    band = cube.bands[0]

    def grown(values: Sequence[int], size: int) -> DataFrame:
        own = cube.select({"m": F.col(band).isin([float(v) for v in values]).cast("double")})
        if erosion > 1:
            own = focal(own, erosion, F.min)
        return (focal(own, size, F.max) if size > 1 else own).df

    a, b = grown(mask1, size1).withColumnRenamed("m", "a"), grown(mask2, size2).withColumnRenamed("m", "b")
    df = a.join(b, cube.keys).select(*cube.keys, F.greatest("a", "b").alias("mask"))
    return Cube(df, replace(cube.meta, bands=(Band("mask"),)))


def _gradients(cube: Cube, band: str) -> tuple[DataFrame, Column, Column]:
    """Horn's east-west and north-south gradients; an absent neighbour counts as the cell itself."""
    around = [(1, 1), (1, 0), (1, -1), (0, 1), (0, 0), (0, -1), (-1, 1), (-1, 0), (-1, -1)]  # source offsets, north-west first
    df = _shifted(cube, around).groupBy(*cube.keys).agg(*[F.max(F.when(F.col("o") == i, F.col(band))).alias(f"n{i}") for i in range(9)])
    df = df.where("n4 IS NOT NULL")
    n = [F.coalesce(F.col(f"n{i}"), F.col("n4")) for i in range(9)]
    g = cube.meta.grid
    east = ((n[2] + 2 * n[5] + n[8]) - (n[0] + 2 * n[3] + n[6])) / (8 * g.res_x)
    south = ((n[6] + 2 * n[7] + n[8]) - (n[0] + 2 * n[1] + n[2])) / (8 * g.res_y)
    return df, east, south


def _terrain(cube: Cube, suffix: str, formula: Callable[[Column, Column], Column]) -> Cube:
    out = None
    for b in cube.bands:
        df, east, south = _gradients(cube, b)
        df = df.select(*cube.keys, formula(east, south).alias(f"{b}_{suffix}"))
        out = df if out is None else out.join(df, cube.keys, "full")
    return Cube(out, replace(cube.meta, bands=tuple(Band(f"{b}_{suffix}") for b in cube.bands)))


def slope(cube: Cube) -> Cube:
    """Steepest slope in radians."""
    return _terrain(cube, "slope", lambda e, s: F.atan(F.sqrt(e * e + s * s)))


def aspect(cube: Cube) -> Cube:
    """Direction of the slope in radians: pi/2 where values grow with the row, pi where they grow with the column."""
    return _terrain(cube, "aspect", lambda e, s: F.when((e == 0) & (s == 0), F.lit(0.0)).otherwise(F.pmod(F.atan2(s, -e), F.lit(2 * math.pi))))


def apply_neighborhood(
    cube: Cube, process: Callable[[pd.DataFrame], pd.DataFrame] | dict | str, size: int, overlap: int = 0, per_date: bool = False
) -> Cube:
    """Run a pandas function on tiles of size x size cells with a margin, or a callback on each cell's own series.

    The function gets the rows of one tile (of all dates, or of one) and returns rows with the same columns; rows in the
    margin are dropped afterwards. A cell travels to the at most four tiles (nine for wide margins) that it touches.
    """
    if not callable(process):
        return cube.apply(process)
    if size < 4:
        raise ProcessParameterInvalid("tiles of fewer than 4 cells")
    if overlap > size:
        raise ProcessParameterInvalid("the margin is wider than the tile")
    tile = lambda c, d: F.floor((F.col(c) + d) / size).cast("int")
    span = lambda c: F.sequence(tile(c, -overlap), tile(c, overlap))
    df = cube.df.withColumn("_ty", F.explode(span("y"))).withColumn("_tx", F.explode(span("x")))
    keys = ["_ty", "_tx"] + (["t"] if per_date and cube.meta.temporal else [])
    columns = cube.df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["_ty"].iloc[0]), int(pdf["_tx"].iloc[0])
        sort = [c for c in ("t", "y", "x") if c in pdf]
        out = process(pdf[columns].sort_values(sort).reset_index(drop=True))
        return out.loc[(out["y"] // size == ty) & (out["x"] // size == tx), columns]

    return replace(cube, df=df.groupBy(*keys).applyInPandas(lambda pdf: run(pdf), cube.df.schema))


def apply_polygon(cube: Cube, feats: DataFrame, process: Callable[[pd.DataFrame], pd.DataFrame], mask_value: float | None = None) -> Cube:
    """Run a pandas function on the cells of each feature; cells outside all features get the mask value."""
    if not callable(process):
        raise FeatureUnsupported("apply_polygon runs functions only")
    columns = cube.df.columns
    inside = cube.df.join(cells_of(feats, cube.meta.grid), ["y", "x"])
    done = inside.groupBy("feature_index").applyInPandas(lambda pdf: process(pdf[columns].reset_index(drop=True))[columns], cube.df.schema)
    done = done.groupBy(*cube.keys).agg(*[F.min(b).alias(b) for b in cube.bands]).withColumn("_in", F.lit(True))
    renamed = done.withColumnsRenamed({b: f"_n_{b}" for b in cube.bands})
    out = cube.df.join(renamed, cube.keys, "left")
    new = lambda b: F.when(F.col("_in").isNotNull(), F.col(f"_n_{b}")).otherwise(F.lit(mask_value).cast("double")).alias(b)
    return replace(cube, df=out.select(*cube.keys, *[new(b) for b in cube.bands]))


# --- other grids

METHODS = ("near", "bilinear", "cubic", "cubicspline", "lanczos", "average", "mode", "max", "min", "med")


def _target_index(cube: Cube, target: GridSpec) -> tuple[Column, Column]:
    """Row and column, in the target grid, of each cell's centre."""
    g = cube.meta.grid
    cx, cy = g.x0 + (F.col("x") + 0.5) * g.res_x, g.y0 - (F.col("y") + 0.5) * g.res_y
    cx, cy = geo.transform(cx, cy, g.crs, target.crs)
    eps = 1e-9  # centres on a grid line fall to the cell that begins there
    return F.floor((F.lit(target.y0) - cy) / target.res_y + eps).cast("int"), F.floor((cx - target.x0) / target.res_x + eps).cast("int")


def _mode(c: Column) -> Column:
    return F.mode(c, deterministic=True)


_AGGREGATES = {"average": F.avg, "max": F.max, "min": F.min, "med": F.median, "mode": _mode}


def resample_to(cube: Cube, target: GridSpec, method: str = "near") -> Cube:
    """Put the cube on another grid; unknown methods count as near.

    average, max, min, med and mode aggregate the source cells whose centre falls in a target cell (mode: ties to the
    least). The others look values up at the target cell's centre: the containing cell, or the weighted cells around.
    """
    method = method if method in METHODS else "near"
    meta = replace(cube.meta, grid=target)
    t = cube.keys[:-2]
    if method in _AGGREGATES:
        ty, tx = _target_index(cube, target)
        df = cube.df.withColumns({"_y": ty, "_x": tx}).where(F.col("_y").between(0, target.height - 1) & F.col("_x").between(0, target.width - 1))
        agg = df.groupBy(*t, "_y", "_x").agg(*[_AGGREGATES[method](F.col(b)).alias(b) for b in cube.bands])
        return Cube(agg.select(*t, F.col("_y").alias("y"), F.col("_x").alias("x"), *cube.bands), meta)
    g, spark = cube.meta.grid, cube.df.sparkSession
    cells = spark.range(target.width * target.height).select(
        F.floor(F.col("id") / target.width).cast("int").alias("_y"), F.pmod("id", F.lit(target.width)).cast("int").alias("_x")
    )
    cx, cy = target.x0 + (F.col("_x") + 0.5) * target.res_x, target.y0 - (F.col("_y") + 0.5) * target.res_y
    cx, cy = geo.transform(cx, cy, target.crs, g.crs)
    u, v = (cx - g.x0) / g.res_x, (F.lit(g.y0) - cy) / g.res_y
    if method == "near":
        look = cells.withColumns({"y": F.floor(v + 1e-9).cast("int"), "x": F.floor(u + 1e-9).cast("int"), "w": F.lit(1.0)})
    else:
        radius = {"bilinear": 1, "lanczos": 3}.get(method, 2)
        side = F.sequence(F.lit(1 - radius), F.lit(radius))
        look = cells.withColumns({"u": u - 0.5, "v": v - 0.5})
        look = look.withColumn("dy", F.explode(side)).withColumn("dx", F.explode(side))
        look = look.withColumns({"y": (F.floor("v") + F.col("dy")).cast("int"), "x": (F.floor("u") + F.col("dx")).cast("int")})
        kernel = {"bilinear": _linear, "lanczos": _lanczos, "cubicspline": _spline}.get(method, _cubic)
        look = look.withColumn("w", kernel(F.abs(F.col("v") - F.col("y"))) * kernel(F.abs(F.col("u") - F.col("x")))).where("w != 0")
    joined = look.join(cube.df, ["y", "x"])
    # weights of cells without data are left out
    value = lambda b: F.try_divide(F.sum(F.col(b) * F.col("w")), F.sum(F.when(F.col(b).isNotNull(), F.col("w"))))
    if method == "near":
        out = joined.select(*t, F.col("_y").alias("y"), F.col("_x").alias("x"), *cube.bands)
    else:
        out = joined.groupBy(*t, "_y", "_x").agg(*[value(b).alias(b) for b in cube.bands])
        out = out.select(*t, F.col("_y").alias("y"), F.col("_x").alias("x"), *cube.bands)
    return Cube(out, meta)


def _linear(d: Column) -> Column:
    return F.greatest(1 - d, F.lit(0.0))


def _cubic(d: Column) -> Column:
    a = -0.5
    return F.when(d <= 1, (a + 2) * d * d * d - (a + 3) * d * d + 1).when(d < 2, a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a).otherwise(0.0)


def _spline(d: Column) -> Column:
    return F.when(d <= 1, 2 / 3 - d * d + d * d * d / 2).when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6).otherwise(0.0)


def _lanczos(d: Column) -> Column:
    p = math.pi * d
    return F.when(d < 1e-9, F.lit(1.0)).when(d < 3, 3 * F.sin(p) * F.sin(p / 3) / (p * p)).otherwise(0.0)


def resample_spatial(cube: Cube, resolution: float | tuple[float, float] = 0, projection: str | None = None, method: str = "near") -> Cube:
    """Other cell size (0: keep) and reference system; within 1e-5 of the present size nothing is done."""
    g = cube.meta.grid
    rx, ry = resolution if isinstance(resolution, tuple) else (resolution, resolution)
    if projection in (None, g.crs):
        rx, ry = rx or g.res_x, ry or g.res_y
        if abs(rx / g.res_x - 1) < 1e-5 and abs(ry / g.res_y - 1) < 1e-5:
            return cube
        return resample_to(cube, g.resampled(rx, ry), method)
    w, s, e, n = g.bounds
    corners = [(w, s), (w, n), (e, s), (e, n), ((w + e) / 2, s), ((w + e) / 2, n), (w, (s + n) / 2), (e, (s + n) / 2)]
    cols = [c.alias(f"c{i}{j}") for i, (a, b) in enumerate(corners) for j, c in enumerate(geo.transform(F.lit(float(a)), F.lit(float(b)), g.crs, projection))]
    got = cube.df.sparkSession.range(1).select(*cols).first()
    xs, ys = got[0::2], got[1::2]
    rx = rx or (max(xs) - min(xs)) / g.width
    ry = ry or (max(ys) - min(ys)) / g.height
    target = GridSpec(projection, min(xs), max(ys), rx, ry, math.ceil(round((max(xs) - min(xs)) / rx, 9)), math.ceil(round((max(ys) - min(ys)) / ry, 9)), g.tile)
    return resample_to(cube, target, method)


def resample_cube_spatial(cube: Cube, target: Cube, method: str = "near") -> Cube:
    return resample_to(cube, target.meta.grid, method)


def bin_to_grid(points: DataFrame, grid: GridSpec, columns: Sequence[str], x: str = "lon", y: str = "lat", super_sampling: int = 1) -> DataFrame:
    """(y, x, means): the mean of scattered points by grid cell, NaN left out. super_sampling spreads each point over
    that many sub-points a side of a grid cell's size."""
    k, df = super_sampling, points
    px, py = F.col(x), F.col(y)
    if k > 1:
        steps = F.array(*[F.lit(((i + 0.5) / k - 0.5)) for i in range(k)])
        df = df.withColumn("_sx", F.explode(steps)).withColumn("_sy", F.explode(steps))
        px, py = px + F.col("_sx") * grid.res_x, py + F.col("_sy") * grid.res_y
    df = df.withColumns({"_x": F.floor((px - grid.x0) / grid.res_x).cast("int"), "_y": F.floor((F.lit(grid.y0) - py) / grid.res_y).cast("int")})
    df = df.where(F.col("_x").between(0, grid.width - 1) & F.col("_y").between(0, grid.height - 1))
    means = [F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in columns]
    return df.groupBy("_y", "_x").agg(*means).withColumnsRenamed({"_y": "y", "_x": "x"})


def nearest_lookup(points: DataFrame, grid: GridSpec, columns: Sequence[str], max_distance: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """(y, x, columns): each grid cell takes the values of the nearest point within max_distance of its centre.

    Points go to the cells that they can reach, so there is no pairing beyond the distance; ties go to the least point.
    """
    rx, ry = math.ceil(max_distance / grid.res_x), math.ceil(max_distance / grid.res_y)
    df = points.withColumns({"_cx": F.floor((F.col(x) - grid.x0) / grid.res_x).cast("int"), "_cy": F.floor((F.lit(grid.y0) - F.col(y)) / grid.res_y).cast("int")})
    df = df.withColumn("_x", F.explode(F.sequence(F.col("_cx") - rx, F.col("_cx") + rx)))
    df = df.withColumn("_y", F.explode(F.sequence(F.col("_cy") - ry, F.col("_cy") + ry)))
    df = df.where(F.col("_x").between(0, grid.width - 1) & F.col("_y").between(0, grid.height - 1))
    dx, dy = grid.x0 + (F.col("_x") + 0.5) * grid.res_x - F.col(x), grid.y0 - (F.col("_y") + 0.5) * grid.res_y - F.col(y)
    df = df.withColumn("_d", dx * dx + dy * dy).where(F.col("_d") <= max_distance**2)
    best = F.min(F.struct("_d", x, y, *columns)).alias("b")
    return df.groupBy("_y", "_x").agg(best).select(F.col("_y").alias("y"), F.col("_x").alias("x"), *[F.col(f"b.{c}").alias(c) for c in columns])


# --- vectors


def vector_to_raster(feats: DataFrame, target: Cube, columns: Sequence[str], dates: DataFrame | None = None) -> Cube:
    """Burn numeric feature columns (or properties) on the target's grid; where features overlap the last one wins."""
    typed = dict(feats.dtypes)
    values = {}
    for c in columns:
        col = F.col(c) if c in typed else F.try_element_at("props", F.lit(c)).try_cast("double")
        if c in typed and typed[c] in ("string", "boolean"):
            raise DimensionMismatch(f"{c} is not numeric")
        values[c] = col.cast("double")
    base = feats.select("feature_index", *[v.alias(c) for c, v in values.items()], *(["t"] if "t" in typed else []))
    key = ["t"] if "t" in typed else []
    cells = cells_of(feats.dropDuplicates(["feature_index"]), target.meta.grid).join(base, "feature_index")
    last = cells.groupBy(*key, "y", "x").agg(F.max(F.struct("feature_index", *columns)).alias("v")).select(*key, "y", "x", "v.*").drop("feature_index")
    return Cube(last, replace(target.meta, temporal=bool(key), bands=tuple(Band(c) for c in columns)))


def zones(cube: Cube, band: str) -> DataFrame:
    """([t], y, x, value, zone): 4-connected zones of equal value; zone is the least cell number of its zone.

    Each round takes the least label among a cell's neighbours and then the label of that label, so that rounds grow
    with the logarithm of a zone's diameter. Each round's labels are a table in shared storage.
    """
    g, t = cube.meta.grid, cube.keys[:-2]
    number = (F.col("y").cast("long") * g.width + F.col("x")).alias("cell")
    cells = cube.df.where(F.col(band).isNotNull()).select(*t, "y", "x", F.col(band).alias("value"), number)
    cells = written(cells.withColumn("zone", F.col("cell")))
    while True:
        around = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
        places = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in around])
        sent = cells.withColumn("_p", F.explode(places))
        sent = sent.select(*t, (F.col("y") + F.col("_p.dy")).alias("y"), (F.col("x") + F.col("_p.dx")).alias("x"), "value", "zone")
        least = sent.groupBy(*t, "y", "x", "value").agg(F.min("zone").alias("near"))
        near = cells.join(least, [*t, "y", "x", "value"])
        jump = near.select(*t, F.col("cell").alias("near"), F.col("near").alias("far"))
        nxt = written(near.join(jump, [*t, "near"]).select(*t, "y", "x", "value", "cell", F.least("near", "far").alias("label"), "zone"))
        changed = not nxt.where("label != zone").isEmpty()
        cells = nxt.drop("zone").withColumnRenamed("label", "zone")
        if not changed:
            return cells.select(*t, "y", "x", "value", "zone")


def raster_to_vector(cube: Cube) -> DataFrame:
    """([t], band, value, zone, n_cells, west, south, east, north, edges): polygons of the zones of each band.

    edges are the unit edges between a zone and what is not part of it, as (x1, y1, x2, y2); chained, they are its rings.
    """
    g, t = cube.meta.grid, cube.keys[:-2]
    out = None
    for band in cube.bands:
        z = zones(cube, band)
        sides = F.array(*[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), *[F.lit(v).alias(n) for n, v in zip(("a", "b", "c", "d"), e, strict=True)])
            for dy, dx, e in ((-1, 0, (0, 0, 1, 0)), (1, 0, (0, 1, 1, 1)), (0, -1, (0, 0, 0, 1)), (0, 1, (1, 0, 1, 1)))
        ])
        side = z.withColumn("_s", F.explode(sides))
        side = side.select("*", (F.col("y") + F.col("_s.dy")).alias("ny"), (F.col("x") + F.col("_s.dx")).alias("nx"))
        other = z.select(*t, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("zone").alias("other"))
        border = side.join(other, [*t, "ny", "nx"], "left").where("other IS NULL OR other != zone")
        at = lambda dx, dy: ((F.col("x") + F.col(f"_s.{dx}")) * g.res_x + g.x0, g.y0 - (F.col("y") + F.col(f"_s.{dy}")) * g.res_y)
        (x1, y1), (x2, y2) = at("a", "b"), at("c", "d")
        edge = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
        edges = border.groupBy(*t, "zone").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
        size = z.groupBy(*t, "value", "zone").agg(
            F.count("*").alias("n_cells"), (F.min("x") * g.res_x + g.x0).alias("west"), (g.y0 - (F.max("y") + 1) * g.res_y).alias("south"),
            ((F.max("x") + 1) * g.res_x + g.x0).alias("east"), (g.y0 - F.min("y") * g.res_y).alias("north"),
        )
        part = size.join(edges, [*t, "zone"]).withColumn("band", F.lit(band))
        out = part if out is None else out.unionByName(part)
    return out
