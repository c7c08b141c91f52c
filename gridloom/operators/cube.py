"""The cube: one row for each (t, y, x), one nullable column for each band."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import callback as cb
from ..functions import geometry as geo
from ..model import (
    Band,
    BandExists,
    CubeMeta,
    DimensionAmbiguous,
    DimensionExists,
    DimensionLabelCountMismatch,
    DimensionMismatch,
    DimensionNotAvailable,
    FeatureUnsupported,
    NirBandAmbiguous,
    OverlapResolverMissing,
    ProcessParameterInvalid,
    RedBandAmbiguous,
)

CELL_TYPES = {
    "int8": (-128, 127), "uint8": (0, 255), "int16": (-32768, 32767), "uint16": (0, 65535), "int32": (-(1 << 31), (1 << 31) - 1),
    "uint32": (0, (1 << 32) - 1), "float32": None, "float64": None,
}
_STORED = {"int8": "short", "uint8": "short", "int16": "short", "uint16": "int", "int32": "int", "uint32": "long", "float32": "float", "float64": "double"}


def instant(value: str) -> Column:
    """A date or timestamp, naive ones in UTC, as a column without time zone."""
    text = str(value).replace("Z", "").replace("T", " ")
    return F.to_timestamp_ntz(F.lit(text if len(text) > 10 else text + " 00:00:00"))


def _moment(value: str) -> datetime:
    """A date or timestamp, however it is spelled; naive ones are UTC."""
    got = datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
    return got.replace(tzinfo=UTC) if got.tzinfo is None else got


def conversion(c: Column, kind: str) -> Column:
    """Cast to a cell type: whole numbers truncate, and values outside the type become no-data."""
    base = kind.split("ud")[0]
    if base not in CELL_TYPES:
        raise ProcessParameterInvalid(f"data type {kind}")
    limits = CELL_TYPES[base]
    if limits is None:
        return c.cast(_STORED[base])
    whole = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
    return F.when(whole.between(*limits), whole).cast(_STORED[base])


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    meta: CubeMeta

    # --- shape

    @property
    def bands(self) -> list[str]:
        return self.meta.names

    @property
    def keys(self) -> list[str]:
        return ["t", "y", "x"] if self.meta.temporal else ["y", "x"]

    def select(self, columns: dict[str, Column], **meta: Any) -> Cube:
        """The same cells with other band columns."""
        df = self.df.select(*self.keys, *[c.alias(n) for n, c in columns.items()])
        own = {b.name: b for b in self.meta.bands}
        changed = {"bands": tuple(own.get(n, Band(n)) for n in columns)} | meta
        return Cube(df, replace(self.meta, **changed))

    def where(self, condition: Column) -> Cube:
        return replace(self, df=self.df.where(condition))

    def values(self) -> cb.Arr:
        return cb.Arr(tuple(F.col(b) for b in self.bands), tuple(self.bands))

    # --- filters and metadata

    def filter_temporal(self, start: str | None, end: str | None) -> Cube:
        """Rows with start <= t < end; equal bounds select that instant. An open bound is None."""
        if not self.meta.temporal:
            raise DimensionNotAvailable("t")
        t, out = F.col("t"), self
        if start is not None and end is not None and _moment(start) >= _moment(end):
            return self.where(t.between(instant(start), instant(end)))
        if start is not None:
            out = out.where(t >= instant(start))
        return out.where(t < instant(end)) if end is not None else out

    def filter_bbox(self, west: float, south: float, east: float, north: float, crs: str | None = None) -> Cube:
        grid = self.meta.grid
        if crs and crs != grid.crs:
            corners = self.df.sparkSession.range(1).select(
                *[c.alias(f"c{i}{j}") for i, (a, b) in enumerate(((west, south), (west, north), (east, south), (east, north)))
                  for j, c in enumerate(geo.transform(F.lit(float(a)), F.lit(float(b)), crs, grid.crs))]
            ).first()
            west, east = min(corners[0::2]), max(corners[0::2])
            south, north = min(corners[1::2]), max(corners[1::2])
        c0, c1, r0, r1 = grid.cells_in(west, south, east, north)
        return self.where(F.col("x").between(c0, c1) & F.col("y").between(r0, r1))

    def filter_bands(self, bands: Sequence[str]) -> Cube:
        """Select and reorder bands, by name, common name or alias."""
        found = [self.meta.band(b) for b in bands]
        return self.select({b.name: F.col(b.name) for b in found}, bands=tuple(found))

    def filter_labels(self, condition: dict, dimension: str) -> Cube:
        """Keep labels for which the callback (parameter ``value``) holds: dates or band names."""
        kind = self.meta.kind_of(dimension)
        if kind == "t":
            held = cb.Compiler(cb.as_graph(condition), {"value": F.col("t"), "x": F.col("t")}).result()
            return self.where(held)
        if kind != "bands":
            raise FeatureUnsupported(f"filter_labels on {dimension}")
        test = self.df.sparkSession.createDataFrame([(b,) for b in self.bands], "value string")
        held = cb.Compiler(cb.as_graph(condition), {"value": F.col("value"), "x": F.col("value")}).result()
        kept = {r.value for r in test.where(held).collect()}  # band names only
        return self.filter_bands([b for b in self.bands if b in kept])

    def dimension_labels(self, dimension: str) -> DataFrame:
        kind = self.meta.kind_of(dimension)
        if kind == "bands":
            return self.df.sparkSession.createDataFrame([(b,) for b in self.bands], "label string")
        if kind == "t":
            return self.df.select(F.col("t").alias("label")).distinct().orderBy("label")
        raise FeatureUnsupported(f"labels of {dimension}")

    def rename_dimension(self, source: str, target: str) -> Cube:
        kind = self.meta.kind_of(source)
        dims = tuple((k, target if k == kind else n) for k, n in self.meta.dims)
        return replace(self, meta=replace(self.meta, dims=dims))

    def rename_labels(self, dimension: str, target: Sequence[str], source: Sequence[str] | None = None) -> Cube:
        if self.meta.kind_of(dimension) != "bands":
            raise FeatureUnsupported(f"rename_labels on {dimension}")
        source = list(source or self.bands)
        if len(source) != len(target):
            raise DimensionLabelCountMismatch(f"{len(source)} labels, {len(target)} new ones")
        new = {self.meta.band(s).name: t for s, t in zip(source, target, strict=True)}
        bands = tuple(replace(b, name=new.get(b.name, b.name)) for b in self.meta.bands)
        if len({b.name for b in bands}) < len(bands):
            raise BandExists(", ".join(target))
        df = self.df.select(*self.keys, *[F.col(b).alias(new.get(b, b)) for b in self.bands])
        return Cube(df, replace(self.meta, bands=bands))

    def add_dimension(self, name: str, label: str, type: str = "other") -> Cube:
        if type == "temporal":
            if self.meta.temporal:
                raise DimensionExists(name)
            df = self.df.withColumn("t", instant(label)).select("t", "y", "x", *self.bands)
            dims = tuple((k, name if k == "t" else n) for k, n in self.meta.dims)
            return Cube(df, replace(self.meta, temporal=True, dims=dims))
        if type == "bands":
            if len(self.bands) > 1:
                raise DimensionExists(name)
            return self.rename_labels(dict(self.meta.dims)["bands"], [label])
        raise FeatureUnsupported(f"dimension type {type}")

    def drop_dimension(self, name: str) -> Cube:
        kind = self.meta.kind_of(name)
        if kind == "t":
            return Cube(self.df.drop("t"), replace(self.meta, temporal=False))
        if kind == "bands" and len(self.bands) == 1:
            return self
        if kind == "bands":
            raise DimensionLabelCountMismatch(f"{name} has {len(self.bands)} labels")
        raise FeatureUnsupported(f"drop_dimension {name}")

    def convert_data_type(self, kind: str) -> Cube:
        return self.select({b: conversion(F.col(b), kind) for b in self.bands}, cell_type=kind)

    def linear_scale_range(self, input_min: float, input_max: float, output_min: float = 0, output_max: float = 1) -> Cube:
        """Affine scaling, clipped to the input range; whole-number bounds wider than 1 give whole numbers."""
        kind = "float64"
        if all(float(v).is_integer() for v in (output_min, output_max)) and output_max - output_min > 1 and output_min >= 0:
            kind = "uint8" if output_max <= 254 else "uint16" if output_max <= 65534 else "float64"
        scale = lambda c: cb.elementwise(cb._scale)(c, input_min, input_max, output_min, output_max)
        return self.select({b: conversion(scale(F.col(b)), kind) for b in self.bands}, cell_type=kind)

    def ndvi(self, nir: str | None = None, red: str | None = None, target_band: str | None = None) -> Cube:
        def pick(name: str | None, common: str, error: type[Exception]) -> str:
            found = [b for b in self.meta.bands if b.answers_to(name or common)]
            exact = [b for b in found if b.name == (name or common)]
            if len(exact or found) != 1:
                raise error(name or common)
            return (exact or found)[0].name

        if len(self.bands) < 2:
            raise DimensionAmbiguous("ndvi needs a bands dimension")
        if target_band and target_band in self.bands:
            raise BandExists(target_band)
        n, r = F.col(pick(nir, "nir", NirBandAmbiguous)), F.col(pick(red, "red", RedBandAmbiguous))
        value = F.try_divide(n - r, n + r)
        own = {b: F.col(b) for b in self.bands} if target_band else {}
        return self.select(own | {target_band or "ndvi": value})

    # --- callbacks

    def apply(self, process: str | dict, context: Any = None) -> Cube:
        graph = cb.as_graph(process)
        run = lambda b: cb.numeric(cb.Compiler(graph, {"x": F.col(b), "context": context}).result())
        return self.select({b: run(b) for b in self.bands})

    def _over_bands(self, process: str | dict, context: Any) -> cb.Value:
        return cb.Compiler(cb.as_graph(process), {"data": self.values(), "context": context}).result()

    def _over_time(self, process: str | dict, band: str, window=None, context: Any = None) -> cb.Value:
        series = cb.Series(F.col(band), F.col("t"), window)
        return cb.Compiler(cb.as_graph(process), {"data": series, "context": context}).result()

    def reduce_dimension(self, dimension: str, reducer: str | dict, context: Any = None) -> Cube:
        kind = self.meta.kind_of(dimension)
        if kind == "bands":
            got = self._over_bands(reducer, context)
            if isinstance(got, cb.Arr):
                raise ProcessParameterInvalid("a reducer returns one value")
            return self.select({"value": cb.numeric(got)})
        if kind != "t":
            raise FeatureUnsupported(f"reduce_dimension over {dimension}")
        cols = []
        for b in self.bands:
            got = self._over_time(reducer, b, context=context)
            if isinstance(got, (cb.Arr, cb.Series)):
                raise ProcessParameterInvalid("a reducer returns one value")
            cols.append(cb.numeric(got).alias(b))
        return Cube(self.df.groupBy("y", "x").agg(*cols), replace(self.meta, temporal=False))

    def apply_dimension(self, dimension: str, process: str | dict, target_dimension: str | None = None, context: Any = None) -> Cube:
        kind = self.meta.kind_of(dimension)
        if kind == "bands":
            got = self._over_bands(process, context)
            items = got.items if isinstance(got, cb.Arr) else (got,)
            names = self.bands if len(items) == len(self.bands) else [f"band_{i}" for i in range(len(items))]
            return self.select({n: cb.numeric(c) for n, c in zip(names, items, strict=True)})
        if kind != "t":
            raise FeatureUnsupported(f"apply_dimension over {dimension}")
        if target_dimension is not None and self.meta.kind_of(target_dimension) == "bands":
            cols: dict[str, Column] = {}
            for b in self.bands:
                got = self._over_time(process, b, context=context)
                for i, c in enumerate(got.items if isinstance(got, cb.Arr) else (got,)):
                    cols[f"{b}_{i}"] = cb.numeric(c)
            df = self.df.groupBy("y", "x").agg(*[c.alias(n) for n, c in cols.items()])
            return Cube(df, replace(self.meta, temporal=False, bands=tuple(Band(n) for n in cols)))
        window = W.partitionBy("y", "x").orderBy("t")
        out = {}
        for b in self.bands:
            got = self._over_time(process, b, window, context)
            out[b] = cb.numeric(got.col if isinstance(got, cb.Series) else got)
        return self.select(out)

    # --- time

    def timeseries(self, x: float, y: float) -> DataFrame:
        """Dates and bands of the cell that holds a coordinate."""
        g = self.meta.grid
        col, row = int((x - g.x0) // g.res_x), int((g.y0 - y) // g.res_y)
        return self.df.where((F.col("x") == col) & (F.col("y") == row)).select("t", *self.bands).orderBy("t")

    def aggregate_temporal(self, intervals: Sequence[Sequence[str]], reducer: str | dict, labels: Sequence[str] | None = None) -> Cube:
        """Reduce [start, end) intervals, which may overlap; an interval without data gives no-data cells."""
        if labels is not None and len(labels) != len(intervals):
            raise DimensionLabelCountMismatch(f"{len(intervals)} intervals, {len(labels)} labels")
        parts = [
            F.struct(F.lit(i).alias("i"), instant(s).alias("start"), instant(e).alias("end"), instant(labels[i] if labels else s).alias("label"))
            for i, (s, e) in enumerate(intervals)
        ]
        # the intervals are part of the request: each row looks up its own, without a join
        within = F.filter(F.array(*parts), lambda p: (p["start"] <= F.col("t")) & (F.col("t") < p["end"]))
        hits = self.df.withColumn("_p", F.explode(within)).withColumn("i", F.col("_p.i"))
        cols = [cb.numeric(self._over_time(reducer, b)).alias(b) for b in self.bands]
        got = hits.groupBy("i", "y", "x").agg(*cols)
        spine = self.df.select("y", "x").distinct().withColumn("_p", F.explode(F.array(*parts)))
        out = spine.select("y", "x", "_p.i", "_p.label").join(got, ["i", "y", "x"], "left")
        bands = [F.coalesce(b, F.lit(0.0)).alias(b) if reducer == "count" else F.col(b) for b in self.bands]
        return Cube(out.select(F.col("label").alias("t"), "y", "x", *bands), self.meta)

    PERIODS = ("hour", "day", "dekad", "week", "month", "season", "tropical-season", "year", "decade")

    def period_start(self, period: str) -> Column:
        t = F.col("t")
        if period not in self.PERIODS:
            raise ProcessParameterInvalid(f"period {period}")
        if period == "season":  # starts in March, June, September and December
            return F.date_trunc("month", F.add_months(t.cast("date"), -(F.month(t) % 3))).cast("timestamp_ntz")
        if period == "tropical-season":  # starts in May and November
            return F.date_trunc("month", F.add_months(t.cast("date"), -((F.month(t) + 1) % 6))).cast("timestamp_ntz")
        if period == "decade":
            return F.make_timestamp_ntz(F.year(t) - F.year(t) % 10, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        if period == "dekad":
            day = F.least(F.floor((F.dayofmonth(t) - 1) / 10), F.lit(2)) * 10 + 1
            return F.make_timestamp_ntz(F.year(t), F.month(t), day.cast("int"), F.lit(0), F.lit(0), F.lit(0))
        return F.date_trunc(period, t).cast("timestamp_ntz")

    def aggregate_temporal_period(self, period: str, reducer: str | dict) -> Cube:
        """Reduce calendar periods; periods without data are absent."""
        cols = [cb.numeric(self._over_time(reducer, b)).alias(b) for b in self.bands]
        df = self.df.withColumn("_p", self.period_start(period)).groupBy("_p", "y", "x").agg(*cols)
        return Cube(df.select(F.col("_p").alias("t"), "y", "x", *self.bands), self.meta)

    def apply_period(self, period: str, process: str | dict) -> Cube:
        """Each row gets what the callback makes of its cell's series within its calendar period."""
        cube = replace(self, df=self.df.withColumn("_p", self.period_start(period)))
        window, out = W.partitionBy("y", "x", "_p").orderBy("t"), {}
        for b in self.bands:
            got = self._over_time(process, b, window)
            out[b] = cb.numeric(got.col if isinstance(got, cb.Series) else got)
        return cube.select(out)

    def select_best_in_period(self, period: str, band: str, day: int = 15) -> Cube:
        """Per cell and period, the row whose day of the month is closest to ``day`` among those with data in ``band``."""
        away = F.abs(F.dayofmonth("t") - day)
        df = self.df.where(F.col(band).isNotNull()).withColumn("_p", self.period_start(period)).withColumn("_a", away)
        best = F.min("_a").over(W.partitionBy("_p", "y", "x"))
        return replace(self, df=df.withColumn("_b", best).where("_a = _b").drop("_p", "_a", "_b"))

    # --- other cubes

    def merge_cubes(self, other: Cube, overlap_resolver: str | dict | None = None) -> Cube:
        """Join on the shared dimensions; shared bands are combined by the resolver (parameters x, y).

        A cell that only one cube has passes through. A cube without time meets every date of the other.
        """
        shared = [b for b in self.bands if b in other.bands]
        if self.meta.grid.crs != other.meta.grid.crs or (self.meta.grid.res_x, self.meta.grid.res_y) != (other.meta.grid.res_x, other.meta.grid.res_y):
            raise DimensionMismatch("cubes on different grids need resample_cube_spatial first")
        if shared and overlap_resolver is None:
            raise OverlapResolverMissing(", ".join(shared))
        keys = ["t", "y", "x"] if self.meta.temporal and other.meta.temporal else ["y", "x"]
        temporal = self.meta.temporal or other.meta.temporal
        how = "full" if self.meta.temporal == other.meta.temporal else "left" if self.meta.temporal else "right"
        left = self.df.withColumnsRenamed({b: f"_l_{b}" for b in self.bands})
        right = other.df.withColumnsRenamed({b: f"_r_{b}" for b in other.bands})
        joined = left.join(right, keys, how)

        def value(b: str) -> Column:
            if b not in shared:
                return F.col(f"_l_{b}" if b in self.bands else f"_r_{b}")
            x, y = F.col(f"_l_{b}"), F.col(f"_r_{b}")
            graph = overlap_resolver if isinstance(overlap_resolver, dict) else _resolver(overlap_resolver)
            both = cb.Compiler(cb.as_graph(graph), {"x": x, "y": y, "data": cb.Arr((x, y))}).result()
            return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(cb.numeric(both))

        names = self.bands + [b for b in other.bands if b not in self.bands]
        own = {b.name: b for b in (*other.meta.bands, *self.meta.bands)}
        df = joined.select(*(["t"] if temporal else []), "y", "x", *[value(b).alias(b) for b in names])
        meta = replace(self.meta, temporal=temporal, bands=tuple(own[n] for n in names), grid=self.meta.grid.union(other.meta.grid))
        return Cube(df, meta)

    def mask(self, mask: Cube, replacement: float | None = None) -> Cube:
        """Where the mask is neither 0 nor no-data, put the replacement or no-data; a mask without time fits all dates."""
        if mask.meta.temporal and not self.meta.temporal:
            raise DimensionMismatch("a temporal mask needs temporal data")
        keys = mask.keys
        one = len(mask.bands) == 1
        if not one and len(mask.bands) != len(self.bands):
            raise DimensionMismatch("a mask has one band, or as many as the data")
        right = mask.df.select(*keys, *[F.col(b).alias(f"_m{i}") for i, b in enumerate(mask.bands)])
        joined = self.df.join(right, keys, "left")
        new = F.lit(replacement).cast("double")
        put = lambda i, b: F.when(F.coalesce(F.col(f"_m{0 if one else i}"), F.lit(0.0)) != 0, new).otherwise(F.col(b))
        return replace(self, df=joined.select(*self.keys, *[put(i, b).alias(b) for i, b in enumerate(self.bands)]))

    def inspect(self, message: str = "", rows: int = 5) -> Cube:
        print(message, self.meta.to_dict())
        self.df.show(rows)
        return self

    def sar_backscatter(self, **options: Any) -> Cube:
        """Calibration is a matter of the source; the cube is passed on."""
        return self

    def unsupported(self, process: str) -> Cube:
        raise FeatureUnsupported(f"{process} needs sensor models that this engine does not have")


def _resolver(name: str) -> dict:
    pair = {"x": {"from_parameter": "x"}, "y": {"from_parameter": "y"}}
    if name in cb.ARRAY_REDUCERS:
        pair = {"data": {"from_parameter": "data"}}
    return {"r": {"process_id": name, "arguments": pair, "result": True}}
