"""Data model: grids, bands, cube metadata and the error contract."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace


class CubeError(Exception):
    """Base of all errors; ``code`` is the stable name a client sees."""

    @property
    def code(self) -> str:
        return type(self).__name__


class OverlapResolverMissing(CubeError): ...


class DimensionMismatch(CubeError): ...


class DimensionNotAvailable(CubeError): ...


class DimensionLabelCountMismatch(CubeError): ...


class DimensionExists(CubeError): ...


class DimensionAmbiguous(CubeError): ...


class BandExists(CubeError): ...


class BandNotFound(CubeError): ...


class RedBandAmbiguous(CubeError): ...


class NirBandAmbiguous(CubeError): ...


class ReducerUnsupported(CubeError): ...


class ProcessUnsupported(CubeError): ...


class ProcessParameterInvalid(CubeError): ...


class FeatureUnsupported(CubeError): ...


class FormatUnsupported(CubeError): ...


class NoDataAvailable(CubeError): ...


class MissingSpatialFilter(CubeError): ...


class ExtentTooLarge(CubeError): ...


class CollectionNotFound(CubeError): ...


@dataclass(frozen=True)
class Band:
    name: str
    common_name: str | None = None
    aliases: tuple[str, ...] = ()
    scale: float = 1.0
    offset: float = 0.0

    def answers_to(self, name: str) -> bool:
        return name == self.name or name == self.common_name or name in self.aliases


@dataclass(frozen=True)
class GridSpec:
    """A regular grid whose rows grow southward from (x0, y0), its upper left corner."""

    crs: str = "index"
    x0: float = 0.0
    y0: float = 0.0
    res_x: float = 1.0
    res_y: float = 1.0
    width: int = 16
    height: int = 16
    tile: int = 256

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east, north."""
        return self.x0, self.y0 - self.height * self.res_y, self.x0 + self.width * self.res_x, self.y0

    def snap(self, value: float, axis: str = "x", mode: str = "round") -> float:
        """The grid line next to a coordinate: down, round or up."""
        origin, res = (self.x0, self.res_x) if axis == "x" else (self.y0, self.res_y)
        pick = {"down": math.floor, "round": round, "up": math.ceil}[mode]
        return origin + pick((value - origin) / res) * res

    def cells_in(self, west: float, south: float, east: float, north: float) -> tuple[int, int, int, int]:
        """First and last column and row that an extent touches, within the grid."""
        c0, c1 = math.floor((west - self.x0) / self.res_x), math.ceil((east - self.x0) / self.res_x) - 1
        r0, r1 = math.floor((self.y0 - north) / self.res_y), math.ceil((self.y0 - south) / self.res_y) - 1
        return max(0, c0), min(self.width - 1, c1), max(0, r0), min(self.height - 1, r1)

    def resampled(self, res_x: float, res_y: float | None = None) -> GridSpec:
        res_y = res_y or res_x
        cols = math.ceil(round(self.width * self.res_x / res_x, 9))
        rows = math.ceil(round(self.height * self.res_y / res_y, 9))
        return replace(self, res_x=res_x, res_y=res_y, width=cols, height=rows)

    def union(self, other: GridSpec) -> GridSpec:
        """The least grid on this grid's lines that holds both extents."""
        if self.crs != other.crs:
            raise DimensionMismatch(f"{self.crs} and {other.crs}")
        w, s, e, n = (f(a, b) for f, a, b in zip((min, min, max, max), self.bounds, other.bounds, strict=True))
        x0, y0 = self.snap(w, "x", "down"), self.snap(n, "y", "up")
        return replace(self, x0=x0, y0=y0, width=math.ceil(round((e - x0) / self.res_x, 9)), height=math.ceil(round((y0 - s) / self.res_y, 9)))

    def buffered(self, cells: int) -> GridSpec:
        return replace(self, x0=self.x0 - cells * self.res_x, y0=self.y0 + cells * self.res_y, width=self.width + 2 * cells, height=self.height + 2 * cells)


#: Cells (columns x rows x dates x bands) above which a load is refused, and columns or rows of a direct request.
MAX_CELLS, MAX_SIDE = 1e11, 20_000


@dataclass(frozen=True)
class CubeMeta:
    bands: tuple[Band, ...]
    grid: GridSpec = field(default_factory=GridSpec)
    temporal: bool = True
    cell_type: str = "float64"
    extent: tuple[str, str] | None = None
    dims: tuple[tuple[str, str], ...] = (("x", "x"), ("y", "y"), ("t", "t"), ("bands", "bands"))

    @property
    def names(self) -> list[str]:
        return [b.name for b in self.bands]

    def band(self, name: str | int) -> Band:
        if isinstance(name, int):
            return self.bands[name]
        for exact in (lambda b: b.name == name, lambda b: b.answers_to(name)):
            if found := [b for b in self.bands if exact(b)]:
                return found[0]
        raise BandNotFound(f"{name}; there are {', '.join(self.names)}")

    def kind_of(self, dimension: str) -> str:
        """x, y, t or bands, for a dimension's current name."""
        for kind, name in self.dims:
            if name == dimension and (kind != "t" or self.temporal):
                return kind
        raise DimensionNotAvailable(dimension)

    def guard(self, dates: int, synchronous: bool = False) -> None:
        """Refuse cubes that are too large to evaluate, from metadata alone."""
        if synchronous and max(self.grid.width, self.grid.height) > MAX_SIDE:
            raise ExtentTooLarge(f"a direct request is limited to {MAX_SIDE} cells a side")
        cells = self.grid.width * self.grid.height * max(1, dates) * len(self.bands)
        if cells > MAX_CELLS:
            raise ExtentTooLarge(f"about {cells:.3g} cells; the limit is {MAX_CELLS:.0g}")

    def to_dict(self) -> dict:
        g = self.grid
        return {
            "bands": [{"name": b.name, "common_name": b.common_name, "aliases": list(b.aliases)} for b in self.bands],
            "dimensions": [name for kind, name in self.dims if kind != "t" or self.temporal],
            "grid": {"crs": g.crs, "bounds": list(g.bounds), "resolution": [g.res_x, g.res_y], "size": [g.width, g.height]},
            "cell_type": self.cell_type,
            "extent": list(self.extent) if self.extent else None,
        }
