"""Geometries as nested arrays, point-in-polygon tests and closed-form projections as Spark columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import FeatureUnsupported, ProcessParameterInvalid

#: WGS 84 ellipsoid and the sphere of web mercator.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE = 0.9996

Ring = list[tuple[float, float]]
FEATURES = "feature_index int, feature_id string, rings array<array<struct<x: double, y: double>>>, point boolean, props map<string, string>"


def parse_wkt(text: str) -> tuple[list[Ring], bool]:
    """(rings, is a point) of a WKT point, polygon or multipolygon."""
    kind = re.match(r"\s*([A-Za-z]+)", text)
    name = kind[1].upper() if kind else ""
    groups = re.findall(r"\(([^()]+)\)", text)
    rings = [[tuple(map(float, p.split()[:2])) for p in g.split(",")] for g in groups]
    if name not in ("POINT", "POLYGON", "MULTIPOLYGON") or not rings:
        raise FeatureUnsupported(f"geometry {text[:40]}")
    return rings, name == "POINT"


def parse_geojson(geometry: dict) -> tuple[list[Ring], bool]:
    kind, c = geometry["type"], geometry.get("coordinates")
    if kind == "Point":
        return [[(float(c[0]), float(c[1]))]], True
    if kind == "Polygon":
        return [[(float(p[0]), float(p[1])) for p in ring] for ring in c], False
    if kind == "MultiPolygon":
        return [[(float(p[0]), float(p[1])) for p in ring] for polygon in c for ring in polygon], False
    if kind == "GeometryCollection":
        parts = [parse_geojson(g) for g in geometry["geometries"]]
        return [r for rings, _ in parts for r in rings], all(p for _, p in parts)
    raise FeatureUnsupported(f"geometry type {kind}")


def features(spark: SparkSession, source: dict | list | str) -> DataFrame:
    """Features of a GeoJSON object, a list of WKT strings, or one WKT string, in order."""
    if isinstance(source, str):
        source = [source]
    if isinstance(source, dict):
        kind = source.get("type")
        items = source["features"] if kind == "FeatureCollection" else [source if kind == "Feature" else {"geometry": source}]
        if kind == "GeometryCollection":
            items = [{"geometry": g} for g in source["geometries"]]
    else:
        items = [{"wkt": w} for w in source]
    rows = []
    for i, f in enumerate(items):
        rings, point = parse_wkt(f["wkt"]) if "wkt" in f else parse_geojson(f["geometry"])
        props = {k: None if v is None else str(v) for k, v in (f.get("properties") or {}).items()}
        rows.append((i, str(f.get("id", props.get("id", i))), rings, point, props))
    return spark.createDataFrame(rows, FEATURES)


def geojson_rows(found: DataFrame) -> DataFrame:
    """Features of parsed GeoJSON (file_path, line, at, f), numbered in that order; coordinates are still JSON text.

    Only the geometries' own JSON is read, by column functions. Numbering orders all features once: a feature table is small
    beside the pixels it is asked of.
    """
    g = F.col("f.geometry")
    pair = "array<double>"
    point = F.from_json(g["coordinates"], pair)
    polygon = F.from_json(g["coordinates"], f"array<array<{pair}>>")
    several = F.from_json(g["coordinates"], f"array<array<array<{pair}>>>")
    xy = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    rings = F.when(g["type"] == "Point", F.array(F.array(xy(point)))).when(g["type"] == "Polygon", F.transform(polygon, lambda r: F.transform(r, xy)))
    rings = rings.when(g["type"] == "MultiPolygon", F.transform(F.flatten(several), lambda r: F.transform(r, xy)))
    rings = F.when(rings.isNull(), F.raise_error(F.concat(F.lit("geometry type "), F.coalesce(g["type"], F.lit("none"))))).otherwise(rings)
    index = (F.row_number().over(W.orderBy("file_path", "line", "at")) - 1).cast("int")
    props = F.coalesce(F.col("f.properties"), F.create_map().cast("map<string,string>"))
    rows = found.select(index.alias("feature_index"), "f", rings.alias("rings"), (g["type"] == "Point").alias("point"), props.alias("props"))
    name = F.coalesce("f.id", F.try_element_at("props", F.lit("id")), F.col("feature_index").cast("string"))
    return rows.select("feature_index", name.alias("feature_id"), "rings", "point", "props")


def as_geojson(feats: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(value): one GeoJSON feature to a line; columns (by default all others) join the properties. Rings are one polygon."""
    known = ["feature_index", "feature_id", "rings", "point", "props"]
    extra = [c for c in feats.columns if c not in known] if columns is None else columns
    outline = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    flat = lambda c, kind: F.struct(F.lit(kind).alias("type"), c.alias("coordinates"))
    props = F.map_concat("props", F.map_from_arrays(F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(f"`{c}`").cast("string") for c in extra]))) if extra else F.col("props")
    parts = [F.lit("Feature").alias("type"), F.col("feature_id").alias("id"), props.alias("properties")]
    first = F.get(F.get(outline, F.lit(0)), F.lit(0))
    return feats.select(
        F.when(F.col("point"), F.to_json(F.struct(*parts, flat(first, "Point").alias("geometry")))).otherwise(F.to_json(F.struct(*parts, flat(outline, "Polygon").alias("geometry")))).alias("value")
    )


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule: whether (x, y) lies within the rings, holes and parts included."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)
        nxt = lambda i: F.get(ring, F.when(i + 1 < n, i + 1).otherwise(0))
        edge = lambda p, i: F.when(
            (p["y"] > y) != (nxt(i)["y"] > y), (x < (nxt(i)["x"] - p["x"]) * (y - p["y"]) / (nxt(i)["y"] - p["y"]) + p["x"]).cast("int")
        ).otherwise(0)
        return F.aggregate(F.transform(ring, edge), F.lit(0), lambda s, e: s + e)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, c: s + c) % 2 == 1


def crossings(y: Column, rings: Column) -> Column:
    """Where the rings' edges cross a horizontal line, in no order; between the first two and every other two it is inside."""

    def of(ring: Column) -> Column:
        n = F.size(ring)
        nxt = lambda i: F.get(ring, F.when(i + 1 < n, i + 1).otherwise(0))
        cut = lambda p, i: F.when((p["y"] > y) != (nxt(i)["y"] > y), (nxt(i)["x"] - p["x"]) * (y - p["y"]) / (nxt(i)["y"] - p["y"]) + p["x"])
        return F.filter(F.transform(ring, cut), lambda x: x.isNotNull())

    return F.flatten(F.transform(rings, of))


def with_bounds(feats: DataFrame) -> DataFrame:
    points = F.flatten("rings")
    pick = lambda axis, fn: fn(F.transform(points, lambda p: p[axis]))
    return feats.withColumns(
        {"west": pick("x", F.array_min), "east": pick("x", F.array_max), "south": pick("y", F.array_min), "north": pick("y", F.array_max)}
    )


def buffered_point(lon: float, lat: float, metres: float) -> dict:
    """A square around a point, as GeoJSON."""
    dy = math.degrees(metres / SEMI_MAJOR)
    dx = dy / max(1e-9, math.cos(math.radians(lat)))
    ring = [[lon - dx, lat - dy], [lon + dx, lat - dy], [lon + dx, lat + dy], [lon - dx, lat + dy], [lon - dx, lat - dy]]
    return {"type": "Polygon", "coordinates": [ring]}


def simplified(boxes: list[tuple[float, float, float, float]]) -> tuple[float, float, float, float] | None:
    """The extent of all boxes (west, south, east, north)."""
    return tuple(f(c) for f, c in zip((min, min, max, max), zip(*boxes, strict=True), strict=True)) if boxes else None


# --- projections


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * SEMI_MAJOR, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * SEMI_MAJOR


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / SEMI_MAJOR), F.degrees(2 * F.atan(F.exp(y / SEMI_MAJOR)) - F.lit(math.pi / 2))


def mercator_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web tile that holds a point."""
    x, y = to_mercator(lon, lat)
    half, n = math.pi * SEMI_MAJOR, 2**zoom
    clip = lambda c: F.least(F.greatest(F.floor(c * n).cast("int"), F.lit(0)), F.lit(n - 1))
    return clip((x + half) / (2 * half)), clip((half - y) / (2 * half))


def utm_zone(lon: float, lat: float) -> str:
    return f"EPSG:{(32600 if lat >= 0 else 32700) + int((lon + 180) // 6) % 60 + 1}"


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Transverse mercator by the series in the third flattening (better than a millimetre within a zone)."""
    zone, south = epsg % 100, epsg // 100 == 327
    n = FLATTENING / (2 - FLATTENING)
    a = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + UTM_SCALE * a * east, (10_000_000 if south else 0) + UTM_SCALE * a * north


def from_utm(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    zone, south = epsg % 100, epsg // 100 == 327
    n = FLATTENING / (2 - FLATTENING)
    a = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (y - (10_000_000 if south else 0)) / (UTM_SCALE * a)
    eta = (x - 500000) / (UTM_SCALE * a)
    u, v = xi, eta
    for j, c in enumerate(beta, 1):
        u = u - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (6 * zone - 183), F.degrees(lat)


def transform(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates from one reference system to another: EPSG 4326, 3857 and the UTM zones 326xx and 327xx."""
    if source == target:
        return x, y

    def code(crs: str) -> int:
        m = re.fullmatch(r"(?:EPSG:)?(\d+)", str(crs))
        if not m or not (int(m[1]) in (4326, 3857) or int(m[1]) // 100 in (326, 327)):
            raise ProcessParameterInvalid(f"reference system {crs}")
        return int(m[1])

    s, t = code(source), code(target)
    lon, lat = (x, y) if s == 4326 else from_mercator(x, y) if s == 3857 else from_utm(x, y, s)
    return (lon, lat) if t == 4326 else to_mercator(lon, lat) if t == 3857 else to_utm(lon, lat, t)
