"""Scene catalogs: items as rows, filtered, deduplicated and exploded to assets."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import ProcessParameterInvalid
from ..operators.cube import instant

SCHEMA = (
    "id string, datetime timestamp_ntz, start timestamp_ntz, end timestamp_ntz, west double, south double, east double, north double, "
    "properties map<string,string>, assets array<struct<name: string, href: string, type: string, roles: array<string>, bands: array<string>, gsd: double>>"
)
#: Times the time tolerance: items of one key that are ordered together.
SPAN = 1000
OPERATORS = ("eq", "like", "lte", "gte", "in")


def conditions(properties: dict[str, Any]) -> list[tuple[str, str, Any]]:
    """(property, operator, value) of literal conditions: a callback graph of one comparison, or a value to equal."""
    out = []
    for name, wanted in properties.items():
        if isinstance(wanted, dict):
            graph = wanted.get("process_graph", wanted)
            for node in graph.values():
                a, op = node["arguments"], node["process_id"]
                if op == "array_contains":
                    out.append((name, "in", a["data"]))
                    continue
                if op == "between":
                    out += [(name, "gte", a["min"]), (name, "lte", a["max"])]
                    continue
                literal = a["y"] if isinstance(a.get("x"), dict) else a["x"]
                if not isinstance(a.get("x"), dict):  # literal first: the comparison is mirrored
                    op = {"lte": "gte", "gte": "lte"}.get(op, op)
                out.append((name, op, literal))
        else:
            out.append((name, "eq", wanted))
    out = [(n, "like" if op == "eq" and isinstance(v, str) and re.search(r"[*?]", v) else op, v) for n, op, v in out]
    for _, op, _ in out:
        if op not in OPERATORS:
            raise ProcessParameterInvalid(f"operator {op} on properties")
    return out


def _holds(actual: Column, op: str, value: Any) -> Column:
    if op == "eq":
        return actual.isNull() if value is None else actual == F.lit(value)
    if op == "like":
        return actual.cast("string").rlike("^(?:" + fnmatch.translate(value).removesuffix(r"\Z").removesuffix(r"\z") + ")$")
    if op == "in":
        return actual.isin(list(value))
    return actual <= F.lit(value) if op == "lte" else actual >= F.lit(value)


def property_filter(properties: dict[str, Any], columns: Sequence[str] = (), source: str = "properties") -> Column:
    """All conditions hold. A missing property never matches; a null one matches only "equals null".

    A property that is a column is compared as such, others as entries of the ``source`` map: numbers numerically.
    """
    out = F.lit(True)
    for name, op, value in conditions(properties):
        if name in columns:
            test = _holds(F.col(f"`{name}`"), op, value)
        else:
            raw = F.try_element_at(source, F.lit(name))
            number = isinstance(value, (int, float)) or (op == "in" and all(isinstance(v, (int, float)) for v in value))
            test = F.map_contains_key(source, F.lit(name)) & _holds(raw.try_cast("double") if number else raw, op, value)
        out = out & F.coalesce(test, F.lit(False))
    return out


def cql2_text(properties: dict[str, Any]) -> str:
    def show(v: Any) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    def one(name: str, op: str, v: Any) -> str:
        key = f'"properties.{name}"'
        if op == "in":
            return f"{key} in ({', '.join(map(show, v))})"
        if op == "like":
            return f"{key} like {show(v.replace('*', '%').replace('?', '_'))}"
        return f"{key} {'=' if op == 'eq' else '<=' if op == 'lte' else '>='} {show(v)}"

    return " and ".join(one(*c) for c in conditions(properties))


def cql2_json(properties: dict[str, Any]) -> dict:
    names = {"eq": "=", "lte": "<=", "gte": ">=", "like": "like", "in": "in"}
    parts = [
        {"op": names[op], "args": [{"property": f"properties.{name}"}, v.replace("*", "%").replace("?", "_") if op == "like" else v]}
        for name, op, v in conditions(properties)
    ]
    return parts[0] if len(parts) == 1 else {"op": "and", "args": parts}


def adapted(properties: dict[str, Any], rules: dict[str, Any]) -> dict[str, Any]:
    """Conditions for another catalog: a rule is None (drop), a new name, or {"name": ..., "values": {old: new}}."""
    out = {}
    for name, wanted in properties.items():
        rule = rules.get(name, name)
        if rule is None:
            continue
        if isinstance(rule, dict):
            wanted = rule.get("values", {}).get(wanted, wanted) if not isinstance(wanted, dict) else wanted
            rule = rule.get("name", name)
        out[rule] = wanted
    return out


def temporal_filter(start: str | None, end: str | None) -> Column:
    """Items whose interval (start, end; else the nominal time) meets [start, end); equal bounds are that whole day."""
    first, last = F.coalesce("start", "datetime"), F.coalesce("end", "datetime")
    out = F.lit(True)
    if start is not None and start == end:
        day = F.date_trunc("day", instant(start)).cast("timestamp_ntz")
        return (first < day + F.expr("interval 1 day")) & (last >= day)
    if start is not None:
        out = out & (last >= instant(start))
    return out & (first < instant(end)) if end is not None else out


def spatial_filter(west: float, south: float, east: float, north: float) -> Column:
    """Items whose box meets the extent; either may cross the antimeridian (west > east)."""
    boxes = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    out = F.lit(False)
    for w, e in boxes:
        plain = (F.col("west") <= e) & (F.col("east") >= w)
        crossing = (F.col("west") <= e) | (F.col("east") >= w)
        out = out | F.when(F.col("west") <= F.col("east"), plain).otherwise(crossing)
    return out & (F.col("south") <= north) & (F.col("north") >= south)


def query(items: DataFrame, extent=None, temporal=None, properties: dict | None = None, max_items: int | None = None) -> DataFrame:
    if extent:
        items = items.where(spatial_filter(*extent))
    if temporal:
        items = items.where(temporal_filter(*temporal))
    if properties:
        items = items.where(property_filter(properties, columns=[c for c in items.columns if c != "properties"]))
    return items.orderBy("datetime", "id").limit(max_items) if max_items else items


def query_json(items: DataFrame) -> DataFrame:
    """(id, item): each item as a JSON document."""
    return items.select("id", F.to_json(F.struct("*")).alias("item"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON lines files in the catalog's schema."""
    return spark.read.schema(SCHEMA).json(path)


def deduplicate(
    items: DataFrame, properties: Sequence[str], seconds: float = 30, box_tolerance: float = 1e-3, preference: dict[str, list] | None = None
) -> DataFrame:
    """One item for each group of duplicates: equal properties, boxes within a tolerance, less than ``seconds`` apart.

    A group is seeded by its earliest item and holds the later ones that match that seed, not each other. The winner has the
    highest preferred property values, then the latest ``updated``, then the greatest id. Groups lie within sessions of items
    with equal properties, so only items close in time meet in one task.
    """
    score = [
        F.coalesce(F.create_map(*[F.lit(x) for i, v in enumerate(vs) for x in (str(v), len(vs) - i)])[F.try_element_at("properties", F.lit(p))], F.lit(0))
        for p, vs in (preference or {}).items()
    ]
    key = F.to_json(F.array(*[F.try_element_at("properties", F.lit(p)) for p in properties])) if properties else F.lit("")
    df = items.select(
        "id", key.alias("_key"), F.coalesce(F.unix_micros(F.coalesce("datetime", "start").cast("timestamp")), F.lit(0)).alias("_time"), "west", "south", "east", "north",
        F.array(*score, F.lit(0)).alias("_score"), F.coalesce(F.try_element_at("properties", F.lit("updated")), F.lit("")).alias("_updated"),
    )
    # items of one key are ordered in spans of time; what a span needs of those before it comes from one row for each span
    span = max(1, int(SPAN * max(seconds, 1) * 1e6))
    df = df.withColumn("_span", F.floor(F.col("_time") / span))
    spans = df.groupBy("_key", "_span").agg(F.max("_time").alias("_last"))
    earlier = W.partitionBy("_key").orderBy("_span")
    spans = spans.select("_key", "_span", F.lag("_last").over(earlier).alias("_before"))
    w = W.partitionBy("_key", "_span").orderBy("_time", "id")
    df = df.join(spans, ["_key", "_span"])
    fresh = F.col("_time") - F.coalesce(F.lag("_time").over(w), F.col("_before")) >= int(seconds * 1e6)
    df = df.withColumn("_start", F.when(F.coalesce(fresh, F.lit(True)), F.col("_time")))
    begun = df.groupBy("_key", "_span").agg(F.max("_start").alias("_begun"))
    begun = begun.select("_key", "_span", F.last("_begun", ignorenulls=True).over(earlier.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    df = df.join(begun, ["_key", "_span"])
    df = df.withColumn("_session", F.coalesce(F.last("_start", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("_carried")))

    def groups(pdf):
        pdf = pdf.sort_values(["_time", "id"], kind="stable").reset_index(drop=True)
        times, boxes = pdf["_time"].to_numpy(), pdf[["west", "south", "east", "north"]].to_numpy(float)
        order = [(*map(int, s), u, i) for s, u, i in zip(pdf["_score"], pdf["_updated"], pdf["id"], strict=True)]
        handled, keep = set(), []
        for i in range(len(pdf)):
            if i in handled:
                continue
            group = [i]
            for j in range(i + 1, len(pdf)):
                if times[j] - times[i] >= seconds * 1e6:
                    break
                near = abs(boxes[i] - boxes[j])
                if j not in handled and bool(((near <= box_tolerance) | (near != near)).all()):
                    group.append(j)
                    handled.add(j)
            keep.append(max(group, key=lambda k: order[k]))
        return pdf.loc[sorted(keep), ["id", "_key"]]

    sizes = df.groupBy("_key", "_session").agg(F.count("*").alias("_n"))
    small = df.join(sizes, ["_key", "_session"]).select("id", "_key", "_session", "_n", "_time", "_score", "_updated", "west", "south", "east", "north")
    alone = small.where("_n = 1").select("id", "_key")
    # sessions that begin in one span of time go to Python together; gaps keep them apart there
    several = small.where("_n > 1").withColumn("_part", F.floor(F.col("_session") / span))
    kept = several.groupBy("_key", "_part").applyInPandas(lambda pdf: groups(pdf), "id string, _key string")
    return items.join(alone.union(kept).select("id"), "id", "left_semi")


def prefer_timeliness(items: DataFrame, acquisition: Sequence[str], order: Sequence[str] = ("NT", "ST", "NR"), property: str = "timeliness") -> DataFrame:
    """Of items with the same acquisition key (columns) the one of the preferred timeliness, then the latest id."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.try_element_at("properties", F.lit(property)))
    w = W.partitionBy(*acquisition).orderBy(F.when(place > 0, place).asc_nulls_last(), F.col("id").desc())
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


RASTER_TYPES = ("image/tiff", "image/vnd.stac.geotiff", "image/jp2", "application/x-netcdf", "application/x-zarr")


def band_assets(items: DataFrame, bands: Sequence[str] | None = None) -> DataFrame:
    """(id, asset): raster assets with data bands; of assets with the same bands in an item the finest (least gsd)."""
    a = items.select("id", F.explode("assets").alias("asset"))
    kind = F.lower(F.split_part(F.col("asset.type"), F.lit(";"), F.lit(1)))
    role = F.col("asset.roles").isNull() | F.exists("asset.roles", lambda r: r.isin("data", "visual", "reflectance"))
    a = a.where(kind.isin(*RASTER_TYPES) & role & (F.size("asset.bands") > 0))
    if bands:
        a = a.where(F.arrays_overlap("asset.bands", F.array(*[F.lit(b) for b in bands])))
    w = W.partitionBy("id", F.array_sort("asset.bands")).orderBy(F.col("asset.gsd").asc_nulls_last(), "asset.name")
    return a.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
