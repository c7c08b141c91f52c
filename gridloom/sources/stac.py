"""STAC documents as scene items, and items as cubes.

Items, item collections, collections and static catalogs are JSON documents. A catalog is read level by level: the documents of a
level are one Spark read, children whose extent misses the request are pruned before they are read, and only the links of
one level pass through the driver. The pixels of an item's assets are rows (href, band, y, x, value) in any table or
files that Spark reads; a cube is a join of the chosen assets with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Band, CubeMeta, GridSpec, NoDataAvailable, ProcessParameterInvalid
from ..operators.cube import Cube, instant
from . import items as it

_ASSET = "struct<href: string, type: string, roles: array<string>, `eo:bands`: array<struct<name: string>>, gsd: double>"
_ITEM = f"struct<type: string, id: string, bbox: array<double>, properties: map<string, string>, assets: map<string, {_ASSET}>>"
DOCUMENT = (
    f"type string, id string, bbox array<double>, properties map<string, string>, assets map<string, {_ASSET}>, features array<{_ITEM}>, "
    "extent struct<spatial: struct<bbox: array<array<double>>>, temporal: struct<interval: array<array<string>>>>, links array<struct<rel: string, href: string>>"
)


def documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, doc): JSON documents, one to a file."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", F.from_json("value", DOCUMENT).alias("doc"))


def _moment(properties: Column, name: str) -> Column:
    return F.to_timestamp_ntz(F.replace(F.replace(F.try_element_at(properties, F.lit(name)), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")))


def _row(item: Column) -> list[Column]:
    """The columns of the item schema of a document."""
    entries = F.map_entries(item["assets"])
    assets = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("name"), e["value"]["href"].alias("href"), e["value"]["type"].alias("type"), e["value"]["roles"].alias("roles"),
            F.transform(e["value"]["eo:bands"], lambda b: b["name"]).alias("bands"), e["value"]["gsd"].alias("gsd"),
        ),
    )
    p, box = item["properties"], item["bbox"]
    return [
        item["id"].alias("id"), _moment(p, "datetime").alias("datetime"), _moment(p, "start_datetime").alias("start"), _moment(p, "end_datetime").alias("end"),
        *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))], p.alias("properties"), assets.alias("assets"),
    ]


def item_rows(docs: DataFrame) -> DataFrame:
    """Items of documents that are items or item collections."""
    single = docs.where("doc.type = 'Feature'").select(*_row(F.col("doc")))
    several = docs.where("doc.type = 'FeatureCollection'").select(F.explode("doc.features").alias("f")).select(*_row(F.col("f")))
    return single.unionByName(several)


def _meets(extent: Sequence[float] | None, temporal: Sequence[str | None] | None) -> Column:
    """Whether a catalog or collection may hold items of the request; without an extent of its own it may."""
    out = F.lit(True)
    if extent:
        w, s, e, n = extent
        box = F.get("doc.extent.spatial.bbox", F.lit(0))
        side = [F.get(box, F.lit(i)) for i in range(4)]
        out = out & F.coalesce((side[0] <= e) & (side[2] >= w) & (side[1] <= n) & (side[3] >= s), F.lit(True))
    if temporal:
        span = F.get("doc.extent.temporal.interval", F.lit(0))
        first, last = (F.to_timestamp_ntz(F.replace(F.replace(F.get(span, F.lit(i)), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))) for i in (0, 1))
        if temporal[0]:
            out = out & F.coalesce(last >= instant(temporal[0]), F.lit(True))
        if temporal[1]:
            out = out & F.coalesce(first < instant(temporal[1]), F.lit(True))
    return out


def walk(spark: SparkSession, root: str, extent: Sequence[float] | None = None, temporal: Sequence[str | None] | None = None, depth: int = 10) -> DataFrame:
    """All items of a static catalog, or of an item or item collection, that its catalogs' extents don't rule out."""
    level, found = [root], []
    for _ in range(depth):
        docs = documents(spark, level)
        found.append(item_rows(docs))
        inner = docs.where(F.col("doc.type").isin("Catalog", "Collection") & _meets(extent, temporal))
        links = inner.select("path", F.explode("doc.links").alias("l")).where(F.col("l.rel").isin("child", "item"))
        base = F.regexp_replace("path", "[^/]*$", "")
        href = F.when(F.col("l.href").rlike("^([a-z0-9]+:|/)"), F.col("l.href")).otherwise(F.concat(base, F.regexp_replace("l.href", r"^\./", "")))
        level = sorted(r.h for r in links.select(href.alias("h")).distinct().collect())  # paths of one level, which Spark lists to read
        if not level:
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def baseline_offset(value: Column, baseline: Column, since: float = 4.0, offset: float = -1000.0) -> Column:
    """Digital numbers of processing baselines from ``since`` on carry an offset, except 0, which is no data in all of them."""
    moved = F.when(F.coalesce(baseline.try_cast("double"), F.lit(0.0)) >= since, F.greatest(value + offset, F.lit(0.0))).otherwise(value)
    return F.when(value != 0, moved)


def load_stac(
    found: DataFrame, pixels: DataFrame, bands: Sequence[str | Band], grid: GridSpec, spatial_extent: Sequence[float] | None = None, temporal_extent: Sequence[str | None] | None = None,
    properties: dict | None = None, period: str | None = None, baseline: str | None = None,
) -> Cube:
    """A cube of the items' pixels: items filtered, the finest asset of each set of bands chosen, joined with its pixels.

    pixels: (href, band, y, x, value). Where items of one time overlap, the greatest id with data wins. period: dates are cut
    to it ("day"). Bands' scale and offset apply; baseline: the property that decides on the offset of newer products.
    """
    own = tuple(b if isinstance(b, Band) else Band(b) for b in bands)
    meta = CubeMeta(own, grid)
    names = [b.name for b in own]
    chosen = it.query(found, spatial_extent, temporal_extent, properties)
    when = F.coalesce("datetime", "start")
    when = F.date_trunc(period, when).cast("timestamp_ntz") if period else when
    kept = chosen.select("id", when.alias("t"), F.try_element_at("properties", F.lit(baseline or "")).alias("baseline"))
    assets = it.band_assets(chosen, names).select("id", F.col("asset.href").alias("href"), F.explode("asset.bands").alias("band")).where(F.col("band").isin(names))
    rows = assets.join(kept, "id").join(pixels, ["href", "band"])
    value = F.nanvl(F.col("value").cast("double"), F.lit(None))
    rows = rows.withColumn("value", baseline_offset(value, F.col("baseline")) if baseline else value).where("value IS NOT NULL")
    if spatial_extent:
        c0, c1, r0, r1 = grid.cells_in(*spatial_extent)
        rows = rows.where(F.col("x").between(c0, c1) & F.col("y").between(r0, r1))
    pick = lambda b: F.max_by(F.when(F.col("band") == b.name, F.col("value") * b.scale + b.offset), F.when(F.col("band") == b.name, F.col("id")))
    df = rows.groupBy("t", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(*[pick(b).alias(b.name) for b in own])
    return Cube(df, meta)


def from_url(spark: SparkSession, url: str, options: dict, bands: Sequence[str] | None, extent: Sequence[float] | None, temporal: Sequence[str | None] | None, properties: dict | None) -> Cube:
    """load_stac of a process graph: options name the pixel table, its format and the grid."""
    if "pixels" not in options or "grid" not in options:
        raise ProcessParameterInvalid("load_stac needs the options pixels and grid")
    found = walk(spark, url, extent, temporal)
    pixels = spark.read.format(options.get("format", "parquet")).load(options["pixels"])
    names = bands or sorted(r.band for r in pixels.select("band").distinct().collect())
    if not names:
        raise NoDataAvailable(url)
    return load_stac(found, pixels, names, GridSpec(**options["grid"]), extent, temporal, properties, options.get("period"), options.get("baseline"))
