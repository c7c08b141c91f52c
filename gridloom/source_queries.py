"""Registered queries of sources, sinks, scenes, functions and errors, each with its SQL."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ml, udf
from . import model as m
from .catalog_queries import CELLS, DATA, EV, LI, PA, POLYGONS, SC, X, _callback, _each, _node, _polygons, _ref, query
from .functions import geometry as geo
from .model import Band, GridSpec
from .operators import spatial as sp
from .operators.cube import Cube
from .plans import graph as pg
from .plans import scratch
from .sinks import files
from .sources import adapters as src
from .sources import items, stac, tables


def _folder(spark: SparkSession, label: str) -> str:
    return f"{scratch.root(spark)}/{label}-{uuid.uuid4().hex}"


def _text(spark: SparkSession, path: str, *documents: dict) -> str:
    """Documents as files of one line each."""
    spark.createDataFrame([(json.dumps(d),) for d in documents], "value string").repartition(len(documents)).write.text(path)
    return path


# --- loading and saving


@query("load_pixel_formats", f"WITH {PA}, f(format) AS (VALUES ('parquet'), ('csv'), ('json'), ('orc')) SELECT format, y, x, round(retail, 6) AS retail FROM pa CROSS JOIN f")
def _(spark, sf):
    """One pixel table in each format, read by its own reader."""
    root, df = _folder(spark, "formats"), src.parts(spark, sf).df.select("y", "x", "retail")
    out = None
    for name in ("parquet", "csv", "json", "orc"):
        df.write.option("header", True).format(name).save(f"{root}/{name}")
        got = tables.load_pixels(spark, f"{root}/{name}", ["retail"], src.GRID, name).df.select(F.lit(name).alias("format"), "y", "x", "retail")
        out = got if out is None else out.unionByName(got)
    return out


@query("load_scaled_bands", f"WITH {PA} SELECT y, x, round(retail * 0.01::DOUBLE - 5, 6) AS retail, CASE WHEN psize <> 25 THEN round(psize, 6) END AS psize FROM pa")
def _(spark, sf):
    df = src.parts(spark, sf).df
    return tables.from_pixels(df, [Band("retail", scale=0.01, offset=-5.0), "psize"], src.GRID, no_data=25.0)


@query("postprocessing_bands", f"WITH {LI} SELECT t, y, x, round(qty * (1 - disc), 6) AS net FROM li WHERE t < '1997-01-01'")
def _(spark, sf):
    net = lambda c: c.select({"net": F.col("qty") * (1 - F.col("disc"))})
    return tables.load_collection(spark, "sales", None, ("1992-01-01", "1997-01-01"), ["net"], postprocessing=net, sf_dir=sf)


@query("first_available", f"WITH {LI} SELECT t, y, x, {_each('{b}')} FROM li")
def _(spark, sf):
    """The events lack the expected months, so the second collection serves."""
    expected = src.sales(spark, sf).df.select("t").distinct()
    return tables.first_available(spark, ["activity", "sales"], expected, sf_dir=sf)


@query("save_load_result", f"WITH {LI} SELECT t, y, x, round(qty, 6) AS qty, round(tax, 6) AS tax FROM li WHERE t >= '1996-01-01' AND x >= 4")
def _(spark, sf):
    root = _folder(spark, "result")
    files.save_result(src.sales(spark, sf), root, partition="t")
    return tables.load_result(spark, root, {"west": 4, "south": 0, "east": 16, "north": 16}, ("1996-01-01", None), ["qty", "tax"])


@query("save_json_arrays", f"WITH {PA}, g AS (SELECT y::INT AS y, x::INT AS x FROM range(16) a(y), range(16) b(x)) SELECT band, y, x, round(CASE band WHEN 0 THEN retail ELSE psize END, 6) AS value FROM g LEFT JOIN pa USING (y, x), (VALUES (0), (1)) v(band)")
def _(spark, sf):
    """The nested arrays bands x rows x columns, taken apart again."""
    data = files.as_json(src.parts(spark, sf)).select(F.from_json("data", "array<array<array<double>>>").alias("a"))
    rows = data.select(F.posexplode("a").alias("band", "rows")).select("band", F.posexplode("rows").alias("y", "row"))
    return rows.select("band", "y", F.posexplode("row").alias("x", "value"))


@query("save_cropped", f"WITH {LI} SELECT t, y, x, {_each('{b}')} FROM li WHERE y <= 5 AND x <= 9")
def _(spark, sf):
    cube = src.sales(spark, sf)
    return files.cropped(replace(cube, meta=replace(cube.meta, grid=replace(cube.meta.grid, width=10, height=6))))


@query("save_debug_metadata", "SELECT unnest(['qty', 'price', 'disc', 'tax']) AS band, unnest([0, 1, 2, 3])::INT AS place, 16 AS width")
def _(spark, sf):
    meta = files.save_result(src.sales(spark, sf), "", "debug")["metadata"]
    return spark.createDataFrame([(b["name"], i, meta["grid"]["size"][0]) for i, b in enumerate(meta["bands"])], "band string, place int, width int")


@query("several_results", f"WITH {LI} SELECT y, x, 'max' AS sink, {_each('max({b})')} FROM li GROUP BY y, x UNION ALL SELECT y, x, 'min' AS sink, {_each('min({b})')} FROM li GROUP BY y, x")
def _(spark, sf):
    """A graph with two sinks and a discarded end."""
    root = _folder(spark, "sinks")
    node = lambda pid, **a: {"process_id": pid, "arguments": a}
    reduce = lambda name: node("reduce_dimension", data={"from_node": "load"}, dimension="t", reducer={"process_graph": _callback(_node(name, data=DATA))})
    graph = {
        "load": node("load_collection", id="sales", featureflags={"sf_dir": sf}), "max": reduce("max"), "min": reduce("min"),
        "one": node("save_result", data={"from_node": "max"}, format="Parquet", options={"path": f"{root}/max"}),
        "two": node("export_workspace", data={"from_node": "min"}, workspace=f"{root}/min"),
        "end": node("discard_result", data={"from_node": "one"}) | {"result": True},
    }
    pg.evaluate(spark, graph)
    read = lambda n: tables.load_result(spark, f"{root}/{n}").df.withColumn("sink", F.lit(n))
    return read("max").unionByName(read("min"))


@query("export_merged", f"WITH {LI} SELECT t, y, x, round(qty, 6) AS qty FROM li")
def _(spark, sf):
    """A workspace that gets one half of a cube, and then the other."""
    root, cube = _folder(spark, "workspace"), src.sales(spark, sf).filter_bands(["qty"])
    for i, half in enumerate((cube.filter_temporal(None, "1995-06-01"), cube.filter_temporal("1995-06-01", None))):
        files.save_result(half, f"{root}/part{i}")
        files.export_result(spark, f"{root}/part{i}", f"{root}/all", merge=i > 0)
    return tables.load_result(spark, f"{root}/all")


# --- vectors


def _collection() -> dict:
    shapes = [geo.parse_wkt(w) for w in POLYGONS]
    kinds = [{"type": "Point", "coordinates": list(r[0][0])} if point else {"type": "Polygon", "coordinates": [[*map(list, ring)] for ring in r]} for r, point in shapes]
    return {"type": "FeatureCollection", "features": [{"type": "Feature", "id": f"f{i}", "properties": {"rank": i}, "geometry": g} for i, g in enumerate(kinds)]}


@query("load_geojson", f"WITH {LI}, {CELLS} SELECT t, y, x, round(qty, 6) AS qty FROM li SEMI JOIN inside USING (y, x)")
def _(spark, sf):
    """Features given in the request."""
    node = lambda pid, **a: {"process_id": pid, "arguments": a}
    graph = {
        "load": node("load_collection", id="sales", bands=["qty"], featureflags={"sf_dir": sf}), "where": node("load_geojson", data=_collection()),
        "cut": node("filter_spatial", data={"from_node": "load"}, geometries={"from_node": "where"}) | {"result": True},
    }
    return pg.evaluate(spark, graph)


@query("load_url_geojson", f"WITH {CELLS} SELECT feature_index, 'f' || feature_index AS feature_id, feature_index::VARCHAR AS rank, y, x FROM inside")
def _(spark, sf):
    """A feature collection in a file, read and parsed by columns."""
    feats = tables.load_features(spark, _text(spark, _folder(spark, "features"), _collection()))
    names = feats.select("feature_index", "feature_id", F.element_at("props", "rank").alias("rank"))
    return sp.cells_of(feats, src.GRID).join(names, "feature_index")


@query("save_geojson", f"WITH {CELLS} SELECT feature_index, feature_index::VARCHAR AS size, y, x FROM inside")
def _(spark, sf):
    """Features written one to a line and read again; a column became a property."""
    path = _folder(spark, "geojson")
    files.save_features(_polygons(spark).withColumn("size", F.col("feature_index")).coalesce(1), path, "geojson")
    feats = tables.load_features(spark, path)
    return sp.cells_of(feats, src.GRID).join(feats.select("feature_index", F.element_at("props", "size").alias("size")), "feature_index")


@query("drop_empty_zonal", f"WITH {LI}, {CELLS} SELECT feature_index, t, round(sum(qty), 6) AS qty FROM inside JOIN li USING (y, x) GROUP BY ALL")
def _(spark, sf):
    zonal = sp.aggregate_spatial(src.sales(spark, sf).filter_bands(["qty"]), _polygons(spark), "sum")
    return sp.drop_empty(zonal, ["qty"])


@query("aggregate_spatial_condition", f"WITH {LI}, {CELLS}, d AS (SELECT DISTINCT t FROM li), f AS (SELECT unnest(range({len(POLYGONS)}))::INT AS feature_index) SELECT f.feature_index, d.t, coalesce(n, 0)::DOUBLE AS qty FROM f CROSS JOIN d LEFT JOIN (SELECT feature_index, t, count(*) AS n FROM inside JOIN li USING (y, x) WHERE qty > 26 GROUP BY ALL) USING (feature_index, t)")
def _(spark, sf):
    graph = _callback(_node("count", data=DATA, condition=_callback(_node("gt", x=X, y=26))))
    zonal = sp.aggregate_spatial(src.sales(spark, sf).filter_bands(["qty"]), _polygons(spark), graph)
    return zonal.withColumn("qty", F.coalesce("qty", F.lit(0.0)))


# --- scenes


def _assets(names: tuple[tuple[str, str, float], ...]) -> Column:
    """Assets (name, band, resolution) with the item's id in their addresses."""
    one = lambda n, b, gsd: F.struct(F.lit(n).alias("name"), F.concat_ws("/", F.lit(n), "id").alias("href"), F.lit("image/tiff; application=geotiff").alias("type"), F.array(F.lit("data")).alias("roles"), F.array(F.lit(b)).alias("bands"), F.lit(gsd).alias("gsd"))
    return F.array(*[one(*x) for x in names])


@query("asset_selection", f"WITH {SC} SELECT id, 'fine/' || id AS href FROM sc UNION ALL SELECT id, 'other/' || id AS href FROM sc")
def _(spark, sf):
    """Of two assets with one band the finer; an overview that is no raster asset goes."""
    scenes = src.scenes(spark, sf).withColumn("assets", _assets((("coarse", "qty", 60.0), ("fine", "qty", 10.0), ("other", "tax", 20.0))))
    preview = F.struct(F.lit("preview").alias("name"), F.lit("p").alias("href"), F.lit("image/png").alias("type"), F.lit(None).cast("array<string>").alias("roles"), F.array(F.lit("qty")).alias("bands"), F.lit(None).cast("double").alias("gsd"))
    scenes = scenes.withColumn("assets", F.concat("assets", F.array(preview)))
    return items.band_assets(scenes, ["qty", "tax"]).select("id", F.col("asset.href").alias("href"))


def _line_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """The order lines as pixels of their order's assets."""
    li = src.table(spark, sf, "lineitem").where("l_linenumber <= 3")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.concat_ws("/", F.lit(n), F.col("l_orderkey")).alias("href"), F.col(c).cast("double").alias("value")) for n, b, c in (("fine", "qty", "l_quantity"), ("coarse", "qty", "l_tax"), ("other", "tax", "l_tax"))]))
    rows = li.select((F.col("l_orderkey") % 16).cast("int").alias("y"), F.col("l_linenumber").alias("x"), each.alias("e")).select("y", "x", "e.*")
    return rows.groupBy("href", "band", "y", "x").agg(F.max("value").alias("value"))


@query("load_stac", f"""WITH {SC}, l AS (SELECT sc.id, date_trunc('month', datetime)::TIMESTAMP AS t, (l_orderkey % 16)::INT AS y, l_linenumber AS x, max(l_quantity) AS qty, max(l_tax) AS tax
  FROM sc JOIN lineitem ON l_orderkey = id::BIGINT WHERE l_linenumber <= 3 AND status = 'F' AND west <= 150 AND west + 0.5 >= -150 AND south <= 60 AND south + 0.5 >= -60 AND datetime >= '1993-01-01' AND datetime < '1997-01-01' GROUP BY ALL)
SELECT t, y, x, round(arg_max(qty, id), 6) AS qty, round(arg_max(tax * 100 - 1, id), 6) AS tax FROM l WHERE y BETWEEN 0 AND 15 GROUP BY t, y, x""")
def _(spark, sf):
    """Items filtered by extent, time and property, the finer asset of a band chosen, pixels joined and overlaid."""
    scenes = src.scenes(spark, sf).withColumn("assets", _assets((("coarse", "qty", 60.0), ("fine", "qty", 10.0), ("other", "tax", 20.0))))
    found = items.query(scenes, (-150, -60, 150, 60))
    bands = ["qty", Band("tax", scale=100.0, offset=-1.0)]
    return stac.load_stac(found, _line_pixels(spark, sf), bands, src.GRID, temporal_extent=("1993-01-01", "1997-01-01"), properties={"status": "F"}, period="month")


@query("load_stac_baseline_offset", f"""WITH {SC}, p AS (SELECT l_orderkey, l_linenumber AS x, max(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)
SELECT date_trunc('day', datetime)::TIMESTAMP AS t, (l_orderkey % 16)::INT AS y, x, arg_max(CASE WHEN left(priority, 1)::INT >= 4 THEN greatest(q - 1000, 0) ELSE q END, id) AS qty
FROM sc JOIN p ON l_orderkey = id::BIGINT WHERE q <> 0 GROUP BY 1, 2, 3""")
def _(spark, sf):
    """Newer processing baselines carry an offset, which is taken off before anything else."""
    scenes = src.scenes(spark, sf).withColumn("assets", _assets((("fine", "qty", 10.0),)))
    base = F.map_concat("properties", F.create_map(F.lit("baseline"), F.substring(F.element_at("properties", "priority"), 1, 1)))
    return stac.load_stac(scenes.withColumn("properties", base), _line_pixels(spark, sf), ["qty"], src.GRID, period="day", baseline="baseline")


def _item(i: int, west: float, when: str) -> dict:
    return {
        "type": "Feature", "id": f"i{i}", "bbox": [west, 0, west + 1, 1], "properties": {"datetime": when, "cloud": i * 10}, "geometry": None,
        "assets": {"b": {"href": f"b/{i}", "type": "image/tiff", "roles": ["data"], "eo:bands": [{"name": "b"}]}},
    }


@query("stac_object_kinds", "SELECT * FROM (VALUES ('i0', 0.0::DOUBLE, '0', 'b/0'), ('i1', 3.0::DOUBLE, '10', 'b/1'), ('i2', 4.0::DOUBLE, '20', 'b/2'), ('i5', 5.0::DOUBLE, '50', 'b/5')) v(id, west, cloud, href)")
def _(spark, sf):
    """A static catalog with an item, an item collection, and collections of which one lies outside the request."""
    root = _folder(spark, "catalog")

    def collection(box, *links):
        return {"type": "Collection", "id": "c", "extent": {"spatial": {"bbox": [box]}, "temporal": {"interval": [["2020-01-01T00:00:00Z", None]]}}, "links": [{"rel": "item", "href": h} for h in links]}

    put = lambda name, doc: _text(spark, f"{root}/{name}", doc)
    put("single", _item(0, 0.0, "2020-01-01T10:00:00Z"))
    put("many", {"type": "FeatureCollection", "features": [_item(1, 3.0, "2020-02-01T00:00:00Z"), _item(2, 4.0, "2020-03-01T00:00:00Z")]})
    put("inner-item", _item(5, 5.0, "2020-04-01T00:00:00Z"))
    put("far-item", _item(6, 100.0, "2020-04-01T00:00:00Z"))
    put("inner", collection([4, 0, 9, 9], f"{root}/inner-item"))
    put("far", collection([90, 0, 120, 9], f"{root}/far-item", f"{root}/missing"))
    links = [("item", "single"), ("item", "many"), ("child", "inner"), ("child", "far"), ("self", "top")]
    put("top", {"type": "Catalog", "id": "top", "links": [{"rel": r, "href": f"{root}/{n}"} for r, n in links]})
    found = stac.walk(spark, f"{root}/top", (0, 0, 10, 10))
    return found.select("id", "west", F.element_at("properties", "cloud").alias("cloud"), F.col("assets")[0]["href"].alias("href"))


@query("dedup_items_tolerance", f"""WITH {SC}, s AS (SELECT id, datetime, status, price, row_number() OVER (PARTITION BY status ORDER BY datetime, id) - 1 AS k FROM sc),
p AS (SELECT id, status, (k // 3) * 100 + CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE 40 END AS sec, k % 3 AS r, k // 3 AS g FROM s)
SELECT id FROM p WHERE r = 2 UNION ALL SELECT max(id) AS id FROM p WHERE r < 2 GROUP BY status, g""")
def _(spark, sf):
    """Triples 20 seconds apart: the second matches its seed, the third matches only the second and stays."""
    from pyspark.sql import Window as W

    scenes = src.scenes(spark, sf)
    k = F.row_number().over(W.partitionBy(F.element_at("properties", "status")).orderBy("datetime", "id")) - 1
    seconds = F.floor(k / 3) * 100 + (k % 3) * 20
    scenes = scenes.withColumns({
        "datetime": F.timestamp_seconds(seconds.cast("long")).cast("timestamp_ntz"), "west": F.lit(0.0) + (k % 3) * 1e-4, "south": F.lit(0.0), "east": F.lit(1.0), "north": F.lit(1.0),
        "properties": F.map_filter("properties", lambda n, v: n == "status"),
    })
    return items.deduplicate(scenes, ["status"], seconds=30).select("id")


@query("adapted_properties", f"WITH {SC} SELECT id FROM sc WHERE status = 'O' AND priority = '1-URGENT'")
def _(spark, sf):
    """Conditions of one catalog's vocabulary asked of another's."""
    wanted = items.adapted({"state": "open", "rank": "1-URGENT", "unknown": 5}, {"state": {"name": "status", "values": {"open": "O"}}, "rank": "priority", "unknown": None})
    return src.scenes(spark, sf).where(items.property_filter(wanted)).select("id")


@query("cql2_text", f"WITH {SC} SELECT id FROM sc WHERE status = 'F' AND price <= 90000 AND priority LIKE '1%'")
def _(spark, sf):
    """The rendered text is a predicate; here over columns of the properties' names."""
    wanted = {"status": "F", "price": _callback(_node("lte", x={"from_parameter": "value"}, y=90000)), "priority": "1*"}
    text = items.cql2_text(wanted)
    scenes = src.scenes(spark, sf)
    for name in wanted:
        text = text.replace(f'"properties.{name}"', f"cast(properties['{name}'] as {'double' if name == 'price' else 'string'})")
    return scenes.where(text).select("id")


@query("cql2_json", f"WITH {SC} SELECT id FROM sc WHERE status IN ('F', 'P') AND price >= 90000")
def _(spark, sf):
    wanted = {"status": _callback(_node("array_contains", data=["F", "P"], value={"from_parameter": "value"})), "price": _callback(_node("gte", x={"from_parameter": "value"}, y=90000))}
    tree = items.cql2_json(wanted)
    prop = lambda a: F.element_at("properties", a["property"].removeprefix("properties."))
    test = {"in": lambda c, v: c.isin(v), ">=": lambda c, v: c.cast("double") >= v}
    out = src.scenes(spark, sf)
    for part in tree["args"]:
        out = out.where(test[part["op"]](prop(part["args"][0]), part["args"][1]))
    return out.select("id")


# --- callbacks and time


for _period, _sql in {"hour": "date_trunc('hour', t)", "decade": "make_timestamp((year(t) // 10 * 10)::BIGINT, 1, 1, 0, 0, 0.0)", "tropical-season": "date_trunc('month', t - to_months(((month(t) + 1) % 6)::INT))"}.items():

    @query(f"aggregate_temporal_period_{_period.replace('-', '_')}", f"WITH {LI} SELECT {_sql}::TIMESTAMP AS t, y, x, {_each('max({b})')} FROM li GROUP BY 1, 2, 3")
    def _(spark, sf, period=_period):
        return src.sales(spark, sf).aggregate_temporal_period(period, "max")


@query("reduce_bands_count_condition", f"WITH {EV} SELECT t, y, x, ({' + '.join(f'coalesce(({e} > 50)::INT, 0)' for e in src.EVENTS)})::DOUBLE AS value FROM ev")
def _(spark, sf):
    return src.activity(spark, sf).reduce_dimension("bands", _callback(_node("count", data=DATA, condition=_callback(_node("gt", x=X, y=50)))))


@query("reduce_bands_append", f"WITH {LI} SELECT t, y, x, round(qty + price + disc + tax + 7, 6) AS value FROM li")
def _(spark, sf):
    return src.sales(spark, sf).reduce_dimension("bands", _callback(_node("array_append", data=DATA, value=7), _node("sum", data=_ref(0))))


@query("reduce_bands_labels", f"WITH {LI} SELECT t, y, x, 1.0::DOUBLE AS value FROM li")
def _(spark, sf):
    """Whether a band of a name is there, from the array's labels."""
    return src.sales(spark, sf).reduce_dimension("bands", _callback(_node("array_labels", data=DATA), _node("array_contains", data=_ref(0), value="disc")))


@query("user_defined_process", f"WITH {LI} SELECT t, y, x, round(price * 3 + 1, 6) AS price FROM li")
def _(spark, sf):
    """A process of the user's own, with a default that the call overrides and one that it leaves."""
    node = lambda pid, **a: {"process_id": pid, "arguments": a}
    scaled = _callback(_node("multiply", x=X, y={"from_parameter": "factor"}), _node("add", x=_ref(0), y={"from_parameter": "shift"}))
    own = {
        "parameters": [{"name": "cube"}, {"name": "factor", "default": 2}, {"name": "shift", "default": 1}],
        "process_graph": {"a": node("apply", data={"from_parameter": "cube"}, process={"process_graph": scaled}) | {"result": True}},
    }
    graph = {"load": node("load_collection", id="sales", bands=["price"], featureflags={"sf_dir": sf}), "own": node("scaled", cube={"from_node": "load"}, factor=3) | {"result": True}}
    return pg.evaluate(spark, graph, user_processes={"scaled": own})


@query("inspect", f"WITH {LI} SELECT t, y, x, round(qty, 6) AS qty FROM li")
def _(spark, sf):
    return src.sales(spark, sf).filter_bands(["qty"]).inspect("sales", rows=1)


@query("udf_metadata", f"WITH {LI} SELECT t, y, x, round(qty, 6) AS a, round(price, 6) AS b, round(disc, 6) AS disc, round(tax, 6) AS tax FROM li")
def _(spark, sf):
    """A function that renames bands in the metadata."""
    names = {"qty": "a", "price": "b"}
    return udf.apply_metadata(src.sales(spark, sf), lambda meta: meta | {"bands": [b | {"name": names.get(b["name"], b["name"])} for b in meta["bands"]]})


_PHI = {"cubic": lambda d: f"(CASE WHEN {d} <= 1 THEN 1.5::DOUBLE * {d} * {d} * {d} - 2.5::DOUBLE * {d} * {d} + 1 WHEN {d} < 2 THEN -0.5::DOUBLE * {d} * {d} * {d} + 2.5::DOUBLE * {d} * {d} - 4 * {d} + 2 ELSE 0 END)",
        "cubicspline": lambda d: f"(CASE WHEN {d} <= 1 THEN 2 / 3.0::DOUBLE - {d} * {d} + {d} * {d} * {d} / 2 WHEN {d} < 2 THEN (2 - {d}) * (2 - {d}) * (2 - {d}) / 6 ELSE 0 END)",
        "lanczos": lambda d: f"(CASE WHEN {d} < 1e-9 THEN 1 WHEN {d} < 3 THEN 3 * sin(pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d} * pi() * {d}) ELSE 0 END)"}
for _method, _phi in _PHI.items():
    _reach = 3 if _method == "lanczos" else 2

    @query(f"resample_{_method}", f"""WITH {PA}, c AS (SELECT y::INT AS ty, x::INT AS tx, (y + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS v, (x + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS u FROM range(32) a(y), range(32) b(x)),
d AS (SELECT ty, tx, retail, abs(v - pa.y) AS dy, abs(u - pa.x) AS dx FROM c JOIN pa ON abs(v - pa.y) <= {_reach} AND abs(u - pa.x) <= {_reach}),
n AS (SELECT ty, tx, retail, {_phi('dy')} * {_phi('dx')} AS w FROM d)
SELECT ty AS y, tx AS x, round(sum(retail * w) / sum(w), 6) AS retail FROM n WHERE w <> 0 GROUP BY ty, tx""")
    def _(spark, sf, method=_method):
        return sp.resample_spatial(src.parts(spark, sf).filter_bands(["retail"]), 0.5, method=method)


# --- models


def _training(spark: SparkSession, sf: str) -> DataFrame:
    """Parts labelled by their size's last digit: one split of one predictor decides."""
    p = src.table(spark, sf, "part").select(F.col("p_partkey").alias("feature_index"), (F.col("p_size") % 10).cast("double").alias("digit"), F.lit(1.0).alias("constant"))
    return p.withColumn("label", (F.col("digit") >= 5).cast("int"))


@query("fit_random_forest", "SELECT p_partkey AS feature_index, (p_size % 10 >= 5)::INT AS predicted FROM part")
def _(spark, sf):
    rows = _training(spark, sf)
    model = ml.fit_class_random_forest(rows, rows, ["digit", "constant"], "label", num_trees=1, seed=42)
    return model.transform(rows).select("feature_index", F.col("prediction").cast("int").alias("predicted"))


def _digits(spark: SparkSession, sf: str) -> Cube:
    return src.parts(spark, sf).select({"digit": F.floor("psize") % 10, "constant": F.lit(1.0)})


@query("save_load_predict", f"WITH {PA} SELECT y, x, (floor(psize) % 10 >= 5)::INT::DOUBLE AS prediction FROM pa")
def _(spark, sf):
    rows, path = _training(spark, sf), _folder(spark, "model")
    ml.save_model(ml.fit_class_random_forest(rows, rows, ["digit", "constant"], "label", num_trees=1, seed=42), path)
    return ml.predict_class(_digits(spark, sf), ml.load_model(path))


@query("reduce_bands_predict_random_forest", f"WITH {PA} SELECT y, x, (floor(psize) % 10 >= 5)::INT::DOUBLE AS value FROM pa")
def _(spark, sf):
    """The model as a reducer's context; the reducer's data are the bands by place."""
    rows = _training(spark, sf)
    model = ml.fit_class_random_forest(rows, rows, ["digit", "constant"], "label", num_trees=1, seed=42)
    cube = _digits(spark, sf).rename_labels("bands", ["first", "second"])
    reducer = _callback(_node("predict_random_forest", data=DATA, model={"from_parameter": "context"}))
    graph = {"r": {"process_id": "reduce_dimension", "arguments": {"data": {"from_parameter": "cube"}, "dimension": "bands", "reducer": {"process_graph": reducer}, "context": {"from_parameter": "model"}}, "result": True}}
    return pg.evaluate(spark, graph, {"cube": cube, "model": model})


# --- geometry and errors


@query("geometry_helpers", """SELECT c_custkey, round(CASE WHEN c_acctbal = 0 THEN 0 ELSE round(c_acctbal / pow(10.0::DOUBLE, floor(log10(abs(c_acctbal)))), 0) * pow(10.0::DOUBLE, floor(log10(abs(c_acctbal)))) END, 6) AS significant,
  round(radians((c_custkey % 360 - 180)::DOUBLE) * 6378137.0::DOUBLE, 6) AS east FROM customer WHERE c_acctbal <> 0 AND abs(c_acctbal / pow(10.0::DOUBLE, floor(log10(abs(c_acctbal)))) % 1) NOT BETWEEN 0.4999 AND 0.5001""")
def _(spark, sf):
    """Rounding on a logarithmic scale and mercator coordinates."""
    c = src.table(spark, sf, "customer").where("c_acctbal <> 0 AND abs(c_acctbal / pow(10, floor(log10(abs(c_acctbal)))) % 1) NOT BETWEEN 0.4999 AND 0.5001")
    east, _north = geo.to_mercator((F.col("c_custkey") % 360 - 180).cast("double"), F.lit(10.0))
    return c.select("c_custkey", sp.log_round(F.col("c_acctbal")).alias("significant"), east.alias("east"))


@query("reprojection_round_trip", "SELECT c_custkey, round(9 + (c_custkey % 50) / 10.0::DOUBLE, 6) AS lon, round(40 + (c_custkey % 70) / 10.0::DOUBLE, 6) AS lat FROM customer")
def _(spark, sf):
    """Degrees to UTM zone 32 to mercator and back."""
    c = src.table(spark, sf, "customer")
    x, y = 9 + F.col("c_custkey") % 50 / 10, 40 + F.col("c_custkey") % 70 / 10
    for a, b in (("EPSG:4326", "EPSG:32632"), ("EPSG:32632", "EPSG:3857"), ("EPSG:3857", "EPSG:4326")):
        x, y = geo.transform(x, y, a, b)
    return c.select("c_custkey", x.alias("lon"), y.alias("lat"))


@query("buffer_and_snap", "SELECT 0 AS feature_index, y::INT AS y, x::INT AS x FROM range(4, 7) a(y), range(7, 10) b(x)")
def _(spark, sf):
    """A square of a cell and a half around a point, as cells; the grid lines next to it are those of the grid."""
    grid = GridSpec("EPSG:4326", 0.0, 16.0, 1.0, 1.0, 16, 16)
    shape = geo.buffered_point(8.5, 10.5, 1.4 * 111_319.49)
    (w, s), (e, n) = shape["coordinates"][0][0], shape["coordinates"][0][2]
    snapped = (grid.snap(w, "x", "up"), grid.snap(s, "y", "up"), grid.snap(e, "x", "down"), grid.snap(n, "y", "down"))
    box = geo.simplified([(snapped[0], snapped[1], snapped[2], snapped[3]), (8.0, 10.0, 9.0, 11.0)])
    wide = f"POLYGON(({box[0] - 1} {box[1] - 1}, {box[2] + 1} {box[1] - 1}, {box[2] + 1} {box[3] + 1}, {box[0] - 1} {box[3] + 1}, {box[0] - 1} {box[1] - 1}))"
    both = geo.features(spark, [wide])
    inside = sp.cells_of(both, grid)
    own = sp.cells_of(geo.features(spark, {"type": "Feature", "geometry": shape}), grid)
    return inside.join(own, ["feature_index", "y", "x"], "left_semi")


def _code(run) -> str | None:
    try:
        run()
    except m.CubeError as e:
        return e.code
    return None


ERRORS = {
    "unknown process": "ProcessUnsupported", "unknown band": "BandNotFound", "space reducer": "FeatureUnsupported", "unknown collection": "CollectionNotFound", "huge extent": "ExtentTooLarge",
    "no extent": "MissingSpatialFilter", "unknown format": "FormatUnsupported", "no resolver": "OverlapResolverMissing", "labels": "DimensionLabelCountMismatch", "no dates": "NoDataAvailable",
    "condition": "ProcessParameterInvalid", "sensor": "FeatureUnsupported",
}


@tables.register("world", bounded=False)
def _world(spark: SparkSession, **options) -> Cube:
    """A fine grid of the whole world without pixels, for guards."""
    meta = m.CubeMeta((Band("b"),), GridSpec("EPSG:4326", -180.0, 90.0, 1e-4, 1e-4, 3_600_000, 1_800_000))
    return Cube(spark.createDataFrame([], "t timestamp_ntz, y int, x int, b double"), meta)


@query("error_codes", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ERRORS.items()) + ") v(condition, code)")
def _(spark, sf):
    """The names of errors that clients see."""
    cube = src.sales(spark, sf)
    world = {"west": -180, "south": -90, "east": 180, "north": 90}
    cases = {
        "unknown process": lambda: pg.evaluate(spark, {"a": {"process_id": "nothing", "arguments": {}, "result": True}}),
        "unknown band": lambda: cube.filter_bands(["nothing"]),
        "space reducer": lambda: cube.reduce_dimension("x", "mean"),
        "unknown collection": lambda: tables.load_collection(spark, "nothing"),
        "huge extent": lambda: tables.load_collection(spark, "world", world, ("2020-01-01", "2021-01-01")),
        "no extent": lambda: tables.load_collection(spark, "world"),
        "unknown format": lambda: files.save_result(cube, "", "gif"),
        "no resolver": lambda: cube.merge_cubes(cube),
        "labels": lambda: cube.aggregate_temporal([["2020-01-01", "2020-02-01"]], "mean", ["a", "b"]),
        "no dates": lambda: tables.load_collection(spark, "testing", options={"extent": (0, 0, 1, 1), "start": "2020-01-06", "end": "2020-01-07"}),
        "condition": lambda: items.conditions({"a": _callback(_node("neq", x={"from_parameter": "value"}, y=1))}),
        "sensor": lambda: cube.unsupported("atmospheric_correction"),
    }
    return spark.createDataFrame([(k, _code(run)) for k, run in cases.items()], "condition string, code string")
