"""Operators on small cubes against values worked out by hand or with numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import model as m
from gridloom import udf
from gridloom.functions import geometry as geo
from gridloom.operators import spatial as sp
from gridloom.operators.cube import Cube
from gridloom.plans import graph as pg
from gridloom.sinks import files
from gridloom.sources import items, synthetic, tables

DATA, X = {"from_parameter": "data"}, {"from_parameter": "x"}


def grid(n):
    return m.GridSpec("index", 0, n, 1, 1, n, n, 4)


def cube(spark, rows, bands, n=5, temporal=True):
    schema = ("t timestamp_ntz, " if temporal else "") + "y int, x int, " + ", ".join(f"{b} double" for b in bands)
    return Cube(spark.createDataFrame(rows, schema), m.CubeMeta(tuple(m.Band(b) for b in bands), grid(n), temporal))


def day(text):
    import datetime

    return datetime.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def three_dates(spark):
    """Ones and twos with holes: cell (0, 0) has one valid date, others three."""
    rows = []
    for y in range(5):
        for x in range(5):
            values = {(0, 0): [None, 2.0, None], (2, 2): [1.0, None, 1.0]}.get((y, x), [1.0, 2.0, 1.0])
            rows += [(day(t), y, x, v) for t, v in zip(("2016-08-24T09:00", "2017-08-24T09:00", "2017-10-17T09:00"), values, strict=True)]
    return cube(spark, rows, ["b"])


def at(c, **where):
    df = c.df if isinstance(c, Cube) else c
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.collect()


@pytest.mark.parametrize("name, lone, full", [("max", 2, 2), ("min", 2, 1), ("sum", 2, 4), ("mean", 2, 4 / 3), ("variance", None, 1 / 3), ("sd", None, 0.5773503), ("count", 1, 3), ("first", 2, 1), ("last", 2, 1), ("median", 2, 1), ("product", 2, 2)])
def test_reducers_skip_no_data(three_dates, name, lone, full):
    got = three_dates.reduce_dimension("t", name)
    for (y, x), want in {(0, 0): lone, (0, 1): full}.items():
        value = at(got, y=y, x=x)[0].b
        assert value is None if want is None else value == pytest.approx(want, rel=1e-6)


def test_variance_is_of_a_sample(spark):
    c = cube(spark, [(day("2020-01-01"), 0, 0, 1.0), (day("2020-01-02"), 0, 0, 5.0)], ["b"])
    assert at(c.reduce_dimension("t", "variance"))[0].b == 8.0


def test_reduce_over_space_is_refused(three_dates):
    with pytest.raises(m.FeatureUnsupported):
        three_dates.reduce_dimension("x", "max")
    with pytest.raises(m.DimensionNotAvailable):
        three_dates.reduce_dimension("depth", "max")


def test_plus_kernel(spark):
    rows = [(day("2020-01-01"), y, x, 2.0) for y in range(5) for x in range(5)]
    got = sp.apply_kernel(cube(spark, rows, ["b"]), [[0, 1, 0], [1, 1, 1], [0, 1, 0]], 2.0)
    assert [at(got, y=y, x=x)[0].b for y, x in ((0, 0), (0, 1), (1, 1))] == [12, 16, 20]
    with pytest.raises(m.FeatureUnsupported):
        sp.apply_kernel(cube(spark, rows, ["b"]), [[1]], border=1)


def test_kernel_against_numpy(spark):
    rng = np.random.default_rng(3)
    a, k = rng.normal(size=(9, 9)), rng.normal(size=(3, 5))
    c = cube(spark, [(y, x, float(a[y, x])) for y in range(9) for x in range(9)], ["b"], 9, temporal=False)
    pad = np.pad(a, ((1, 1), (2, 2)))
    want = sum(k[r, s] * pad[r : r + 9, s : s + 9] for r in range(3) for s in range(5))
    got = {(r.y, r.x): r.b for r in sp.apply_kernel(c, k.tolist()).df.collect()}
    assert all(got[y, x] == pytest.approx(want[y, x]) for y in range(9) for x in range(9))


def test_aspect_of_ramps(spark):
    rows = [(y, x, float(y), float(x)) for y in range(10) for x in range(10)]
    c = cube(spark, rows, ["rows", "cols"], 10, temporal=False)
    got = at(sp.aspect(c), y=4, x=4)[0]
    assert (got.rows_aspect, got.cols_aspect) == pytest.approx((math.pi / 2, math.pi))
    assert at(sp.slope(c), y=4, x=4)[0].rows_slope == pytest.approx(math.pi / 4)


def test_zonal_statistics_band_major(spark):
    rows = [(day("2020-01-01"), y, x, 1.0, 2.0) for y in range(4) for x in range(4)]
    c = cube(spark, rows, ["red", "nir"], 4)
    g = {k: {"process_id": k, "arguments": {"data": DATA}} for k in ("sum", "count", "max")}
    g["all"] = {"process_id": "array_create", "arguments": {"data": [{"from_node": k} for k in ("sum", "count", "max")]}, "result": True}
    feats = geo.features(spark, ["POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((9 9, 10 9, 10 10, 9 9))"])
    got = {r.feature_index: tuple(r)[2:] for r in sp.aggregate_spatial(c, feats, g).collect()}
    assert got == {0: (16, 16, 1, 32, 16, 2), 1: (None, 0, None, None, 0, None)}


def test_mean_over_box_of_synthetic_collection(spark):
    c = synthetic.load(spark, (0, 0, 6, 4), "2021-01-01", "2021-01-11", ["Longitude", "Latitude"], tile=4)
    feats = geo.features(spark, ["POLYGON((3.1 1.2, 4.9 1.2, 4.9 2.8, 3.1 2.8, 3.1 1.2))"])
    row = sp.aggregate_spatial(c, feats, "mean").first()
    assert (row.Longitude, row.Latitude) == (3.875, 1.875)
    low, n = (sp.aggregate_spatial(c, feats, r).first() for r in ("min", "count"))
    assert (low.Longitude, low.Latitude, n.Longitude) == (3.0, 1.25, 48)


def test_merge_and_mask_contracts(spark, three_dates):
    with pytest.raises(m.OverlapResolverMissing):
        three_dates.merge_cubes(three_dates)
    flat = three_dates.reduce_dimension("t", "max")
    with pytest.raises(m.DimensionMismatch):
        flat.mask(three_dates)
    doubled = three_dates.merge_cubes(three_dates, "sum")
    assert sorted(r.b for r in at(doubled, y=1, x=1)) == [2.0, 2.0, 4.0]
    less = three_dates.merge_cubes(flat, "subtract")  # operands keep their order
    assert sorted(r.b for r in at(less, y=1, x=1)) == [-1.0, -1.0, 0.0]
    assert {r.b for r in at(three_dates.mask(flat.apply({"g": {"process_id": "gt", "arguments": {"x": X, "y": 1.5}, "result": True}}), 10), y=1, x=1)} == {10.0}


def test_labels_and_bands(spark, three_dates):
    two = three_dates.merge_cubes(three_dates.rename_labels("bands", ["c"]))
    assert two.bands == ["b", "c"]
    assert two.filter_bands(["c", "b"]).bands == ["c", "b"]
    with pytest.raises(m.BandNotFound):
        two.filter_bands(["z"])
    with pytest.raises(m.DimensionLabelCountMismatch):
        two.rename_labels("bands", ["one"])
    with pytest.raises(m.DimensionLabelCountMismatch):
        two.drop_dimension("bands")
    with pytest.raises(m.DimensionExists):
        two.add_dimension("t", "2020-01-01", "temporal")
    with pytest.raises(m.NirBandAmbiguous):
        two.ndvi()
    assert two.filter_temporal("2017-01-01", "2017-10-17").df.select("t").distinct().count() == 1
    assert three_dates.filter_temporal("2017-10-17T09:00:00", "2017-10-17T09:00:00").df.count() == 25


def test_interpolation_fills_between(spark):
    rows = [(day(f"2020-01-0{d}"), 0, 0, v) for d, v in ((1, 1.0), (2, None), (4, 4.0), (5, None))]
    got = cube(spark, rows, ["b"]).apply_dimension("t", {"i": {"process_id": "array_interpolate_linear", "arguments": {"data": DATA}, "result": True}})
    assert [r.b for r in got.df.orderBy("t").collect()] == [1.0, 2.0, 4.0, None]


def test_scaling_types(spark):
    c = cube(spark, [(0, 0, 0.5, None)], ["a", "b"], temporal=False)
    got = c.linear_scale_range(0, 1, 0, 250)
    assert got.meta.cell_type == "uint8" and tuple(got.df.first())[2:] == (125, None)
    assert c.linear_scale_range(0, 1, 0, 60000).meta.cell_type == "uint16"
    with pytest.raises(m.ProcessParameterInvalid):
        c.convert_data_type("complex")


@pytest.mark.parametrize("method", ["near", "bilinear", "cubic", "cubicspline", "lanczos", "average", "mode", "max", "min", "med", "no-such"])
def test_resample_keeps_a_constant(spark, method):
    rows = [(y, x, 3.0) for y in range(8) for x in range(8)]
    got = sp.resample_spatial(cube(spark, rows, ["b"], 8, temporal=False), 2.0, method=method)
    assert got.meta.grid.width == 4 and {round(r.b, 9) for r in got.df.collect()} == {3.0} and got.df.count() == 16


def test_reprojection_round_trip(spark):
    lon, lat = F.col("lon"), F.col("lat")
    df = spark.createDataFrame([(3.0, 51.0), (5.9, -33.5), (2.0, 0.1)], "lon double, lat double")
    for epsg in ("EPSG:32631", "EPSG:3857"):
        x, y = geo.transform(lon, lat, "EPSG:4326", epsg)
        df2 = df.select("lon", "lat", x.alias("x"), y.alias("y"))
        a, b = geo.transform(F.col("x"), F.col("y"), epsg, "EPSG:4326")
        for r in df2.select("lon", "lat", a.alias("a"), b.alias("b"), "x", "y").collect():
            assert (r.a, r.b) == pytest.approx((r.lon, r.lat), abs=1e-8)
    x, y = geo.to_utm(F.lit(3.0), F.lit(51.0), 32631)  # on the central meridian
    assert spark.range(1).select(x).first()[0] == pytest.approx(500000)


def test_zones_and_rings(spark):
    a = np.array([[1, 1, 0, 0], [1, 0, 0, 1], [0, 0, 1, 1], [1, 0, 1, 1]], float)
    c = cube(spark, [(y, x, float(a[y, x])) for y in range(4) for x in range(4)], ["b"], 4, temporal=False)
    got = {r.zone: r for r in sp.raster_to_vector(c).collect()}
    assert {(r.value, r.n_cells) for r in got.values()} == {(1.0, 3), (0.0, 7), (1.0, 5), (1.0, 1)}
    ring = files.chain_rings([tuple(e) for e in got[12].edges])
    assert len(ring) == 1 and ring[0][0] == ring[0][-1] and len(ring[0]) == 5


def test_process_graph_with_macro_and_errors(spark, sf):
    double = {"process_graph": {"a": {"process_id": "apply", "arguments": {"data": {"from_parameter": "data"}, "process": {"process_graph": {"m": {"process_id": "multiply", "arguments": {"x": X, "y": {"from_parameter": "by"}}, "result": True}}}}, "result": True}}, "parameters": [{"name": "data"}, {"name": "by", "default": 3}]}
    graph = {
        "l": {"process_id": "load_collection", "arguments": {"id": "testing", "featureflags": {"extent": [0, 0, 2, 2], "start": "2021-01-01", "end": "2021-02-01", "bands": ["Flat:2"]}}},
        "d": {"process_id": "double", "arguments": {"data": {"from_node": "l"}}},
        "r": {"process_id": "reduce_dimension", "arguments": {"data": {"from_node": "d"}, "dimension": "t", "reducer": {"process_graph": {"s": {"process_id": "sum", "arguments": {"data": DATA}, "result": True}}}}, "result": True},
    }
    got = pg.evaluate(spark, graph, user_processes={"double": double})
    assert {r[2] for r in got.df.collect()} == {18.0} and got.df.count() == 64
    with pytest.raises(m.ProcessUnsupported):
        pg.evaluate(spark, {"a": {"process_id": "no_such", "arguments": {}}})
    loop = {"a": {"process_id": "slope", "arguments": {"data": {"from_node": "b"}}}, "b": {"process_id": "slope", "arguments": {"data": {"from_node": "a"}}}}
    with pytest.raises(m.ProcessParameterInvalid):
        pg.evaluate(spark, loop)
    with pytest.raises(m.CollectionNotFound):
        tables.load_collection(spark, "nowhere")


def test_user_functions_in_graphs(spark):
    load = {"process_id": "load_collection", "arguments": {"id": "testing", "featureflags": {"extent": [0, 0, 2, 2], "start": "2021-01-01", "end": "2021-02-01", "bands": ["Day"]}}}

    def run(pid, **arguments):
        return pg.evaluate(spark, {"l": load, "r": {"process_id": pid, "arguments": {"data": {"from_node": "l"}} | arguments, "result": True}}).df

    code = lambda text: {"process_graph": {"u": {"process_id": "run_udf", "arguments": {"data": X, "udf": text, "runtime": "Python", "context": {"k": 3}}, "result": True}}}
    assert {r.Day for r in run("apply", process=code("def apply_datacube(a, c):\n    return a * c['k']")).collect()} == {15.0, 45.0, 75.0}
    assert {r.Day for r in run("reduce_dimension", dimension="t", reducer=code("def apply_datacube(a, c):\n    return a.max(axis=0)")).collect()} == {25.0}
    size = [{"dimension": "x", "value": 4, "unit": "px"}, {"dimension": "y", "value": 4, "unit": "px"}]
    assert run("apply_neighborhood", size=size, process=code("def apply_datacube(a, c):\n    return a + 1")).count() == 192
    with pytest.raises(m.ProcessParameterInvalid):
        run("apply_neighborhood", size=[{"dimension": "x", "value": 2, "unit": "px"}], process=code("def apply_datacube(a, c):\n    return a"))
    box = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}
    got = run("chunk_polygon", chunks=box, mask_value=-1, reducer=code("def transform(df):\n    return df.assign(Day=df['Day'] * 0)")).groupBy("Day").count().collect()
    assert {r.Day: r["count"] for r in got} == {0.0: 48, -1.0: 144}
    window = run("apply_neighborhood", size=[{"dimension": "x", "value": 1}, {"dimension": "t", "value": "month"}], process={"process_graph": {"s": {"process_id": "sum", "arguments": {"data": DATA}, "result": True}}})
    assert {r.Day for r in window.collect()} == {45.0}
    some = {"process_graph": {"c": {"process_id": "count", "arguments": {"data": DATA, "condition": {"process_graph": {"g": {"process_id": "gt", "arguments": {"x": X, "y": 10}, "result": True}}}}, "result": True}}}
    assert {r.Day for r in run("reduce_dimension", dimension="t", reducer=some).collect()} == {2.0}


@pytest.mark.parametrize("process", ["atmospheric_correction", "resolution_merge", "corsa_compress", "corsa_decompress"])
def test_sensor_processes_are_refused(three_dates, process):
    with pytest.raises(m.FeatureUnsupported):
        three_dates.unsupported(process)


def test_size_guard():
    big = m.CubeMeta((m.Band("b"),), m.GridSpec(width=400_000, height=400_000))
    with pytest.raises(m.ExtentTooLarge):
        big.guard(1)
    with pytest.raises(m.ExtentTooLarge):
        m.CubeMeta((m.Band("b"),), m.GridSpec(width=30_000, height=10)).guard(1, synchronous=True)


def test_save_and_load(spark, three_dates, tmp_path):
    files.save_result(three_dates, str(tmp_path / "a"))
    back = tables.load_result(spark, str(tmp_path / "a"), temporal_extent=("2017-01-01", None))
    assert back.df.count() == 50 and back.bands == ["b"]
    files.export_result(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    files.export_result(spark, str(tmp_path / "a"), str(tmp_path / "b"), merge=True)
    assert tables.load_result(spark, str(tmp_path / "b")).df.count() == 150
    files.save_result(three_dates, str(tmp_path / "t"), partition="tile")
    out = files.save_result(three_dates, str(tmp_path / "j"), "json")
    assert out["format"] == "json"
    import json

    images = [json.loads(r.data) for r in files.as_json(three_dates).orderBy("t").collect()]
    assert images[0][0][0][:2] == [None, 1.0] and len(images[0][0]) == 5
    with pytest.raises(m.FormatUnsupported):
        files.save_result(three_dates, str(tmp_path / "g"), "gtiff")
    cells = sp.cells_of(geo.features(spark, ["POINT(0.5 0.5)"]), three_dates.meta.grid)
    files.save_result(three_dates, str(tmp_path / "f"), "csv", "feature", cells)
    assert files.save_result(three_dates, "", "debug")["metadata"]["bands"][0]["name"] == "b"


def test_tile_function_with_margin(spark):
    rows = [(y, x, float(y * 8 + x)) for y in range(8) for x in range(8)]
    c = cube(spark, rows, ["b"], 8, temporal=False)

    def rolled(pdf):
        lookup = {(y, x): b for y, x, b in pdf[["y", "x", "b"]].itertuples(index=False)}
        return pdf.assign(b=[lookup.get((y, x + 1), -1.0) for y, x in zip(pdf.y, pdf.x, strict=True)])

    got = {(r.y, r.x): r.b for r in sp.apply_neighborhood(c, rolled, 4, 1).df.collect()}
    assert len(got) == 64 and got[0, 3] == 4.0 and got[0, 7] == -1.0
    with pytest.raises(m.ProcessParameterInvalid):
        sp.apply_neighborhood(c, rolled, 2)


def test_udf_surface(spark, three_dates):
    code = "def apply_datacube(cube, context):\n    return np.nanmax(cube, axis=0) * context['k']"
    got = udf.apply_tiles(three_dates, code, tile=4, context={"k": 2}, bands=["m"])
    assert {r.m for r in got.df.collect()} <= {2.0, 4.0}
    assert udf.run_inline("def transform(data, context):\n    return [x + 1 for x in data]", [1, 2]) == [2, 3]
    with pytest.raises(m.ProcessParameterInvalid):
        udf.compile_code("a = 1", ("apply",))
    with pytest.raises(SyntaxError):
        udf.compile_code("def (", ("apply",))


ITEMS = [
    ("a", "2020-01-01 00:00:00", 0.0, {"platform": "s1", "cover": "10", "v": "1"}), ("b", "2020-01-01 00:00:20", 0.0, {"platform": "s1", "cover": "30", "v": "2"}),
    ("c", "2020-01-01 00:00:40", 0.0, {"platform": "s1", "cover": None, "v": "1"}), ("d", "2020-01-01 00:00:00", 9.0, {"platform": "s1"}), ("e", "2020-01-02 00:00:00", 0.0, {"platform": "s2", "cover": "5"}),
]


@pytest.fixture(scope="module")
def scenes(spark):
    rows = [(i, t, None, None, w, 0.0, w + 1, 1.0, p) for i, t, w, p in ITEMS]
    df = spark.createDataFrame(rows, "id string, dt string, start timestamp_ntz, end timestamp_ntz, west double, south double, east double, north double, properties map<string,string>")
    return df.withColumn("datetime", F.to_timestamp_ntz("dt")).drop("dt")


def cond(op, value):
    return {"c": {"process_id": op, "arguments": {"x": {"from_parameter": "value"}, "y": value}, "result": True}}


@pytest.mark.parametrize("wanted, ids", [({"platform": "s1"}, "abcd"), ({"platform": "s?"}, "abcde"), ({"cover": cond("lte", 10)}, "ae"), ({"cover": cond("gte", 10)}, "ab"), ({"cover": cond("eq", None)}, "c"), ({"x": "y"}, ""), ({"platform": {"c": {"process_id": "array_contains", "arguments": {"data": ["s2", "s3"], "value": {"from_parameter": "value"}}}}}, "e")])
def test_property_filters(scenes, wanted, ids):
    assert "".join(sorted(r.id for r in scenes.where(items.property_filter(wanted)).collect())) == ids


def test_property_filter_rendering():
    wanted = {"platform": "s*", "cover": cond("lte", 20)}
    assert items.cql2_text(wanted) == "\"properties.platform\" like 's%' and \"properties.cover\" <= 20"
    assert items.cql2_json({"cover": cond("lte", 20)}) == {"op": "<=", "args": [{"property": "properties.cover"}, 20]}
    assert items.adapted({"a": 1, "b": 2, "c": 3}, {"a": None, "b": "z", "c": {"values": {3: 4}}}) == {"z": 2, "c": 4}
    with pytest.raises(m.ProcessParameterInvalid):
        items.conditions({"a": cond("neq", 3)})


def test_dedup_groups_are_stars(scenes):
    # b matches its seed a, c is too far from a and matches only b: it stays, as do other boxes
    got = items.deduplicate(scenes, ["platform"], 30, preference={"v": [2, 1]})
    assert sorted(r.id for r in got.collect()) == ["b", "c", "d", "e"]


def test_scene_extents(scenes):
    assert scenes.where(items.spatial_filter(8, 0, 12, 1)).count() == 1
    assert scenes.where(items.spatial_filter(175, 0, 1, 1)).count() == 4  # across the antimeridian
    assert scenes.where(items.temporal_filter("2020-01-02", "2020-01-02")).count() == 1


def test_forest(spark, tmp_path):
    from gridloom import ml

    rows = [(i, float(i % 10), float(i % 7), i % 10 // 5) for i in range(200)]
    df = spark.createDataFrame(rows, "feature_index int, a double, b double, label int")
    model = ml.fit_class_random_forest(df, df, ["a", "b"], "label", num_trees=5, seed=1)
    c = cube(spark, [(0, 0, 1.0, 1.0), (0, 1, 8.0, 2.0), (1, 1, None, 2.0)], ["a", "b"], temporal=False)
    ml.save_model(model, str(tmp_path / "m"))
    got = {(r.y, r.x): r.prediction for r in ml.predict_class(c, ml.load_model(str(tmp_path / "m"))).df.collect()}
    assert got == {(0, 0): 0.0, (0, 1): 1.0, (1, 1): None}
    with pytest.raises(m.FeatureUnsupported):
        ml.fit_class_catboost()
    with pytest.raises(m.ProcessParameterInvalid):
        ml.fit_class_random_forest(df, df, ["z"], "label")


def test_stream_equals_batch(spark, sf, tmp_path):
    from gridloom.streaming import periods

    src = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(src))
    stream = periods.aggregate_period(periods.read_rows(spark, str(src), events.schema), "ts", ["event_type"], "value")
    got = periods.run_available(stream, "by_day", str(tmp_path / "cp"))
    want = periods.aggregate_period(events, "ts", ["event_type"], "value")
    key = lambda df: sorted((str(r.t), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(got) == key(want)


def test_binning_super_sampling(spark):
    g = m.GridSpec("index", 0, 4, 1, 1, 4, 4)
    pts = spark.createDataFrame([(0.5, 3.5, 1.0), (0.6, 3.4, 3.0), (2.0, 2.0, float("nan"))], "lon double, lat double, v double")
    got = {(r.y, r.x): r.v for r in sp.bin_to_grid(pts, g, ["v"]).collect()}
    assert got[0, 0] == 2.0 and got[2, 2] is None
    assert sp.bin_to_grid(pts, g, ["v"], super_sampling=2).count() >= 3
    assert [g.snap(1.4, mode=k) for k in ("down", "round", "up")] == [1, 1, 2]
