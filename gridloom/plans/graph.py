"""Process graphs: JSON in, cubes or tables out.

A flat graph is checked (references, cycles, known processes), user-defined processes are expanded as macros, and every
node is evaluated once, depth first. Nothing runs on the cluster until a result is written: each process only extends a
DataFrame plan, so filters anywhere in the graph reach the scans through the optimizer.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import geometry as geo
from ..functions.callback import as_graph
from ..model import FeatureUnsupported, ProcessParameterInvalid, ProcessUnsupported
from ..operators import spatial
from ..operators.cube import Cube
from ..sinks import files
from ..sources import items, stac, synthetic, tables  # noqa: F401  (synthetic registers itself)

Process = Callable[["Evaluator", dict], Any]
PROCESSES: dict[str, Process] = {}
#: Arguments that hold callbacks, which are compiled by their operator and not evaluated here.
CALLBACKS = ("process", "reducer", "overlap_resolver", "condition", "properties")


def process(name: str) -> Callable[[Process], Process]:
    """Add a process to the registry."""

    def add(fn: Process) -> Process:
        PROCESSES[name] = fn
        return fn

    return add


class Evaluator:
    def __init__(self, spark: SparkSession, graph: dict | str, parameters: dict | None = None, user_processes: dict[str, dict] | None = None):
        graph = json.loads(graph) if isinstance(graph, str) else copy.deepcopy(graph)
        self.spark, self.graph = spark, graph.get("process_graph", graph)
        self.parameters, self.user = parameters or {}, user_processes or {}
        self.done: dict[str, Any] = {}
        self.busy: list[str] = []
        self.saved: list[Any] = []
        self.validate()

    def validate(self) -> None:
        for name, node in self.graph.items():
            if node["process_id"] not in PROCESSES and node["process_id"] not in self.user:
                raise ProcessUnsupported(node["process_id"])
            for ref in _nodes(node.get("arguments", {})):
                if ref not in self.graph:
                    raise ProcessParameterInvalid(f"{name} refers to {ref}, which does not exist")

    def result(self) -> Any:
        """The result node's value; other ends of the graph, such as further sinks, are evaluated too."""
        used = {r for n in self.graph.values() for r in _nodes(n.get("arguments", {}))}
        marked = [k for k, n in self.graph.items() if n.get("result")]
        ends = [k for k in self.graph if k not in used]
        if not (marked or ends):
            raise ProcessParameterInvalid("the graph has no end: it is a cycle")
        for k in ends:
            self.node(k)
        return self.node((marked or ends)[0])

    def node(self, name: str) -> Any:
        if name in self.busy:
            raise ProcessParameterInvalid(f"cycle: {' -> '.join([*self.busy, name])}")
        if name not in self.done:
            self.busy.append(name)
            node = self.graph[name]
            args = {k: self._callback(v) if k in CALLBACKS and isinstance(v, dict) and "from_node" not in v and "from_parameter" not in v else self.value(v) for k, v in node.get("arguments", {}).items()}
            pid = node["process_id"]
            if pid in self.user:
                udp = self.user[pid]
                defaults = {p["name"]: p["default"] for p in udp.get("parameters", []) if "default" in p}
                sub = Evaluator(self.spark, udp["process_graph"], defaults | args, self.user)
                self.done[name] = sub.result()
            else:
                self.done[name] = PROCESSES[pid](self, args)
            self.busy.pop()
        return self.done[name]

    def _callback(self, v: dict) -> dict:
        """Outer parameters inside callbacks become constants."""
        inner = {"x", "y", "data", "value", "context", "label", "index"}

        def fill(a: Any) -> Any:
            if isinstance(a, dict):
                p = a.get("from_parameter")
                if p is not None and p not in inner and p in self.parameters:
                    return self.parameters[p]
                return {k: fill(x) for k, x in a.items()}
            return [fill(x) for x in a] if isinstance(a, list) else a

        return fill(v)

    def value(self, arg: Any) -> Any:
        if isinstance(arg, dict):
            if "from_node" in arg:
                return self.node(arg["from_node"])
            if "from_parameter" in arg:
                if arg["from_parameter"] not in self.parameters:
                    raise ProcessParameterInvalid(f"no value for parameter {arg['from_parameter']}")
                return self.parameters[arg["from_parameter"]]
            return {k: self.value(v) for k, v in arg.items()}
        return [self.value(v) for v in arg] if isinstance(arg, list) else arg


def _nodes(arguments: Any) -> list[str]:
    if isinstance(arguments, dict):
        if set(arguments) == {"from_node"}:
            return [arguments["from_node"]]
        return [r for k, v in arguments.items() if k != "process_graph" for r in _nodes(v)]
    return [r for v in arguments for r in _nodes(v)] if isinstance(arguments, list) else []


def evaluate(spark: SparkSession, graph: dict | str, parameters: dict | None = None, user_processes: dict[str, dict] | None = None) -> Any:
    return Evaluator(spark, graph, parameters, user_processes).result()


def _features(e: Evaluator, source: Any) -> DataFrame:
    return source if isinstance(source, DataFrame) else geo.features(e.spark, source)


def _reducer(v: Any) -> str | dict:
    """A callback of one reducer over the data is that reducer by name."""
    graph = as_graph(v)
    if len(graph) == 1:
        node = next(iter(graph.values()))
        if node.get("arguments") == {"data": {"from_parameter": "data"}}:
            return node["process_id"]
    return graph


def _udf(callback: Any) -> dict | None:
    """The arguments of a callback that is one run_udf node."""
    graph = as_graph(callback) if isinstance(callback, dict) else {}
    nodes = [n for n in graph.values() if isinstance(n, dict) and n.get("process_id") == "run_udf"]
    if not nodes:
        return None
    if len(graph) > 1:
        raise FeatureUnsupported("a user function among other processes in a callback")
    return nodes[0]["arguments"]


def _forest(callback: Any, context: Any) -> Any | None:
    """The model of a callback that is one predict_random_forest node over the data: given there, or as the context."""
    graph = as_graph(callback) if isinstance(callback, dict) else {}
    nodes = [n for n in graph.values() if isinstance(n, dict) and n.get("process_id") == "predict_random_forest"]
    if not nodes:
        return None
    if len(graph) > 1:
        raise FeatureUnsupported("a model among other processes in a callback")
    model = nodes[0]["arguments"].get("model")
    return context if model == {"from_parameter": "context"} else model


def _tiles(cube: Cube, a: dict, udf_args: dict, **options: Any) -> Cube:
    from .. import udf

    context = udf_args.get("context")
    context = a.get("context") if context is None or context == {"from_parameter": "context"} else context
    return udf.apply_tiles(cube, udf_args["udf"], context=context, **options)


@process("load_collection")
def _load(e, a):
    extent = tuple(a["temporal_extent"]) if a.get("temporal_extent") else None
    return tables.load_collection(e.spark, a["id"], a.get("spatial_extent"), extent, a.get("bands"), a.get("properties"), options=a.get("featureflags"))


@process("load_result")
def _load_result(e, a):
    return tables.load_result(e.spark, a["id"], a.get("spatial_extent"), a.get("temporal_extent"), a.get("bands"))


@process("load_geojson")
def _load_geojson(e, a):
    return geo.features(e.spark, a["data"])


@process("load_url")
def _load_url(e, a):
    return tables.load_features(e.spark, a["url"], {"GeoJSON": "geojson", "Parquet": "parquet"}.get(a["format"], a["format"].lower()))


@process("load_stac")
def _load_stac(e, a):
    extent = a.get("spatial_extent")
    box = [extent[k] for k in ("west", "south", "east", "north")] if extent else None
    return stac.from_url(e.spark, a["url"], a.get("featureflags") or {}, a.get("bands"), box, a.get("temporal_extent"), a.get("properties"))


@process("query_stac")
def _query_stac(e, a):
    extent = a.get("spatial_extent")
    box = [extent[k] for k in ("west", "south", "east", "north")] if extent else None
    found = items.read_catalog(e.spark, a["url"]) if a["url"].endswith(".jsonl") else stac.walk(e.spark, a["url"], box, a.get("temporal_extent"))
    return items.query_json(items.query(found, box, a.get("temporal_extent"), a.get("properties")))


@process("filter_temporal")
def _filter_temporal(e, a):
    return a["data"].filter_temporal(*a["extent"])


@process("filter_bbox")
def _filter_bbox(e, a):
    x = a["extent"]
    return a["data"].filter_bbox(x["west"], x["south"], x["east"], x["north"], x.get("crs"))


@process("filter_bands")
def _filter_bands(e, a):
    return a["data"].filter_bands(a["bands"])


@process("filter_spatial")
def _filter_spatial(e, a):
    return spatial.filter_spatial(a["data"], _features(e, a["geometries"]))


@process("filter_labels")
def _filter_labels(e, a):
    return a["data"].filter_labels(a["condition"], a["dimension"])


@process("rename_labels")
def _rename_labels(e, a):
    return a["data"].rename_labels(a["dimension"], a["target"], a.get("source"))


@process("rename_dimension")
def _rename_dimension(e, a):
    return a["data"].rename_dimension(a["source"], a["target"])


@process("add_dimension")
def _add_dimension(e, a):
    return a["data"].add_dimension(a["name"], a["label"], a.get("type", "other"))


@process("drop_dimension")
def _drop_dimension(e, a):
    return a["data"].drop_dimension(a["name"])


@process("dimension_labels")
def _dimension_labels(e, a):
    return a["data"].dimension_labels(a["dimension"])


@process("apply")
def _apply(e, a):
    if own := _udf(a["process"]):
        return _tiles(a["data"], a, own, per_date=True)
    return a["data"].apply(a["process"], a.get("context"))


@process("apply_dimension")
def _apply_dimension(e, a):
    if own := _udf(a["process"]):
        return _tiles(a["data"], a, own)
    return a["data"].apply_dimension(a["dimension"], a["process"], a.get("target_dimension"), a.get("context"))


@process("reduce_dimension")
def _reduce_dimension(e, a):
    if own := _udf(a["reducer"]):
        return _reduced(_tiles(a["data"], a, own), a["data"].meta.kind_of(a["dimension"]))
    if (model := _forest(a["reducer"], a.get("context"))) is not None:
        from .. import ml

        if a["data"].meta.kind_of(a["dimension"]) != "bands":
            raise FeatureUnsupported("a model reads bands")
        return ml.predict_class(a["data"], model, "value", by_position=True)
    return a["data"].reduce_dimension(a["dimension"], a["reducer"], a.get("context"))


def _reduced(cube: Cube, kind: str) -> Cube:
    """A function that reduced time leaves rows without dates."""
    return cube.drop_dimension("t") if kind == "t" and cube.meta.temporal else cube


def _pixels(size: list[dict], dimension: str) -> int:
    found = [d for d in size if d["dimension"] == dimension]
    if any(d.get("unit", "px") != "px" for d in found):
        raise ProcessParameterInvalid("sizes of neighbourhoods are in pixels")
    return int(found[0]["value"]) if found else 0


@process("apply_neighborhood")
def _apply_neighborhood(e, a):
    size, overlap = a["size"], a.get("overlap") or []
    side, margin = _pixels(size, "x"), _pixels(overlap, "x")
    times = [d["value"] for d in size if d["dimension"] == "t"]
    own = _udf(a["process"])
    if own:
        if side < 4:
            raise ProcessParameterInvalid("tiles of fewer than 4 cells")
        return _tiles(a["data"], a, own, tile=side, per_date=times == ["P1D"])
    if side <= 1 and times and times != ["P1D"]:
        period = {"day": "day", "week": "week", "month": "month", "season": "season", "year": "year", "dekad": "dekad"}.get(times[0])
        if period is None:
            raise ProcessParameterInvalid(f"period {times[0]}")
        return a["data"].apply_period(period, a["process"])
    return spatial.apply_neighborhood(a["data"], a["process"], side, margin)


@process("apply_polygon")
def _apply_polygon(e, a):
    own = _udf(a["process"])
    if not own:
        raise FeatureUnsupported("apply_polygon runs functions only")
    from .. import udf

    code = own["udf"]
    run = lambda pdf: udf.compile_code(code, ("apply_polygon", "apply_frame", "transform"))[1](pdf)
    return spatial.apply_polygon(a["data"], _features(e, a.get("geometries", a.get("chunks"))), run, a.get("mask_value"))


PROCESSES["chunk_polygon"] = lambda e, a: _apply_polygon(e, a | {"process": a.get("process", a.get("reducer"))})


@process("aggregate_temporal")
def _aggregate_temporal(e, a):
    flat = a["intervals"]
    pairs = flat if isinstance(flat[0], list) else [flat[i : i + 2] for i in range(0, len(flat), 2)]
    return a["data"].aggregate_temporal(pairs, _reducer(a["reducer"]), a.get("labels"))


@process("aggregate_temporal_period")
def _aggregate_temporal_period(e, a):
    return a["data"].aggregate_temporal_period(a["period"], _reducer(a["reducer"]))


@process("aggregate_spatial")
def _aggregate_spatial(e, a):
    return spatial.aggregate_spatial(a["data"], _features(e, a["geometries"]), _reducer(a["reducer"]), a.get("target_dimension"))


@process("merge_cubes")
def _merge_cubes(e, a):
    return a["cube1"].merge_cubes(a["cube2"], a.get("overlap_resolver"))


@process("mask")
def _mask(e, a):
    return a["data"].mask(a["mask"], a.get("replacement"))


@process("mask_polygon")
def _mask_polygon(e, a):
    return spatial.mask_polygon(a["data"], _features(e, a["mask"]), a.get("replacement"), a.get("inside", False))


@process("apply_kernel")
def _apply_kernel(e, a):
    return spatial.apply_kernel(a["data"], a["kernel"], a.get("factor", 1.0), a.get("border", 0), a.get("replace_invalid", 0))


@process("to_scl_dilation_mask")
def _scl(e, a):
    return spatial.scl_dilation_mask(a["data"], a.get("erosion_kernel_size", 0), a.get("mask1_values", [2, 4, 5, 6, 7]), a.get("mask2_values", [3, 8, 9, 10, 11]), a.get("kernel1_size", 17), a.get("kernel2_size", 77))


@process("resample_spatial")
def _resample_spatial(e, a):
    return spatial.resample_spatial(a["data"], a.get("resolution", 0), a.get("projection"), a.get("method", "near"))


@process("resample_cube_spatial")
def _resample_cube_spatial(e, a):
    return spatial.resample_cube_spatial(a["data"], a["target"], a.get("method", "near"))


@process("ndvi")
def _ndvi(e, a):
    return a["data"].ndvi(a.get("nir"), a.get("red"), a.get("target_band"))


@process("linear_scale_range")
def _linear_scale_range(e, a):
    return a["x"].linear_scale_range(a["inputMin"], a["inputMax"], a.get("outputMin", 0), a.get("outputMax", 1))


@process("convert_data_type")
def _convert(e, a):
    return a["data"].convert_data_type(a["data_type"])


@process("slope")
def _slope(e, a):
    return spatial.slope(a["data"])


@process("aspect")
def _aspect(e, a):
    return spatial.aspect(a["data"])


@process("raster_to_vector")
def _raster_to_vector(e, a):
    return spatial.raster_to_vector(a["data"])


@process("vector_to_raster")
def _vector_to_raster(e, a):
    return spatial.vector_to_raster(a["data"], a["target"], a.get("columns") or [c for c in a["data"].columns if c not in ("feature_index", "feature_id", "rings", "point", "props")])


@process("sar_backscatter")
def _sar(e, a):
    return a["data"].sar_backscatter()


for _name in ("atmospheric_correction", "resolution_merge", "corsa_compress", "corsa_decompress", "run_cwl"):
    process(_name)(lambda e, a, n=_name: a["data"].unsupported(n))


@process("inspect")
def _inspect(e, a):
    data = a["data"]
    return data.inspect(a.get("message", "")) if isinstance(data, Cube) else data


@process("fit_class_random_forest")
def _fit(e, a):
    from .. import ml

    return ml.fit_class_random_forest(a["predictors"], a["target"], a["features"], a["label"], num_trees=a.get("num_trees", 100), seed=a.get("seed"))


@process("predict_class")
def _predict(e, a):
    from .. import ml

    return ml.predict_class(a["data"], a["model"])


@process("load_ml_model")
def _load_model(e, a):
    from .. import ml

    return ml.load_model(a["id"])


@process("run_udf")
def _run_udf(e, a):
    from .. import udf

    if isinstance(a["data"], Cube):
        return udf.apply_tiles(a["data"], a["udf"], context=a.get("context"))
    if isinstance(a["data"], DataFrame):
        return udf.apply_features(a["data"], a["udf"], a.get("context"))
    return udf.run_inline(a["udf"], a["data"], a.get("context"))


@process("save_result")
def _save(e, a):
    """With a path option the result is written; the data is passed on either way, so sinks can stand inside a graph."""
    options = a.get("options", {})
    if path := options.get("path"):
        data = a["data"]
        e.saved.append(files.save_result(data, path, a["format"], options.get("partition")) if isinstance(data, Cube) else files.save_features(data, path, a["format"]))
    return a["data"]


@process("export_workspace")
def _export(e, a):
    """Write a cube to a workspace folder and pass it on."""
    data = a["data"]
    e.saved.append(files.save_result(data, a["workspace"]) if isinstance(data, Cube) else files.save_features(data, a["workspace"]))
    return data


@process("discard_result")
def _discard(e, a):
    return a["data"]
