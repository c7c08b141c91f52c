"""User functions over cubes and features, run in Arrow-fed pandas groups."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Band, FeatureUnsupported, ProcessParameterInvalid
from .operators.cube import Cube

RUNTIMES = {"Python": {"title": "Python with numpy and pandas", "type": "language", "default": "3"}}


def compile_code(code: str, names: tuple[str, ...]) -> tuple[str, Callable]:
    """(name, function): the first of ``names`` that the code defines. Syntax errors surface before any job starts."""
    scope: dict[str, Any] = {"np": np, "pd": pd}
    exec(compile(code, "<udf>", "exec"), scope)
    for name in names:
        if callable(scope.get(name)):
            return name, scope[name]
    raise ProcessParameterInvalid(f"the code defines none of {', '.join(names)}")


def in_executor() -> bool:
    return TaskContext.get() is not None


def summary(error: BaseException) -> str:
    """The last lines of a user function's error, as users need them."""
    lines = [x for x in str(error).splitlines() if x.strip()]
    own = [i for i, x in enumerate(lines) if '"<udf>"' in x]
    return "\n".join(lines[own[0] :][:8] if own else lines[-3:])


def dense(pdf: pd.DataFrame, bands: list[str], y0: int, x0: int, height: int, width: int) -> np.ndarray:
    """(t, bands, y, x) array of a tile's rows; absent cells are NaN."""
    times = np.sort(pdf["t"].unique()) if "t" in pdf else np.array([0])
    at = np.searchsorted(times, pdf["t"].to_numpy()) if "t" in pdf else np.zeros(len(pdf), int)
    out = np.full((len(times), len(bands), height, width), np.nan)
    for i, b in enumerate(bands):
        out[at, i, pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf[b].to_numpy(float)
    return out


def apply_tiles(cube: Cube, fn: Callable[..., np.ndarray] | str, tile: int | None = None, context: Any = None, per_date: bool = False, bands: list[str] | None = None) -> Cube:
    """Run fn(array, context) on the (t, bands, y, x) array of each tile; bands: names of the result's bands.

    With per_date a tile is one date. The result keeps rows and columns; it may change bands, and drop time by
    returning (bands, y, x). Cells that are NaN in all bands are absent from the result.
    """
    if isinstance(fn, str):
        code, known_names = fn, ("apply_datacube", "apply_array")
        compile_code(code, known_names)
        fn = lambda a, c: compile_code(code, known_names)[1](a, c)
    size = tile or cube.meta.grid.tile
    names, own, temporal = bands or cube.bands, cube.bands, cube.meta.temporal
    df = cube.df.withColumns({"_ty": F.floor(F.col("y") / size).cast("int"), "_tx": F.floor(F.col("x") / size).cast("int")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["_ty"].iloc[0]) * size, int(pdf["_tx"].iloc[0]) * size
        times = np.sort(pdf["t"].unique()) if temporal else [None]
        got = np.asarray(fn(dense(pdf, own, y0, x0, size, size), context), float)
        if got.ndim == 3:
            got, times = got[None], [None]
        if got.shape[1] != len(names) or got.shape[2:] != (size, size) or len(got) != len(times):
            raise ValueError(f"the function returned shape {got.shape}")
        t, y, x = np.nonzero(~np.isnan(got).all(axis=1))
        out = pd.DataFrame({"y": (y + y0).astype("int32"), "x": (x + x0).astype("int32")})
        if times[0] is not None or temporal:
            dates = [times[i] if times[i] is not None else pd.NaT for i in t]
            out.insert(0, "t", pd.Series(dates, dtype="datetime64[us]"))
        for i, b in enumerate(names):
            out[b] = got[t, i, y, x]
        return out

    keys = ["_ty", "_tx"] + (["t"] if per_date and temporal else [])
    schema = ", ".join([*(["t timestamp_ntz"] if temporal else []), "y int", "x int", *[f"`{b}` double" for b in names]])
    done = df.groupBy(*keys).applyInPandas(lambda pdf: run(pdf), schema)
    known = {b.name: b for b in cube.meta.bands}
    return Cube(done, replace(cube.meta, bands=tuple(known.get(b, Band(b)) for b in names)))


def apply_features(zonal: DataFrame, fn: Callable | str, context: Any = None) -> DataFrame:
    """(feature_index, result): run fn on each feature's frame of (t, columns); the result is JSON.

    Code may define udf_apply_feature_dataframe(frame[, context]) or udf_apply_udf_data(payload); scalars, series, frames,
    dicts and lists are accepted as results. Without dates each feature has one row.
    """
    if isinstance(fn, str):
        code, names = fn, ("udf_apply_feature_dataframe", "udf_apply_udf_data", "apply_vectorcube")
        kind, _ = compile_code(code, names)
        call = lambda frame: compile_code(code, names)[1](_payload(frame, context) if kind == "udf_apply_udf_data" else frame)
    else:
        call = fn

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        index = int(pdf["feature_index"].iloc[0])
        frame = pdf.drop(columns=["feature_index"])
        frame = frame.sort_values("t").set_index("t") if "t" in frame else frame.reset_index(drop=True)
        return pd.DataFrame({"feature_index": [index], "result": [_as_json(call(frame))]})

    return zonal.groupBy("feature_index").applyInPandas(lambda pdf: run(pdf), "feature_index int, result string")


def _payload(frame: pd.DataFrame, context: Any) -> dict:
    return {"structured_data_list": [{"type": "dict", "data": {str(t): list(r) for t, r in zip(frame.index, frame.to_numpy().tolist(), strict=True)}}], "user_context": context}


def _as_json(result: Any) -> str:
    if isinstance(result, pd.DataFrame):
        return result.to_json(orient="split", date_format="iso")
    if isinstance(result, pd.Series):
        return result.to_json(date_format="iso")
    if isinstance(result, np.ndarray):
        result = result.tolist()
    if isinstance(result, np.generic):
        result = result.item()
    return json.dumps(result, default=str)


def run_inline(code: str, data: Any, context: Any = None) -> Any:
    """A function over plain data from the request, outside any cube: run as a task, not on the driver."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    names = ("apply", "transform", "udf_apply_udf_data")
    compile_code(code, names)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"r": [json.dumps(compile_code(code, names)[1](json.loads(v), context)) for v in pdf["v"]]})

    got = spark.createDataFrame([(json.dumps(data),)], "v string").mapInPandas(run, "r string").first()
    return json.loads(got.r)


def apply_metadata(cube: Cube, fn: Callable[[dict], dict]) -> Cube:
    """Let a function rename bands in the metadata; it may not change their number or drop the dimension."""
    got = fn(cube.meta.to_dict())
    names = [b["name"] for b in got.get("bands", [])]
    if len(names) != len(cube.bands):
        raise FeatureUnsupported("the number of bands is decided by the data")
    return cube.rename_labels(dict(cube.meta.dims)["bands"], names)
