"""Callback graphs compiled to Spark columns.

A callback is a flat graph of named processes over a pixel's values. While it is compiled a value is a scalar
``Column``, an ``Arr`` of columns (the bands of a pixel, unrolled) or a ``Series``: one column seen along time. Reducers
turn an Arr into an expression of its columns and a Series into an aggregate, or into a window aggregate where the
callback keeps the time dimension. No-data is NULL: reducers skip it, arithmetic passes it on, x / 0 is NULL.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import BandNotFound, ProcessParameterInvalid, ProcessUnsupported, ReducerUnsupported


@dataclass(frozen=True)
class Arr:
    items: tuple[Column, ...]
    labels: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Series:
    """A value for each date. window: the pixel's dates in order, where results keep the time dimension."""

    col: Column
    time: Column
    window: Any = None


Value = Any


def lit(v: Value) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v)


def elementwise(fn: Callable[..., Column]) -> Callable[..., Value]:
    """Lift a function of columns to arrays (matched or repeated) and series."""

    @functools.wraps(fn)
    def lifted(*args: Value) -> Value:
        arrays = [a for a in args if isinstance(a, Arr)]
        if arrays:
            n = max(len(a.items) for a in arrays)
            pick = lambda a, i: a.items[i] if isinstance(a, Arr) else a
            return replace(arrays[0], items=tuple(lifted(*[pick(a, i) for a in args]) for i in range(n)))
        series = [a for a in args if isinstance(a, Series)]
        if series:
            return replace(series[0], col=fn(*[a.col if isinstance(a, Series) else lit(a) for a in args]))
        return fn(*[lit(a) for a in args])

    return lifted


def _scale(x: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    return _clip(F.try_divide((x - a) * (d - c), b - a) + c, F.least(c, d), F.greatest(c, d))


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))  # least and greatest skip NULL


def _difference(a: Value, b: Value, unit: str = "second") -> Column:
    return F.timestamp_diff(unit.upper(), _date(a), _date(b)).cast("double")


def _date(c: Value) -> Column:
    return F.to_timestamp_ntz(F.lit(c)) if isinstance(c, str) else (c if isinstance(c, Column) else lit(c))


def _replace_component(date: Value, component: str, value: Value) -> Column:
    d = _date(date)
    parts = {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "hour": F.hour(d), "minute": F.minute(d), "second": F.extract(F.lit("SECOND"), d)}
    if component not in parts:
        raise ProcessParameterInvalid(f"component {component}")
    parts[component] = lit(value).cast("int") if component != "second" else lit(value)
    return F.make_timestamp_ntz(*[parts[k] for k in ("year", "month", "day", "hour", "minute", "second")])


_UNARY = {
    "absolute": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "ln": lambda x: F.when(x > 0, F.log(x)), "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"),
    "int": lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double"), "not": lambda x: ~x, "is_nodata": lambda x: x.isNull(),
}
_BINARY = {
    "add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "divide": F.try_divide,
    "eq": lambda x, y: x == y, "neq": lambda x, y: x != y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y,
    "lte": lambda x, y: x <= y, "and": lambda x, y: x & y, "or": lambda x, y: x | y, "mod": F.try_mod,
}


def _sorted(a: Arr) -> Column:
    return F.array_sort(F.filter(F.array(*a.items), lambda v: v.isNotNull()))


def _quantile(values: Column, p: float) -> Column:
    """Linear interpolation between order statistics; NULL without values."""
    n = F.size(values)
    at = (n - 1) * F.lit(float(p))
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, n - 1))
    return F.when(n > 0, a + (b - a) * (at - low))


def _arr_sum(a: Arr) -> Column:
    total = functools.reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0.0)) for c in a.items])
    return F.when(F.coalesce(*a.items).isNotNull(), total)


def _arr_count(a: Arr) -> Column:
    return functools.reduce(lambda x, y: x + y, [c.isNotNull().cast("int") for c in a.items]).cast("double")


def _arr_variance(a: Arr) -> Column:
    n, mean = _arr_count(a), F.try_divide(_arr_sum(a), _arr_count(a))
    square = functools.reduce(lambda x, y: x + y, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in a.items])
    return F.try_divide(square, F.when(n > 1, n - 1))


def _least(cols, fn) -> Column:
    return fn(*cols) if len(cols) > 1 else cols[0]


ARRAY_REDUCERS: dict[str, Callable[[Arr], Column]] = {
    "sum": _arr_sum,
    "count": _arr_count,
    "mean": lambda a: F.try_divide(_arr_sum(a), _arr_count(a)),
    "min": lambda a: _least(a.items, F.least),
    "max": lambda a: _least(a.items, F.greatest),
    "first": lambda a: F.coalesce(*a.items),
    "last": lambda a: F.coalesce(*a.items[::-1]),
    "variance": _arr_variance,
    "sd": lambda a: F.sqrt(_arr_variance(a)),
    "median": lambda a: _quantile(_sorted(a), 0.5),
    "product": lambda a: F.when(F.coalesce(*a.items).isNotNull(), functools.reduce(lambda x, y: x * y, [F.coalesce(c, F.lit(1.0)) for c in a.items])),
}


def _valid_first(col: Column, time: Column, pick) -> Column:
    return pick(col, F.when(col.isNotNull(), time))


#: Aggregates over rows; all skip NULL, and give NULL without values but for count.
AGGREGATES: dict[str, Callable[[Column, Column | None], Column]] = {
    "sum": lambda c, t: F.sum(c),
    "count": lambda c, t: F.count(c).cast("double"),
    "mean": lambda c, t: F.avg(c),
    "min": lambda c, t: F.min(c),
    "max": lambda c, t: F.max(c),
    "first": lambda c, t: _valid_first(c, t, F.min_by),
    "last": lambda c, t: _valid_first(c, t, F.max_by),
    "variance": lambda c, t: F.var_samp(c),
    "sd": lambda c, t: F.stddev_samp(c),
    "median": lambda c, t: F.median(c),
    "product": lambda c, t: F.product(c),
}


def reducer(name: str) -> Callable[[Value], Value]:
    def run(data: Value) -> Value:
        if isinstance(data, (list, tuple)):
            data = Arr(tuple(lit(v) for v in data))
        if isinstance(data, Arr):
            return ARRAY_REDUCERS[name](data)
        if isinstance(data, Series):
            agg = AGGREGATES[name](data.col, data.time)
            return agg if data.window is None else agg.over(data.window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        raise ReducerUnsupported(f"{name} over a single value")

    return run


def quantiles(data: Value, probabilities: list[float] | int) -> Arr:
    if isinstance(probabilities, int):
        probabilities = [i / probabilities for i in range(1, probabilities)]
    if isinstance(data, Arr):
        return Arr(tuple(_quantile(_sorted(data), p) for p in probabilities))
    cols = [F.percentile(data.col, F.lit(float(p))) for p in probabilities]
    return Arr(tuple(c if data.window is None else c.over(data.window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for c in cols))


def interpolate_linear(data: Value) -> Value:
    """Fill NULLs between two values, in proportion to their distance in time (for arrays: in places)."""
    if isinstance(data, Arr):
        n, out = len(data.items), []
        for i, c in enumerate(data.items):
            before = F.coalesce(*[F.when(data.items[j].isNotNull(), F.struct(F.lit(j).alias("p"), data.items[j].alias("v"))) for j in range(i, -1, -1)])
            after = F.coalesce(*[F.when(data.items[j].isNotNull(), F.struct(F.lit(j).alias("p"), data.items[j].alias("v"))) for j in range(i, n)])
            share = (F.lit(i) - before.p) / (after.p - before.p)
            out.append(F.coalesce(c, before.v + (after.v - before.v) * share))
        return replace(data, items=tuple(out))
    if data.window is None:
        raise ProcessUnsupported("array_interpolate_linear keeps the time dimension")
    seconds = F.unix_micros(data.time.cast("timestamp"))
    point = F.when(data.col.isNotNull(), F.struct(seconds.alias("p"), data.col.alias("v")))
    before = F.last(point, ignorenulls=True).over(data.window.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(data.window.rowsBetween(0, W.unboundedFollowing))
    share = F.try_divide((seconds - before.p).cast("double"), (after.p - before.p).cast("double"))
    return replace(data, col=F.coalesce(data.col, before.v + (after.v - before.v) * share))


def array_element(data: Value, index: int | None = None, label: str | None = None, return_nodata: bool = False) -> Value:
    if isinstance(data, Series):
        if index is None or data.window is not None:
            raise ProcessUnsupported("array_element of a time series needs an index and drops time")
        return F.get(F.transform(F.array_sort(F.collect_list(F.struct(data.time.alias("t"), data.col.alias("v")))), lambda s: s["v"]), F.lit(index))
    items = list(data.items) if isinstance(data, Arr) else [lit(v) for v in data]
    if label is not None:
        labels = data.labels if isinstance(data, Arr) else None
        if not labels or label not in labels:
            raise BandNotFound(str(label))
        index = labels.index(label)
    if index is None or not -len(items) <= index < len(items):
        if return_nodata:
            return F.lit(None).cast("double")
        raise ProcessParameterInvalid(f"no element {index} in {len(items)}")
    return items[index]


def _as_items(v: Value) -> list[Column]:
    return list(v.items) if isinstance(v, Arr) else [lit(x) for x in v] if isinstance(v, (list, tuple)) else [lit(v)]


class Compiler:
    """Compiles a flat graph; ``parameters`` are what from_parameter may name."""

    def __init__(self, graph: dict[str, dict], parameters: dict[str, Value]):
        self.graph, self.parameters, self.done, self.busy = graph, parameters, {}, set()

    def result(self) -> Value:
        ends = [k for k, n in self.graph.items() if n.get("result")] or [self._last()]
        return self.node(ends[0])

    def _last(self) -> str:
        used = {name for n in self.graph.values() for name in _references(n.get("arguments", {}))}
        ends = [k for k in self.graph if k not in used]
        if len(ends) != 1:
            raise ProcessParameterInvalid("a callback needs one result node")
        return ends[0]

    def node(self, name: str) -> Value:
        if name in self.busy:
            raise ProcessParameterInvalid(f"cycle at node {name}")
        if name not in self.done:
            self.busy.add(name)
            node = self.graph[name]
            self.done[name] = self.call(node["process_id"], node.get("arguments", {}))
            self.busy.discard(name)
        return self.done[name]

    def value(self, arg: Any) -> Value:
        if isinstance(arg, dict):
            if "from_node" in arg:
                return self.node(arg["from_node"])
            if "from_parameter" in arg:
                if arg["from_parameter"] not in self.parameters:
                    raise ProcessParameterInvalid(f"no parameter {arg['from_parameter']}")
                return self.parameters[arg["from_parameter"]]
            return arg
        if isinstance(arg, list):
            return [self.value(a) for a in arg]
        return arg

    def call(self, process: str, arguments: dict) -> Value:
        a = {k: self.value(v) for k, v in arguments.items() if not (process == "array_apply" and k == "process")}
        if process in _UNARY:
            return elementwise(_UNARY[process])(a["x"])
        if process in _BINARY:
            if "data" in a and "x" not in a:  # several operands
                items = _as_items(a["data"])
                return functools.reduce(elementwise(_BINARY[process]), items)
            x, y = (a["x"], a["y"]) if "x" in a else (a["value"], a["expression"])
            return elementwise(_BINARY[process])(x, y)
        if process in ARRAY_REDUCERS:
            if process == "count" and a.get("condition") is True:  # all elements
                a["data"] = elementwise(lambda c: F.coalesce(c, F.lit(0.0)))(a["data"])
            elif process == "count" and isinstance(a.get("condition"), dict):
                test = lambda c: Compiler(as_graph(a["condition"]), self.parameters | {"x": c}).result()
                a["data"] = elementwise(lambda c: F.when(test(c), F.lit(1.0)))(a["data"])
            return reducer(process)(a["data"])
        if process == "power":
            return elementwise(lambda x, p: F.pow(x, p))(a.get("base", a.get("x")), a["p"])
        if process == "pi":
            return F.lit(3.141592653589793)
        if process == "e":
            return F.lit(2.718281828459045)
        if process == "linear_scale_range":
            args = [a["x"], a.get("inputMin"), a.get("inputMax"), a.get("outputMin", 0), a.get("outputMax", 1)]
            return elementwise(_scale)(*args)
        if process == "clip":
            return elementwise(_clip)(a["x"], a["min"], a["max"])
        if process == "if":
            accept, reject = a.get("accept"), a.get("reject")
            return elementwise(lambda v, t, f: F.when(v, t).otherwise(f))(a["value"], accept, reject)
        if process == "between":
            return elementwise(lambda x, lo, hi: x.between(lo, hi))(a["x"], a["min"], a["max"])
        if process == "date_difference":
            return _difference(a["date1"], a["date2"], a.get("unit", "second"))
        if process == "date_replace_component":
            return _replace_component(a["date"], a["component"], a["value"])
        if process == "quantiles":
            return quantiles(a["data"], a.get("probabilities", a.get("q")))
        if process == "array_element":
            return array_element(a["data"], a.get("index"), a.get("label"), a.get("return_nodata", False))
        if process in ("array_create", "create_array"):
            items = [x for v in (a["data"] if isinstance(a["data"], list) else [a["data"]]) for x in _as_items(v)]
            return Arr(tuple(items * int(a.get("repeat", 1))))
        if process in ("array_concat", "array_append"):
            first, second = (a["array1"], a["array2"]) if process == "array_concat" else (a["data"], a["value"])
            return Arr(tuple(_as_items(first) + _as_items(second)))
        if process == "array_find":
            at = F.array_position(F.array(*_as_items(a["data"])), lit(a["value"]))
            return F.when(at > 0, (at - 1).cast("double"))
        if process == "array_contains":
            return F.coalesce(F.array_contains(F.array(*_as_items(a["data"])), lit(a["value"])), F.lit(False))
        if process == "array_interpolate_linear":
            return interpolate_linear(a["data"])
        if process == "array_apply":
            return self._array_apply(a["data"], arguments["process"]["process_graph"])
        if process == "array_labels":
            return list(a["data"].labels or range(len(a["data"].items)))
        if process in ("predict_random_forest", "predict_onnx", "predict_catboost"):
            raise ProcessUnsupported(f"{process} runs on a whole cube: see gridloom.ml")
        raise ProcessUnsupported(process)

    def _array_apply(self, data: Value, graph: dict) -> Value:
        if isinstance(data, Series):
            label = F.date_format(data.time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
            index = (F.row_number().over(data.window) - 1).cast("double") if data.window is not None else None
            got = Compiler(graph, self.parameters | {"x": data.col, "label": data.time, "label_text": label, "index": index}).result()
            return replace(data, col=got)
        items = _as_items(data)
        labels = data.labels if isinstance(data, Arr) and data.labels else tuple(range(len(items)))
        out = [Compiler(graph, self.parameters | {"x": c, "label": labels[i], "index": F.lit(float(i))}).result() for i, c in enumerate(items)]
        return Arr(tuple(lit(c) for c in out), data.labels if isinstance(data, Arr) else None)


def _references(arguments: Any) -> list[str]:
    if isinstance(arguments, dict):
        if "from_node" in arguments:
            return [arguments["from_node"]]
        return [r for k, v in arguments.items() if k != "process_graph" for r in _references(v)]
    if isinstance(arguments, list):
        return [r for v in arguments for r in _references(v)]
    return []


def as_graph(process: str | dict) -> dict[str, dict]:
    """A callback as a flat graph: a graph itself, {"process_graph": graph}, or the name of a reducer or unary process."""
    if isinstance(process, dict):
        return process.get("process_graph", process)
    key = "data" if process in ARRAY_REDUCERS else "x"
    return {process: {"process_id": process, "arguments": {key: {"from_parameter": key}}, "result": True}}


def numeric(c: Value) -> Column:
    """A callback's result as a cube value: booleans become 0 and 1."""
    return lit(c).cast("double")
