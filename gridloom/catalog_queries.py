"""Registered queries of the cube operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as geo
from .model import GridSpec
from .operators import spatial as sp
from .operators.cube import Cube
from .plans import graph as pg
from .sinks import files
from .sources import adapters as src
from .sources import items, swath, synthetic, tables
from .streaming import periods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LI = """li AS (
  SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS t, (l_suppkey % 16)::INT AS y, (l_partkey % 16)::INT AS x,
         avg(l_quantity) AS qty, avg(l_extendedprice) AS price, avg(l_discount) AS disc, avg(l_tax) AS tax
  FROM lineitem GROUP BY ALL)"""
EV = """ev AS (
  SELECT date_trunc('day', ts)::TIMESTAMP AS t, (user_id % 16)::INT AS y, ((user_id // 16) % 16)::INT AS x,
         avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'error') AS error,
         avg(value) FILTER (event_type = 'purchase') AS purchase, avg(value) FILTER (event_type = 'signup') AS signup,
         avg(value) FILTER (event_type = 'view') AS view
  FROM events GROUP BY ALL)"""
PA = """pa AS (
  SELECT ((p_partkey // 16) % 16)::INT AS y, (p_partkey % 16)::INT AS x, avg(p_retailprice) AS retail, avg(p_size) AS psize
  FROM part GROUP BY ALL)"""
SC = """sc AS (
  SELECT o_orderkey::VARCHAR AS id, o_orderdate AS datetime, (o_custkey % 36 * 10 - 180)::DOUBLE AS west, (o_orderkey % 17 * 10 - 80)::DOUBLE AS south,
         o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders)"""
LI_BANDS = ("qty", "price", "disc", "tax")


#: Added before rounding on both sides: means of cents often lie halfway between two rounded values, and the last bit of a
#: sum, which depends on its order, must not decide.
NUDGE = 2e-8


def rounded(result: Cube | DataFrame) -> DataFrame:
    """Doubles to six decimals, as the SQL has them."""
    df = result.df if isinstance(result, Cube) else result
    return df.select(*[F.round(F.col(f"`{n}`") + NUDGE, 6).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql.replace(", 6)", f" + {NUDGE}, 6)")
        return fn

    return add


def _each(form: str, bands=LI_BANDS) -> str:
    """A SQL expression for each band, where {b} is the band."""
    return ", ".join(f"round({form.format(b=b)}, 6) AS {b}" for b in bands)


def _node(pid: str, **arguments) -> dict:
    return {"process_id": pid, "arguments": arguments}


X, DATA = {"from_parameter": "x"}, {"from_parameter": "data"}


def _callback(*nodes: dict) -> dict:
    """A graph of nodes n0, n1, ... of which the last is the result."""
    graph = {f"n{i}": n for i, n in enumerate(nodes)}
    graph[f"n{len(nodes) - 1}"]["result"] = True
    return graph


def _ref(i: int) -> dict:
    return {"from_node": f"n{i}"}


POLYGONS = ["POLYGON((1 1, 9 2, 7 12, 2 10, 1 1))", "POLYGON((8 8, 15.2 8, 15.2 15.2, 8 15.2, 8 8), (10 10, 12 10, 12 12, 10 12, 10 10))", "POINT(3.5 4.5)", "POLYGON((40 40, 44 40, 44 44, 40 40))"]


def _crossings(points: list[tuple[float, float]]) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(points, points[1:], strict=False):
        if y1 != y2:
            parts.append(f"(CASE WHEN ({y1} > cy) <> ({y2} > cy) AND cx < ({x2 - x1}) * (cy - {y1}) / ({y2 - y1}) + {x1} THEN 1 ELSE 0 END)")
    return " + ".join(parts)


def _cells_sql() -> str:
    """(feature_index, y, x) of the cells of POLYGONS by the even-odd rule."""
    parts = []
    for i, wkt in enumerate(POLYGONS):
        rings, point = geo.parse_wkt(wkt)
        if point:
            (px, py), = rings[0]
            test = f"x = {int(px)} AND y = {15 - int(py)}"
        else:
            test = f"({' + '.join(_crossings([*r, r[0]]) for r in rings)}) % 2 = 1"
        parts.append(f"SELECT {i} AS feature_index, y, x FROM cell WHERE {test}")
    grid = "cell AS (SELECT y::INT AS y, x::INT AS x, x + 0.5::DOUBLE AS cx, 16 - (y + 0.5::DOUBLE) AS cy FROM range(16) a(y), range(16) b(x))"
    return f"{grid}, inside AS ({' UNION ALL '.join(parts)})"


CELLS = _cells_sql()


def _polygons(spark: SparkSession) -> DataFrame:
    return geo.features(spark, POLYGONS)


# --- filters, labels and types


@query("filter_temporal", f"WITH {LI} SELECT t, y, x, {_each('{b}')} FROM li WHERE t >= '1994-01-01' AND t < '1995-06-01'")
def _(spark, sf):
    return src.sales(spark, sf).filter_temporal("1994-01-01", "1995-06-01")


@query("filter_bbox", f"WITH {LI} SELECT t, y, x, {_each('{b}')} FROM li WHERE x BETWEEN 2 AND 7 AND y BETWEEN 4 AND 10")
def _(spark, sf):
    return src.sales(spark, sf).filter_bbox(west=2.2, south=5.1, east=7.5, north=11.9)


@query("filter_bands", f"WITH {LI} SELECT t, y, x, round(tax, 6) AS tax, round(price, 6) AS price FROM li")
def _(spark, sf):
    return src.sales(spark, sf).filter_bands(["vat", "nir"])


@query("filter_spatial", f"WITH {LI}, {CELLS} SELECT t, y, x, {_each('{b}')} FROM li SEMI JOIN inside USING (y, x)")
def _(spark, sf):
    return sp.filter_spatial(src.sales(spark, sf), _polygons(spark))


@query("filter_labels", f"WITH {LI} SELECT t, y, x, {_each('{b}')} FROM li WHERE date_diff('day', TIMESTAMP '1995-01-01', t) >= 0 AND t < '1996-01-01'")
def _(spark, sf):
    late = _callback(_node("date_difference", date1="1995-01-01", date2={"from_parameter": "value"}, unit="day"), _node("gte", x=_ref(0), y=0))
    return src.sales(spark, sf).filter_labels(late, "t").filter_temporal(None, "1996-01-01")


SCENE_PROPERTIES = {"status": "F", "priority": "[1-3]*", "price": _callback(_node("between", x={"from_parameter": "value"}, min=50000, max=200000))}


@query("filter_properties", f"WITH {SC} SELECT id, datetime FROM sc WHERE status = 'F' AND regexp_full_match(priority, '[1-3].*') AND price BETWEEN 50000 AND 200000")
def _(spark, sf):
    return src.scenes(spark, sf).where(items.property_filter(SCENE_PROPERTIES)).select("id", "datetime")


@query("query_items", f"WITH {SC} SELECT id, datetime, west, south FROM sc WHERE (west <= 180 AND west + 0.5 >= 150 OR west <= -140 AND west + 0.5 >= -180) AND south <= 40 AND south + 0.5 >= -20 AND datetime >= '1995-01-01' AND datetime < '1996-01-01' ORDER BY datetime, id LIMIT 200")
def _(spark, sf):
    return items.query(src.scenes(spark, sf), (150, -20, -140, 40), ("1995-01-01", "1996-01-01"), max_items=200).select("id", "datetime", "west", "south")


@query("dimension_labels", f"WITH {LI} SELECT DISTINCT t AS label FROM li")
def _(spark, sf):
    return src.sales(spark, sf).dimension_labels("t")


@query("rename_labels", f"WITH {LI} SELECT t, y, x, round(qty, 6) AS a, round(price, 6) AS price, round(disc, 6) AS d, round(tax, 6) AS tax FROM li")
def _(spark, sf):
    return src.sales(spark, sf).rename_labels("bands", ["a", "d"], ["qty", "disc"])


@query("rename_dimension", f"WITH {LI} SELECT y, x, {_each('avg({b})')} FROM li GROUP BY y, x")
def _(spark, sf):
    return src.sales(spark, sf).rename_dimension("t", "time").reduce_dimension("time", "mean")


@query("add_dimension", f"WITH {PA} SELECT TIMESTAMP '2020-05-01' AS t, y, x, round(retail, 6) AS retail, round(psize, 6) AS psize FROM pa")
def _(spark, sf):
    return src.parts(spark, sf).add_dimension("t", "2020-05-01", "temporal")


@query("drop_dimension", f"WITH {LI} SELECT y, x, {_each('{b}')} FROM li WHERE t = '1995-03-01'")
def _(spark, sf):
    return src.sales(spark, sf).filter_temporal("1995-03-01", "1995-04-01").drop_dimension("t")


@query("convert_data_type", f"WITH {LI} SELECT t, y, x, " + ", ".join(f"CASE WHEN trunc({b}) BETWEEN 0 AND 255 THEN trunc({b})::SMALLINT END AS {b}" for b in LI_BANDS) + " FROM li")
def _(spark, sf):
    return src.sales(spark, sf).convert_data_type("uint8")


@query("linear_scale_range", f"WITH {LI} SELECT t, y, x, floor(least(greatest((price - 20000) * 200 / 30000.0 + 0, 0), 200))::SMALLINT AS price FROM li")
def _(spark, sf):
    return src.sales(spark, sf).filter_bands(["price"]).linear_scale_range(20000, 50000, 0, 200)


@query("ndvi", f"WITH {LI} SELECT t, y, x, {_each('{b}')}, round((price - qty) / nullif(price + qty, 0), 6) AS index FROM li")
def _(spark, sf):
    return src.sales(spark, sf).ndvi(target_band="index")


@query("timeseries_point", f"WITH {LI} SELECT t, {_each('{b}')} FROM li WHERE x = 3 AND y = 11")
def _(spark, sf):
    return src.sales(spark, sf).timeseries(3.4, 4.2)


# --- per-pixel callbacks

for _name, _graph, _sql in (
    ("apply_cos", "cos", "cos({b})"),
    ("apply_abs", _callback(_node("subtract", x=X, y=25), _node("absolute", x=_ref(0))), "abs({b} - 25)"),
    ("apply_power", _callback(_node("power", base=X, p=0.5)), "pow({b}, 0.5)"),
    ("apply_if", _callback(_node("gt", x=X, y=26), _node("if", value=_ref(0), accept=X, reject=-1)), "CASE WHEN {b} > 26 THEN {b} ELSE -1 END"),
    ("apply_linear_scale", _callback(_node("linear_scale_range", x=X, inputMin=0, inputMax=40, outputMin=0, outputMax=1)), "least(greatest({b} / 40.0::DOUBLE, 0), 1)"),
    (
        "apply_math",
        _callback(_node("divide", x=X, y=-10000), _node("exp", x=_ref(0)), _node("sin", x=_ref(1)), _node("add", x=_ref(2), y=_ref(1)), _node("multiply", x=_ref(3), y=100), _node("int", x=_ref(4))),
        "trunc((sin(exp({b} / -10000)) + exp({b} / -10000)) * 100)",
    ),
):

    @query(_name, f"WITH {LI} SELECT t, y, x, {_each(_sql)} FROM li")
    def _(spark, sf, graph=_graph):
        return src.sales(spark, sf).apply(graph)


def _ev_list(keep: str = "") -> str:
    return f"list_filter([click, error, purchase, signup, view], lambda v: v IS NOT NULL){keep}"


_sum = "CASE WHEN coalesce(click, error, purchase, signup, view) IS NOT NULL THEN " + " + ".join(f"coalesce({e}, 0)" for e in src.EVENTS) + " END"
_count = " + ".join(f"({e} IS NOT NULL)::INT" for e in src.EVENTS)
for _reducer, _sql in {
    "sum": _sum,
    "count": f"({_count})::DOUBLE",
    "mean": f"({_sum}) / nullif({_count}, 0)",
    "min": "least(click, error, purchase, signup, view)",
    "max": "greatest(click, error, purchase, signup, view)",
    "first": "coalesce(click, error, purchase, signup, view)",
    "last": "coalesce(view, signup, purchase, error, click)",
    "median": f"list_aggregate({_ev_list()}, 'median')",
    "variance": f"list_aggregate({_ev_list()}, 'var_samp')",
    "sd": f"list_aggregate({_ev_list()}, 'stddev_samp')",
}.items():

    @query(f"reduce_bands_{_reducer}", f"WITH {EV} SELECT t, y, x, round({_sql}, 6) AS value FROM ev")
    def _(spark, sf, reducer=_reducer):
        return src.activity(spark, sf).reduce_dimension("bands", reducer)


def _element(label: str) -> dict:
    return _node("array_element", data=DATA, label=label)


EVI = _callback(
    _element("price"), _element("qty"), _element("disc"), _node("subtract", x=_ref(0), y=_ref(1)), _node("multiply", data=[6, _ref(1)]), _node("multiply", data=[7.5, _ref(2)]),
    _node("subtract", data=[_ref(4), _ref(5)]), _node("add", data=[1, _ref(0), _ref(6)]), _node("divide", data=[_ref(3), _ref(7)]), _node("multiply", data=[2.5, _ref(8)]),
)


@query("reduce_bands_evi", f"WITH {LI} SELECT t, y, x, round(2.5::DOUBLE * ((price - qty) / nullif(1 + price + (6 * qty - 7.5::DOUBLE * disc), 0)), 6) AS value FROM li")
def _(spark, sf):
    """The whole query as a JSON process graph."""
    graph = {
        "load": {"process_id": "load_collection", "arguments": {"id": "sales", "featureflags": {"sf_dir": sf}}},
        "evi": {"process_id": "reduce_dimension", "arguments": {"data": {"from_node": "load"}, "dimension": "bands", "reducer": {"process_graph": EVI}}},
        "save": {"process_id": "save_result", "arguments": {"data": {"from_node": "evi"}, "format": "parquet"}, "result": True},
    }
    return pg.evaluate(spark, graph)


@query("reduce_bands_logic", f"WITH {LI} SELECT t, y, x, ((qty > 25 AND price < 40000) OR NOT (disc >= 0.03))::INT::DOUBLE AS value FROM li")
def _(spark, sf):
    g = _callback(
        _element("qty"), _element("price"), _element("disc"), _node("gt", x=_ref(0), y=25), _node("lt", x=_ref(1), y=40000), _node("and", x=_ref(3), y=_ref(4)),
        _node("gte", x=_ref(2), y=0.03), _node("not", x=_ref(6)), _node("or", x=_ref(5), y=_ref(7)),
    )
    return src.sales(spark, sf).reduce_dimension("bands", g)


@query("reduce_bands_find", f"WITH {EV} SELECT t, y, x, ((click IS NOT NULL AND click = greatest(click, error, purchase, signup, view)))::INT::DOUBLE AS value FROM ev")
def _(spark, sf):
    g = _callback(_node("max", data=DATA), _node("array_element", data=DATA, index=0), _node("array_create", data=[_ref(1)]), _node("array_contains", data=_ref(2), value=_ref(0)))
    return src.activity(spark, sf).reduce_dimension("bands", g)


@query("reduce_bands_quantile", f"WITH {EV} SELECT t, y, x, round(quantile_cont(v, 0.9), 6) AS value FROM (SELECT t, y, x, unnest([click, error, purchase, signup, view]) AS v FROM ev) GROUP BY t, y, x")
def _(spark, sf):
    return src.activity(spark, sf).reduce_dimension("bands", _callback(_node("quantiles", data=DATA, probabilities=[0.9]), _node("array_element", data=_ref(0), index=0)))


@query("apply_dimension_array_concat", f"WITH {LI} SELECT t, y, x, round(qty, 6) AS band_0, round(price, 6) AS band_1, round(disc, 6) AS band_2, round(tax, 6) AS band_3, round(qty * 2, 6) AS band_4, 1.0::DOUBLE AS band_5, 1.0::DOUBLE AS band_6 FROM li")
def _(spark, sf):
    g = _callback(
        _node("array_element", data=DATA, index=0), _node("multiply", x=_ref(0), y=2), _node("array_append", data=DATA, value=_ref(1)), _node("array_create", data=[1], repeat=2), _node("array_concat", array1=_ref(2), array2=_ref(3))
    )
    return src.sales(spark, sf).apply_dimension("bands", g)


@query("apply_dimension_array_apply", f"WITH {EV} SELECT t, y, x, round(click * 1, 6) AS click, round(error * 2, 6) AS error, round(purchase * 3, 6) AS purchase, round(signup * 4, 6) AS signup, round(view * 5, 6) AS view FROM ev")
def _(spark, sf):
    inner = _callback(_node("add", x={"from_parameter": "index"}, y=1), _node("multiply", x=X, y=_ref(0)))
    return src.activity(spark, sf).apply_dimension("bands", _callback(_node("array_apply", data=DATA, process={"process_graph": inner})))


# --- time

for _reducer, _sql in {
    "min": "min({b})", "max": "max({b})", "sum": "sum({b})", "mean": "avg({b})", "median": "median({b})", "sd": "stddev_samp({b})", "variance": "var_samp({b})",
    "count": "count({b})::DOUBLE", "first": "arg_min({b}, t) FILTER ({b} IS NOT NULL)", "last": "arg_max({b}, t) FILTER ({b} IS NOT NULL)",
}.items():

    @query(f"reduce_t_{_reducer}", f"WITH {EV} SELECT y, x, {_each(_sql, src.EVENTS)} FROM ev GROUP BY y, x")
    def _(spark, sf, reducer=_reducer):
        return src.activity(spark, sf).reduce_dimension("t", reducer)


@query("reduce_t_product", f"WITH {LI} SELECT y, x, round(product(1 + tax), 6) AS tax FROM li GROUP BY y, x")
def _(spark, sf):
    plus = src.sales(spark, sf).filter_bands(["tax"]).apply(_callback(_node("add", x=1, y=X)))
    return plus.reduce_dimension("t", "product")


@query("reduce_t_quantiles", f"WITH {LI} SELECT y, x, {_each('quantile_cont({b}, 0.25)')} FROM li GROUP BY y, x")
def _(spark, sf):
    return src.sales(spark, sf).reduce_dimension("t", _callback(_node("quantiles", data=DATA, probabilities=[0.25, 0.5]), _node("array_element", data=_ref(0), index=0)))


@query("reduce_t_expression", f"WITH {LI} SELECT y, x, {_each('max({b}) - min({b}) * 2')} FROM li GROUP BY y, x")
def _(spark, sf):
    g = _callback(_node("max", data=DATA), _node("min", data=DATA), _node("multiply", x=_ref(1), y=2), _node("subtract", x=_ref(0), y=_ref(2)))
    return src.sales(spark, sf).reduce_dimension("t", g)


@query("apply_dimension_interpolate", f"""WITH {EV}, p AS (
  SELECT t, y, x, view, epoch_us(t) AS s,
         last_value(CASE WHEN view IS NOT NULL THEN {{'p': epoch_us(t), 'v': view}} END IGNORE NULLS) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
         first_value(CASE WHEN view IS NOT NULL THEN {{'p': epoch_us(t), 'v': view}} END IGNORE NULLS) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
  FROM ev)
SELECT t, y, x, round(coalesce(view, b.v + (a.v - b.v) * ((s - b.p)::DOUBLE / nullif((a.p - b.p)::DOUBLE, 0))), 6) AS view FROM p""")
def _(spark, sf):
    return src.activity(spark, sf).filter_bands(["view"]).apply_dimension("t", _callback(_node("array_interpolate_linear", data=DATA)))


@query("apply_dimension_t_to_bands", f"WITH {LI} SELECT y, x, " + ", ".join(f"round(quantile_cont({b}, 0.25), 6) AS {b}_0, round(quantile_cont({b}, 0.75), 6) AS {b}_1, round(stddev_samp({b}), 6) AS {b}_2, round(avg({b}), 6) AS {b}_3" for b in LI_BANDS) + " FROM li GROUP BY y, x")
def _(spark, sf):
    g = _callback(
        _node("quantiles", data=DATA, probabilities=[0.25, 0.75]), _node("sd", data=DATA), _node("mean", data=DATA), _node("array_create", data=[_ref(1), _ref(2)]), _node("array_concat", array1=_ref(0), array2=_ref(3))
    )
    return src.sales(spark, sf).apply_dimension("t", g, "bands")


INTERVALS = [("1994-01-01", "1994-07-01"), ("1994-04-01", "1995-01-01"), ("1970-01-01", "1971-01-01")]


def _interval_sql(cte: str, values: str, intervals: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"({i}, TIMESTAMP '{s}', TIMESTAMP '{e}')" for i, (s, e) in enumerate(intervals))
    return f"""WITH {cte}, iv(i, s, e) AS (VALUES {rows}), cell AS (SELECT DISTINCT y, x FROM li)
SELECT s AS t, c.y, c.x, {values} FROM iv CROSS JOIN cell c LEFT JOIN li ON li.y = c.y AND li.x = c.x AND li.t >= s AND li.t < e GROUP BY i, s, c.y, c.x"""


@query("aggregate_temporal_overlap", _interval_sql(LI, _each("avg({b})"), INTERVALS[:2]))
def _(spark, sf):
    return src.sales(spark, sf).aggregate_temporal(INTERVALS[:2], "mean")


@query("aggregate_temporal_empty", _interval_sql(LI, _each("count({b})::DOUBLE"), INTERVALS))
def _(spark, sf):
    return src.sales(spark, sf).aggregate_temporal(INTERVALS, "count")


for _period, _sql in {
    "day": "t", "month": "date_trunc('month', t)::TIMESTAMP", "year": "date_trunc('year', t)::TIMESTAMP",
    "season": "date_trunc('month', t - to_months((month(t) % 3)::INT))::TIMESTAMP", "week": "date_trunc('week', t)::TIMESTAMP",
    "dekad": "(date_trunc('month', t) + to_days((least((day(t) - 1) // 10, 2) * 10)::INT))::TIMESTAMP",
}.items():

    @query(f"aggregate_temporal_period_{_period}", f"WITH {EV} SELECT {_sql} AS t, y, x, {_each('avg({b})', src.EVENTS)} FROM ev GROUP BY 1, y, x")
    def _(spark, sf, period=_period):
        return src.activity(spark, sf).aggregate_temporal_period(period, "mean")


@query("neighborhood_year", f"WITH {LI} SELECT t, y, x, {_each('{b} - avg({b}) OVER (PARTITION BY y, x, year(t))')} FROM li")
def _(spark, sf):
    g = _callback(_node("mean", data=DATA), _node("subtract", x=DATA, y=_ref(0)))
    return src.sales(spark, sf).apply_period("year", g)


@query("best_pixel", f"""WITH {EV}, d AS (SELECT *, abs(day(t) - 15) AS a FROM ev WHERE view IS NOT NULL),
m AS (SELECT *, min(a) OVER (PARTITION BY date_trunc('month', t), y, x) AS b FROM d)
SELECT t, y, x, {_each('{b}', src.EVENTS)} FROM m WHERE a = b""")
def _(spark, sf):
    return src.activity(spark, sf).select_best_in_period("month", "view")


@query("date_components", f"WITH {EV} SELECT t, y, x, date_diff('day', make_timestamp(year(t), month(t), 15, 0, 0, 0), t)::DOUBLE AS view FROM ev")
def _(spark, sf):
    label = {"from_parameter": "label"}
    inner = _callback(_node("date_replace_component", date=label, component="day", value=15), _node("date_difference", date1=_ref(0), date2=label, unit="day"))
    cube = src.activity(spark, sf).filter_bands(["view"])
    return cube.apply_dimension("t", _callback(_node("array_apply", data=DATA, process={"process_graph": inner})))


@query("period_events", """SELECT date_trunc('day', ts)::TIMESTAMP AS t, event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def _(spark, sf):
    return periods.aggregate_period(src.table(spark, sf, "events"), "ts", ["event_type"], "value", "day")


# --- several cubes


@query("merge_cubes_bands", f"WITH {LI}, {EV}, e AS (SELECT date_trunc('month', t)::TIMESTAMP AS t, y, x, avg(view) AS view FROM ev GROUP BY 1, 2, 3) SELECT t, y, x, round(qty, 6) AS qty, round(view, 6) AS view FROM (SELECT t, y, x, qty FROM li) l FULL JOIN e USING (t, y, x)")
def _(spark, sf):
    other = src.activity(spark, sf).filter_bands(["view"]).aggregate_temporal_period("month", "mean")
    return src.sales(spark, sf).filter_bands(["qty"]).merge_cubes(other)


_SPLIT = "a AS (SELECT t, y, x, qty FROM li WHERE t < '1996-01-01'), b AS (SELECT t, y, x, qty FROM li WHERE t >= '1994-01-01' AND y < 12)"
for _name, _sql in (("sum", "a.qty + b.qty"), ("subtract", "a.qty - b.qty"), ("max", "greatest(a.qty, b.qty)")):

    @query(f"merge_cubes_{_name}", f"WITH {LI}, {_SPLIT} SELECT t, y, x, round(CASE WHEN a.qty IS NULL THEN b.qty WHEN b.qty IS NULL THEN a.qty ELSE {_sql} END, 6) AS qty FROM a FULL JOIN b USING (t, y, x)")
    def _(spark, sf, resolver=_name):
        cube = src.sales(spark, sf).filter_bands(["qty"])
        other = cube.filter_temporal("1994-01-01", None).where(F.col("y") < 12)
        return cube.filter_temporal(None, "1996-01-01").merge_cubes(other, resolver)


@query("merge_cubes_spatial", f"WITH {LI}, {PA} SELECT t, y, x, round(price, 6) AS price, round(retail, 6) AS retail, round(psize, 6) AS psize FROM (SELECT t, y, x, price FROM li) l LEFT JOIN pa USING (y, x)")
def _(spark, sf):
    return src.sales(spark, sf).filter_bands(["price"]).merge_cubes(src.parts(spark, sf))


_MASKED = "CASE WHEN coalesce(m.m, 0) <> 0 THEN {r} ELSE {{b}} END"
_OWN_MASK = "(SELECT t, y, x, (qty > 30)::INT::DOUBLE AS m FROM li) m USING (t, y, x)"


def _own_mask(cube: Cube) -> Cube:
    return cube.filter_bands(["qty"]).apply(_callback(_node("gt", x=X, y=30)))


@query("mask_keep", f"WITH {LI} SELECT t, y, x, {_each(_MASKED.format(r='NULL'))} FROM li LEFT JOIN {_OWN_MASK}")
def _(spark, sf):
    cube = src.sales(spark, sf)
    return cube.mask(_own_mask(cube))


@query("mask_replacement", f"WITH {LI} SELECT t, y, x, {_each(_MASKED.format(r='-5'))} FROM li LEFT JOIN {_OWN_MASK}")
def _(spark, sf):
    cube = src.sales(spark, sf)
    return cube.mask(_own_mask(cube), -5)


@query("mask_broadcast", f"WITH {LI}, {PA} SELECT t, y, x, {_each(_MASKED.format(r='NULL'))} FROM li LEFT JOIN (SELECT y, x, (psize > 25)::INT::DOUBLE AS m FROM pa) m USING (y, x)")
def _(spark, sf):
    mask = src.parts(spark, sf).filter_bands(["psize"]).apply(_callback(_node("gt", x=X, y=25)))
    return src.sales(spark, sf).mask(mask)


@query("mask_polygon", f"WITH {LI}, {CELLS} SELECT t, y, x, {_each('CASE WHEN i THEN {b} END')} FROM li LEFT JOIN (SELECT DISTINCT y, x, true AS i FROM inside) USING (y, x)")
def _(spark, sf):
    return sp.mask_polygon(src.sales(spark, sf), _polygons(spark))


@query("mask_polygon_inside", f"WITH {LI}, {CELLS} SELECT t, y, x, {_each('CASE WHEN i THEN 0 ELSE {b} END')} FROM li LEFT JOIN (SELECT DISTINCT y, x, true AS i FROM inside) USING (y, x)")
def _(spark, sf):
    return sp.mask_polygon(src.sales(spark, sf), _polygons(spark), 0, inside=True)


# --- polygons

_SPINE = "feature(feature_index) AS (VALUES (0), (1), (2), (3))"


def _zonal_sql(cte: str, name: str, values: str) -> str:
    return f"""WITH {cte}, {CELLS}, {_SPINE}, day AS (SELECT DISTINCT t FROM {name})
SELECT d.t, f.feature_index, {values} FROM day d CROSS JOIN feature f LEFT JOIN inside i ON i.feature_index = f.feature_index
LEFT JOIN {name} ON {name}.t = d.t AND {name}.y = i.y AND {name}.x = i.x GROUP BY d.t, f.feature_index"""


@query("aggregate_spatial_mean", _zonal_sql(LI, "li", _each("avg({b})")))
def _(spark, sf):
    return sp.aggregate_spatial(src.sales(spark, sf), _polygons(spark), "mean")


_multi = ", ".join(f'round(sum({b}), 6) AS "sum({b})", count({b})::DOUBLE AS "count({b})", round(max({b}), 6) AS "max({b})"' for b in src.EVENTS)


@query("aggregate_spatial_multi", _zonal_sql(EV, "ev", _multi))
def _(spark, sf):
    g = _callback(_node("sum", data=DATA), _node("count", data=DATA), _node("max", data=DATA), _node("array_create", data=[_ref(0), _ref(1), _ref(2)]))
    return sp.aggregate_spatial(src.activity(spark, sf), _polygons(spark), g)


@query("aggregate_spatial_static", f"WITH {PA}, {CELLS}, {_SPINE} SELECT feature_index, round(median(retail), 6) AS retail, round(median(psize), 6) AS psize FROM feature LEFT JOIN inside USING (feature_index) LEFT JOIN pa USING (y, x) GROUP BY feature_index")
def _(spark, sf):
    return sp.aggregate_spatial(src.parts(spark, sf), _polygons(spark), "median")


@query("aggregate_spatial_histogram", f"WITH {PA}, {CELLS} SELECT feature_index, 'psize' AS band, trunc(psize) AS value, count(*) AS n FROM inside JOIN pa USING (y, x) GROUP BY ALL")
def _(spark, sf):
    return sp.zonal_histogram(src.parts(spark, sf).filter_bands(["psize"]).apply("int"), _polygons(spark))


@query("coverage_json", f"WITH {LI}, {CELLS}, d AS (SELECT DISTINCT t FROM li), f AS (SELECT unnest(range({len(POLYGONS)}))::INT AS feature_index), z AS (SELECT feature_index, t, avg(qty) AS qty, avg(tax) AS tax FROM inside JOIN li USING (y, x) GROUP BY ALL) SELECT f.feature_index, strftime(d.t, '%Y-%m-%dT%H:%M:%SZ') AS time, round(qty, 6) AS qty, round(tax, 6) AS tax FROM f CROSS JOIN d LEFT JOIN z USING (feature_index, t)")
def _(spark, sf):
    """The documents, taken apart again: a coverage for each feature, with its axis and its ranges."""
    docs = files.coverage_json(sp.aggregate_spatial(src.sales(spark, sf).filter_bands(["qty", "tax"]), _polygons(spark), "mean"))
    values = "struct<values: array<double>>"
    form = f"type string, id int, domain struct<axes: struct<t: struct<values: array<string>>>>, ranges struct<qty: {values}, tax: {values}>"
    parsed = docs.select(F.from_json("value", form).alias("c")).where("c.type = 'Coverage'")
    rows = parsed.select("c.id", F.explode(F.arrays_zip(F.col("c.domain.axes.t.values").alias("time"), F.col("c.ranges.qty.values").alias("qty"), F.col("c.ranges.tax.values").alias("tax"))).alias("r"))
    return rows.select(F.col("id").alias("feature_index"), "r.time", "r.qty", "r.tax")


@query("vector_to_raster", f"WITH {CELLS} SELECT y, x, (arg_max(feature_index, feature_index) * 1.5::DOUBLE + 1) AS level FROM inside GROUP BY y, x")
def _(spark, sf):
    feats = _polygons(spark).withColumn("level", F.col("feature_index") * 1.5 + 1)
    return sp.vector_to_raster(feats, src.sales(spark, sf), ["level"])


@query("raster_to_vector", f"""WITH RECURSIVE {PA}, c AS (SELECT y, x, (psize > 25)::INT::DOUBLE AS v, (y * 16 + x)::BIGINT AS cell FROM pa),
r AS (SELECT y, x, v, cell, cell AS zone FROM c UNION SELECT c.y, c.x, c.v, c.cell, r.zone FROM r JOIN c ON c.v = r.v AND abs(c.y - r.y) + abs(c.x - r.x) = 1),
z AS (SELECT y, x, v, min(zone) AS zone FROM r GROUP BY y, x, v)
SELECT zone, v AS value, count(*) AS n_cells, min(x)::DOUBLE AS west, (16 - max(y) - 1)::DOUBLE AS south, (max(x) + 1)::DOUBLE AS east, (16 - min(y))::DOUBLE AS north, 'psize' AS band FROM z GROUP BY zone, v""")
def _(spark, sf):
    flat = src.parts(spark, sf).filter_bands(["psize"]).apply(_callback(_node("gt", x=X, y=25)))
    return sp.raster_to_vector(flat).drop("edges")


# --- surroundings and grids

KERNEL = [[0, 1, 0], [1, 2, 1], [0, 1, 0]]
_shifts = ", ".join(f"({dy}, {dx}, {KERNEL[dy + 1][dx + 1]})" for dy in (-1, 0, 1) for dx in (-1, 0, 1) if KERNEL[dy + 1][dx + 1])


@query("apply_kernel", f"""WITH {LI}, k(dy, dx, w) AS (VALUES {_shifts}),
s AS (SELECT t, y - dy AS y, x - dx AS x, {', '.join(f'sum({b} * w) AS {b}' for b in LI_BANDS)} FROM li CROSS JOIN k GROUP BY ALL)
SELECT li.t, li.y, li.x, {', '.join(f'round(coalesce(s.{b}, 0) * 0.5::DOUBLE, 6) AS {b}' for b in LI_BANDS)} FROM li LEFT JOIN s ON s.t = li.t AND s.y = li.y AND s.x = li.x""")
def _(spark, sf):
    return sp.apply_kernel(src.sales(spark, sf), KERNEL, 0.5)


_around = ", ".join(f"(max(v) FILTER (dy = {dy} AND dx = {dx})) AS n{(dy + 1) * 3 + dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
_horn = f"""WITH {PA}, o AS (SELECT a.y, a.x, b.y - a.y AS dy, b.x - a.x AS dx, b.retail AS v, a.retail AS c FROM pa a JOIN pa b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
n AS (SELECT y, x, any_value(c) AS c, {_around} FROM o GROUP BY y, x),
g AS (SELECT y, x, ((coalesce(n2, c) + 2 * coalesce(n5, c) + coalesce(n8, c)) - (coalesce(n0, c) + 2 * coalesce(n3, c) + coalesce(n6, c))) / 8.0::DOUBLE AS e,
  ((coalesce(n6, c) + 2 * coalesce(n7, c) + coalesce(n8, c)) - (coalesce(n0, c) + 2 * coalesce(n1, c) + coalesce(n2, c))) / 8.0::DOUBLE AS s FROM n)"""


@query("slope", _horn + " SELECT y, x, round(atan(sqrt(e * e + s * s)), 6) AS retail_slope FROM g")
def _(spark, sf):
    return sp.slope(src.parts(spark, sf).filter_bands(["retail"]))


@query("aspect", _horn + " SELECT y, x, round(CASE WHEN e = 0 AND s = 0 THEN 0 WHEN atan2(s, -e) < 0 THEN atan2(s, -e) + 2 * pi() ELSE atan2(s, -e) END, 6) AS retail_aspect FROM g")
def _(spark, sf):
    return sp.aspect(src.parts(spark, sf).filter_bands(["retail"]))


@query("scl_dilation_mask", f"""WITH {PA}, c AS (SELECT y, x, trunc(psize / 5) AS k FROM pa), o(d) AS (VALUES (-1), (0), (1)), o5(d) AS (VALUES (-2), (-1), (0), (1), (2)),
a AS (SELECT y + p.d AS y, x + q.d AS x FROM c, o p, o q WHERE k IN (3, 4)), b AS (SELECT y + p.d AS y, x + q.d AS x FROM c, o5 p, o5 q WHERE k IN (7))
SELECT y, x, ((y, x) IN (SELECT (y, x) FROM a) OR (y, x) IN (SELECT (y, x) FROM b))::INT::DOUBLE AS mask FROM c""")
def _(spark, sf):
    classes = src.parts(spark, sf).filter_bands(["psize"]).apply(_callback(_node("divide", x=X, y=5), _node("int", x=_ref(0))))
    return sp.scl_dilation_mask(classes, 0, [3, 4], [7], 3, 5)


for _method, _sql in {"average": "avg({b})", "max": "max({b})", "min": "min({b})", "med": "median({b})"}.items():

    @query(f"resample_{_method}", f"WITH {LI} SELECT t, (y // 4)::INT AS y, (x // 4)::INT AS x, {_each(_sql)} FROM li GROUP BY ALL")
    def _(spark, sf, method=_method):
        return sp.resample_spatial(src.sales(spark, sf), 4, method=method)


@query("resample_mode", f"WITH {PA}, k AS (SELECT y // 4 AS y, x // 4 AS x, trunc(psize / 10) AS v, count(*) AS n FROM pa GROUP BY ALL) SELECT y::INT AS y, x::INT AS x, arg_max(v, n * 1000 - v) AS psize FROM k GROUP BY y, x")
def _(spark, sf):
    classes = src.parts(spark, sf).filter_bands(["psize"]).apply(_callback(_node("divide", x=X, y=10), _node("int", x=_ref(0))))
    return sp.resample_spatial(classes, 4, method="mode")


@query("resample_near", f"WITH {LI}, c AS (SELECT y::INT AS ty, x::INT AS tx, (4 * y + 2)::INT AS y, (4 * x + 2)::INT AS x FROM range(4) a(y), range(4) b(x)) SELECT t, ty AS y, tx AS x, {_each('{b}')} FROM c JOIN li USING (y, x)")
def _(spark, sf):
    return sp.resample_spatial(src.sales(spark, sf), 4, method="near")


@query("resample_bilinear", f"""WITH {PA}, c AS (SELECT y::INT AS ty, x::INT AS tx, (y + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS v, (x + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS u FROM range(32) a(y), range(32) b(x)),
n AS (SELECT ty, tx, retail, (1 - abs(v - pa.y)) * (1 - abs(u - pa.x)) AS w FROM c JOIN pa ON abs(v - pa.y) < 1 AND abs(u - pa.x) < 1)
SELECT ty AS y, tx AS x, round(sum(retail * w) / sum(w), 6) AS retail FROM n GROUP BY ty, tx""")
def _(spark, sf):
    return sp.resample_spatial(src.parts(spark, sf).filter_bands(["retail"]), 0.5, method="bilinear")


@query("resample_cube_spatial", f"WITH {LI} SELECT t, (y // 2)::INT AS y, (x // 2)::INT AS x, {_each('avg({b})')} FROM li GROUP BY ALL")
def _(spark, sf):
    cube = src.sales(spark, sf)
    target = replace(cube, meta=replace(cube.meta, grid=cube.meta.grid.resampled(2)))
    return sp.resample_cube_spatial(cube, target, "average")


BIN_GRID = GridSpec("index", 0.0, 1000.0, 50.0, 100.0, 40, 10)


@query("bin_to_grid", "SELECT (floor((1000 - c_acctbal / 10) / 100))::INT AS y, (floor(c_custkey / 50.0))::INT AS x, round(avg(c_acctbal), 6) AS c_acctbal FROM customer WHERE floor((1000 - c_acctbal / 10) / 100) BETWEEN 0 AND 9 AND floor(c_custkey / 50.0) BETWEEN 0 AND 39 GROUP BY 1, 2")
def _(spark, sf):
    c = src.table(spark, sf, "customer").withColumn("v", F.col("c_acctbal") / 10)
    return sp.bin_to_grid(c, BIN_GRID, ["c_acctbal"], x="c_custkey", y="v")


@query("nearest_lookup", """WITH cell AS (SELECT y::INT AS y, x::INT AS x, (x + 0.5::DOUBLE) * 50 AS cx, 1000 - (y + 0.5::DOUBLE) * 100 AS cy FROM range(10) a(y), range(40) b(x)),
n AS (SELECT y, x, c_acctbal, row_number() OVER (PARTITION BY y, x ORDER BY (cx - c_custkey) * (cx - c_custkey) + (cy - c_acctbal / 10) * (cy - c_acctbal / 10), c_custkey) AS k
  FROM cell JOIN customer ON (cx - c_custkey) * (cx - c_custkey) + (cy - c_acctbal / 10) * (cy - c_acctbal / 10) <= 3600)
SELECT y, x, c_acctbal FROM n WHERE k = 1""")
def _(spark, sf):
    c = src.table(spark, sf, "customer").withColumn("v", F.col("c_acctbal") / 10)
    return sp.nearest_lookup(c, BIN_GRID, ["c_acctbal"], 60.0, x="c_custkey", y="v")


@query("swath_binning", """WITH p AS (SELECT *, (user_id % 200) / 10.0::DOUBLE AS lon, (event_id % 160) / 10.0::DOUBLE AS lat FROM events WHERE event_type <> 'error' AND ts >= '2024-01-05' AND ts < '2024-01-20')
SELECT date_trunc('day', ts)::TIMESTAMP AS t, (floor((16 - lat) / 2))::INT AS y, (floor(lon / 2.5::DOUBLE))::INT AS x, round(avg(value), 6) AS value FROM p
WHERE lon BETWEEN 1 AND 15 AND lat BETWEEN 1 AND 15 AND floor((16 - lat) / 2) BETWEEN 0 AND 7 AND floor(lon / 2.5::DOUBLE) BETWEEN 0 AND 7 GROUP BY 1, 2, 3""")
def _(spark, sf):
    e = src.table(spark, sf, "events").withColumns({"lon": F.col("user_id") % 200 / 10, "lat": F.col("event_id") % 160 / 10, "good": F.col("event_type") != "error"})
    grid = GridSpec("index", 0.0, 16.0, 2.5, 2.0, 8, 8)
    return swath.load(e, grid, ["value"], time="ts", start="2024-01-05", end="2024-01-20", extent=(1, 1, 15, 15), quality="good", minimum=True)


@query("mercator_tiles", """WITH c AS (SELECT c_custkey, (c_custkey % 360 - 180)::DOUBLE AS lon, (c_custkey % 160 - 80)::DOUBLE AS lat FROM customer)
SELECT c_custkey, least(greatest(floor((lon + 180) / 360 * 256), 0), 255)::INT AS tx,
  least(greatest(floor((1 - ln(tan(pi() / 4 + radians(lat) / 2)) / pi()) / 2 * 256), 0), 255)::INT AS ty FROM c WHERE lon % 1.40625::DOUBLE <> 0""")
def _(spark, sf):
    c = src.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"), (F.col("c_custkey") % 160 - 80).cast("double").alias("lat"))
    tx, ty = geo.mercator_tile(F.col("lon"), F.col("lat"), 8)
    return c.where(F.col("lon") % 1.40625 != 0).select("c_custkey", tx.alias("tx"), ty.alias("ty"))


# --- sources and scenes


@query("synthetic_collection", """WITH d(t) AS (VALUES (TIMESTAMP '2021-01-05'), (TIMESTAMP '2021-01-15'), (TIMESTAMP '2021-01-25'), (TIMESTAMP '2021-02-05'))
SELECT t, y::INT AS y, x::INT AS x, ((x // 4) * 10 + y // 4)::DOUBLE AS TileColRow, 1 + x * 0.25::DOUBLE AS Longitude, 3 - (y + 1) * 0.25::DOUBLE AS Latitude, day(t)::DOUBLE AS Day FROM d, range(8) a(y), range(12) b(x)""")
def _(spark, sf):
    return synthetic.load(spark, (1, 1, 4, 3), "2021-01-01", "2021-02-10", ["TileColRow", "Longitude", "Latitude", "Day"])


@query("load_collection", f"WITH {LI} SELECT t, y, x, round(tax, 6) AS vat, round(qty, 6) AS qty FROM li WHERE t >= '1995-01-01' AND t < '1996-01-01' AND x BETWEEN 0 AND 7 AND y BETWEEN 8 AND 15")
def _(spark, sf):
    extent = {"west": 0, "south": 0, "east": 8, "north": 8}
    return tables.load_collection(spark, "sales", extent, ("1995-01-01", "1996-01-01"), ["vat", "qty"], sf_dir=sf)


@query("missing_products", f"WITH {EV}, a AS (SELECT DISTINCT t FROM ev), e AS (SELECT unnest(generate_series((SELECT min(t) FROM a), (SELECT max(t) FROM a) + INTERVAL 5 DAY, INTERVAL 1 DAY)) AS t) SELECT t FROM e ANTI JOIN a USING (t)")
def _(spark, sf):
    have = src.activity(spark, sf).df.select("t").distinct()
    bounds = have.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    every = bounds.select(F.explode(F.sequence(F.col("a"), F.col("b") + F.expr("interval 5 days"), F.expr("interval 1 day"))).alias("t"))
    return tables.missing_products(every, have, ["t"])


@query("query_stac_json", f"WITH {SC} SELECT id, west, status, strftime(datetime, '%Y-%m-%d') AS day FROM sc WHERE west <= 30 AND west + 0.5 >= 0 AND south <= 30 AND south + 0.5 >= 0")
def _(spark, sf):
    """The items' documents, taken apart again."""
    docs = items.query_json(items.query(src.scenes(spark, sf), (0, 0, 30, 30)))
    parsed = docs.select("id", F.from_json("item", "id string, datetime string, west double, properties map<string, string>").alias("d")).where("id = d.id")
    return parsed.select("id", "d.west", F.element_at("d.properties", "status").alias("status"), F.substring("d.datetime", 1, 10).alias("day"))


# order dates are whole days, so items half a day apart are those of one day
@query("dedup_items", f"WITH {SC} SELECT max(id) AS id, datetime FROM sc GROUP BY status, priority, datetime")
def _(spark, sf):
    coarse = src.scenes(spark, sf).withColumns({"west": F.lit(0.0), "south": F.lit(0.0), "east": F.lit(1.0), "north": F.lit(1.0)})
    return items.deduplicate(coarse, ["status", "priority"], seconds=43200).select("id", "datetime")


@query("prefer_timeliness", f"WITH {SC}, r AS (SELECT id, datetime, row_number() OVER (PARTITION BY datetime ORDER BY CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END NULLS LAST, id DESC) AS k FROM sc) SELECT id, datetime FROM r WHERE k = 1")
def _(spark, sf):
    return items.prefer_timeliness(src.scenes(spark, sf), ["datetime"], ("F", "O", "P"), "status").select("id", "datetime")


# --- functions and models


@query("udf_tiles", f"WITH {LI} SELECT t, y, x, round(qty - avg(qty) OVER (PARTITION BY y, x), 6) AS anomaly FROM li")
def _(spark, sf):
    from . import udf

    def anomaly(a, context):
        import warnings

        import numpy as np

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # cells without any date
            return a - np.nanmean(a, axis=0, keepdims=True)

    return udf.apply_tiles(src.sales(spark, sf).filter_bands(["qty"]), anomaly, tile=8, bands=["anomaly"])


@query("udf_features", f"WITH {LI}, {CELLS}, {_SPINE}, z AS (SELECT feature_index, t, sum(qty) AS s FROM inside JOIN li USING (y, x) GROUP BY ALL) SELECT feature_index, count(s)::VARCHAR AS result FROM feature LEFT JOIN z USING (feature_index) GROUP BY feature_index")
def _(spark, sf):
    from . import udf

    zonal = sp.aggregate_spatial(src.sales(spark, sf).filter_bands(["qty"]), _polygons(spark), "sum")
    return udf.apply_features(zonal, "def udf_apply_feature_dataframe(df):\n    return int(df['qty'].notna().sum())")


@query("apply_neighborhood", f"WITH {LI} SELECT t, y, x, round(qty * 2, 6) AS qty FROM li")
def _(spark, sf):
    return sp.apply_neighborhood(src.sales(spark, sf).filter_bands(["qty"]), lambda pdf: pdf.assign(qty=pdf["qty"] * 2), size=8, overlap=2)


@query("apply_polygon", f"WITH {LI}, {CELLS} SELECT t, y, x, round(CASE WHEN i THEN qty + 1 ELSE -1 END, 6) AS qty FROM li LEFT JOIN (SELECT DISTINCT y, x, true AS i FROM inside) USING (y, x)")
def _(spark, sf):
    return sp.apply_polygon(src.sales(spark, sf).filter_bands(["qty"]), _polygons(spark), lambda pdf: pdf.assign(qty=pdf["qty"] + 1), -1)


@query("random_forest")
def _(spark, sf):
    from . import ml

    e = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("feature_index"), "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(8)])
    names = [f"e{i}" for i in range(8)]
    model = ml.fit_class_random_forest(e, e, names, "label", num_trees=10, seed=42)
    return model.transform(e.dropna()).select("feature_index", "label", F.col("prediction").cast("int").alias("predicted"))


from . import source_queries  # noqa: E402, F401  (registers its queries here)
