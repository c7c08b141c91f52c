"""Properties that hold for any cube: order of independent steps, tile sizes, and numpy as a second opinion."""

import datetime

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridloom import model as m
from gridloom import udf
from gridloom.operators import spatial as sp
from gridloom.operators.cube import Cube

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
N = 6
cells = st.lists(st.one_of(st.none(), st.integers(-9, 9)), min_size=3 * N * N, max_size=3 * N * N)


def build(spark, values):
    a = np.array([np.nan if v is None else v for v in values], float).reshape(3, N, N)
    rows = [(datetime.datetime(2020, 1, 1 + t), y, x, None if np.isnan(a[t, y, x]) else float(a[t, y, x])) for t in range(3) for y in range(N) for x in range(N)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, y int, x int, b double")
    return Cube(df, m.CubeMeta((m.Band("b"),), m.GridSpec("index", 0, N, 1, 1, N, N, 4))), a


def grid_of(cube):
    out = np.full((N, N), np.nan)
    for r in cube.df.collect():
        out[r.y, r.x] = np.nan if r.b is None else r.b
    return out


@FEW
@given(cells)
def test_reducers_against_numpy(spark, values):
    cube, a = build(spark, values)
    empty = np.isnan(a).all(axis=0)
    with np.errstate(all="ignore"):
        for name, fn in (("min", np.fmin.reduce), ("max", np.fmax.reduce), ("sum", lambda v: np.nansum(v, axis=0))):
            got, want = grid_of(cube.reduce_dimension("t", name)), np.where(empty, np.nan, fn(a))
            assert np.array_equal(got, want, equal_nan=True)
        assert np.array_equal(grid_of(cube.reduce_dimension("t", "count")), (~np.isnan(a)).sum(axis=0))


@FEW
@given(cells, st.integers(0, 3), st.integers(2, 5))
def test_filter_and_reduce_commute(spark, values, low, high):
    cube, _ = build(spark, values)
    box = {"west": low, "east": high, "south": 0, "north": N - 1}
    first = grid_of(cube.filter_bbox(**box).reduce_dimension("t", "max"))
    last = grid_of(cube.reduce_dimension("t", "max").filter_bbox(**box))
    assert np.array_equal(first, last, equal_nan=True)


@FEW
@given(cells, st.sampled_from([1, 2, 3, 5, 6]))
def test_tile_size_does_not_matter(spark, values, tile):
    cube, a = build(spark, values)
    got = udf.apply_tiles(cube, lambda v, _: v * 2 + 1, tile=tile)
    want = {(t, y, x): 2 * a[t, y, x] + 1 for t in range(3) for y in range(N) for x in range(N) if not np.isnan(a[t, y, x])}
    assert {(r.t.day - 1, r.y, r.x): r.b for r in got.df.collect()} == want


@FEW
@given(cells)
def test_merging_halves_gives_the_whole(spark, values):
    cube, _ = build(spark, values)
    cut = "2020-01-02"
    whole = cube.filter_temporal(None, cut).merge_cubes(cube.filter_temporal(cut, None), "sum")
    key = lambda c: sorted((str(r.t), r.y, r.x, str(r.b)) for r in c.df.collect())
    assert key(whole) == key(cube)


@FEW
@given(cells)
def test_average_of_coarse_cells(spark, values):
    cube, a = build(spark, values)
    flat = cube.reduce_dimension("t", "first")
    first = grid_of(flat)
    got = {(r.y, r.x): r.b for r in sp.resample_spatial(flat, 2, method="average").df.collect()}
    for y in range(3):
        for x in range(3):
            block = first[2 * y : 2 * y + 2, 2 * x : 2 * x + 2]
            block = block[~np.isnan(block)]
            assert got[y, x] is None if not len(block) else abs(got[y, x] - block.mean()) < 1e-9
