"""What reaches the scan, and what must not be in a plan."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridloom import catalog_queries as cq
from gridloom.model import GridSpec
from gridloom.sources import tables


@pytest.fixture(scope="module")
def pixels(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pixels") / "p")
    rows = spark.range(2000).select(
        F.timestamp_add("DAY", (F.col("id") % 40).cast("int"), F.lit(datetime.datetime(2020, 1, 1)).cast("timestamp_ntz")).alias("t"),
        (F.col("id") % 8).cast("int").alias("y"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("x"), *[(F.col("id") * k).cast("double").alias(f"b{k}") for k in range(5)],
    )
    rows.write.parquet(path)
    return tables.load_pixels(spark, path, [f"b{k}" for k in range(5)], GridSpec("index", 0, 8, 1, 1, 8, 8))


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")  # else filters are cut short in print
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_bands_reach_the_scan(pixels):
    cube = pixels.filter_bbox(2, 0, 5, 4).filter_temporal("2020-01-05", "2020-01-09").filter_bands(["b3"]).reduce_dimension("t", "mean")
    text = plan(cube.df)
    pushed = text[text.index("PushedFilters") :].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(t" in pushed and all(f"GreaterThanOrEqual({c}," in pushed for c in "xy"), pushed
    assert "b3:double" in text and not any(f"b{k}:double" in text for k in (0, 1, 2, 4))


def test_one_shuffle_for_a_temporal_reduction(pixels):
    assert plan(pixels.reduce_dimension("t", "median").df).count("Exchange ") == 1


@pytest.mark.parametrize("name", ["aggregate_temporal_overlap", "aggregate_spatial_mean", "mask_polygon", "filter_spatial", "resample_near", "merge_cubes_spatial", "apply_kernel"])
def test_no_cross_join_or_row_function(spark, sf, name):
    text = plan(cq.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    # the one row of dates that every feature meets is the only thing joined without keys
    assert text.count("NestedLoop") == (name == "aggregate_spatial_mean")
