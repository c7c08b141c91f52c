"""Cubes, scenes and points over the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Band, CubeMeta, GridSpec
from ..operators.cube import Cube
from .tables import register

SIDE = 16
GRID = GridSpec("index", 0.0, float(SIDE), 1.0, 1.0, SIDE, SIDE, 8)
EVENTS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> Cube:
    """Months x supplier and part classes; means of quantity, price, discount and tax."""
    li = table(spark, sf_dir, "lineitem")
    df = li.groupBy(
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("t"),
        (F.col("l_suppkey") % SIDE).cast("int").alias("y"),
        (F.col("l_partkey") % SIDE).cast("int").alias("x"),
    ).agg(*[F.avg(c).alias(n) for n, c in (("qty", "l_quantity"), ("price", "l_extendedprice"), ("disc", "l_discount"), ("tax", "l_tax"))])
    return Cube(df, CubeMeta((Band("qty", "red"), Band("price", "nir"), Band("disc"), Band("tax", aliases=("vat",))), GRID))


def activity(spark: SparkSession, sf_dir: str) -> Cube:
    """Days x user classes; mean value of each event type, mostly no-data."""
    ev = table(spark, sf_dir, "events")
    mean = [F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(e) for e in EVENTS]
    df = ev.groupBy(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("t"),
        (F.col("user_id") % SIDE).cast("int").alias("y"),
        (F.floor(F.col("user_id") / SIDE) % SIDE).cast("int").alias("x"),
    ).agg(*mean)
    return Cube(df, CubeMeta(tuple(Band(e) for e in EVENTS), GRID))


def parts(spark: SparkSession, sf_dir: str) -> Cube:
    """Without time: part classes by size class; mean retail price."""
    p = table(spark, sf_dir, "part")
    df = p.groupBy((F.floor(F.col("p_partkey") / SIDE) % SIDE).cast("int").alias("y"), (F.col("p_partkey") % SIDE).cast("int").alias("x"))
    df = df.agg(F.avg("p_retailprice").alias("retail"), F.avg("p_size").alias("psize"))
    return Cube(df, CubeMeta((Band("retail"), Band("psize")), GRID, temporal=False))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scene items with boxes of half a degree."""
    o = table(spark, sf_dir, "orders")
    west, south = (F.col("o_custkey") % 36 * 10 - 180).cast("double"), (F.col("o_orderkey") % 17 * 10 - 80).cast("double")
    props = F.create_map(
        F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("updated"), F.col("o_orderdate").cast("string")
    )
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("datetime"),
        F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(None).cast("timestamp_ntz").alias("end"),
        west.alias("west"), south.alias("south"), (west + 0.5).alias("east"), (south + 0.5).alias("north"), props.alias("properties"),
    )


@register("sales")
def _sales(spark: SparkSession, sf_dir: str) -> Cube:
    return sales(spark, sf_dir)


@register("activity")
def _activity(spark: SparkSession, sf_dir: str) -> Cube:
    return activity(spark, sf_dir)

