"""The streaming twin of period aggregation: late rows are taken until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOWS = {"hour": "1 hour", "day": "1 day", "week": "7 days"}


def read_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def aggregate_period(stream: DataFrame, time: str, keys: list[str], value: str, period: str = "day", delay: str = "1 day") -> DataFrame:
    """(t, keys, n, total, mean) of fixed windows of a stream or a table."""
    ts = F.col(time).cast("timestamp")
    df = stream.withColumn("_t", ts)
    if stream.isStreaming:
        df = df.withWatermark("_t", delay)
    grouped = df.groupBy(F.window("_t", WINDOWS[period]).alias("w"), *keys)
    out = grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("t"), *keys, "n", "total", "mean")


def run_available(out: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what there is and return it as a table in memory (for tests and small results)."""
    query = out.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.table(table)
