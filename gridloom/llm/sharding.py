"""Sharding by extendible hashing, in DataFrame operations only.

Documents are placed by the leading bits of a 60-bit hash of their content. A directory bucket that exceeds the byte
limit splits on its next bit, and only such buckets do. The splitting works on sums: one aggregation yields the
bytes of every cell STEP bits below the buckets that are still too large, and the least fitting depth of each cell
follows from these sums by windows over its buckets, without a row for each depth; rows are read again only where a
bucket is too large even STEP bits deeper.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BITS = 60
STEP = 12
#: Bytes of a shard, by default and in the registered query: small, so that tables of a few MB split too.
LIMIT = 128 << 10


def _hash(*cols):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, BITS // 4), 16, 10).cast("long")


def _least_buckets(cells: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth, prefix, shard_bytes, shard_rows): the shallowest bucket of each cell that fits, else nulls.

    cells: cell (a prefix of ``bits`` bits), bytes, n. A cell keeps its one row: its buckets' sums are windows over the cells of
    its bucket at ``base``, at most 2 ** STEP.
    """
    fit = []
    out = cells.withColumn("top", F.expr(f"shiftright(cell, {bits - base})")).repartition("top")
    for depth in range(base, bits + 1):
        prefix = F.expr(f"shiftright(cell, {bits - depth})")
        bucket = Window.partitionBy("top", prefix)
        sums = F.struct(
            F.lit(depth).alias("depth"), prefix.alias("prefix"), F.sum("bytes").over(bucket).alias("shard_bytes"), F.sum("n").over(bucket).alias("shard_rows")
        )
        out = out.withColumn(f"b{depth}", sums)
        b = F.col(f"b{depth}")
        fits = (b["shard_bytes"] <= limit) | (b["shard_rows"] == 1) | F.lit(depth == BITS)
        fit.append(F.when(fits, b))
    return out.select("cell", F.coalesce(*fit).alias("b")).select("cell", "b.*")


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_rows) for every input row.

    shard is the bucket's hash prefix in bits ('' if all fits one shard), depth its length. A bucket of one row
    is never split, however large the row; so a shard exceeds the limit only if it holds a single row. Null texts
    have 0 bytes. Rows with equal id and text get hashes of their own, from the number of the copy. Extra columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        _hash(F.col(id_col).cast("string"), F.col(text_col)).alias("h"),
    )
    counted = rows.groupBy("doc_id", "n_bytes", "h").agg(F.count("*").alias("n"))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    own = F.when(F.col("n") == 1, F.col("h")).otherwise(_hash(F.col("h").cast("string"), F.col("copy").cast("string")))
    rows = materialize(copies.select("doc_id", "n_bytes", own.alias("h")), "shard-rows")

    open_rows, base, parts = rows, 0, []
    while True:
        bits = min(base + STEP, BITS)
        cell = F.shiftright("h", BITS - bits)
        cells = materialize(
            open_rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")), "cells"
        )
        placed = materialize(_least_buckets(cells, base, bits, limit), "directory")
        parts.append(rows.withColumn("cell", cell).join(placed.where("depth IS NOT NULL"), "cell"))
        if bits == BITS:
            break
        left = placed.where("depth IS NULL").select("cell")
        if left.isEmpty():
            break
        open_rows = open_rows.withColumn("cell", cell).join(left, "cell", "left_semi").drop("cell")
        base = bits
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("doc_id", "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(limit: int = LIMIT) -> str:
    return f"""
WITH k AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS h,
         row_number() OVER (PARTITION BY doc_id, text) AS copy, count(*) OVER (PARTITION BY doc_id, text) AS n
  FROM documents),
r AS (
  SELECT doc_id, n_bytes, copy, CASE WHEN n = 1 THEN h ELSE ('0x' || substr(md5(h::VARCHAR || '|' || copy::VARCHAR), 1, 15))::BIGINT END AS h
  FROM k),
levels AS (
  SELECT doc_id, n_bytes, copy, h, d.depth, h >> (60 - d.depth) AS prefix FROM r, (SELECT unnest(range(0, 61))::INT AS depth) d),
sums AS (
  SELECT *, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows FROM levels WINDOW w AS (PARTITION BY depth, prefix)),
least AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, copy, h ORDER BY depth) AS place
  FROM sums WHERE shard_bytes <= {limit} OR shard_rows = 1 OR depth = 60)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
FROM least WHERE place = 1
"""


SQL = sql()
