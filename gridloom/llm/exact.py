"""Exact deduplication by two-pass Bloom filtering.

Pass one sets every row's text hash in a Bloom filter that remembers which cells were set twice. Pass two probes
it: rows whose hash certainly occurs once pass straight through; only possibly repeated rows shuffle, by the
SHA-256 of their normalised text. A corpus of more hashes than one broadcast segment of the filter holds passes segment by
segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import split_rows
from .common import lower_ascii, materialize


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its group of equal texts and whether it is the row that stays.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when identical after lower-casing
    A-Z; a null text counts as empty. The largest id stays; a null id is below all others. Of rows with the
    same id and text exactly one is kept. Extra columns are ignored; an empty table gives no rows.
    """
    keyed = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(lower_ascii(F.col(text_col)), 256).alias("text_sha256")),
        "exact",
    ).withColumn("h", F.xxhash64("text_sha256"))

    def groups(probed: DataFrame) -> DataFrame:
        straight = probed.where(~F.col("again")).select(
            "doc_id",
            F.col("doc_id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
            "text_sha256",
        )
        # rows of the same id and text become one counted row; then each group's keeper
        rows = materialize(probed.where("again").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n")), "exact-rows")
        keepers = materialize(
            rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "exact-groups"
        )
        back = (
            rows.join(keepers, "text_sha256")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
            .select(
                "doc_id",
                "keep_id",
                "group_size",
                (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                "text_sha256",
            )
        )
        return straight.unionByName(back)

    return split_rows(keyed, "h", keyed.count(), groups)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without exact copies, all columns kept; of equal texts the row with the largest id stays.

    Same rules as exact_groups. Rows equal in id and text are ordered by their other columns, so that the row
    that stays is the same on each run.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.sha2(lower_ascii(F.col(text_col)), 256).alias("key")).withColumn(
        "h", F.xxhash64("key")
    )
    order = F.struct(
        F.col(f"row.`{id_col}`").isNotNull(),
        F.col(f"row.`{id_col}`"),
        F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != id_col]),
    )

    def keepers(probed: DataFrame) -> DataFrame:
        best = probed.where("again").groupBy("key").agg(F.max_by("row", order).alias("row")).select("row.*")
        return probed.where(~F.col("again")).select("row.*").unionByName(best)

    return split_rows(keyed, "h", docs.count(), keepers)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH k AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM k WINDOW w AS (PARTITION BY text_sha256)
"""
