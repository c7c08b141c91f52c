"""Chat formatting after cumulative-snapshot collapse, in DataFrame operations only.

Chat logs often hold a conversation many times, once after every turn. Each turn gets a rolling hash of the
conversation up to it (a running sum of hashes of position and content, kept in two independent 64-bit hashes). A
conversation whose whole hash occurs as the hash of a proper prefix of another one is a snapshot of that longer
conversation; an anti-join drops it. Equal conversations are merged first. Those left are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

START, END = "<|im_start|>", "<|im_end|>"


def _content(salt: int) -> Column:
    """A hash of role and text that tells null from empty."""
    return F.xxhash64(F.lit(salt), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def _escaped(c: Column, default: str) -> Column:
    return F.replace(F.coalesce(c, F.lit(default)), F.lit("<|"), F.lit("< |"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): the conversations that are no proper prefix of another one.

    Of equal conversations the least conv_id stays (null only if there is no other) and copies counts them. Turns are
    ordered by turn (null first), ties by content; a row that repeats another of its conversation counts once. A null
    conv_id is a conversation of its own. An empty table gives no rows; extra columns are ignored.
    """
    rows = turns.select("conv_id", "turn", _content(1).alias("a"), _content(2).alias("b"))
    w = W.partitionBy("conv_id").orderBy("turn", "a", "b")
    same = F.lag(F.struct("turn", "a", "b")).over(w).eqNullSafe(F.struct("turn", "a", "b"))
    rows = rows.withColumn("again", same).where("NOT again").withColumn("k", F.row_number().over(w))
    running = [F.sum(F.xxhash64("k", c).cast("decimal(38,0)")).over(w.rowsBetween(W.unboundedPreceding, 0)) for c in "ab"]
    rows = rows.select(
        "conv_id", "k", running[0].alias("p"), running[1].alias("q"), F.lead("k").over(w).isNotNull().alias("proper")
    )
    rows = materialize(rows, "chat-prefixes")
    whole = rows.where("NOT proper").groupBy("k", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    prefixes = rows.where("proper").select("k", "p", "q").distinct()
    return whole.join(prefixes, ["k", "p", "q"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, rendered) of every maximal conversation.

    A turn becomes START role newline text END newline; a null role is "unknown", a null text is empty, and "<|"
    in either is written "< |", so that no content can open or close a turn. One conversation is one row of the
    result and so must fit a row.
    """
    chosen = materialize(maximal_conversations(turns), "chat-chosen")
    rows = turns.select(F.col("conv_id").alias("c"), F.struct("turn", _content(1).alias("a"), _content(2).alias("b"), "role", "text").alias("row"))
    rows = rows.join(chosen.select("conv_id"), F.col("c").eqNullSafe(F.col("conv_id")), "left_semi")
    one = lambda r: F.concat(
        F.lit(START), _escaped(r["role"], "unknown"), F.lit("\n"), _escaped(r["text"], ""), F.lit(END + "\n")
    )
    shown = rows.groupBy("c").agg(F.array_sort(F.collect_set("row")).alias("rows"))
    shown = shown.select("c", F.concat_ws("", F.transform("rows", one)).alias("rendered"))
    return shown.join(chosen, F.col("c").eqNullSafe(F.col("conv_id"))).select("conv_id", "n_turns", "copies", "rendered")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
conv AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST) AS l,
         string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
                    || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST) AS rendered
  FROM turns GROUP BY conv_id),
whole AS (SELECT l, min(conv_id) AS conv_id, count(*) AS copies, any_value(rendered) AS rendered FROM conv GROUP BY l),
prefixes AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM conv))
SELECT conv_id, CAST(len(l) AS INT) AS n_turns, copies, rendered FROM whole
WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE prefixes.l = whole.l)
"""
