"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of all words in proportion to its weight, at most CAP times its own words; what a capped
source leaves is shared by weight among the others (water filling). A source whose target is r times its size takes
floor(r) whole copies of each document for certain; the fraction left is a fixed-size sample in words with unequal
inclusion probabilities: they are in proportion to the root of a document's size, or to a column of odds, and where that
passes 1 a document gets one more whole copy and the others' probabilities are calibrated anew. Documents are ranked by
random odds divided by inclusion odds, u / (1 - u) * (1 - p) / p, and taken in that order while the middle of a document
lies within the words still wanted.

The running sum over a source never meets in one task: the logarithms of the ranks, which spread alike whatever p is, fall
into cells, cells are summed, and only the cell in which a source's words run out is ordered row by row, after a second,
finer division. Sources without a fraction, and documents that are certain, take no part in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Cells of a unit of the logarithm of ranks, at either of two levels; a source has at most 75 times as many.
CELLS = 1024
_DIGITS = 13  # hexadecimal digits of the random number: 52 bits


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; weights repeat over sources by code point, null last.

    The target is the smaller of level * weight and cap * size, with the level at which all targets sum to the
    words of all sources. One row per source: these few rows are ordered in one task.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn("weight", F.get(weight, place % len(weights)))
    fill = W.orderBy((F.col("source_size") * cap / F.col("weight")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    level = (total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    levelled = ranked.withColumn("level", level)
    # sources are capped in this order; the first that isn't sets the level
    capped = F.col("source_size") * cap <= F.col("level") * F.col("weight")
    levelled = levelled.withColumn("open", F.when(~capped, F.col("level")))
    final = F.first("open", ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    share = F.least(F.coalesce(final * F.col("weight"), F.col("source_size") * F.lit(cap)), F.col("source_size") * F.lit(cap))
    return levelled.select("source", "source_size", share.cast("double").alias("target"))


def uniform(*cols: Column, seed: int) -> Column:
    """A number in (0, 1) from the MD5 of the columns' text: the same on each run and each machine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long") + 0.5) / float(16**_DIGITS)


def inclusion(sums: DataFrame, targets: DataFrame) -> DataFrame:
    """(of, level, source_size, target, whole, rest, p) for each source and level of odds, from (source, level, words) rows.

    whole: certain copies. p: the probability of one more, null where there is none to draw; odds are 2 ** (level / 2), and
    levels whose probability would reach 1 are certain. rest: words to draw from the levels with a probability. A source
    has as many rows as levels, at most a few thousand.
    """
    part = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = sums.withColumnRenamed("source", "of").join(targets, F.col("of").eqNullSafe(targets.source)).withColumn("whole", F.floor(part))
    plan = plan.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("odds", F.pow(F.lit(2.0), F.col("level") / 2))
    down = W.partitionBy("of").orderBy(F.desc("level"))
    before, rest = down.rowsBetween(W.unboundedPreceding, -1), down.rowsBetween(W.currentRow, W.unboundedFollowing)
    ahead = F.coalesce(F.sum("words").over(before), F.lit(0))
    weighted = F.sum(F.col("odds") * F.col("words")).over(rest)
    plan = plan.withColumn("ahead", ahead).withColumn("unit", F.when(weighted > 0, (F.col("wanted") - ahead) / weighted).otherwise(0.0))
    # levels are certain in this order; the first that isn't sets the unit of probability
    plan = plan.withColumn("open", F.when(F.col("unit") * F.col("odds") < 1, F.struct("unit", "ahead")))
    plan = plan.withColumn("set", F.first("open", ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    drawn = (F.col("wanted") > 0) & (F.col("open").isNotNull() | F.col("set").isNull())
    sure = (F.col("wanted") > 0) & ~drawn
    p = F.when(drawn, F.least(F.greatest(F.col("set.unit") * F.col("odds"), F.lit(1e-12)), F.lit(1 - 1e-12)))
    return plan.select(
        "of", "level", "source_size", "target", (F.col("whole") + sure.cast("int")).alias("whole"), (F.col("wanted") - F.col("set.ahead")).alias("rest"), p.alias("p")
    )


def _sized(doc_id: Column, source: Column, text: Column, odds: Column, seed: int) -> dict[str, Column]:
    """What the mix needs of a document: id, source, size in words, random number and level of odds."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    level = F.coalesce(F.round(2 * F.log2(F.when(odds < 1e-12, F.lit(1e-12)).otherwise(odds))).cast("int"), F.length(F.bin(size + 1)))
    return {"doc_id": doc_id, "source": source, "size": size, "u": uniform(doc_id, text, seed=seed), "level": level}


def _rank() -> Column:
    """Random odds by inclusion odds; null where nothing is drawn."""
    return (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))


def _planned(docs: DataFrame, weights: Sequence[float], cap: int, seed: int, odds: str | None, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): what the mix needs of every document, and what it does with each source and level."""
    own = F.lit(None).cast("double") if odds is None else F.coalesce(F.col(odds).cast("double"), F.lit(1.0))
    columns = _sized(F.col(id_col), F.col(source_col), F.col(text_col), own, seed)
    rows = materialize(docs.select(*[c.alias(n) for n, c in columns.items()]), "mix-sizes")
    sums = materialize(rows.groupBy("source", "level").agg(F.sum("size").alias("words")), "mix-levels")
    targets = source_targets(sums.withColumnRenamed("words", "size"), weights, cap)
    return rows, materialize(inclusion(sums, targets).withColumnRenamed("level", "l"), "mix-plan")


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, size, u, source_size, target, whole, rest, p, q, cell, fine) for every row; q is null where nothing is drawn."""
    both = rows.alias("r").join(plan, F.col("r.source").eqNullSafe(F.col("of")) & (F.col("r.level") == F.col("l")))
    both = both.drop("of", "l", "level").withColumn("q", _rank())
    z = F.log("q")
    return materialize(both.withColumn("cell", F.floor(z * CELLS)).withColumn("fine", F.floor(z * CELLS * CELLS)), "mix-ranked")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: int = CAP,
    seed: int = 42,
    odds: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, source, size, u, source_size, target, copies, taken (= copies * size, in words).

    odds: a column of relative inclusion odds, rounded to half powers of two (null: 1; below 1e-12: that); without it they
    are the root of the size's next power of two. A null text has size 0; a null source is a source of its own. u is
    drawn from id and text: rows that repeat both share it and are taken one by one. An empty table gives no rows.
    Extra columns are ignored.
    """
    out = _decided(_ranked(*_planned(docs, weights, cap, seed, odds, id_col, text_col, source_col)))
    out = out.withColumn("copies", F.least(F.lit(cap), F.col("whole") + F.col("extra")).cast("long"))
    return out.select("doc_id", "source", "size", "u", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _decided(ranked: DataFrame) -> DataFrame:
    """ranked rows with extra: 1 for those of the sample, which is a beginning of its source in the order of (q, doc_id, size)."""
    drawn = ranked.where("q IS NOT NULL")

    def running(cell: str, of: DataFrame, *keys: str) -> DataFrame:
        """Words in the cells before each cell, and up to its end."""
        sums = of.groupBy(*keys, cell).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        upto = F.sum("words").over(W.partitionBy(*keys).orderBy(cell))
        return sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))

    def at(of: DataFrame, cells: DataFrame, cell: str) -> DataFrame:
        """Rows with the bounds of their cell."""
        names = cells.select(F.col("source").alias("s"), F.col(cell).alias("c"), "before", "upto")
        return of.join(names, F.col("source").eqNullSafe(F.col("s")) & (F.col(cell) == F.col("c"))).drop("s", "c")

    edge = "before <= rest AND upto >= rest"
    coarse = materialize(running("cell", drawn, "source"), "mix-coarse")
    bounds = at(drawn, coarse, "cell")
    inside = bounds.where(edge).withColumn("rest", F.col("rest") - F.col("before")).drop("before", "upto")
    inside = materialize(inside, "mix-edge")
    finer = at(inside, materialize(running("fine", inside, "source", "cell"), "mix-fine"), "fine")
    # whole cells are taken or left by their own bounds; the rows of the edge cells of the fine grid are ordered, equal ones as one
    cols = ["doc_id", "source", "size", "u", "source_size", "target", "whole", "q"]
    extra = (F.col("upto") < F.col("rest")).cast("int").alias("extra")
    clear = bounds.where(f"NOT ({edge})").select(*cols, extra).unionByName(finer.where(f"NOT ({edge})").select(*cols, extra))
    alike = finer.where(edge).groupBy(*cols, "fine", "rest", "before").agg(F.count("*").alias("n"))
    order = W.partitionBy("source", "fine").orderBy("q", "doc_id", "size")
    ahead = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fits = F.when(F.col("size") > 0, F.floor((F.col("rest") - ahead) / F.col("size") + 0.5)).otherwise(F.when(ahead <= F.col("rest"), F.col("n")).otherwise(0))
    few = alike.withColumn("fits", fits).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    few = few.select(*cols, (F.col("k") <= F.col("fits")).cast("int").alias("extra"))
    return ranked.where("q IS NULL").select(*cols, F.lit(0).alias("extra")).unionByName(clear).unionByName(few)


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = 42) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to cap times); all columns kept.

    The sample of a source ends at one place in its order, so documents are decided where they lie, by the plan and that
    place; none of them moves. Rows of one id and text are decided together: if the sample takes one of them, all.
    """
    rows, plan = _planned(docs, weights, cap, seed, None, "doc_id", "text", "source")
    place = F.struct("q", "doc_id", "size")
    last = _decided(_ranked(rows, plan)).where("extra = 1").groupBy("source").agg(F.max(place).alias("last"))
    last = materialize(last.select(F.col("source").alias("_of"), "last"), "mix-last")
    # a row for each source and level: some hundreds, or a few thousand levels of each source at most
    plan = plan.join(last, F.col("of").eqNullSafe(F.col("_of")), "left").select("of", "l", "whole", "p", "last")
    row = lambda c: F.col(f"row.`{c}`")
    own = _sized(row("doc_id"), row("source"), row("text"), F.lit(None).cast("double"), seed)
    sized = docs.select(F.struct("*").alias("row")).withColumns(own)
    joined = sized.join(F.broadcast(materialize(plan, "mix-cuts")), F.col("source").eqNullSafe(F.col("of")) & (F.col("level") == F.col("l"))).withColumn("q", _rank())
    extra = F.when(F.col("q").isNotNull() & F.col("last").isNotNull(), (place <= F.col("last")).cast("int")).otherwise(0)
    copies = F.least(F.lit(cap), F.col("whole") + extra).cast("long")
    taken = joined.withColumn("copies", copies).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighted AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
      ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
water AS (
  SELECT arg_min(level, source_size * 3 / weight) AS level FROM levels WHERE source_size * 3 > level * weight),
target AS (
  SELECT source, source_size, least(coalesce(water.level * weight, source_size * 3), source_size * 3)::DOUBLE AS target
  FROM levels, water),
plan AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM target),
levelled AS (
  SELECT *, length(bin(size + 1)) AS level, ((('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT
    + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS u FROM sized),
odds AS (
  SELECT p.source, p.source_size, p.target, whole, target - whole * source_size AS wanted, level, pow(2.0::DOUBLE, level / 2.0::DOUBLE) AS odds, sum(size) AS words
  FROM levelled s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source GROUP BY ALL),
units AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
         sum(odds * words) OVER (PARTITION BY source ORDER BY level DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weighted FROM odds),
opened AS (SELECT *, CASE WHEN weighted > 0 THEN (wanted - gone) / weighted ELSE 0 END AS unit FROM units),
firsts AS (
  SELECT *, arg_max(unit, level) FILTER (unit * odds < 1) OVER (PARTITION BY source) AS step,
         arg_max(gone, level) FILTER (unit * odds < 1) OVER (PARTITION BY source) AS sure FROM opened),
ranked AS (
  SELECT s.doc_id, s.size, f.source, source_size, target, wanted - sure AS rest,
         whole + CASE WHEN wanted > 0 AND unit * odds >= 1 THEN 1 ELSE 0 END AS copies, wanted > 0 AND unit * odds < 1 AS drawn,
         u / (1 - u) / (least(greatest(step * odds, 1e-12), 1 - 1e-12) / (1 - least(greatest(step * odds, 1e-12), 1 - 1e-12))) AS q
  FROM levelled s JOIN firsts f ON s.source IS NOT DISTINCT FROM f.source AND s.level = f.level),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, drawn ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM ranked)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, copies + CASE WHEN drawn AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
