"""A blocked Bloom filter of keys seen at least twice, built and probed without moving the rows that hold them.

All cells of a key lie in one block of the filter. Keys travel to the task that owns their block, which sets two bitmaps: cells
set once and cells set again. A key that occurs twice sets all its cells twice, so there are no false negatives. Unrelated
keys may collide, which only sends some unique rows along with the repeated ones. The number of blocks is in proportion to
the keys. Blocks are written to shared storage; a segment of at most SEGMENT blocks is broadcast at a time, and callers
with more keys than one segment holds pass over their rows segment by segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK_BITS = 1 << 20
BITS_PER_KEY = 16
HASHES = 4
#: Blocks that are broadcast together: 32 MiB, for about 17 million keys.
SEGMENT = 256


def n_blocks(n_keys: int) -> int:
    return max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))


def n_segments(n_keys: int) -> int:
    return -(-n_blocks(n_keys) // SEGMENT)


def one_segment(n_keys: int) -> int:
    """n_keys, or as many as one segment is made for."""
    return min(n_keys, SEGMENT * BLOCK_BITS // BITS_PER_KEY)


def _mix(keys: np.ndarray) -> np.ndarray:
    a = keys.astype(np.uint64)
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (a ^ (a >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def block_of(key: Column, blocks: int) -> Column:
    """The block of a key, which is a 64-bit hash."""
    return F.coalesce(F.pmod(key.cast("long"), F.lit(blocks)), F.lit(0)).cast("int")


def segment_of(key: Column, blocks: int) -> Column:
    return F.floor(block_of(key, blocks) / SEGMENT).cast("int")


def cells(keys: np.ndarray, bits: int) -> np.ndarray:
    """HASHES rows of cell numbers in the keys' blocks of so many bits (double hashing over the mixed key)."""
    a = _mix(keys)
    b = (a >> np.uint64(32)) | np.uint64(1)
    i = np.arange(HASHES, dtype=np.uint64)[:, None]
    return (a[None, :] + i * b[None, :]) & np.uint64(bits - 1)


def repeated_blocks(keys: DataFrame, n_keys: int) -> DataFrame:
    """(block, again): compressed bitmaps of the cells set at least twice, over the column k of keys (64-bit hashes); nulls are skipped.

    n_keys sizes the filter; a wrong count costs only precision. A key that many rows of a batch share travels once.
    """
    blocks, bits = n_blocks(n_keys), BLOCK_BITS

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k, n = np.unique(pdf["k"].dropna().to_numpy(np.int64), return_counts=True)
            yield pd.DataFrame({"k": k, "twice": n > 1})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        k = np.concatenate((pdf["k"].to_numpy(np.int64), pdf.loc[pdf["twice"], "k"].to_numpy(np.int64)))
        # the cells of one key may coincide, which counts as a second setting: a false positive at worst
        cell, n = np.unique(cells(k, bits), return_counts=True)
        byte, mask = (cell >> np.uint64(3)).astype(np.int64), (128 >> (cell & np.uint64(7)).astype(np.int64)).astype(np.uint8)
        np.bitwise_or.at(once, byte, mask)
        np.bitwise_or.at(again, byte, np.where(n > 1, mask, np.uint8(0)))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "again": [zlib.compress(again.tobytes(), 1)]})

    seen = keys.select(F.col("k").cast("long").alias("k")).mapInPandas(distinct, "k long, twice boolean")
    seen = seen.withColumn("block", block_of(F.col("k"), blocks))
    return materialize(seen.groupBy("block").applyInPandas(lambda pdf: fill(pdf), "block int, again binary"), "bloom")


@dataclass(frozen=True)
class Filter:
    """One segment of a filter: how many blocks the whole filter has, the first of this segment, and the bits of a block."""

    blocks: int
    first: int
    bits: int
    bitmap: Broadcast

    def again(self, keys: np.ndarray) -> np.ndarray:
        """True where all cells of a key are set in its block, which must lie in this segment."""
        words = np.frombuffer(self.bitmap.value, np.uint8)
        at = cells(keys, self.bits).astype(np.int64) + (np.mod(keys, self.blocks) - self.first) * self.bits
        return ((words[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def load(table: DataFrame, n_keys: int, segment: int = 0) -> Filter:
    """A segment of the filter on every executor: at most SEGMENT blocks, which pass through the driver."""
    blocks, first = n_blocks(n_keys), segment * SEGMENT
    size = BLOCK_BITS // 8
    bitmap = np.zeros(min(SEGMENT, blocks - first) * size, np.uint8)
    for row in table.where((F.col("block") >= first) & (F.col("block") < first + SEGMENT)).collect():
        at = (row.block - first) * size
        bitmap[at : at + size] = np.frombuffer(zlib.decompress(bytes(row.again)), np.uint8)
    return Filter(blocks, first, BLOCK_BITS, table.sparkSession.sparkContext.broadcast(bitmap.tobytes()))


def member_filter(keys: DataFrame, key: str) -> Filter:
    """A filter that the keys of a table pass, and few others. It has one segment: beyond what that is made for more others pass."""
    k = keys.select(F.col(key).alias("k"))
    n_keys = one_segment(k.count())
    return load(repeated_blocks(k.union(k), n_keys), n_keys)


def maybe_repeated(key: Column, filt: Filter) -> Column:
    """False only where the key certainly occurs once; null keys count as possibly repeated. Keys are of filt's segment."""

    @F.pandas_udf("boolean")
    def probe(s: pd.Series) -> pd.Series:
        out = np.ones(len(s), bool)
        ok = s.notna().to_numpy()
        out[ok] = filt.again(s[ok].to_numpy(np.int64))
        return pd.Series(out)

    return probe(key)


def split_rows(rows: DataFrame, key: str, n_keys: int, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """each(rows with a column again) for all rows: again is false only where the row's key certainly occurs once.

    More keys than one segment holds: the rows are dealt to folders by segment once, and every segment is filtered and written
    by itself, so that neither the broadcast nor the share of rows that pass straight through depends on the corpus's size.
    """
    n, blocks = n_segments(n_keys), n_blocks(n_keys)
    table = repeated_blocks(rows.select(F.col(key).alias("k")), n_keys)
    if n == 1:
        return each(rows.withColumn("again", maybe_repeated(F.col(key), load(table, n_keys))))
    dealt = materialize(rows.withColumn("_segment", segment_of(F.col(key), blocks)), "bloom-dealt", "_segment")
    parts = []
    for i in range(n):
        filt = load(table, n_keys, i)
        part = dealt.where(F.col("_segment") == i).drop("_segment").withColumn("again", maybe_repeated(F.col(key), filt))
        parts.append(materialize(each(part), "bloom-part"))
        filt.bitmap.unpersist()
    return reduce(DataFrame.unionByName, parts)
