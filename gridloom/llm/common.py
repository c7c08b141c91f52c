"""Helpers that several operators share: scratch tables, table access, byte-level text rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.scratch import root as scratch_root
from ..plans.scratch import written as materialize

__all__ = ["LOWER_BYTES", "WORD", "lower_ascii", "materialize", "scratch_root", "sliced", "utf8"]

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: lower-cases A-Z and leaves all other bytes.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def sliced(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Arrow batches in parts of so many rows: what a worker makes of whole texts is bounded by a part, not by the batch."""
    for pdf in batches:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i : i + rows]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
