"""The held-out fold that learned operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; a row without an id counts as held out (0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0))


def held_out(id_col: str) -> Column:
    return fold(id_col) == 0
