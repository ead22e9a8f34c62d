"""Bounded, reproducible samples for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
_RANGE = 1 << 30


def fold(id_column: Column) -> Column:
    """CRC-32 of the id as text, modulo 5; a null id counts as empty text."""
    return (F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def thin(df: DataFrame, id_col: str, limit: int, rows: int, salt: int) -> DataFrame:
    """About ``limit`` of ``rows`` rows, chosen by a hash of the id, and at most ``limit``.

    The hash threshold is set from the row count, so no task sorts or gathers
    more than the sample.
    """
    if rows <= limit:
        return df.limit(limit)
    share = int(_RANGE * 0.95 * limit / rows)
    return df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(_RANGE)) < share).limit(limit)
