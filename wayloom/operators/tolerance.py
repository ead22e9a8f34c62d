"""Rows that count as equal when a value is closer than a tolerance.

Values lie in cells four tolerances wide. Whatever is closer to a value than
the tolerance lies in the cell of the value less the tolerance or in that of
the value and the tolerance, two neighbours at most: rounding is monotone,
and so are sums and quotients of doubles. So rows meet by key and cell, and a
key with very many values costs no more than its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import written
from ..shipping import ship

#: Undecided rows that are scanned in order, one group a key, instead of in rounds.
SCAN_ROWS = 100_000


def _cell(value: Column, tolerance: float) -> Column:
    return F.rint(value / F.lit(4.0 * tolerance))


def _reach(value: Column, tolerance: float) -> Column:
    """Cells with all values that are closer than the tolerance."""
    return F.array_distinct(F.array(_cell(value - tolerance, tolerance), _cell(value + tolerance, tolerance)))


def tolerance_anti(df: DataFrame, existing: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows without an existing one of equal key and a value closer than a tolerance.

    A null key or value and one that isn't finite is close to nothing.
    """
    there = existing.select(F.col(key).alias("__key"), F.col(value).cast("double").alias("__value"))
    there = there.withColumn("__cell", F.explode(_reach(F.col("__value"), tolerance)))
    mine = df[value].cast("double")
    close = (df[key] == there["__key"]) & (_cell(mine, tolerance) == there["__cell"]) & (F.abs(mine - there["__value"]) < tolerance)
    return df.join(there, close, "left_anti")


def first_within(df: DataFrame, key: str, value: str, order: Sequence[str], tolerance: float = 1e-6, *, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """Rows as a loop in ``order`` would append them: each unless an appended one of its key is closer than the tolerance.

    Closeness isn't transitive: of 1.0, 1.0 + 0.6 t and 1.0 + 1.2 t the first
    and the last stay. Rows are decided in rounds. A row that comes before all
    undecided rows in its reach stays, which the first of each cell tells, and
    then what is close to it goes. Once few rows are undecided they are
    scanned in order, key by key. Rounds are few where values come in any
    order; a run of values that rises with the order takes one round a cell.

    ``order`` has to tell the rows apart. Rows whose key or value is null or
    whose value isn't finite are close to nothing: all of them stay. The first
    of rows with equal key and value is the only one of them that can stay.
    """
    ship(df.sparkSession)
    number = F.col(value).cast("double")
    comparable = F.coalesce(F.col(key).isNotNull() & (F.abs(number) < float("inf")), F.lit(False))
    place = F.struct(*order)
    row = F.struct(*[F.col(c) for c in df.columns])
    firsts = df.where(comparable).groupBy(F.col(key).alias("k"), (number + 0.0).alias("v")).agg(F.min(place).alias("at"), F.min_by(row, place).alias("row"))
    firsts = written(firsts.withColumn("c", _cell(F.col("v"), tolerance)), "tolerance-rows")
    undecided, stay = firsts.select("k", "v", "at", "c"), []
    while undecided.count() > scan_rows:
        heads = written(undecided.groupBy("k", "c").agg(F.min(F.struct("at", "v")).alias("head")).select("k", "c", "head.at", "head.v"), "tolerance-heads")
        reach = heads.withColumn("n", F.explode(_reach(F.col("v"), tolerance))).where("n <> c")
        beside = heads.select("k", F.col("c").alias("n"), F.col("at").alias("other"))
        behind = reach.join(beside, ["k", "n"]).where("other < at").select("k", "c")
        chosen = written(heads.join(behind, ["k", "c"], "left_anti").select("k", "v"), "tolerance-chosen")
        stay.append(chosen)
        undecided = written(tolerance_anti(undecided, chosen, "k", "v", tolerance), "tolerance-undecided")

    def in_order(group: pd.DataFrame) -> pd.DataFrame:
        group, cells, keep = group.sort_values("i"), {}, []
        v = group["v"].to_numpy()
        low, here, high = (np.rint((v + x) / (4.0 * tolerance)) for x in (-tolerance, 0.0, tolerance))
        for k in range(len(v)):
            near = (w for c in {low[k], high[k]} for w in cells.get(c, ()))
            if not any(abs(v[k] - w) < tolerance for w in near):
                keep.append(k)
                cells.setdefault(here[k], []).append(v[k])
        return group[["k", "v"]].iloc[keep]

    kind = firsts.schema["k"].dataType.simpleString()
    numbered = undecided.select("k", "v", F.row_number().over(Window.partitionBy("k").orderBy("at")).alias("i"))
    scanned = numbered.groupBy("k").applyInPandas(in_order, f"k {kind}, v double")
    for part in stay:
        scanned = scanned.unionByName(part)
    kept = firsts.join(scanned, ["k", "v"], "left_semi").select("row.*")
    return kept.unionByName(df.where(~comparable))


def upsert_append(existing: DataFrame, new: DataFrame, key: str, value: str, order: Sequence[str], tolerance: float = 1e-6, *, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """Existing rows and, in ``order``, each new one that is not within a tolerance of an existing or an appended one of its key."""
    fresh = tolerance_anti(new, existing, key, value, tolerance)
    return existing.unionByName(first_within(fresh, key, value, order, tolerance, scan_rows=scan_rows))
