"""Bounded samples of labelled rows for fitting; the draw depends on the rows alone, so a lost task draws the same again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def thinned(df: DataFrame, limit: int, group: str, *key: str) -> DataFrame:
    """About `limit` rows of every value of `group` (all, if it has fewer), drawn by a hash of the key columns."""
    counts = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("draw"), *key), F.lit(_STEPS))
    if all(n <= limit for n in counts.values()):
        return df
    keep: Column = F.lit(False)
    for value, n in counts.items():
        keep = keep | (F.col(group).eqNullSafe(F.lit(value)) & (draw < int(_STEPS * min(1.0, limit / n))))
    return df.where(keep)
