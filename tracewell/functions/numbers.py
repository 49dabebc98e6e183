"""Expressions and aggregates over numbers: missing is not zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_sum(c: Column) -> Column:
    """The sum, or null if a value is null or there is none."""
    return F.when((F.count(F.lit(1)) > 0) & (F.count(F.lit(1)) == F.count(c)), F.sum(c))


def wilson_low(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval of k successes in n; 0 for none."""
    p = k / n
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, low).otherwise(0.0)


def bucket(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width bucket from 0; the greatest value lies in the last one; one bucket if all are equal."""
    return F.when(hi > lo, F.least(F.lit(n - 1), F.floor((v - lo) / ((hi - lo) / n)))).otherwise(0).cast("long")
