"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % t quantiles for n = 2..10 values; 1.96 from there on.
T_CRITICAL = {2: 12.706, 3: 4.303, 4: 3.182, 5: 2.776, 6: 2.571, 7: 2.447, 8: 2.365, 9: 2.306, 10: 2.262}


def half_up(x: Column, digits: int = 6) -> Column:
    """Rounds by floor(x * 10^d + 0.5) / 10^d, which every engine computes alike."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def t_critical(n: Column) -> Column:
    out = F.lit(1.96)
    for size, value in T_CRITICAL.items():
        out = F.when(n == size, value).otherwise(out)
    return out


def reader_unit(likert: Column) -> Column:
    """A score of 1 to 5 as 0 to 1; what is below 1 counts as 0 to 1 already."""
    return F.when(likert >= 1, (likert - 1) / 4).otherwise(likert)


def ranking_unit(likert: Column) -> Column:
    """As ``reader_unit``, held to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), reader_unit(likert)))
