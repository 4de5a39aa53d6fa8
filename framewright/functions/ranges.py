"""Range predicates over ordered doubles: strict order of signed zeros, one-sided and unbounded ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, null if NaN or infinite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c)


def ordered_range(c: Column, lo: float | None, hi: float | None) -> Column:
    """lo <= c <= hi with c present. None and non-finite bounds are open on their side.

    -0.0 is below 0.0: a lower bound of +0.0 leaves stored -0.0 out, as an upper bound of -0.0 leaves 0.0 out.
    """
    negative_zero = c.cast("string") == "-0.0"  # not with c == 0: the optimizer would put 0.0 in its place
    p = c.isNotNull()
    if lo is not None and math.isfinite(lo):
        p = p & (c >= F.lit(float(lo)))
        if lo == 0 and math.copysign(1, lo) > 0:
            p = p & ~negative_zero
    if hi is not None and math.isfinite(hi):
        p = p & (c <= F.lit(float(hi)))
        if hi == 0 and math.copysign(1, hi) < 0:
            p = p & ~(c.cast("string") == "0.0")
    return p
