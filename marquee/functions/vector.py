"""Numeric and vector expressions (X12-X17) on array columns, JVM-side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(u, v) -> Column:
    """Dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_c(u), _c(v), lambda a, b: a * b),
                       F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(u) -> Column:
    return F.sqrt(F.aggregate(_c(u), F.lit(0.0).cast("double"), lambda s, x: s + x * x))


def unit(u) -> Column:
    """L2-normalised array (zero vector stays zero)."""
    n = norm(u)
    return F.transform(_c(u), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def clip(x, lo: float, hi: float) -> Column:
    """X13, of a column or a numpy array (NaN: ``hi``, as in Spark)."""
    if isinstance(x, np.ndarray):
        return np.fmax(lo, np.fmin(hi, x))
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def z_to_unit(z) -> Column:
    """Z-score mapped to [0, 1] by (z + 3) / 6, clamped."""
    return clip(((F.col(z) if isinstance(z, str) else z) + 3.0) / 6.0, 0.0, 1.0)


def r6(x) -> Column:
    """Round to 6 decimals (the precision every oracle comparison uses)."""
    return F.round(_c(x).cast("double"), 6)
