"""Rounding half up to decimal digits as SQL's ``round`` does it, without a decimal number for every value."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Scaled values up to 2^40 are exact to 2^-13; nearer than this to a half the decimal expansion decides.
LARGEST = 2.0 ** 40
NEAR = 1e-3


def rounded_column(c: Column, digits: int) -> Column:
    """``round(c, digits)`` of a double column that is cheap to read."""
    scale = 10.0 ** digits
    y = c * scale
    sure = (F.abs(y) < LARGEST) & (F.abs(y - F.floor(y).cast("double") - 0.5) > NEAR)
    # adding 0 turns -0 into 0, which is what a decimal number has
    return F.when(sure, F.rint(y) / scale + F.lit(0.0)).otherwise(F.round(c, digits))


def rounded_values(x: np.ndarray, digits: int) -> np.ndarray:
    """The same for an array; NaN and infinities stay."""
    scale = 10.0 ** digits
    y = x * scale
    nearest = np.rint(y)
    out = nearest / scale + 0.0
    with np.errstate(invalid="ignore"):
        unsure = np.flatnonzero(~((np.abs(y) < LARGEST) & (np.abs(y - nearest) < 0.5 - NEAR)))
    for i in unsure:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0 if abs(x[i]) < 1e15 else x[i]
    return out
