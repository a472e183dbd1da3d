"""Place of a value among sorted bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounds_below(value: Column, bounds: list[float]) -> Column:
    """Number of bounds below the value, by two searches over arrays of about the root of their number."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def below(column):
        return F.size(F.filter(column, lambda b: b < value))

    def listed(values):
        return F.array(*[F.lit(v) for v in values])

    coarse = F.least(below(listed([p[-1] for p in parts])), F.lit(len(parts) - 1))
    return coarse * width + below(F.element_at(F.array(*[listed(p) for p in parts]), coarse + 1))
