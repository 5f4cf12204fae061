"""Vector functions in double precision, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this width the products are written out, so that they stay inside generated code.
UNROLLED = 128


def literal(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector])


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    if not isinstance(b, Column):
        if len(b) <= UNROLLED:
            return sum((F.get(a, F.lit(i)).cast("double") * F.lit(float(x)) for i, x in enumerate(b)), F.lit(0.0))
        b = literal(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column | Sequence[float]) -> Column:
    """1 - cosine; null where either vector is null, empty or zero."""
    if isinstance(b, Column):
        other = F.sqrt(dot(b, b))
    else:
        other = F.lit(sum(float(x) ** 2 for x in b) ** 0.5)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) * other
    return 1 - dot(a, b) / F.nullif(norm, F.lit(0.0))
