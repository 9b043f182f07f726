"""Vector functions (V1)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; NULL for a NULL or zero vector, or unequal widths."""
    similarity = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(F.size(a) == F.size(b), F.lit(1.0) - similarity)


def distance_to(a: Column, vector: list[float]) -> Column:
    """Cosine distance to a fixed vector, whose length is worked out once."""
    length = math.sqrt(sum(v * v for v in vector))
    if not length:
        return F.lit(None).cast("double")
    unit = F.array(*[F.lit(v / length) for v in vector])
    distance = F.lit(1.0) - F.try_divide(dot(a, unit), norm(a))
    return F.when(F.size(a) == len(vector), distance)
