"""Vector expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity in double precision; NULL when either vector is zero or their sizes differ."""
    same_size = F.size(a) == F.size(b)
    return F.when(same_size, 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))))
