"""Vector arithmetic over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import col, let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def clipped_dot(a: Column, b: Column) -> Column:
    """The inner product, at least 0; 0 for empty vectors and for different sizes."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.greatest(F.lit(0.0), dot(a, b))).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column | str) -> Column:
    """Length 1; a zero vector stays."""
    v = col(a)
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double"))))


def most_similar(a: Column, lexicon: Column) -> Column:
    """The largest clipped product with any vector of a lexicon."""
    return F.array_max(F.transform(lexicon, lambda b: clipped_dot(a, b)))


def difference(a: Column, b: Column) -> Column:
    """struct<max_abs, max_rel, l2> between two tensors of one shape."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    relative = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) / F.greatest(F.abs(y.cast("double")), F.lit(1e-12)))
    return F.struct(F.array_max(gap).alias("max_abs"), F.array_max(relative).alias("max_rel"), F.sqrt(total(F.transform(gap, lambda x: x * x))).alias("l2"))
