"""Vector functions as column expressions; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors up to so many dimensions are summed by one generated expression instead of a loop over lambdas.
UNROLLED = 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_with(a: Column, vector: list[float]) -> Column:
    """Product with a vector known to the driver."""
    if len(vector) > UNROLLED:
        return dot(a, F.array(*[F.lit(float(x)) for x in vector]))
    out = F.lit(0.0)
    for i, x in enumerate(vector):
        out = out + F.get(a, F.lit(i)).cast("double") * F.lit(float(x))
    return out


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _cosine(product: Column, squares: Column) -> Column:
    """One root of the product of both squared lengths, not a product of two roots: equal vectors give exactly 1, so
    rows that all equal their query tie, and go by the order that follows."""
    ratio = product / F.nullif(F.sqrt(squares), F.lit(0.0))
    return F.when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))  # these two pass over nulls


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is null or zero."""
    return _cosine(dot(a, b), dot(a, a) * dot(b, b))


def cosine_with(a: Column, vector: list[float]) -> Column:
    """Cosine with a vector known to the driver; null if either is null or zero."""
    square = 0.0
    for x in vector:  # one after another, as dot() adds; sum() would round otherwise
        square += float(x) * float(x)
    return _cosine(dot_with(a, vector), dot(a, a) * F.lit(square))


def normalized(a: Column) -> Column:
    """Unit length, as float; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(a)


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def confidence(similarity: Column) -> Column:
    """Similarity of -1 to 1 as 0 to 1; no similarity counts as 0."""
    return clip((F.coalesce(similarity, F.lit(0.0)) + 1) / 2)


def store_score(similarity: Column) -> Column:
    return F.round(clip(similarity), 4)
