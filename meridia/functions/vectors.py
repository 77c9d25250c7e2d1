"""Vector functions over ``array<float|double>`` columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import once


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(a: Column) -> Column:
    """Null elements for a zero vector, never an error."""
    return once(norm(a), lambda n: F.transform(a, lambda x: F.try_divide(x.cast("double"), n)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def softmax(a: Column) -> Column:
    shifted = once(F.array_max(a).cast("double"), lambda most: F.transform(a, lambda x: F.exp(x.cast("double") - most)))
    return once(shifted, lambda s: once(_sum(s), lambda total: F.transform(s, lambda x: x / total)))


def argmax(a: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def fuse(image: Column, text: Column, how: str) -> Column:
    """``concat``, ``image``, ``text`` or ``mult``; a product needs equal lengths."""
    if how == "concat":
        return F.concat(image, text)
    if how in ("image", "text"):
        return image if how == "image" else text
    if how == "mult":
        fits = F.size(image) == F.size(text)
        return F.when(fits, F.zip_with(image, text, lambda x, y: x.cast("double") * y.cast("double"))).otherwise(F.raise_error(F.lit("dimensions differ")))
    raise ValueError(f"unknown fusion {how!r}")


def entropy_bits(p: Column) -> Column:
    """Shannon entropy with probabilities clipped to [1e-15, 1]."""
    clip = F.transform(p, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(1e-15), x.cast("double"))))
    return -_sum(F.transform(clip, lambda x: x * F.log2(x)))


def margin(p: Column) -> Column:
    """Difference of the two largest probabilities."""
    ordered = F.sort_array(p, asc=False)
    return (F.try_element_at(ordered, F.lit(1)) - F.coalesce(F.try_element_at(ordered, F.lit(2)), F.lit(0.0))).cast("double")
