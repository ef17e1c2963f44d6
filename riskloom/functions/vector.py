"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _as_double(col: Column) -> Column:
    return col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_as_double(a), _as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; NULL if a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def measurable(a: Column, width: int | None = None) -> Column:
    """Whether a vector has a direction: finite, not all zero and of the given width."""
    values = _as_double(a)
    finite = F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = finite & F.exists(values, lambda x: x != 0)
    return F.coalesce(fits if width is None else fits & (F.size(a) == width), F.lit(False))
