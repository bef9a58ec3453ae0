"""Vector arithmetic on ``array<double>`` columns, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vec: Column | str) -> Column:
    """Cast a vector column to ``array<double>``."""
    return (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")


def array_sum(vec: Column | str) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda total, x: total + x)


def dot(left: Column | str, right: Column | str) -> Column:
    """Dot product of two vectors of the same width."""
    return array_sum(F.zip_with(left, right, lambda a, b: a * b))


def l2_norm(vec: Column | str) -> Column:
    return F.sqrt(array_sum(F.transform(vec, lambda x: x * x)))


def euclidean(left: Column | str, right: Column | str) -> Column:
    return l2_norm(F.zip_with(left, right, lambda a, b: a - b))


def l2_normalize(vec: Column | str) -> Column:
    """``vec / norm2(vec)``; a zero vector gives null.

    The norm is bound as the variable of an outer one-element ``transform``, so it is
    computed once per row and not once per vector element.
    """
    scaled = F.transform(
        F.array(l2_norm(vec)),
        lambda norm: F.when(norm > 0, F.transform(vec, lambda x: x / norm)),
    )
    return F.element_at(scaled, 1)


def argmax(vec: Column | str) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(vec, F.array_max(vec)) - 1).cast("int")


def one_hot(label: Column | str, n_classes: int) -> Column:
    """Indicator vector of an integer class label in ``[0, n_classes)``."""
    label = F.col(label) if isinstance(label, str) else label
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == label).cast("double")
    )


def linspace(n: int) -> Column:
    """``n`` evenly spaced values over [0, 1] as an array column."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: grid_value(k, n))


def grid_value(k: Column, n: int) -> Column:
    """The ``k``-th of ``n`` evenly spaced values over [0, 1]; the last one is exactly 1."""
    step = 1.0 / (n - 1)
    return F.when(k == n - 1, F.lit(1.0)).otherwise(k.cast("double") * F.lit(step))


def first_grid_index_at_or_above(p: Column, n: int) -> Column:
    """Smallest ``k`` with ``p <= grid_value(k)``; ``n`` when ``p`` lies above the grid.

    The arithmetic guess can be one off because ``p * (n - 1)`` rounds; it is settled by
    comparing with the neighbouring grid values themselves.
    """
    guess = F.ceil(p * (n - 1)).cast("int")
    settled = (
        F.when(p <= grid_value(guess - 1, n), guess - 1)
        .when(p > grid_value(guess, n), guess + 1)
        .otherwise(guess)
    )
    return F.when(p <= 0, F.lit(0)).when(p > 1, F.lit(n)).otherwise(settled)


def bin_index(p: Column, edges: int) -> Column:
    """Histogram bin of ``p`` for ``edges`` evenly spaced edges over [0, 1].

    Bins are closed on the left, the last one on both sides; null outside [0, 1].
    """
    bins = edges - 1
    guess = F.floor(p * bins).cast("int")
    settled = (
        F.when(p < grid_value(guess, edges), guess - 1)
        .when(p >= grid_value(guess + 1, edges), guess + 1)
        .otherwise(guess)
    )
    return F.when((p >= 0) & (p <= 1), F.least(settled, F.lit(bins - 1)))


def or_zeros(vec: Column | str, width: int) -> Column:
    """The vector, or zeros where it is missing: models score both and blank the latter."""
    return F.coalesce(vec, F.array_repeat(F.lit(0.0), width))


def blank_without(vec: str, value: Column | str) -> Column:
    """``value`` where the row has a vector, null elsewhere."""
    return F.when(F.col(vec).isNotNull(), F.col(value) if isinstance(value, str) else value)


def with_vector(df: DataFrame, vec: str, label: str) -> DataFrame:
    """The rows a model can be fitted on: those with a vector and a label."""
    return df.where(F.col(vec).isNotNull() & F.col(label).isNotNull())
