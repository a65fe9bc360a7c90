"""Arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2sq(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2sq(a, b))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise(a: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(F.array(n), lambda d: F.transform(_c(a), lambda x: x.cast("double") / d))[0]).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def argmax(logits: Column | str) -> Column:
    """Position of the first greatest value, from 0."""
    return (F.array_position(_c(logits), F.array_max(_c(logits))) - 1).cast("int")


def log_sum_exp(values: Column) -> Column:
    most = F.array_max(values)
    return F.transform(F.array(most), lambda m: m + F.log(total(F.transform(values, lambda v: F.exp(v - m)))))[0]


METRICS = {"l2sq": l2sq, "l2": l2, "ip": dot, "cosine": cosine}
#: Metrics where more is nearer.
DESCENDING = {"ip", "cosine"}
