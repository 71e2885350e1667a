"""Vector algebra as column expressions, in double precision.

zip_with pads the shorter array with nulls, so functions of two vectors that may differ in dimension are
called through distance(), which checks it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import invalid

#: Accepted names of each metric.
METRIC_NAMES = {"cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "dotproduct": "dot_product", "dot": "dot_product", "inner": "dot_product", "manhattan": "manhattan", "l1": "manhattan"}
METRICS = ("cosine", "euclidean", "dot_product", "manhattan")


def parse_metric(name: str) -> str:
    """The canonical name of a metric, in any case; an error for others."""
    low = name.lower()
    if low in METRICS:
        return low
    if low not in METRIC_NAMES:
        raise invalid(f"unknown metric {name}")
    return METRIC_NAMES[low]


def metric_name(metric: str) -> str:
    """The canonical name, or `unknown`."""
    try:
        return parse_metric(metric)
    except Exception:
        return "unknown"


def literal(values: Sequence[float]) -> Column:
    """A vector constant of doubles."""
    return F.array(*[F.lit(float(x)) for x in values]) if len(values) else F.array().cast("array<double>")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def magnitude(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def normalize(v: Column) -> Column:
    """v over its magnitude; a zero vector stays as it is."""
    m = magnitude(v)
    return F.when(m > 0, F.transform(doubles(v), lambda x: x / m)).otherwise(doubles(v))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    norm = magnitude(a) * magnitude(b)
    return F.when(norm > 0, dot_product(a, b) / norm).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def dot_product_distance(a: Column, b: Column) -> Column:
    return -dot_product(a, b)


def manhattan_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


_DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean_distance, "dot_product": dot_product_distance, "manhattan": manhattan_distance}


def distance(a: Column, b: Column, metric: str = "cosine", checked: bool = True) -> Column:
    """Distance by metric; checked: vectors of different dimensions end the query with an error."""
    d = _DISTANCES[parse_metric(metric)](a, b)
    if not checked:
        return d
    return F.when(F.size(a) == F.size(b), d).otherwise(F.raise_error(F.lit("INVALID_ARGUMENT: vectors differ in dimension")).cast("double"))


def dimension(v: Column) -> Column:
    """Number of elements; 0 for null."""
    return F.coalesce(F.greatest(F.size(v), F.lit(0)), F.lit(0))


def is_empty(v: Column) -> Column:
    return dimension(v) == 0


def element(v: Column, index: int) -> Column:
    """Zero-based element; null past the end."""
    return F.get(v, F.lit(index))


def parse_csv(text: Column) -> Column:
    """`0.1,0.2` as a vector; null if any part isn't a number."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(F.exists(parts, lambda x: x.isNull()), F.lit(None)).otherwise(parts)


def to_csv(v: Column) -> Column:
    """Comma-joined elements."""
    return F.concat_ws(",", F.transform(v, lambda x: x.cast("string")))


def similarity_bar(d: Column) -> Column:
    """Width of a result's bar in percent: 100 less ten times the distance, 5 at least."""
    return F.greatest(F.lit(5.0), F.lit(100.0) - 10 * d)
