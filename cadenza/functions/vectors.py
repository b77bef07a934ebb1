"""Column builders over arrays of numbers; all stay in the JVM and accumulate in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once a row, where a lambda within f would work it out for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def l2(v: Column) -> Column:
    """Unit length; the norm is floored, so that a zero vector stays zero."""
    return bound(F.greatest(norm(v), F.lit(EPS)), lambda n: F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def softmax(v: Column, temperature: float = 0.05) -> Column:
    t = max(temperature, 1e-6)
    e = bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / t)))
    return bound(e, lambda w: bound(total(w), lambda s: F.transform(w, lambda x: x / s)))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def margin(p: Column) -> Column:
    """Best minus second best; of one value, that value."""
    s = F.reverse(F.array_sort(p))
    return F.when(F.size(p) > 1, s[0] - F.try_element_at(s, F.lit(2))).otherwise(F.try_element_at(s, F.lit(1)))


def is_constant(v: Column) -> Column:
    """Aggregate: fewer than two values, or a spread below the relative tolerance."""
    return (F.count(v) < 2) | (F.stddev_pop(v) <= 1e-12 * F.max(F.abs(v)))


def bad_vectors(df: DataFrame, vec: str, width: int) -> DataFrame:
    """Rows whose vector has another width, or an element that is null or not finite."""
    return df.where((F.size(vec) != width) | F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def mean_vectors(df: DataFrame, keys: list[str], vec: str, out: str = "v") -> DataFrame:
    """The mean vector of each group, by partial aggregation per position, whatever the size of a group."""
    long = df.select(*keys, F.posexplode(doubles(F.col(vec))).alias("_p", "_x")).groupBy(*keys, "_p").agg(F.avg("_x").alias("_x"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"]).alias(out))


def ensure_finite(df: DataFrame, vec: str, width: int, key: str = "id") -> DataFrame:
    """``df`` itself, or a ValueError that names up to ten rows that `bad_vectors` finds."""
    bad = [r[0] for r in bad_vectors(df, vec, width).select(key).orderBy(key).limit(10).collect()]
    if bad:
        raise ValueError(f"vectors that are not {width} finite numbers, first at {key} {bad}")
    return df
