"""Column expressions shared by the operators; all stay in the JVM and none divides by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution: a fixed value.
Z95 = 1.959963984540054


def usable(c: Column) -> Column:
    """The value as double, null where it is null, NaN or infinite, so that aggregates skip it."""
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def is_missing(c: Column) -> Column:
    d = c.cast("double")
    return d.isNull() | F.isnan(d)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def share(condition: Column) -> Column:
    """Aggregate: the share of true among non-null."""
    return F.avg(condition.cast("double"))


def wilson(positives: Column, rows: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of a rate, clipped to 0..1; null without rows."""
    n, p = rows.cast("double"), ratio(positives, rows)
    scale = 1 + ratio(F.lit(z * z), n)
    middle = (p + ratio(F.lit(z * z / 2), n)) / scale
    half = z * F.sqrt(ratio(p * (1 - p), n) + ratio(F.lit(z * z / 4), n * n)) / scale
    clip = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return clip(middle - half), clip(middle + half)


def adjusted_skewness(v: Column) -> Column:
    """Aggregate: Fisher-Pearson skewness with the sample correction; null under 3 values or without spread."""
    n = F.count(v).cast("double")
    return F.when((n >= 3) & (F.min(v) < F.max(v)), ratio(F.skewness(v) * F.sqrt(n * (n - 1)), n - 2))


def adjusted_kurtosis(v: Column) -> Column:
    """Aggregate: excess kurtosis with the sample correction; null under 4 values or without spread."""
    n = F.count(v).cast("double")
    return F.when((n > 3) & (F.min(v) < F.max(v)), ratio((n - 1) * ((n + 1) * F.kurtosis(v) + 6), (n - 2) * (n - 3)))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson over pairs where both are there; null under 3 pairs or without spread on a side.

    From centred moments that Spark keeps for covariance and variance; where a side is null both are.
    """
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    degenerate = (F.count(a) < 3) | (F.min(a) >= F.max(a)) | (F.min(b) >= F.max(b))
    return F.when(~degenerate, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.covar_pop(a, b), spread))))


def xlogx(p: Column) -> Column:
    return F.when(p > 0, p * F.ln(p)).otherwise(0.0)
