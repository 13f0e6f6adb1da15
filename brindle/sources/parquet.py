"""Parquet tables against a declared schema; only declared columns are read."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.features import CATEGORICAL, NUMERICAL, quoted


class SchemaError(ValueError):
    pass


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """The table; names are told apart by case, and nanosecond times come as microseconds."""
    if not str(path).lower().rstrip("/").endswith(".parquet"):
        raise SchemaError(f"{path}: a .parquet table is expected")
    spark.conf.set("spark.sql.caseSensitive", "true")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    return spark.read.parquet(path)


def _fits(kind: str, t: T.DataType) -> bool:
    if kind == NUMERICAL:
        return isinstance(t, (T.NumericType, T.BooleanType, T.NullType))
    return isinstance(t, (T.IntegralType, T.FractionalType, T.StringType, T.BinaryType, T.BooleanType, T.NullType))


def declared(df: DataFrame, target: str, features: dict[str, str], context: list[str] = (), ignore: list[str] = (), strict: bool = True, order: str | None = None) -> DataFrame:
    """The declared columns, after checks of names and types; ``order`` adds the file's row order under that name."""
    names = df.columns
    wanted = list(dict.fromkeys([target, *features, *[c for c in context if c]]))
    lost = [c for c in wanted if c not in names]
    if lost:
        near = {c: difflib.get_close_matches(c, names, 3) for c in lost}
        raise SchemaError(f"columns that are not in the table, with names like them: {near}")
    extra = sorted(set(names) - set(wanted) - set(ignore))
    if strict and extra:
        raise SchemaError(f"columns that are neither declared nor ignored: {extra}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wrong = {c: kinds[c].simpleString() for c, k in features.items() if not _fits(k, kinds[c])}
    if wrong:
        raise SchemaError(f"types that do not fit the declared features: {wrong}")
    cols = [_plain(quoted(c), features.get(c), kinds[c]).alias(c) for c in wanted]
    if order:
        cols.append(F.monotonically_increasing_id().alias(order))
    return df.select(*cols)


def _plain(c: Column, kind: str | None, t: T.DataType) -> Column:
    if kind == CATEGORICAL and isinstance(t, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c


def check_target(df: DataFrame, target: str, both: bool = True) -> None:
    """One aggregate: rows there are, the target is 0 or 1 in each, and both occur."""
    y = quoted(target)
    number = y.cast("double")
    rows, null, other, zero, one = df.agg(F.count("*"), F.count_if(y.isNull()), F.count_if(y.isNotNull() & ~F.coalesce(number.isin(0.0, 1.0), F.lit(False))), F.count_if(number == 0), F.count_if(number == 1)).first()
    if not rows:
        raise SchemaError("the table has no rows")
    if null or other:
        raise SchemaError(f"{target} must be 0 or 1: {null} rows are null and {other} hold something else")
    if both and not (zero and one):
        raise SchemaError(f"{target} must have both classes: {zero} rows of 0, {one} of 1")


def validation(df: DataFrame, target: str, features: dict[str, str]) -> DataFrame:
    """What the checks count, as one row per column: rows, nulls, NaN, infinite, distinct values."""
    from brindle.operators.features import long_levels

    numbers = [n for n, k in features.items() if k == NUMERICAL]
    bad = F.lit(False)
    x = long_levels(df, [target, *features])
    v = F.when(F.col("feature").isin(numbers), F.col("level").try_cast("double")) if numbers else F.lit(None).cast("double")
    return x.groupBy("feature").agg(F.count("*").alias("rows"), F.count_if(F.col("level").isNull()).alias("nulls"), F.count_if(F.coalesce(F.isnan(v), bad)).alias("nans"), F.count_if(F.coalesce(F.abs(v) == float("inf"), bad)).alias("infinities"), F.count_distinct("level").alias("distinct_values"))
