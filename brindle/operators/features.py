"""Full-data profiles and buckets of declared features.

Features go in long form: one scan, a row per feature, and aggregates by feature that are
combined on the map side, so a table of any width and length is read once for each step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.columns import adjusted_kurtosis, adjusted_skewness, is_missing, ratio, share, usable
from brindle.operators.quantiles import CELLS, ends_of, exact_quantiles, first_cells

NUMERICAL, CATEGORICAL = "numerical", "categorical"
PROBABILITIES = {"min": 0.0, "p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "max": 1.0}
MISSING, OTHER = 0, 1


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def long_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, raw double, v double): raw as stored, v null where it is not finite."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), quoted(n).cast("double").alias("raw")) for n in names])).alias("r")
    return df.select(rows).select("r.feature", "r.raw", usable(F.col("r.raw")).alias("v"))


def long_levels(df: DataFrame, names: list[str], order: str | None = None) -> DataFrame:
    """(feature, level string, place): place is the column ``order`` (row order) or null."""
    place = quoted(order).cast("long") if order else F.lit(None).cast("long")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), quoted(n).cast("string").alias("level"), place.alias("place")) for n in names])).alias("r")
    return df.select(rows).select("r.*")


#: The columns of each switchable metric of a numerical profile.
NUMERIC_METRICS: dict[str, list[str]] = {
    "mean": ["mean"],
    "std": ["std"],
    "median": ["median"],
    "quantiles": list(PROBABILITIES),
    "iqr": ["iqr"],
    "mad": ["mad_unscaled"],
    "skewness": ["skewness"],
    "kurtosis": ["excess_kurtosis"],
    "zero_fraction": ["zero_fraction_finite"],
    "negative_fraction": ["negative_fraction_finite"],
    "outlier_fraction": ["iqr_outlier_fraction"],
}
CATEGORY_METRICS: dict[str, list[str]] = {
    "entropy": ["entropy_nats_nonmissing", "effective_levels_nonmissing"],
    "rare_categories": ["singleton_levels", "rare_levels", "rare_row_fraction"],
}


def numeric_profile(df: DataFrame, names: list[str], metrics: set[str] | None = None) -> DataFrame:
    """One row per feature: counts, distinct and dominant values, and the metrics asked for (all by default).

    A metric that is off adds no expression to the plan.  Without a finite value, metrics are null.
    """
    on = set(NUMERIC_METRICS) if metrics is None else metrics
    values = long_numbers(df, names)
    v = F.col("v")
    sums = {
        "rows": F.count("*"),
        "finite_count": F.count(v),
        "missing_count": F.count_if(is_missing(F.col("raw"))),
        "missing_fraction": share(is_missing(F.col("raw"))),
        "nonfinite_nonmissing_count": F.count_if(v.isNull() & ~is_missing(F.col("raw"))),
        "unusable_fraction": share(v.isNull()),
    }
    switched = {
        "zero_fraction": ("zero_fraction_finite", share(v == 0)),
        "negative_fraction": ("negative_fraction_finite", share(v < 0)),
        "mean": ("mean", F.avg(v)),
        "std": ("std", F.stddev_samp(v)),
        "skewness": ("skewness", adjusted_skewness(v)),
        "kurtosis": ("excess_kurtosis", adjusted_kurtosis(v)),
    }
    sums |= dict(c for m, c in switched.items() if m in on)
    out = values.groupBy("feature").agg(*[c.alias(n) for n, c in sums.items()])
    # distinct values are counted by (feature, value), which any number of tasks share
    levels = values.where("v is not null").groupBy("feature", "v").agg(F.count("*").alias("n"))
    most = levels.groupBy("feature").agg(F.count("*").alias("unique_nonmissing"), F.max("n").alias("most"))
    out = out.join(most, "feature", "left").withColumns({"unique_nonmissing": F.coalesce("unique_nonmissing", F.lit(0)), "dominant_fraction_nonmissing": ratio(F.col("most"), F.col("finite_count"))}).drop("most")
    if on & {"median", "quantiles", "iqr", "mad", "outlier_fraction"}:
        out = _with_quantiles(df, out, values, names, on)
    return out


def _with_quantiles(df: DataFrame, out: DataFrame, values: DataFrame, names: list[str], on: set[str]) -> DataFrame:
    there = values.where("v is not null").select("feature", "v")
    q = exact_quantiles(there, list(PROBABILITIES.values()))
    at = {f: dict(zip(PROBABILITIES, x, strict=True)) for f, x in q.items()}
    rows = {n: {} for n in names}
    for n, x in at.items():
        rows[n] = {"median": x["p50"], **x, "iqr": x["p75"] - x["p25"]}
    pick = lambda key: F.coalesce(*[F.when(F.col("feature") == n, F.lit(r[key])) for n, r in rows.items() if r], F.lit(None).cast("double"))
    if at and "mad" in on:
        away = there.select("feature", F.abs(F.col("v") - pick("p50")).alias("v"))
        for n, (m,) in exact_quantiles(away, [0.5]).items():
            rows[n]["mad_unscaled"] = m
    if at and "outlier_fraction" in on:
        low, high = pick("p25") - 1.5 * pick("iqr"), pick("p75") + 1.5 * pick("iqr")
        for r in there.groupBy("feature").agg(share((F.col("v") < low) | (F.col("v") > high)).alias("x")).collect():
            rows[r["feature"]]["iqr_outlier_fraction"] = r["x"]
    columns = [c for m in ("median", "quantiles", "iqr", "mad", "outlier_fraction") if m in on for c in NUMERIC_METRICS[m]]
    schema = "feature string, " + ", ".join(f"`{c}` double" for c in columns)
    table = df.sparkSession.createDataFrame([(n, *[rows[n].get(c) for c in columns]) for n in names], schema)
    return out.join(F.broadcast(table), "feature")  # one row per feature


@dataclass
class Pooling:
    """The levels of a categorical feature that keep a bucket of their own, in order, and how many are pooled."""

    kept: list[str]
    pooled_levels: int
    labels: dict[int, str] = field(default_factory=dict)


def level_counts(df: DataFrame, names: list[str], order: str | None = None) -> DataFrame:
    """(feature, level, n, place), non-null levels; place is where a level is first seen, if rows have an order."""
    return long_levels(df, names, order).where("level is not null").groupBy("feature", "level").agg(F.count("*").alias("n"), F.min("place").alias("place"))


#: Parts of a feature's levels that are ranked apart before the last ranking.
SALTS = 64


def top_levels(counts: DataFrame, rare_min_count: int, max_categories: int) -> DataFrame:
    """(feature, level, n, place, rank) of levels of at least ``rare_min_count`` rows, the most frequent ``max_categories``.

    Levels are ranked within salted parts first, so an identifier with any number of levels
    sends no more than ``SALTS * max_categories`` of them to one task.
    """
    order = (F.desc("n"), F.asc_nulls_last("place"), "level")
    salt = F.pmod(F.xxhash64("level"), F.lit(SALTS))
    part = F.row_number().over(Window.partitionBy("feature", "salt").orderBy(*order))
    some = counts.where(F.col("n") >= rare_min_count).withColumn("salt", salt).withColumn("rank", part).where(F.col("rank") <= max_categories)
    whole = F.row_number().over(Window.partitionBy("feature").orderBy(*order))
    return some.drop("salt").withColumn("rank", whole).where(F.col("rank") <= max_categories)


def pool_levels(counts: DataFrame, names: list[str], rare_min_count: int = 100, max_categories: int = 20) -> dict[str, Pooling]:
    """By feature: the levels that keep a bucket; ties go by first row, then by value."""
    # at most max_categories rows per feature, and one count
    top = top_levels(counts, rare_min_count, max_categories).orderBy("feature", "rank").collect()
    levels = {r["feature"]: r["k"] for r in counts.groupBy("feature").agg(F.count("*").alias("k")).collect()}
    out = {}
    for n in names:
        kept = [r["level"] for r in top if r["feature"] == n]
        pooled = levels.get(n, 0) - len(kept)
        labels = {MISSING: "[missing]", OTHER: f"[other: {pooled} pooled levels]"} | {i + 2: f"value: {x}" for i, x in enumerate(kept)}
        out[n] = Pooling(kept, pooled, labels)
    return out


def category_code(c: Column, pooling: Pooling) -> Column:
    """0 for null, 1 for pooled levels, 2 and up for kept ones; a literal ``[missing]`` is a level like others."""
    level = c.cast("string")
    code = F.lit(OTHER)
    if pooling.kept:
        codes = F.create_map(*[F.lit(x) for i, k in enumerate(pooling.kept) for x in (k, i + 2)])
        code = F.coalesce(F.try_element_at(codes, level), F.lit(OTHER))
    return F.when(level.isNull(), F.lit(MISSING)).otherwise(code).cast("int")


def categorical_profile(df: DataFrame, names: list[str], rare_min_count: int = 100, max_categories: int = 20, metrics: set[str] | None = None) -> DataFrame:
    """One row per feature, from its original levels before pooling."""
    on = set(CATEGORY_METRICS) if metrics is None else metrics
    counts = level_counts(df, names)
    n = F.col("n")
    rare = n < rare_min_count
    sums = {
        "unique_nonmissing": F.count("*"),
        "total": F.sum(n),
        "dominant": F.max(n),
        # entropy from sums that need no total beforehand
        "nlogn": F.sum(n * F.ln(n)),
        "singleton_levels": F.count_if(n == 1),
        "rare_levels": F.count_if(rare),
        "rare_rows": F.coalesce(F.sum(F.when(rare, n)), F.lit(0)),
    }
    by = counts.groupBy("feature").agg(*[c.alias(k) for k, c in sums.items()])
    by = by.withColumn("entropy", F.ln("total") - ratio(F.col("nlogn"), F.col("total")))
    kept = top_levels(counts, rare_min_count, max_categories).groupBy("feature").agg(F.count("*").alias("retained_levels"), F.sum("n").alias("kept_rows"))
    by = by.join(kept, "feature", "left").withColumn("pooled_rows", F.col("total") - F.coalesce("kept_rows", F.lit(0)))
    rows = long_levels(df, names).groupBy("feature").agg(F.count("*").alias("rows"), F.count_if(F.col("level").isNull()).alias("missing_count"), share(F.col("level").isNull()).alias("missing_fraction"))
    out = rows.join(by, "feature", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    columns = {
        "unique_nonmissing": zero("unique_nonmissing"),
        "unique_fraction_nonmissing": ratio(F.col("unique_nonmissing"), F.col("total")),
        "dominant_fraction_nonmissing": ratio(F.col("dominant"), F.col("total")),
        "pooled_row_fraction": ratio(zero("pooled_rows"), F.col("rows")),
        "retained_levels": zero("retained_levels"),
    }
    if "entropy" in on:
        entropy = F.when(F.col("entropy").isNotNull(), F.greatest(F.col("entropy"), F.lit(0.0)))
        columns |= {"entropy_nats_nonmissing": entropy, "effective_levels_nonmissing": F.exp(entropy)}
    if "rare_categories" in on:
        columns |= {"singleton_levels": zero("singleton_levels"), "rare_levels": zero("rare_levels"), "rare_row_fraction": ratio(zero("rare_rows"), F.col("rows"))}
    return out.select("feature", "rows", "missing_count", "missing_fraction", *[c.alias(n) for n, c in columns.items()])


@dataclass
class Cuts:
    """A numerical feature's buckets: distinct values if there are few, else right-closed intervals between edges."""

    values: list[float] | None
    edges: list[float]

    @property
    def labels(self) -> dict[int, str]:
        out = {MISSING: "[missing or nonfinite]"}
        if self.values is not None:
            return out | {i + 1: f"value: {v:g}" for i, v in enumerate(self.values)}
        return out | {i + 1: f"{'(' if i else '['}{a:.7g}, {b:.7g}]" for i, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False))}


def cut_numbers(df: DataFrame, names: list[str], bins: int = 10) -> dict[str, Cuts]:
    """By feature: up to ``bins`` distinct values as they are, else ``bins`` quantile intervals, equal edges merged."""
    values = long_numbers(df, names).where("v is not null").select("feature", "v")
    ends = ends_of(values)
    cells = first_cells(values, ends)
    held = {f: x for (f, _), x in cells.items()} | {f: [(0, n, low, high)] for f, (n, low, high) in ends.items() if low == high}
    out = {n: Cuts([], []) for n in names if n not in held}
    # a feature with few full cells may still have many values in one of them
    unsure = {n for n, x in held.items() if len(x) <= bins and any(low < high for *_, low, high in x)}
    few = {n: [low for _, _, low, _ in x] for n, x in held.items() if len(x) <= bins and n not in unsure} | _few_values(values, unsure, bins)
    out |= {n: Cuts(sorted(x), []) for n, x in few.items()}
    if many := [n for n in held if n not in few]:
        own = {n: ends[n] for n in many}
        q = exact_quantiles(values.where(F.col("feature").isin(many)), [i / bins for i in range(bins + 1)], own, _renumbered(cells, ends, own))
        out |= {n: Cuts(None, sorted(set(q[n]))) for n in many}
    return out


def _renumbered(cells: dict, ends: dict, own: dict) -> dict:
    """The cells of some features, numbered as a first pass over those only."""
    old = {f: k for k, f in enumerate(sorted(ends))}
    return {(f, k): [(c - (old[f] - k) * CELLS, *x) for c, *x in cells[f, old[f]]] for k, f in enumerate(sorted(own)) if (f, old[f]) in cells}


def _few_values(values: DataFrame, names: set[str], most: int) -> dict[str, list[float]]:
    """The distinct values of those features that have at most ``most``; parts are ranked first, as there may be any number."""
    if not names:
        return {}
    part = F.row_number().over(Window.partitionBy("feature", "salt").orderBy("v"))
    rank = F.row_number().over(Window.partitionBy("feature").orderBy("v"))
    some = values.where(F.col("feature").isin(sorted(names))).distinct().withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).withColumn("k", part).where(F.col("k") <= most + 1)
    out: dict[str, list[float]] = {}
    for r in some.withColumn("k", rank).where(F.col("k") <= most + 1).collect():
        out.setdefault(r["feature"], []).append(r["v"])
    return {n: x for n, x in out.items() if len(x) <= most}


def number_code(c: Column, cuts: Cuts) -> Column:
    """0 where not finite, else the bucket's number from 1."""
    v = usable(c)
    steps = cuts.values if cuts.values is not None else cuts.edges[1:-1]
    code = F.lit(MISSING)
    if cuts.values is not None:
        for i, x in enumerate(cuts.values):
            code = F.when(v == x, i + 1).otherwise(code)
        return F.when(v.isNull(), F.lit(MISSING)).otherwise(code).cast("int")
    code = F.lit(len(steps) + 1)
    for i in range(len(steps) - 1, -1, -1):
        code = F.when(v <= steps[i], i + 1).otherwise(code)
    return F.when(v.isNull(), F.lit(MISSING)).otherwise(code).cast("int")


def bucket_codes(df: DataFrame, features: dict[str, str], bins: int = 10, rare_min_count: int = 100, max_categories: int = 20, order: str | None = None) -> tuple[dict[str, Column], dict[str, dict[int, str]]]:
    """(code column, labels by code) of each feature; only bounds and kept levels come to the driver."""
    numbers = [n for n, k in features.items() if k == NUMERICAL]
    levels = [n for n, k in features.items() if k == CATEGORICAL]
    cuts = cut_numbers(df, numbers, bins) if numbers else {}
    pools = pool_levels(level_counts(df, levels, order), levels, rare_min_count, max_categories) if levels else {}
    codes = {n: number_code(quoted(n), cuts[n]) if k == NUMERICAL else category_code(quoted(n), pools[n]) for n, k in features.items()}
    return codes, {n: (cuts[n] if n in cuts else pools[n]).labels for n in features}


def diversity(profile: DataFrame) -> DataFrame:
    """(feature, metric, value, low, high): entropy and effective levels of a categorical profile in long form, with their bounds."""
    k = F.col("unique_nonmissing")
    parts = [
        F.struct(F.lit("entropy_nats_nonmissing").alias("metric"), F.col("entropy_nats_nonmissing").alias("value"), F.lit(0.0).alias("low"), F.when(k > 0, F.ln(k)).alias("high")),
        F.struct(F.lit("effective_levels_nonmissing").alias("metric"), F.col("effective_levels_nonmissing").alias("value"), F.lit(1.0).alias("low"), F.when(k > 0, k.cast("double")).alias("high")),
    ]
    return profile.select("feature", F.explode(F.array(*parts)).alias("r")).select("feature", "r.*")


def flags(profile: DataFrame, rules: dict[str, float] | None = None) -> DataFrame:
    """Adds flags, a text joined by ``; ``, to a profile of either kind (columns that it lacks count as null)."""
    limits = {"near_constant": 0.995, "missingness": 0.8, "high_cardinality": 1000} | (rules or {})
    col = lambda n, kind="double": F.col(n) if n in profile.columns else F.lit(None).cast(kind)
    number = "finite_count" in profile.columns
    there = F.col("finite_count") if number else F.col("rows") - F.col("missing_count")
    missing = F.coalesce(col("unusable_fraction"), F.col("missing_fraction"))
    one = F.col("unique_nonmissing") == 1
    parts = [
        F.when(there == 0, "all_missing_or_nonfinite").when(one, F.when(missing > 0, "constant_observed_values_with_missingness").otherwise("constant")),
        F.when(col("dominant_fraction_nonmissing") >= limits["near_constant"], "near_constant_observed_values"),
        F.when(missing >= limits["missingness"], "high_missingness"),
        F.when(col("nonfinite_nonmissing_count") > 0, "contains_infinity"),
        F.when(F.lit(not number) & (F.col("unique_nonmissing") >= limits["high_cardinality"]), "high_cardinality"),
        F.when(F.lit(not number) & (col("unique_fraction_nonmissing") >= 0.95), "near_unique_review_identifier"),
        F.when(col("pooled_row_fraction") >= 0.5, "most_categories_pooled_signal_may_be_hidden"),
    ]
    return profile.withColumn("flags", F.concat_ws("; ", *parts))
