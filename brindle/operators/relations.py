"""Pairs of features, configured combinations, periods and groups."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.columns import correlation, ratio, share, usable
from brindle.operators.features import CATEGORICAL, NUMERICAL, quoted
from brindle.operators.target import average_ranks, long_codes, positive_rates, rates_of_cells, table_association

MAX_CELLS = 20_000
NO_PERIOD = "[missing]"


def first_pairs(names: list[str], most: int = 500) -> list[tuple[str, str]]:
    return list(itertools.islice(itertools.combinations(names, 2), most))


def _long_pairs(df: DataFrame, pairs: list[tuple[str, str]], left: dict[str, Column], right: dict[str, Column], extra: list[str] = ()) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.lit(str(i)).alias("pair"), left[a].alias("a"), right[b].alias("b")) for i, (a, b) in enumerate(pairs)])).alias("r")
    return df.select(rows, *extra).select("r.*", *extra)


def numeric_pairs(df: DataFrame, pairs: list[tuple[str, str]], pearson: bool = True, spearman: bool = True) -> DataFrame:
    """(feature_a, feature_b, valid_rows, pearson_r, spearman_r): all pairs in one pass; ranks are of a pair's complete rows."""
    names = {n for p in pairs for n in p}
    values = {n: usable(quoted(n)) for n in names}
    rows = _long_pairs(df, pairs, values, values).where("a is not null and b is not null")
    keys = ["feature_a", "feature_b"]
    out = [F.count("*").alias("valid_rows")]
    if pearson:
        out.append(correlation(F.col("a"), F.col("b")).alias("pearson_r"))
    found = rows.groupBy(*keys, "pair").agg(*out)
    if not spearman:
        return found.drop("pair")
    # a pair's rows are summed by both values, and by either one for its ranks; no task needs a pair's rows
    cells = rows.groupBy(F.col("pair").alias("feature"), "a", "b").agg(F.count("*").alias("n"))
    ranks = lambda c: average_ranks(cells.groupBy("feature", F.col(c).alias("v")).agg(F.sum("n").alias("n"))).select("feature", F.col("v").alias(c), (F.col("rank") - (F.col("all_n") + 1) / 2.0).alias(f"r{c}"))
    both = cells.join(ranks("a"), ["feature", "a"]).join(ranks("b"), ["feature", "b"])
    n, x, y = F.col("n"), F.col("ra"), F.col("rb")
    s = both.groupBy("feature").agg(F.sum(n).alias("k"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    r = F.when((F.col("k") >= 3) & (F.col("xx") > 0) & (F.col("yy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")))))
    return found.join(s.select(F.col("feature").alias("pair"), r.alias("spearman_r")), "pair").drop("pair")


def category_pairs(df: DataFrame, pairs: list[tuple[str, str]], codes: dict[str, Column], max_cells: int = MAX_CELLS) -> DataFrame:
    """(feature_a, feature_b, cramers_v_corrected, valid_rows, status): buckets, missing ones too; large tables are skipped."""
    cells = _long_pairs(df, pairs, codes, codes).groupBy("feature_a", "feature_b", "a", "b").agg(F.count("*").alias("n"))
    keys = ["feature_a", "feature_b"]
    v = table_association(cells, keys, ["a"], "b")
    size = cells.groupBy(*keys).agg((F.count_distinct("a") * F.count_distinct("b")).alias("cells"), F.sum("n").alias("valid_rows"))
    skipped = F.col("cells") > max_cells
    return v.join(size, keys).select(*keys, F.when(~skipped, F.col("cramers_v_corrected")).alias("cramers_v_corrected"), "valid_rows", F.when(skipped, "skipped_cell_limit").alias("status"))


def mixed_pairs(df: DataFrame, pairs: list[tuple[str, str]], codes: dict[str, Column]) -> DataFrame:
    """pairs of (categorical, numerical) -> eta squared: the share of the number's variance between buckets."""
    numbers = {b: usable(quoted(b)) for _, b in pairs}
    rows = _long_pairs(df, pairs, codes, numbers).where("b is not null")
    keys = ["feature_a", "feature_b"]
    groups = rows.groupBy(*keys, "a").agg(F.count("*").alias("n"), F.avg("b").alias("m"), F.var_pop("b").alias("v"), F.min("b").alias("low"), F.max("b").alias("high"))
    n = F.col("n")
    total = groups.withColumn("mean", F.sum(n * F.col("m")).over(Window.partitionBy(*keys)) / F.sum(n).over(Window.partitionBy(*keys)))
    s = total.groupBy(*keys).agg(F.sum(n).alias("valid_rows"), F.sum(n * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"), F.sum(n * F.col("v")).alias("within"), F.min("low").alias("low"), F.max("high").alias("high"))
    eta = ratio(F.col("between"), F.col("between") + F.col("within"))
    spread = (F.col("valid_rows") >= 2) & (F.col("low") < F.col("high"))
    return s.select(*keys, F.when(spread, F.greatest(F.lit(0.0), F.least(F.lit(1.0), eta))).alias("eta_squared"), "valid_rows")


def missing_together(df: DataFrame, pairs: list[tuple[str, str]], codes: dict[str, Column]) -> DataFrame:
    """(feature_a, feature_b, missingness_phi): Pearson of the two features being in bucket 0."""
    gone = {n: (c == 0).cast("double") for n, c in codes.items()}
    cells = _long_pairs(df, pairs, gone, gone)
    return cells.groupBy("feature_a", "feature_b").agg(correlation(F.col("a"), F.col("b")).alias("missingness_phi"))


def all_pairs(df: DataFrame, features: dict[str, str], codes: dict[str, Column], most: int = 500, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per pair, in the order of the features, with what fits the kinds of its two features."""
    spark = df.sparkSession
    pairs = first_pairs(list(features), most)
    schema = "place int, feature_a string, feature_b string, type_a string, type_b string"
    out = spark.createDataFrame([(i, a, b, features[a], features[b]) for i, (a, b) in enumerate(pairs)], schema)
    kinds = lambda *k: [(a, b) for a, b in pairs if (features[a], features[b]) == k]
    keys = ["feature_a", "feature_b"]
    parts = []
    if both := kinds(NUMERICAL, NUMERICAL):
        parts.append(numeric_pairs(df, both))
    if both := kinds(CATEGORICAL, CATEGORICAL):
        parts.append(category_pairs(df, both, codes, max_cells))
    mixed = kinds(CATEGORICAL, NUMERICAL) + [(b, a) for a, b in kinds(NUMERICAL, CATEGORICAL)]
    if mixed:
        eta = mixed_pairs(df, mixed, codes)
        turned = set(kinds(NUMERICAL, CATEGORICAL))
        turn = F.concat_ws("\0", "feature_b", "feature_a").isin(["\0".join(p) for p in turned]) if turned else F.lit(False)
        parts.append(eta.select(F.when(turn, F.col("feature_b")).otherwise(F.col("feature_a")).alias("feature_a"), F.when(turn, F.col("feature_a")).otherwise(F.col("feature_b")).alias("feature_b"), "eta_squared", "valid_rows"))
    found = None
    for p in parts:
        found = p if found is None else found.unionByName(p, allowMissingColumns=True)
    # tables of one row per pair
    out = out.join(found, keys, "left") if found is not None else out
    out = out.join(missing_together(df, pairs, codes), keys, "left") if pairs else out
    return out.withColumn("sample_rows", F.lit(df.count()))


def joint_rates(df: DataFrame, codes: list[Column], y: Column, overall: Column | None = None) -> DataFrame:
    """bucket_1.. of two or three features -> positive rates of the observed cells."""
    names = [f"bucket_{i + 1}" for i in range(len(codes))]
    return positive_rates(df.select(*[c.alias(n) for c, n in zip(codes, names, strict=True)], y.cast("int").alias("y")), names, overall)


def joint_information(df: DataFrame, codes: dict[str, Column], y: Column) -> DataFrame:
    """One row: information of the features together about the target, the gain over the best single one, and each given the others.

    The cells of all features and the target are counted once; every subset is a sum over them (grouping sets).
    """
    names = list(codes)
    cells = df.select(*[c.alias(f"c{i}") for i, c in enumerate(codes.values())], y.cast("int").alias("y")).groupBy(*[f"c{i}" for i in range(len(names))], "y").agg(F.count("*").alias("n"))
    every = tuple(range(len(names)))
    subsets = list(dict.fromkeys([every, *[(i,) for i in every], *[tuple(j for j in every if j != i) for i in every]]))
    tagged = None
    for s in subsets:
        part = cells.groupBy(*[f"c{i}" for i in s], "y").agg(F.sum("n").alias("n"))
        part = part.select(F.lit("+".join(map(str, s))).alias("subset"), F.concat_ws("|", *[F.col(f"c{i}").cast("string") for i in s]).alias("cell"), "y", "n")
        tagged = part if tagged is None else tagged.union(part)
    mi = table_association(tagged, ["subset"], ["cell"], "y").select("subset", "mi_nats")
    value = lambda s: F.max(F.when(F.col("subset") == "+".join(map(str, s)), F.col("mi_nats")))
    best = F.greatest(*[value((i,)) for i in every])
    clip = lambda x: F.greatest(F.lit(0.0), x)
    out = mi.agg(value(every).alias("joint_mi_nats"), best.alias("best_single_mi_nats"), clip(value(every) - best).alias("gain_over_best_single_nats"), *[clip(value(every) - value(tuple(j for j in every if j != i))).alias(f"conditional_mi_{i + 1}_nats") for i in every])
    size = cells.agg(F.sum("n").alias("sample_rows"), F.count_distinct(*[f"c{i}" for i in every]).alias("observed_sample_cells"))
    return size.join(out).select(F.lit(" + ".join(names)).alias("features"), "*")  # a row beside a row


def interaction(df: DataFrame, group: list[str], codes: dict[str, Column], y: Column, sample: DataFrame | None = None, max_cells: int = MAX_CELLS, rates: bool = True, information: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(a row of information with its status, the rates) of one configured combination."""
    spark = df.sparkSession
    name = " + ".join(group)
    if not rates and not information:
        return spark.createDataFrame([(name, "disabled")], "features string, status string"), None
    own = {n: codes[n] for n in group}
    seen = df.select(*[c.alias(f"c{i}") for i, c in enumerate(own.values())]).agg(*[F.count_distinct(f"c{i}") for i in range(len(group))]).first()
    possible = math.prod(seen)
    if possible > max_cells:
        return spark.createDataFrame([(name, "skipped_cell_limit", possible)], "features string, status string, possible_cells long"), None
    table = joint_rates(df, list(own.values()), y)
    cover = table.agg(F.count("*").alias("observed_full_cells"), ratio(F.coalesce(F.sum(F.when(F.col("low_support"), F.col("rows"))), F.lit(0)), F.sum("rows")).alias("low_support_row_fraction"))
    row = joint_information(sample if sample is not None else df, own, y) if information else spark.createDataFrame([(name,)], "features string")
    row = row.join(cover).withColumns({"status": F.lit("computed"), "possible_cells": F.lit(possible).cast("long")})
    return row, table if rates else None


def period(t: Column, frequency: str) -> Column:
    """Calendar periods in UTC as texts: days, Monday-to-Sunday weeks as ``first/last``, months; ``[missing]`` for null."""
    if frequency == "W":
        monday = F.date_trunc("WEEK", t)
        text = F.concat_ws("/", F.date_format(monday, "yyyy-MM-dd"), F.date_format(F.date_add(monday.cast("date"), 6), "yyyy-MM-dd"))
    else:
        text = F.date_format(t, {"D": "yyyy-MM-dd", "M": "yyyy-MM"}[frequency])
    return F.when(t.isNull(), F.lit(NO_PERIOD)).otherwise(text)


def parsed_time(df: DataFrame, column: str) -> Column:
    """The column as a timestamp; numbers and texts that do not parse are refused."""
    kind = dict(df.dtypes)[column]
    c = quoted(column)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp_ntz") if kind == "timestamp_ntz" else c.cast("timestamp")
    if kind != "string":
        raise ValueError(f"{column}: a time column is a timestamp, a date or an ISO text; epoch units of numbers are ambiguous")
    t = F.expr(f"try_cast(`{column}` AS TIMESTAMP)")
    bad = df.where(c.isNotNull() & t.isNull()).count()
    if bad:
        raise ValueError(f"{column}: {bad} values that are not null are no timestamps")
    return t


def period_rates(df: DataFrame, periods: Column, y: Column) -> DataFrame:
    return positive_rates(df.select(periods.alias("period"), y.cast("int").alias("y")), ["period"])


def period_feature_rates(df: DataFrame, codes: dict[str, Column], periods: Column, y: Column) -> DataFrame:
    """(feature, period, bucket) rates; lift is over the whole data's rate."""
    cells = long_codes(df, codes, y, {"period": periods}).groupBy("feature", "period", "bucket").agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("positives"))
    rows, positives = df.agg(F.count("*"), F.sum(y.cast("long"))).first()
    return rates_of_cells(cells, F.lit((positives or 0) / rows if rows else None).cast("double"))


def period_drift(df: DataFrame, codes: dict[str, Column], periods: Column) -> DataFrame:
    """(feature, period, rows, js_divergence_nats_vs_all): each period's buckets against those of all rows.

    Buckets that a period lacks count with the whole's share: their sum is 1 less the shares of those it has.
    """
    cells = long_codes(df, codes, F.lit(0), {"period": periods}).groupBy("feature", "period", "bucket").agg(F.count("*").alias("n"))
    of = lambda *k: F.sum("n").over(Window.partitionBy("feature", *k))
    p, q = F.col("n") / of("period"), of("bucket") / of()
    x = cells.withColumns({"p": p, "q": q})
    m = (F.col("p") + F.col("q")) / 2
    here = F.col("p") * F.ln(F.col("p") / m) + F.col("q") * F.ln(F.col("q") / m)
    out = x.groupBy("feature", "period").agg(F.sum("n").alias("rows"), F.sum(here).alias("here"), F.sum("q").alias("seen"))
    # q ln(q / (q / 2)) for the buckets that are not there
    absent = F.greatest(F.lit(0.0), 1 - F.col("seen")) * math.log(2)
    return out.select("feature", "period", "rows", F.greatest(F.lit(0.0), (F.col("here") + absent) / 2).alias("js_divergence_nats_vs_all"))


def temporal(df: DataFrame, codes: dict[str, Column], column: str | None, y: Column, frequency: str = "W", max_periods: int = 120, rates: bool = True, feature_rates: bool = True, drift: bool = True) -> dict:
    """{status, missing_rows, and the tables that were asked for}."""
    if column is None:
        return {"status": "not_requested", "missing_rows": 0}
    if not (rates or feature_rates or drift):
        return {"status": "disabled", "missing_rows": 0}
    p = period(parsed_time(df, column), frequency)
    n, missing = df.agg(F.count_distinct(p), F.count_if(p == NO_PERIOD)).first()
    if n > max_periods:
        return {"status": "skipped_period_limit_choose_coarser_frequency", "missing_rows": missing}
    out = {"status": "computed", "missing_rows": missing}
    if rates:
        out["rates"] = period_rates(df, p, y)
    if feature_rates:
        out["feature_rates"] = period_feature_rates(df, codes, p, y)
    if drift:
        out["drift"] = period_drift(df, codes, p)
    return out


def group_summary(df: DataFrame, column: str, y: Column) -> DataFrame:
    """One row: groups (null is one), rows without a group, median and largest size, share of groups with a positive."""
    g = df.select(quoted(column).alias("g"), y.cast("int").alias("y")).groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    # sizes repeat, so that the exact median is of (size, groups) pairs
    return g.agg(F.count("*").alias("groups_including_missing"), F.coalesce(F.sum(F.when(F.col("g").isNull(), F.col("n"))), F.lit(0)).alias("missing_group_rows"), F.percentile("n", 0.5).alias("median_rows_per_group"), F.max("n").alias("max_rows_per_group"), share(F.col("p") > 0).alias("fraction_groups_with_positives"))
