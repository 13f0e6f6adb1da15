"""How features go with a 0/1 target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.columns import correlation, ratio, usable, wilson, xlogx
from brindle.functions.special import chi_square_tail, step_up
from brindle.operators.features import quoted

MIN_ROWS, MIN_EVENTS = 200, 10


def long_codes(df: DataFrame, codes: dict[str, Column], y: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """(feature, bucket, y, extra columns): one row per feature and row."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("bucket")) for n, c in codes.items()])).alias("r")
    keep = extra or {}
    return df.select(y.cast("int").alias("y"), *[c.alias(n) for n, c in keep.items()], rows).select("r.feature", "r.bucket", "y", *keep)


def positive_rates(rows: DataFrame, keys: list[str], overall: Column | None = None, min_rows: int = MIN_ROWS, min_events: int = MIN_EVENTS) -> DataFrame:
    """rows (keys, y) -> a row per observed cell: counts, rate, lift over the whole data, Wilson interval, support.

    ``overall`` is the whole data's rate; without it, that of the rows given, taken from the cells.
    """
    cells = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("positives"))
    return rates_of_cells(cells, overall, min_rows, min_events)


def rates_of_cells(cells: DataFrame, overall: Column | None = None, min_rows: int = MIN_ROWS, min_events: int = MIN_EVENTS) -> DataFrame:
    cells = cells.withColumns({"negatives": F.col("rows") - F.col("positives"), "positive_rate": ratio(F.col("positives"), F.col("rows"))})
    if overall is None:
        rows, positives = cells.agg(F.sum("rows"), F.sum("positives")).first()
        overall = F.lit((positives or 0) / rows if rows else None).cast("double")
    low, high = wilson(F.col("positives"), F.col("rows"))
    weak = (F.col("rows") < min_rows) | (F.col("positives") < min_events) | (F.col("negatives") < min_events)
    return cells.withColumns({"lift": ratio(F.col("positive_rate"), overall), "positive_rate_low_iid": low, "positive_rate_high_iid": high, "low_support": weak})


def table_association(cells: DataFrame, by: list[str], row: list[str], column: str, n: str = "n") -> DataFrame:
    """Contingency tables (by, row keys, column key, n) -> per ``by``: mi_nats, cramers_v_corrected, chi2, freedom, min_expected_count.

    Works on counts, empty lines and columns left out; the last four are null for fewer than two of either.
    """
    group = lambda keys: Window.partitionBy(*by, *keys) if by or keys else Window.partitionBy(F.lit(1))
    x = cells.where(F.col(n) > 0).withColumns({"_t": F.sum(n).over(group([])), "_r": F.sum(n).over(group(row)), "_c": F.sum(n).over(group([column]))})
    expected = F.col("_r") * F.col("_c") / F.col("_t")
    # sum of (o - e)^2 / e over all cells, the empty ones included, is sum of o^2 / e over full cells, less the total
    total = F.first("_t").cast("double")
    stats = x.groupBy(*by).agg(
        total.alias("_n"),
        F.sum(F.col(n) * F.col(n) / expected).alias("_o"),
        F.sum(F.col(n) / F.col("_t") * F.ln(F.col(n) / expected)).alias("_mi"),
        F.count_distinct(*row).alias("_k"),
        F.count_distinct(column).alias("_l"),
        (F.min("_r") * F.min("_c") / F.first("_t")).alias("_least"),
    )
    real = (F.col("_n") > 1) & (F.least("_k", "_l") >= 2)
    k, m, size = F.col("_k").cast("double"), F.col("_l").cast("double"), F.col("_n")
    chi = F.greatest(F.lit(0.0), F.col("_o") - size)
    phi = F.greatest(F.lit(0.0), chi / size - ratio((k - 1) * (m - 1), size - 1))
    den = F.least(k - ratio((k - 1) * (k - 1), size - 1) - 1, m - ratio((m - 1) * (m - 1), size - 1) - 1)
    return stats.select(
        *by,
        F.when(real, F.greatest(F.lit(0.0), F.col("_mi"))).otherwise(0.0).alias("mi_nats"),
        F.when(real & (den > 0), F.sqrt(ratio(phi, den))).alias("cramers_v_corrected"),
        F.when(real, chi).alias("chi2"),
        F.when(real, ((k - 1) * (m - 1)).cast("long")).alias("freedom"),
        F.when(real, F.col("_least")).alias("min_expected_count"),
    )


def target_tables(rates: DataFrame) -> DataFrame:
    """The (feature, bucket, label, n) cells of positive-rate rows."""
    pair = F.explode(F.array(F.struct(F.lit(0).alias("label"), F.col("negatives").alias("n")), F.struct(F.lit(1).alias("label"), F.col("positives").alias("n")))).alias("r")
    return rates.select("feature", "bucket", pair).select("feature", "bucket", "r.label", "r.n")


def bucket_associations(rates: DataFrame) -> DataFrame:
    """By feature, of its bucket-by-target table; and how many buckets were seen."""
    return table_association(target_tables(rates), ["feature"], ["bucket"], "label").join(rates.groupBy("feature").agg(F.count("*").alias("observed_buckets")), "feature")


def tail_probabilities(associations: DataFrame, grouped: bool = False) -> DataFrame:
    """Adds chi2_p_iid (expected counts of at least 5; never with a group column) and chi2_q_bh_iid; one row per feature is collected."""
    rows = associations.collect()
    p = [None if grouped or r["chi2"] is None or r["min_expected_count"] < 5 else chi_square_tail(r["chi2"], r["freedom"]) for r in rows]
    table = associations.sparkSession.createDataFrame([(r["feature"], a, b) for r, a, b in zip(rows, p, step_up(p), strict=True)], "feature string, chi2_p_iid double, chi2_q_bh_iid double")
    return associations.join(F.broadcast(table), "feature")


def sampled(df: DataFrame, rows: int, key: Column, seed: int = 42) -> DataFrame:
    """The ``rows`` rows with the least MD5 of seed and key: uniform, without replacement, the same in every run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), key).limit(rows)


def long_values(df: DataFrame, names: list[str], y: Column) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), usable(quoted(n)).alias("v")) for n in names])).alias("r")
    return df.select(y.cast("int").alias("y"), rows).select("r.feature", "r.v", "y").where("v is not null")


def standardized_difference(values: DataFrame) -> DataFrame:
    """values (feature, v, y) -> Cohen's d and Hedges' g of label 1 against 0, with their status and the classes' rows and means."""
    one, zero = F.when(F.col("y") == 1, F.col("v")), F.when(F.col("y") == 0, F.col("v"))
    s = values.groupBy("feature").agg(F.count(one).alias("sample_rows_y1"), F.count(zero).alias("sample_rows_y0"), F.avg(one).alias("sample_mean_y1"), F.avg(zero).alias("sample_mean_y0"), F.var_samp(one).alias("_a"), F.var_samp(zero).alias("_b"), (F.min(one) == F.max(one)).alias("_flat1"), (F.min(zero) == F.max(zero)).alias("_flat0"))
    n1, n0 = F.col("sample_rows_y1"), F.col("sample_rows_y0")
    enough = F.least(n1, n0) >= 2
    freedom = (n1 + n0 - 2).cast("double")
    pooled = F.when(~(F.col("_flat1") & F.col("_flat0")), F.sqrt(ratio((n1 - 1) * F.col("_a") + (n0 - 1) * F.col("_b"), freedom)))
    d = F.when(enough, ratio(F.col("sample_mean_y1") - F.col("sample_mean_y0"), F.nullif(pooled, F.lit(0.0))))
    status = F.when(~enough, "insufficient_class_rows").when(d.isNull(), "zero_or_nonfinite_pooled_sd").otherwise("computed")
    return s.select("feature", d.alias("cohens_d"), (d * (1 - ratio(F.lit(3.0), 4 * freedom - 1))).alias("hedges_g"), status.alias("cohens_d_status"), "sample_rows_y1", "sample_rows_y0", "sample_mean_y1", "sample_mean_y0")


#: Equal cells of a feature's values, each of which a task can sum by itself.
CELLS = 1024


def running_sums(steps: DataFrame, columns: list[str], down: bool = False) -> DataFrame:
    """steps (feature, v, columns) -> also cum_<column>, over v upwards or downwards, and all_<column>.

    Values are dealt to cells; within a cell a window runs, and the sums of the cells before it
    are added, so no task needs all values of a feature.
    """
    turn = (lambda c: F.desc(c)) if down else F.asc
    ends = steps.groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high"))  # a row per feature
    cell = F.coalesce(F.least(F.lit(CELLS - 1), F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * CELLS)), F.lit(0))
    dealt = steps.join(ends, "feature").withColumn("cell", cell).drop("low", "high")
    sums = dealt.groupBy("feature", "cell").agg(*[F.sum(c).alias(f"in_{c}") for c in columns])  # at most CELLS rows per feature
    before = Window.partitionBy("feature").orderBy(turn("cell")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("feature")
    sums = sums.select("feature", "cell", *[F.coalesce(F.sum(f"in_{c}").over(before), F.lit(0)).alias(f"to_{c}") for c in columns], *[F.sum(f"in_{c}").over(every).alias(f"all_{c}") for c in columns])
    run = Window.partitionBy("feature", "cell").orderBy(turn("v"))
    out = dealt.withColumns({f"cum_{c}": F.sum(c).over(run) for c in columns}).join(sums, ["feature", "cell"])
    return out.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"to_{c}") for c in columns}).drop("cell", *[f"to_{c}" for c in columns])


def rank_separation(values: DataFrame) -> DataFrame:
    """values (feature, v, y) -> AUC (ties half), its flipped and direction-free forms, and the KS statistic; rows are summed by value first."""
    steps = values.groupBy("feature", "v").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    steps = running_sums(steps, ["p", "q"])
    s = steps.groupBy("feature").agg(
        F.sum(F.col("p") * (F.col("cum_q") - F.col("q") / 2)).alias("wins"),
        F.max(F.abs(ratio(F.col("cum_p"), F.col("all_p")) - ratio(F.col("cum_q"), F.col("all_q")))).alias("ks_statistic"),
        F.first("all_p").alias("P"),
        F.first("all_q").alias("N"),
    )
    auc = ratio(F.col("wins"), F.nullif(F.col("P") * F.col("N"), F.lit(0)))
    return s.select("feature", auc.alias("raw_numeric_auc"), F.greatest(auc, 1 - auc).alias("direction_free_auc"), (1 - auc).alias("flipped_auc"), "ks_statistic")


def average_ranks(counts: DataFrame) -> DataFrame:
    """counts (feature, v, n) -> also rank, from 1, equal values sharing their mean, and all_n; no task needs all values of a feature."""
    return running_sums(counts, ["n"]).withColumn("rank", F.col("cum_n") - (F.col("n") - 1) / 2.0).drop("cum_n")


def target_correlations(values: DataFrame) -> DataFrame:
    """values (feature, v, y) -> point_biserial_r and spearman_target; rows are summed by value first."""
    plain = values.groupBy("feature").agg(correlation(F.col("v"), F.col("y").cast("double")).alias("point_biserial_r"), F.count("*").alias("sample_rows_numeric_target"))
    x = average_ranks(values.groupBy("feature", "v").agg(F.count("*").alias("n"), F.sum("y").alias("p")))
    middle, n, p = (F.col("all_n") + 1) / 2.0, F.col("n"), F.col("p")
    away = F.col("rank") - middle
    s = x.groupBy("feature").agg(F.sum(p * away).alias("ones"), F.sum(n * away * away).alias("vv"), F.sum(p).alias("P"), F.first("all_n").alias("N"), (F.min("v") < F.max("v")).alias("spread"))
    # labels have two ranks, N / 2 apart, so their sums of products follow from the ranks of the ones
    # (as doubles: the product of three counts passes a long's end at some 3 million rows)
    one, zero = F.col("P").cast("double"), (F.col("N") - F.col("P")).cast("double")
    r = ratio(F.col("ones") * F.col("N") / 2.0, F.sqrt(F.col("vv")) * F.sqrt(one * zero * F.col("N") / 4.0))
    s = s.select("feature", F.when((F.col("N") >= 3) & F.col("spread") & (one > 0) & (zero > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("spearman_target"))
    return plain.join(s, "feature").select("feature", "point_biserial_r", "spearman_target", "sample_rows_numeric_target")


def entropy_of(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Entropy in nats of counts by group."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return counts.withColumn("_h", xlogx(p)).groupBy(*by).agg((-F.sum("_h")).alias("entropy"))
