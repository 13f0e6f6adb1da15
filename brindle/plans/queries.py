"""A query for each operator over the supplied tables, and the SQL that gives the same rows.

Both sides start from the same injected edge cases: nulls, NaN and infinities in prices, nulls
and a literal ``[missing]`` among categories.  Doubles are rounded alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import decisions, features, relations, scoring, splits, target
from brindle.operators.features import CATEGORICAL, NUMERICAL
from brindle.plans.oracles import ORACLES

DIGITS = 6
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}

NUMBERS = {n: NUMERICAL for n in ("price", "qty", "disc", "tax")}
LEVELS = {n: CATEGORICAL for n in ("line", "supp", "status", "gone")}

def Y():  # noqa: N802
    """The target; columns need a session, modules do not."""
    return F.col("y")



def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(c), DIGITS) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint", "decimal(20,0)") else F.col(c) for c, t in df.dtypes])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a target (returned), numbers, categories, a time and a group."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "cast(l_returnflag = 'R' as int) y",
        "case when l_linenumber = 7 then null when l_linenumber = 6 and l_quantity = 1 then double('NaN') when l_linenumber = 6 and l_quantity = 2 then double('Infinity') else l_extendedprice end price",
        "l_quantity qty",
        "l_discount disc",
        "l_tax tax",
        "case when l_linenumber = 5 then null when l_linenumber = 4 then '[missing]' else cast(l_linenumber as string) end line",
        "cast(l_suppkey as string) supp",
        "l_linestatus status",
        "cast(null as string) gone",
        "l_shipdate t",
        "l_orderkey g",
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a target (purchase), numbers, categories, a time, a group, and a score to judge."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id id",
        "cast(event_type = 'purchase' as int) y",
        "value",
        "cast(get_json_object(props, '$.k') as double) k",
        "case when user_id % 10 = 3 then null else value * 2 + 1 end twice",
        "cast(user_id % 7 as string) kind",
        "cast(user_id as string) user",
        "ts t",
        "1 / (1 + exp(1.2 - value / (1 + abs(value)) * 0.5)) p",
    )


def _profile(metrics: set[str], columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(features.numeric_profile(items(spark, sf_dir), list(NUMBERS), metrics).select("feature", *columns))

    return run


#: Operator, metric switches, columns.
PROFILES = {
    "u01_u02_numeric_counts": (set(), ["rows", "finite_count", "missing_count", "missing_fraction", "nonfinite_nonmissing_count", "unusable_fraction"]),
    "u03_unique_nonmissing": (set(), ["unique_nonmissing"]),
    "u04_dominant_fraction": (set(), ["dominant_fraction_nonmissing"]),
    "u05_zero_negative_fraction": ({"zero_fraction", "negative_fraction"}, ["zero_fraction_finite", "negative_fraction_finite"]),
    "u06_mean": ({"mean"}, ["mean"]),
    "u07_std": ({"std"}, ["std"]),
    "u08_median": ({"median"}, ["median"]),
    "u09_quantiles": ({"quantiles"}, list(features.PROBABILITIES)),
    "u10_iqr": ({"iqr"}, ["iqr"]),
    "u11_mad_unscaled": ({"mad"}, ["mad_unscaled"]),
    "u12_skewness": ({"skewness"}, ["skewness"]),
    "u13_excess_kurtosis": ({"kurtosis"}, ["excess_kurtosis"]),
    "u14_iqr_outlier_fraction": ({"outlier_fraction"}, ["iqr_outlier_fraction"]),
}
for _name, (_metrics, _columns) in PROFILES.items():
    _queries[_name] = _profile(_metrics, _columns)

#: Columns of the categorical profile by operator.
CATEGORY_PROFILES = {
    "c01_category_counts": ["rows", "missing_count", "missing_fraction", "unique_nonmissing", "unique_fraction_nonmissing", "dominant_fraction_nonmissing"],
    "c02_entropy": ["entropy_nats_nonmissing"],
    "c03_effective_levels": ["effective_levels_nonmissing"],
    "c04_singleton_levels": ["singleton_levels"],
    "c05_rare_levels": ["rare_levels", "rare_row_fraction"],
    "c06_pooled_fraction": ["pooled_row_fraction", "retained_levels"],
}


def _categories(columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = items(spark, sf_dir)
        return rounded(features.categorical_profile(df, list(LEVELS), rare_min_count=600).select("feature", *columns))

    return run


for _name, _columns in CATEGORY_PROFILES.items():
    _queries[_name] = _categories(_columns)


@query("c07_categorical_diversity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy and effective levels in long form, with their bounds."""
    p = features.categorical_profile(items(spark, sf_dir), list(LEVELS), rare_min_count=600)
    return rounded(features.diversity(p).where("value is not null"))


@query("c08_flags")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    a = features.flags(features.numeric_profile(df, list(NUMBERS), set()), {"missingness": 0.1}).select("feature", "flags")
    b = features.flags(features.categorical_profile(df, list(LEVELS), rare_min_count=600), {"high_cardinality": 50}).select("feature", "flags")
    return a.union(b)


def codes_of(df: DataFrame, names: list[str]) -> dict:
    codes, _ = features.bucket_codes(df, {n: (NUMBERS | LEVELS)[n] for n in names}, rare_min_count=600)
    return codes


def _buckets(names: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = items(spark, sf_dir)
        return rounded(target.long_codes(df, codes_of(df, names), Y()).groupBy("feature", "bucket").agg(F.count("*").alias("rows")))

    return run


_queries["b1_discrete_buckets"] = _buckets(["tax"])
_queries["b2_quantile_buckets"] = _buckets(["price", "qty", "disc"])
_queries["b3_category_pooling"] = _buckets(["supp", "status", "gone"])
_queries["b6_literal_missing_is_a_level"] = _buckets(["line"])


@query("b4_b5_bucket_dictionary")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, labels = features.bucket_codes(items(spark, sf_dir), {n: (NUMBERS | LEVELS)[n] for n in ("tax", "line", "status", "gone")}, rare_min_count=600)
    return spark.createDataFrame([(f, code, text) for f, x in labels.items() for code, text in x.items()], "feature string, bucket_code long, bucket_label string")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    codes = codes_of(df, [*NUMBERS, *LEVELS])
    overall = df.agg(F.avg("y")).first()[0]
    return target.positive_rates(target.long_codes(df, codes, Y()), ["feature", "bucket"], F.lit(overall))


@query("screen_positive_rate")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2 with B1 to B3 and B6: rates of all features' buckets."""
    return rounded(rates(spark, sf_dir))


@query("t03_mutual_information")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(target.bucket_associations(rates(spark, sf_dir)).select("feature", "mi_nats"))


@query("t04_cramers_v_target")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(target.bucket_associations(rates(spark, sf_dir)).select("feature", "cramers_v_corrected"))


@query("t05_chi_square")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(target.bucket_associations(rates(spark, sf_dir)).select("feature", "chi2", "freedom", "min_expected_count"))


@query("t06_chi2_p_and_q")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose tables have an even number of degrees of freedom, for which SQL has a closed form."""
    df = items(spark, sf_dir)
    three = {f"m{k}": (F.col("g") * k % 7 % 3).cast("int") for k in (1, 2, 3, 4, 5)}
    r = target.positive_rates(target.long_codes(df, three, Y()), ["feature", "bucket"])
    return rounded(target.tail_probabilities(target.bucket_associations(r)).select("feature", "chi2", "chi2_p_iid", "chi2_q_bh_iid"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target.long_values(items(spark, sf_dir), list(NUMBERS), Y())


@query("t07_t08_cohens_d_hedges_g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(target.standardized_difference(values(spark, sf_dir)))


@query("t09_t10_auc_ks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(target.rank_separation(values(spark, sf_dir)))


@query("t11_t12_t14_target_correlations")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(target.target_correlations(values(spark, sf_dir)))


@query("t13_association_order")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    a = target.bucket_associations(rates(spark, sf_dir)).select("feature", "mi_nats", "observed_buckets")
    names = F.array(*map(F.lit, NUMBERS | LEVELS))
    order = Window.orderBy(F.round("mi_nats", 9).desc_nulls_last(), F.array_position(names, F.col("feature")))
    return rounded(a.withColumn("place", F.row_number().over(order)))


@query("sample_by_hash")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed sample that sampled statistics share."""
    return rounded(target.sampled(clicks(spark, sf_dir).select("id", "y", "value"), 2000, F.col("id")))


@query("sampled_auc")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = target.sampled(clicks(spark, sf_dir), 2000, F.col("id"))
    return rounded(target.rank_separation(target.long_values(s, ["value", "k", "twice"], Y())))


@query("r1_r2_numeric_pairs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["value", "k", "twice", "id"]
    return rounded(relations.numeric_pairs(clicks(spark, sf_dir).withColumn("id", F.col("id").cast("double")), relations.first_pairs(names)))


@query("r3_category_pairs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    codes = codes_of(df, list(LEVELS))
    return rounded(relations.category_pairs(df, relations.first_pairs(list(codes)), codes, max_cells=100))


@query("r4_eta_squared")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    codes = codes_of(df, ["line", "status", "gone"])
    return rounded(relations.mixed_pairs(df, [(a, b) for a in ("line", "status", "gone") for b in ("price", "qty")], codes))


@query("r5_missingness_phi")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    codes = codes_of(df, ["price", "line", "qty", "gone"])
    return rounded(relations.missing_together(df, relations.first_pairs(["price", "line", "qty", "gone"]), codes))


@query("r6_all_pairs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    codes = codes_of(df, [*NUMBERS, *LEVELS])
    return rounded(relations.all_pairs(df, NUMBERS | LEVELS, codes, most=9).drop("place"))


JOINT = ["tax", "line", "status"]


@query("j1_joint_positive_rate")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    codes = codes_of(df, JOINT)
    return rounded(relations.joint_rates(df, [codes[n] for n in JOINT], Y()))


@query("j3_j4_joint_information")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    codes = codes_of(df, JOINT)
    return rounded(relations.joint_information(df, {n: codes[n] for n in JOINT}, Y()))


@query("j2_j5_j6_interaction_status")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    codes = codes_of(df, [*JOINT, "price", "supp"])
    out = None
    for group, most in ((JOINT, 20_000), (["price", "supp"], 50)):
        row, _ = relations.interaction(df, group, codes, Y(), max_cells=most, information=False)
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return rounded(out.select("features", "status", "possible_cells", "observed_full_cells", "low_support_row_fraction"))


def _periods(frequency: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = items(spark, sf_dir).withColumn("t", F.when(F.col("line") == "1", F.lit(None)).otherwise(F.col("t")))
        p = relations.period(relations.parsed_time(df, "t"), frequency)
        return rounded(relations.period_rates(df, p, Y()))

    return run


for _f in "DWM":
    _queries[f"w1_w3_time_positive_rate_{_f.lower()}"] = _periods(_f)


@query("w2_w6_time_status")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    got = [(f, relations.temporal(df, {}, "t", Y(), f, feature_rates=False, drift=False)) for f in "DWM"] + [("none", relations.temporal(df, {}, None, Y()))]
    return spark.createDataFrame([(f, r["status"], r["missing_rows"]) for f, r in got], "frequency string, status string, missing_rows long")


@query("w4_time_feature_positive_rate")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    codes = codes_of(df, ["tax", "status"])
    p = relations.period(relations.parsed_time(df, "t"), "M")
    return rounded(relations.period_feature_rates(df, {n: codes[n] for n in ("tax", "status")}, p, Y()))


@query("w5_time_drift")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    codes = codes_of(df, ["tax", "line", "supp"])
    p = relations.period(relations.parsed_time(df, "t"), "M")
    return rounded(relations.period_drift(df, {n: codes[n] for n in ("tax", "line", "supp")}, p))


@query("g1_group_summary")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.group_summary(items(spark, sf_dir).withColumn("g", F.when(F.col("g") % 10 != 0, F.col("g"))), "g", Y()))


def _features_table(df: DataFrame, kinds: dict[str, str], rare: int) -> DataFrame:
    """Profiles beside associations, a row per feature."""
    numbers, levels = ([n for n, k in kinds.items() if k == x] for x in (NUMERICAL, CATEGORICAL))
    a = features.numeric_profile(df, numbers, set()).withColumn("type", F.lit(NUMERICAL))
    b = features.categorical_profile(df, levels, rare_min_count=rare).withColumn("type", F.lit(CATEGORICAL))
    p = a.unionByName(b, allowMissingColumns=True)
    v = target.long_values(df, numbers, Y())
    codes, _ = features.bucket_codes(df, kinds, rare_min_count=rare)
    t = target.bucket_associations(target.positive_rates(target.long_codes(df, codes, Y()), ["feature", "bucket"])).select("feature", "mi_nats")
    for more in (target.standardized_difference(v).select("feature", "cohens_d", "hedges_g"), target.rank_separation(v)):
        t = t.join(more, "feature", "left")
    return p.join(t, "feature")


@query("d01_d07_rule_hits")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of single features say, by the plan that the audit runs."""
    policy = decisions.Policy(NUMBERS | LEVELS)
    policy.rules["missingness"]["threshold"], policy.rules["high_cardinality"]["threshold"], policy.rules["near_constant"]["threshold"] = 0.1, 100, 0.5
    policy.rules["direction"].update(min_abs_d=0.0, min_auc_distance=0.0)
    facts = decisions.facts_table(_features_table(items(spark, sf_dir), NUMBERS | LEVELS, 600), policy)
    return decisions.evaluations(facts, policy).where("rule <> 'coverage'").select("feature", "rule", (F.col("status") == "triggered").alias("hit"))


@query("d08_d15_decisions")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine over events, where ``twice`` repeats ``value``; only rows by feature and pair are collected."""
    df = clicks(spark, sf_dir)
    kinds = {"value": NUMERICAL, "k": NUMERICAL, "twice": NUMERICAL, "kind": CATEGORICAL, "user": CATEGORICAL, "id": NUMERICAL}
    df = df.withColumn("id", F.col("id").cast("double"))
    policy = decisions.Policy(kinds, prefer=["k"], expected={"value": "positive"}, interactions=[["value", "kind"]], force_keep=["user"], force_exclude=["id"])
    facts = decisions.facts_table(_features_table(df, kinds, 100), policy)
    numbers = [n for n, k in kinds.items() if k == NUMERICAL]
    pairs = relations.numeric_pairs(df, relations.first_pairs(numbers)).withColumn("sample_rows", F.lit(df.count()))
    rows, record = decisions.decide(facts, [r.asDict() for r in pairs.collect()], policy)
    kept = set(decisions.selected(rows))
    fired = {r["feature"]: sorted({x["rule"] for x in record if x["feature"] == r["feature"] and x["status"] == "triggered"}) for r in rows}
    return spark.createDataFrame([(r["feature"], r["decision"], r["expected_direction"], r["related_features"], ", ".join(fired[r["feature"]]), r["feature"] in kept) for r in rows], "feature string, decision string, expected_direction string, related_features string, fired string, selected boolean")


# tuning


def bounds(df: DataFrame) -> splits.Bounds:
    from datetime import timedelta

    return splits.find_bounds(df, "t", gap=timedelta(days=1))


@query("m01_m02_split_summary")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clicks(spark, sf_dir)
    return rounded(splits.split_summary(df, "t", Y(), bounds(df)))


@query("m02_gap_rows")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clicks(spark, sf_dir)
    return rounded(splits.gap_rows(df, "t", bounds(df)))


@query("m03_crossing_entities")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clicks(spark, sf_dir)
    return rounded(splits.crossing_entities(df, "t", "user", bounds(df)))


@query("m04_encoder")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of levels fitted on train, of all rows; levels that train lacks are null."""
    df = clicks(spark, sf_dir)
    kinds = {"value": NUMERICAL, "user": CATEGORICAL}
    e = splits.Encoder.fit(splits.parts_of(df, "t", bounds(df))["train"].where("user % 3 <> 0"), kinds)
    return rounded(df.select("id", *e.columns()))


@query("m05_unseen_categories")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clicks(spark, sf_dir)
    parts = splits.parts_of(df, "t", bounds(df))
    e = splits.Encoder.fit(parts["train"].where("user % 3 <> 0"), {"user": CATEGORICAL, "kind": CATEGORICAL})
    return spark.createDataFrame(list(e.unseen(parts["test"]).items()), "feature string, rows long")


@query("m10_m11_m18_evaluation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clicks(spark, sf_dir)
    a = scoring.evaluate(df, Y(), F.col("p"), 0.25).withColumn("dataset", F.lit("score"))
    b = scoring.evaluate(df, Y(), F.lit(0.25), 0.25).withColumn("dataset", F.lit("constant"))
    return rounded(a.unionByName(b))


@query("m13_group_metrics")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clicks(spark, sf_dir).withColumn("kind", F.when(F.col("kind") != "6", F.col("kind")))
    out = scoring.evaluate(df, Y(), F.col("p"), 0.25, ["kind"])
    return rounded(out.withColumn("low_support", (F.col("rows") < 1400) | (F.col("actual_clicks") < 10)))


@query("m12_bootstrap")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clicks(spark, sf_dir)
    return rounded(scoring.bootstrap(df, Y(), F.col("p"), 0.25, scoring.unit_of("time_block", "t"), F.unix_micros(F.col("t").cast("timestamp")), times=100))


@query("m12_units")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bootstrap draws from: sums by block of time."""
    df = clicks(spark, sf_dir)
    u = scoring.unit_sums(df, Y(), F.col("p"), 0.25, scoring.unit_of("time_block", "t"), F.col("id"))
    return rounded(u)


@query("m13_group_bootstrap")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clicks(spark, sf_dir)
    return rounded(scoring.group_evaluation(df, ["kind"], Y(), F.col("p"), 0.25, scoring.unit_of("time_block", "t"), F.unix_micros(F.col("t").cast("timestamp")), times=50))


@query("m14_calibration")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.calibration(clicks(spark, sf_dir), Y(), F.col("p")))


@query("m15_daily")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.daily(clicks(spark, sf_dir), Y(), F.col("p"), F.col("t")))


def _trained(spark: SparkSession, sf_dir: str):
    """A small model on train, with early stopping inside of it, and its predictions of the test part."""
    from brindle.operators import trees

    df = clicks(spark, sf_dir)
    kinds = {"value": NUMERICAL, "k": NUMERICAL, "twice": NUMERICAL, "kind": CATEGORICAL}
    parts = splits.parts_of(df, "t", bounds(df))
    e = splits.Encoder.fit(parts["fit"], kinds)
    x = {n: trees.encoded(parts[n], e, Y(), ["id"]) for n in ("fit", "early_stop", "train", "test")}
    params = {"maxDepth": 3, "stepSize": 0.1}
    rounds, _ = trees.train_early(x["fit"], x["early_stop"], e, params, 4, 2, 42)
    model = trees.train(x["train"], e, params, rounds, 42)
    return trees.probability(model, x["test"]), model, e


@query("m06_m09_training")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _ = _trained(spark, sf_dir)
    return out.select("id", "p", "margin")


def _tuning(spark: SparkSession, sf_dir: str):
    """What the tuning workflow starts from, over events: its configuration, parts and frames."""
    from brindle.plans import tuning
    from brindle.plans.config import tuning_config

    df = clicks(spark, sf_dir).withColumns({tuning.TIME: F.col("t").cast("timestamp_ntz"), tuning.PLACE: F.col("id")})
    cfg = tuning_config({
        "target": "y", "time_column": "t", "features": {"value": NUMERICAL, "k": NUMERICAL, "kind": CATEGORICAL}, "output_dir": "unused",
        "tuning": {"n_trials": 2, "num_boost_round": 6, "early_stopping_rounds": 2, "stability_penalty": 1.0}, "bootstrap": {"n_resamples": 50, "training_repeats": 2},
    })
    parts = splits.parts_of(df, tuning.TIME, bounds(df))
    return tuning, cfg, parts, splits.class_share(parts["train"], Y())


@query("m07_m08_search")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of the search, with the objective and what it is made of."""
    tuning, cfg, parts, rate = _tuning(spark, sf_dir)
    trials = tuning.searched(tuning.training_frames(parts, cfg, Y()), cfg, rate, lambda *a: None)
    columns = ("number", "value", "best_so_far", "num_boost_round", "validation_logloss", "bootstrap_logloss_mean", "bootstrap_logloss_std")
    return rounded(spark.createDataFrame([tuple(r[c] for c in columns) for r in trials], ", ".join(f"{c} {'long' if c in ('number', 'num_boost_round') else 'double'}" for c in columns)))


@query("m09_m16_refits")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refit on train and validation, and refits on resamples of their units, judged on the same test rows."""
    from brindle.operators import trees

    tuning, cfg, parts, _ = _tuning(spark, sf_dir)
    both = parts["train"].unionByName(parts["validation"])
    encoder, keep = splits.Encoder.fit(both, cfg["features"]), tuning.kept_columns(cfg)
    x_both, x_test = (trees.encoded(x, encoder, Y(), keep) for x in (both, parts["test"]))
    test = trees.probability(trees.train(x_both, encoder, {"maxDepth": 3}, 4, cfg["seed"]), x_test)
    whole = scoring.evaluate(test, F.col(trees.LABEL), F.col("p"), splits.class_share(both, Y())).first().asDict()
    rows = [{"repeat": -1, "status": "ok", "mean_abs_prediction_change": 0.0} | whole, *tuning.refits(x_both, x_test, test, encoder, {"maxDepth": 3}, 4, cfg, F.col(trees.LABEL))]
    return rounded(spark.createDataFrame([(r["repeat"], r["status"], r.get("logloss"), r.get("mean_abs_prediction_change")) for r in rows], "repeat long, status string, logloss double, mean_abs_prediction_change double"))


@query("m17_shapley")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions to the log-odds by feature, and what is missing of the margin."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    from brindle.operators import trees

    out, model, e = _trained(spark, sf_dir)
    names, own = [n for _, n in trees.columns_of(e)], list(e.features)
    rows = target.sampled(out, 2000, F.col("id")).select("id", "margin", vector_to_array(trees.VECTOR).alias("x")).collect()
    got, base = trees.shapley(trees.trees_of(model), np.array([r["x"] for r in rows]), [own.index(n) for n in names])
    data = [(r["id"], *map(float, v), float(abs(v.sum() + base - r["margin"]))) for r, v in zip(rows, got, strict=True)]
    return rounded(spark.createDataFrame(data, "id long, " + ", ".join(f"{n} double" for n in own) + ", rest double"))


@query("m19_best_so_far")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running least of a day's log loss."""
    from pyspark.sql import Window

    df = clicks(spark, sf_dir)
    u = scoring.unit_sums(df, Y(), F.col("p"), 0.25, scoring.unit_of("time_block", "t"), F.col("id"))
    loss = u.select("unit", (F.col("loss") / F.col("n")).alias("logloss"))  # a row per day
    return rounded(loss.withColumn("best", F.min("logloss").over(Window.orderBy("unit"))))


@query("m20_top_features")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = target.bucket_associations(rates(spark, sf_dir)).select("feature", F.round("mi_nats", 9).alias("mi_nats"))
    return rounded(a.orderBy(F.desc("mi_nats"), "feature").limit(3))


@query("p3_p4_s1_validation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.sources.parquet import check_target, declared, validation

    df = items(spark, sf_dir)
    own = declared(df, "y", NUMBERS | LEVELS, ["t"], ["g"])
    check_target(own, "y")
    return rounded(validation(own, "y", NUMBERS | LEVELS))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {n: s for n, s in ORACLES.items() if n in _queries}
