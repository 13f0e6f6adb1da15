"""Statistics with known values, and their edge cases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.functions.columns import wilson
from brindle.functions.special import chi_square_tail, step_up
from brindle.operators import features, relations, scoring, target
from brindle.operators.quantiles import exact_quantiles

NUM = features.NUMERICAL
CAT = features.CATEGORICAL

def Y():  # noqa: N802
    """The target; columns need a session, modules do not."""
    return F.col("y")



def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_wilson(spark):
    low, high = wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in frame(spark, [(0, 100), (50, 100), (100, 100), (0, 0)], "k long, n long").select(low, high).collect()]
    assert got[0] == (pytest.approx(0.0, abs=1e-15), pytest.approx(0.0369934982)) and got[1][0] == pytest.approx(0.4038315304) and got[2][1] == 1.0
    assert got[3] == (None, None)


def test_step_up():
    assert step_up([0.01, 0.04, 0.03, float("nan"), None]) == [pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04), None, None]
    assert step_up([]) == []


def test_chi_square_tail():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi_square_tail(4.0, 2) == pytest.approx(math.exp(-2))
    assert chi_square_tail(30.0, 20) == pytest.approx(0.0698536, abs=1e-6)
    assert chi_square_tail(0.0, 5) == 1.0


def cells(spark, tables):
    rows = [(name, i, j, n) for name, t in tables.items() for i, r in enumerate(t) for j, n in enumerate(r)]
    df = frame(spark, rows, "feature string, bucket int, label int, n long")
    return {r["feature"]: r for r in target.table_association(df, ["feature"], ["bucket"], "label").collect()}


def test_associations_of_tables(spark):
    got = cells(spark, {"none": [[100, 100], [100, 100]], "all": [[100, 0], [0, 100]], "few": [[1, 0], [0, 1]], "one": [[5, 7]], "empty line": [[3, 4], [0, 0]]})
    assert got["none"]["mi_nats"] == pytest.approx(0, abs=1e-12) and got["none"]["cramers_v_corrected"] == 0
    assert got["all"]["mi_nats"] == pytest.approx(math.log(2)) and got["all"]["cramers_v_corrected"] == pytest.approx(1)
    assert got["few"]["min_expected_count"] == 0.5
    assert got["one"]["mi_nats"] == got["empty line"]["mi_nats"] == 0 and got["one"]["chi2"] is None
    df = frame(spark, [("few", 0, 0, 1), ("few", 1, 1, 1)], "feature string, bucket int, label int, n long")
    assert target.tail_probabilities(target.table_association(df, ["feature"], ["bucket"], "label")).first()["chi2_p_iid"] is None


def test_nothing_alone_everything_together(spark):
    df = frame(spark, [(a, b, a ^ b) for a in (0, 1) for b in (0, 1)] * 100, "a int, b int, y int")
    r = relations.joint_information(df, {"a": F.col("a"), "b": F.col("b")}, Y()).first()
    assert r["best_single_mi_nats"] == pytest.approx(0, abs=1e-9)
    for c in ("joint_mi_nats", "gain_over_best_single_nats", "conditional_mi_1_nats", "conditional_mi_2_nats"):
        assert r[c] == pytest.approx(math.log(2))


def test_standardized_difference(spark):
    rows = [("x", float(v), y) for v, y in zip([1, 2, 3, 2, 3, 4], [0, 0, 0, 1, 1, 1], strict=True)]
    rows += [("turned", -v, y) for _, v, y in rows] + [("flat", 1.0, y) for y in (0, 0, 1, 1)] + [("short", 1.0, 0), ("short", 2.0, 1)]
    got = {r["feature"]: r for r in target.standardized_difference(frame(spark, rows, "feature string, v double, y int")).collect()}
    assert got["x"]["cohens_d"] == pytest.approx(1) and got["x"]["hedges_g"] == pytest.approx(0.8) and got["turned"]["cohens_d"] == pytest.approx(-1)
    assert got["flat"]["cohens_d"] is None and got["flat"]["cohens_d_status"] == "zero_or_nonfinite_pooled_sd"
    assert got["short"]["cohens_d_status"] == "insufficient_class_rows"


def test_auc_turns_and_ties(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 8, 300).astype(float), rng.integers(0, 2, 300)
    rows = [("x", float(a), int(b)) for a, b in zip(x, y, strict=True)] + [("turned", -float(a), int(b)) for a, b in zip(x, y, strict=True)] + [("flat", 1.0, int(b)) for b in y] + [("one class", float(a), 1) for a in x]
    got = {r["feature"]: r for r in target.rank_separation(frame(spark, rows, "feature string, v double, y int")).collect()}
    p, q = x[y == 1], x[y == 0]
    want = np.mean((p[:, None] > q) + 0.5 * (p[:, None] == q))
    assert got["x"]["raw_numeric_auc"] == pytest.approx(want) and got["turned"]["raw_numeric_auc"] == pytest.approx(1 - want)
    assert got["flat"]["raw_numeric_auc"] == 0.5 and got["one class"]["raw_numeric_auc"] is None
    steps = np.unique(x)
    assert got["x"]["ks_statistic"] == pytest.approx(max(abs(np.mean(p <= s) - np.mean(q <= s)) for s in steps))


def test_entropy_and_flags(spark):
    rows = [("a" if i < 40 else "b" if i < 80 else "c" if i < 100 else None, "a" if i < 50 else "b" if i < 100 else None, "k" if i < 100 else None, None, float(i), i % 2) for i in range(120)]
    df = frame(spark, rows, "`<channel|name>` string, balanced string, constant string, empty string, `num.ber` double, y int")
    names = ["<channel|name>", "balanced", "constant", "empty"]
    got = {r["feature"]: r for r in features.flags(features.categorical_profile(df, names, 30)).collect()}
    assert got["<channel|name>"]["entropy_nats_nonmissing"] == pytest.approx(1.0549201679861442) and got["<channel|name>"]["effective_levels_nonmissing"] == pytest.approx(2.871745887492588)
    assert got["balanced"]["effective_levels_nonmissing"] == pytest.approx(2) and got["constant"]["entropy_nats_nonmissing"] == 0
    assert got["empty"]["entropy_nats_nonmissing"] is None and got["empty"]["flags"] == "all_missing_or_nonfinite; high_missingness"
    assert got["constant"]["flags"].startswith("constant_observed_values_with_missingness")
    assert features.numeric_profile(df, ["num.ber"]).first()["mean"] == pytest.approx(59.5)


def test_missing_is_no_level(spark):
    df = frame(spark, [("[missing]",)] * 5 + [("[other]",)] * 4 + [(None,)] * 3 + [("rare",)], "c string")
    (pool,) = features.pool_levels(features.level_counts(df, ["c"]), ["c"], 2, 20).values()
    assert pool.kept == ["[missing]", "[other]"] and pool.labels[2] == "value: [missing]" and pool.labels[1] == "[other: 1 pooled levels]"
    got = {tuple(r) for r in df.select("c", features.category_code(F.col("c"), pool).alias("b")).distinct().collect()}
    assert got == {("[missing]", 2), ("[other]", 3), (None, 0), ("rare", 1)}


def test_buckets_hold_their_right_ends(spark):
    inf, nan = float("inf"), float("nan")
    df = frame(spark, [(float(i), 1.0) for i in range(101)] + [(nan, 2.0), (inf, None), (None, nan)], "x double, few double")
    cuts = features.cut_numbers(df, ["x", "few"], 10)
    assert cuts["x"].edges == [10.0 * i for i in range(11)] and cuts["few"].values == [1.0, 2.0]
    code = {r[0]: r[1] for r in df.where("x is not null and not isnan(x)").select("x", features.number_code(F.col("x"), cuts["x"])).collect()}
    assert code[0.0] == 1 and code[10.0] == 1 and code[10.0 + 1] == 2 and code[100.0] == 10 and code[inf] == 0
    assert cuts["x"].labels[1] == "[0, 10]" and cuts["x"].labels[2] == "(10, 20]" and cuts["few"].labels[1] == "value: 1"


@pytest.mark.parametrize("kind", ["uniform", "heavy", "ties", "one", "wide", "tiny"])
def test_quantiles_by_histograms(spark, kind):
    rng = np.random.default_rng(7)
    x = {"uniform": rng.random(3000), "heavy": np.exp(rng.normal(0, 12, 3000)) * rng.choice([-1, 1], 3000), "ties": rng.integers(0, 5, 3000).astype(float), "one": np.full(50, 3.5), "wide": np.array([-1.7e308, 0.0, 1.7e308, 1.0, 2.0, -3.0]), "tiny": np.array([5e-324, 0.0, 1e-323, 1e-310, 0.0])}[kind]
    p = [0, 0.01, 0.25, 0.5, 1 / 3, 0.99, 1]
    df = frame(spark, [("f", float(v)) for v in x], "feature string, v double")
    if kind == "wide":  # differences overflow in between; the values themselves are found
        p = [0, 0.2, 0.4, 0.6, 0.8, 1]
    assert np.allclose(exact_quantiles(df, p)["f"], np.sort(x) if kind == "wide" else np.quantile(x, p), rtol=1e-12, atol=0)


def test_ranks_of_pairs_and_target_from_counts(spark):
    rng = np.random.default_rng(3)
    x, z, y = rng.integers(0, 9, 400).astype(float), rng.normal(size=400).round(1), rng.integers(0, 2, 400)
    df = frame(spark, [(float(a), float(b), int(c)) for a, b, c in zip(x, z, y, strict=True)], "x double, z double, y int")
    rank = lambda v: pd.Series(v).rank().to_numpy()
    got = relations.numeric_pairs(df, [("x", "z")]).first()
    assert np.isclose(got["spearman_r"], np.corrcoef(rank(x), rank(z))[0, 1]) and np.isclose(got["pearson_r"], np.corrcoef(x, z)[0, 1]) and got["valid_rows"] == 400
    for r in target.target_correlations(target.long_values(df, ["x", "z"], F.col("y"))).collect():
        v = {"x": x, "z": z}[r["feature"]]
        assert np.isclose(r["spearman_target"], np.corrcoef(rank(v), rank(y))[0, 1]) and np.isclose(r["point_biserial_r"], np.corrcoef(v, y)[0, 1])


def test_target_correlations_of_millions_of_rows(spark):
    v, y = [3.0, 1.0, 2.0, 2.0, 5.0], [1, 0, 0, 1, 0]  # repeated rows leave correlations as they are
    at = (F.col("id") % 5).cast("int") + 1
    df = spark.range(4_000_000).select(F.element_at(F.array(*map(F.lit, v)), at).alias("v"), F.element_at(F.array(*map(F.lit, y)), at).alias("y"))
    r = target.target_correlations(target.long_values(df, ["v"], F.col("y"))).first()
    assert r["sample_rows_numeric_target"] == 4_000_000
    assert np.isclose(r["spearman_target"], np.corrcoef(pd.Series(v).rank(), pd.Series(y).rank())[0, 1]) and np.isclose(r["point_biserial_r"], np.corrcoef(v, y)[0, 1])


def test_degenerate_correlations(spark):
    df = frame(spark, [(1.0, 2.0, 1.0), (1.0, 3.0, 2.0), (1.0, None, 3.0), (1.0, 5.0, None)], "flat double, x double, z double")
    got = {(r["feature_a"], r["feature_b"]): r for r in relations.numeric_pairs(df, relations.first_pairs(["flat", "x", "z"])).collect()}
    assert got["flat", "x"]["pearson_r"] is None and got["flat", "x"]["valid_rows"] == 3
    assert got["x", "z"]["spearman_r"] is None and got["x", "z"]["valid_rows"] == 2


def test_drift_and_periods(spark):
    import datetime as d

    rows = [(d.datetime(2026, 1, 1), 1, 1), (d.datetime(2026, 1, 4, 23), 2, 0), (d.datetime(2026, 1, 5), 2, 1), (None, 1, 0)]
    df = frame(spark, rows, "t timestamp_ntz, b int, y int")
    weeks = [r[0] for r in df.select(relations.period(F.col("t"), "W")).collect()]
    assert weeks == ["2025-12-29/2026-01-04", "2025-12-29/2026-01-04", "2026-01-05/2026-01-11", "[missing]"]
    got = {r["period"]: r["js_divergence_nats_vs_all"] for r in relations.period_drift(df, {"f": F.col("b")}, relations.period(F.col("t"), "W")).collect()}
    js = lambda p, q: sum(a * math.log(2 * a / (a + b)) if a else 0 for a, b in zip(p, q, strict=True)) / 2 + sum(b * math.log(2 * b / (a + b)) for a, b in zip(p, q, strict=True)) / 2
    assert got["2025-12-29/2026-01-04"] == pytest.approx(0, abs=1e-12) and got["[missing]"] == pytest.approx(js((1, 0), (0.5, 0.5)))
    with pytest.raises(ValueError, match="no timestamps"):
        relations.parsed_time(frame(spark, [("2026-01-01",), ("soon",)], "t string"), "t")
    with pytest.raises(ValueError, match="ambiguous"):
        relations.parsed_time(frame(spark, [(5,)], "t long"), "t")


def test_probability_metrics(spark):
    df = frame(spark, [(1, 0.8), (0, 0.1), (1, 0.7), (0, 0.2)], "y int, p double")
    r = scoring.evaluate(df, Y(), F.col("p"), 0.5).first()
    ll = -np.mean(np.log([0.8, 0.9, 0.7, 0.8]))
    assert r["logloss"] == pytest.approx(ll) and r["ne"] == pytest.approx(ll / math.log(2)) and r["click_error_pct"] == pytest.approx(-10)
    assert r["z_score"] == pytest.approx(0.2 / math.sqrt(0.16 + 0.09 + 0.21 + 0.16)) and r["roc_auc"] == 1 and r["average_precision"] == 1
    none = scoring.evaluate(df.withColumn("y", F.lit(0)), Y(), F.lit(0.0), 0.5).first()
    assert none["ne"] is None and none["click_error_pct"] is None and none["z_score"] is None and none["roc_auc"] is None
    assert none["ne_status"] == "undefined_single_class" and none["click_error_pct_status"] == "undefined_zero_actual_clicks"


def test_bootstrap_takes_units_whole(spark):
    units = np.array([[2.0, 1, 0.8, 0.3, 1.0, 0.4, 1.2], [3.0, 1, 1.2, 0.6, 2.0, 0.5, 1.9], [1.0, 0, 0.3, 0.2, 0.4, 0.1, 0.7]])
    assert all(np.isin(t[0], range(3, 10)) for t in scoring.resampled(units, 50, 1))
    assert np.allclose(list(scoring.resampled(units, 5, 3)), list(scoring.resampled(units, 5, 3)))
    assert scoring.intervals(units[:1], 10, 0.95, 1)[0]["status"] == "insufficient_units"
    df = frame(spark, [(i, i // 4, i % 2, 0.1 + 0.02 * (i % 30), "g" if i % 3 else None) for i in range(40)], "id int, c int, y int, p double, g string")
    got = scoring.bootstrap(df, Y(), F.col("p"), 0.5, scoring.unit_of("cluster", cluster="c"), F.col("id"), 20).collect()
    assert len(got) == 6 and all(r["units"] == 10 and r["low"] <= r["high"] for r in got)
    groups = scoring.group_evaluation(df, ["g"], Y(), F.col("p"), 0.5, scoring.unit_of("cluster", cluster="c"), F.col("id"), times=10).collect()
    assert [r["g"] for r in groups] == ["g", None] and groups[0]["rows"] == 26 and groups[0]["low_support"]


def test_many_units_are_drawn_as_many_times_as_there_are(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_UNITS", 100)
    df = spark.range(3000).selectExpr("id", "cast(id % 3 = 0 as int) y", "0.2 + 0.3 * (id % 2) p")
    totals = []
    known = scoring.from_totals
    monkeypatch.setattr(scoring, "from_totals", lambda t: totals.append(t) or known(t))
    scoring.bootstrap(df, Y(), F.col("p"), 0.3, F.col("id"), F.col("id"), 50).collect()
    assert (totals[0][:, 0] == 3000).all() and 15 < totals[0][:, 1].std() < 40  # sqrt(3000 * 1/3 * 2/3) is 26


def test_many_units_get_weights_where_they_are(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "cast(id % 3 = 0 as int) y", "0.2 + 0.3 * (id % 2) p")
    args = (df, Y(), F.col("p"), 0.3, F.col("id"), F.col("id"), 200)
    a = {r["metric"]: r for r in scoring.bootstrap(*args).collect()}
    monkeypatch.setattr(scoring, "MOST_UNITS", 100)
    b = {r["metric"]: r for r in scoring.bootstrap(*args).collect()}
    again = {r["metric"]: r for r in scoring.bootstrap(args[0].repartition(5), *args[1:]).collect()}
    assert all(again[m]["low"] == pytest.approx(b[m]["low"]) for m in scoring.METRICS)
    for m in scoring.METRICS:
        assert b[m]["units"] == 3000 and b[m]["std"] == pytest.approx(a[m]["std"], rel=0.25)
        assert b[m]["low"] == pytest.approx(a[m]["low"], abs=2 * a[m]["std"])
