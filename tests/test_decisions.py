from __future__ import annotations

import copy

import pytest

from brindle.operators import decisions
from brindle.operators.decisions import RULES, Policy, facts_of, selected


_spark = None


@pytest.fixture(autouse=True)
def session(spark):
    global _spark
    _spark = spark


def decide(profiles, targets, pairs, policy):
    return decisions.decide(facts_of(_spark, profiles, targets, policy), pairs, policy, targets)


def setting(names=("x", "z"), **more):
    rules = copy.deepcopy(RULES)
    for rule, values in more.pop("rules", {}).items():
        rules[rule].update(values)
    return Policy(dict.fromkeys(names, "numerical"), rules, **more)


def tables(names=("x", "z"), r=0.99, valid=2000, sample=2000, **own):
    profiles = [{"feature": n, "type": "numerical", "unique_nonmissing": 50, "missing_fraction": 0.0, "unusable_fraction": 0.0, "dominant_fraction_nonmissing": 0.1} | own.get(n, {}) for n in names]
    targets = [{"feature": n, "cohens_d": 0.3, "raw_numeric_auc": 0.6, "mi_nats": 0.01} | own.get(n, {}) for n in names]
    pairs = [{"feature_a": a, "feature_b": b, "spearman_r": r, "pearson_r": r, "valid_rows": valid, "sample_rows": sample} for i, a in enumerate(names) for b in names[i + 1 :]]
    return profiles, targets, pairs


def actions(policy, *t):
    rows, record = decide(*t, policy)
    return {r["feature"]: r["decision"] for r in rows}, record


def test_redundancy_keeps_the_first_and_honours_preference():
    assert actions(setting(), *tables())[0] == {"x": "keep", "z": "exclude"}
    assert actions(setting(prefer=["z"]), *tables())[0] == {"x": "exclude", "z": "keep"}
    assert actions(setting(), *tables(z={"raw_numeric_auc": 0.9}))[0] == {"x": "exclude", "z": "keep"}
    assert actions(setting(), *tables(x={"unusable_fraction": 0.1}))[0] == {"x": "exclude", "z": "keep"}


def test_redundancy_needs_support_and_sign():
    assert actions(setting(), *tables(valid=999))[0]["z"] == "keep"
    got, record = actions(setting(), *tables(valid=1000, sample=2001))
    assert got["z"] == "keep" and [r["status"] for r in record if r["rule"] == "redundancy"] == ["not_triggered", "skipped"]
    assert actions(setting(rules={"redundancy": {"sign": "positive"}}), *tables(r=-0.99))[0]["z"] == "keep"
    assert actions(setting(rules={"redundancy": {"sign": "negative"}}), *tables(r=-0.99))[0]["z"] == "exclude"
    assert actions(setting(off={"spearman"}), *tables())[0]["z"] == "keep"


def test_excluded_features_stand_for_none():
    got, _ = actions(setting(force_exclude=["x"]), *tables())
    assert got == {"x": "exclude", "z": "keep"}
    names = ("a", "b", "c")
    p, t, pairs = tables(names)
    pairs[2]["spearman_r"] = 0.1  # b and c
    pairs[0]["spearman_r"] = 0.99
    assert actions(setting(names), p, t, pairs)[0] == {"a": "keep", "b": "exclude", "c": "exclude"}


def test_force_keep_has_the_last_word():
    got, record = actions(setting(force_keep=["z"]), *tables())
    assert got == {"x": "exclude", "z": "keep"}
    got, _ = actions(setting(force_keep=["x", "z"]), *tables())
    assert got == {"x": "keep", "z": "keep"}


def test_interactions_protect():
    got, _ = actions(setting(interactions=[["x", "z"]]), *tables())
    assert got["z"] == "review"
    got, _ = actions(setting(interactions=[["x", "z"]], protect_interactions=False), *tables())
    assert got["z"] == "exclude"
    weak = {"cohens_d": 0.0, "raw_numeric_auc": 0.5, "mi_nats": 0.0}
    got, _ = actions(setting(interactions=[["x", "z"]], rules={"weak_signal": {"action": "exclude"}}), *tables(r=0.1, x=weak))
    assert got["x"] == "review"


def test_direction():
    wrong = actions(setting(expected={"x": "negative"}), *tables(r=0.1))[0]
    assert wrong == {"x": "review", "z": "keep"}
    torn, record = actions(setting(), *tables(r=0.1, x={"cohens_d": 0.3, "raw_numeric_auc": 0.4}))
    assert torn["x"] == "review" and any("disagree" in r["reason"] for r in record)
    quiet, record = actions(setting(), *tables(r=0.1, x={"cohens_d": 0.01, "raw_numeric_auc": 0.5}))
    assert [r["status"] for r in record if r["rule"] == "direction" and r["feature"] == "x"] == ["skipped"]


def test_observed_rules_and_skips():
    got, record = actions(setting(), *tables(r=0.1, x={"unique_nonmissing": 0, "unusable_fraction": 1.0, "cohens_d": None, "raw_numeric_auc": None, "dominant_fraction_nonmissing": None}, z={"unique_nonmissing": 1, "dominant_fraction_nonmissing": 1.0}))
    assert got == {"x": "exclude", "z": "exclude"}
    status = {(r["feature"], r["rule"]): r["status"] for r in record}
    assert status["x", "weak_signal"] == "skipped" and status["z", "near_constant"] == "triggered" and status["z", "constant"] == "triggered"
    assert actions(setting(off={"mutual_information", "auc", "cohens_d", "ks", "cramers_v_target"}), *tables(r=0.1))[0] == {"x": "review", "z": "review"}


def test_pooled_categories_get_reviewed():
    policy = Policy({"c": "categorical"})
    p = [{"feature": "c", "type": "categorical", "unique_nonmissing": 5, "missing_fraction": 0.0, "dominant_fraction_nonmissing": 0.3, "pooled_row_fraction": 0.6}]
    rows, record = decide(p, [{"feature": "c", "mi_nats": 0.0}], [], policy)
    assert rows[0]["decision"] == "review" and any(r["rule"] == "coverage" for r in record)
    assert selected(rows) == ["c"]
    p[0]["pooled_row_fraction"] = 0.5
    assert any(r["rule"] == "weak_signal" and r["status"] == "triggered" for r in decide(p, [{"feature": "c", "mi_nats": 0.0}], [], policy)[1])
