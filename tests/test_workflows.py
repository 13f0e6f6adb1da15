"""Configurations, splits, trees, and both workflows from a file to a directory."""

from __future__ import annotations

import csv
import datetime as d
import itertools
import json
import logging
import math
import sqlite3
import subprocess
import sys
from datetime import timedelta
from pathlib import Path

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from brindle.operators import splits, trees
from brindle.operators.splits import Encoder
from brindle.plans import queries as Q
from brindle.plans.audit import audit
from brindle.plans.config import ConfigError, audit_config, duration, enabled, read_yaml, tuning_config
from brindle.plans.runs import logged, run_directory, write_json
from brindle.plans.search import Search
from brindle.plans.tuning import PREDICTION, predict, tune
from brindle.sources.parquet import SchemaError, check_target, declared, open_table

AUDIT = {"target": "y", "features": {"x": "numerical", "c": "categorical"}}
TUNE = {"target": "y", "time_column": "t", "features": {"x": "numerical", "c": "categorical"}}


@pytest.mark.parametrize("more", [{"bins": 1}, {"bins": True}, {"sample_rows": 9}, {"nope": 1}, {"time_frequency": "H"}, {"interactions": [["x"]]}, {"interactions": [["x", "c"], ["c", "x"]]}, {"interactions": [["x", "q"]]}, {"ignore": ["x"]}, {"time_column": "y"}, {"statistics": {"include": ["d"]}}, {"rules": {"nope": {}}}, {"rules": {"missingness": {"threshold": 0}}}, {"rules": {"direction": {"min_auc_distance": 0.6}}}, {"rules": {"constant": {"action": "drop"}}}, {"force_keep": ["x"], "force_exclude": ["x"]}, {"prefer": ["q"]}, {"expected_direction": {"c": "positive"}}, {"features": {}}, {"features": {"x": "number"}}, {"target": "x"}, {"logging": {"console_level": "LOUD"}}])
def test_audit_configs_that_are_refused(more):
    with pytest.raises(ConfigError):
        audit_config(AUDIT | more)


@pytest.mark.parametrize("more", [{"split": {"train_fraction": 0.9}}, {"split": {"train_end": "2026-01-01"}}, {"split": {"gap": "-1D"}}, {"split": {"gap": "soon"}}, {"split": {"entity_column": "x"}}, {"bootstrap": {"method": "cluster"}}, {"bootstrap": {"time_frequency": "0D"}}, {"tuning": {"params": {"eta": 0.1}}}, {"tuning": {"params": {"stepSize": 2.0}}}, {"tuning": {"params": {"maxDepth": 3}}}, {"tuning": {"search_space": {"maxDepth": {"type": "float", "low": 1, "high": 2}}}}, {"tuning": {"search_space": {"stepSize": {"type": "float", "low": 0.5, "high": 0.1}}}}, {"tuning": {"search_space": {"maxDepth": {"type": "categorical", "choices": []}}}}, {"group_by": [["y"]]}, {"group_by": [["c"], ["c"]]}, {"seed": -1}, {"time_column": "x"}, {"report": {"shap_rows": 0}}])
def test_tuning_configs_that_are_refused(more):
    with pytest.raises(ConfigError):
        tuning_config(TUNE | more)


def test_configs(tmp_path):
    cfg = audit_config(AUDIT | {"statistics": {"include": ["auc", "ks"], "exclude": ["ks"]}})
    assert enabled(cfg, "auc") and not enabled(cfg, "ks") and not enabled(cfg, "mean") and cfg["rules"]["redundancy"]["threshold"] == 0.95
    assert tuning_config(TUNE | {"group_by": ["c", "x"]})["group_by"] == [["c", "x"]]
    assert duration("12h") == timedelta(hours=12)
    (tmp_path / "twice.yaml").write_text("target: y\nrules: {constant: {enabled: true, enabled: false}}\n")
    with pytest.raises(ConfigError, match="twice"):
        read_yaml(tmp_path / "twice.yaml")


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, 0.5, "a", True, d.date(2026, 1, 1)), (0, None, None, False, None)], "y int, `a.x` double, c string, flag boolean, day date").write.parquet(path)
    df = open_table(spark, path)
    own = declared(df, "y", {"a.x": "numerical", "c": "categorical", "flag": "categorical"}, ["day"], order="place")
    assert own.columns == ["y", "a.x", "c", "flag", "day", "place"] and own.where("y = 1").first()["flag"] == "True"
    check_target(own, "y")
    with pytest.raises(SchemaError, match="neither declared nor ignored"):
        declared(df, "y", {"a.x": "numerical"})
    with pytest.raises(SchemaError, match="not in the table.*'c'"):
        declared(df, "y", {"cc": "categorical"}, strict=False)
    with pytest.raises(SchemaError, match="do not fit"):
        declared(df, "y", {"day": "categorical"}, strict=False)
    with pytest.raises(SchemaError, match="do not fit"):
        declared(df, "y", {"c": "numerical"}, strict=False)
    for rows, words in (([(1,), (1,)], "both classes"), ([(1,), (None,)], "1 rows are null"), ([(1,), (2,)], "something else"), ([], "no rows")):
        with pytest.raises(SchemaError, match=words):
            check_target(spark.createDataFrame(rows, "y int"), "y")
    with pytest.raises(SchemaError, match="parquet"):
        open_table(spark, str(tmp_path / "t.csv"))


def times(spark):
    rng = np.random.default_rng(123)
    rows = [(float(rng.normal()), ["a", "b", None, "c"][i % 4], [0, 1, 0, 0][i % 4], d.datetime(2026, 1, 1) + timedelta(days=i // 10), i // 2) for i in range(800)]
    return spark.createDataFrame(rows, "x double, c string, y int, t timestamp_ntz, session int")


def test_splits(spark):
    df = times(spark)
    bounds = splits.find_bounds(df, "t", gap=timedelta(days=1))
    assert bounds.train_end == d.datetime(2026, 2, 17) and bounds.validation_end == d.datetime(2026, 3, 5)
    assert splits.gap_rows(df, "t", bounds).first()["excluded_gap_rows"] == 20
    summary = {r["split"]: r["rows"] for r in splits.split_summary(df, "t", F.col("y"), bounds).collect()}
    parts = splits.parts_of(df, "t", bounds)
    assert summary == {n: p.count() for n, p in parts.items()} and summary["train"] == 480
    assert splits.crossing_entities(df, "t", "session", bounds).count() == 0
    assert splits.crossing_entities(df, "t", "c", bounds).where("level = 'outer'").count() == 4
    with pytest.raises(splits.SplitError, match="too few"):
        splits.find_bounds(df.where("t < '2026-01-04'"), "t")
    with pytest.raises(splits.SplitError, match="before"):
        splits.find_bounds(df, "t", train_end="2026-03-01", validation_end="2026-02-01")
    with pytest.raises(splits.SplitError, match="both classes"):
        splits.check_parts([{"split": n, "rows": 5, "actual_clicks": 0} for n in splits.PARTS])


def test_encoder(spark):
    train = spark.createDataFrame([(1.0, "b"), (float("inf"), "a")], "x double, c string")
    later = spark.createDataFrame([(2.0, "future"), (None, None), (3.0, "b")], "x double, c string")
    e = Encoder.fit(train, {"x": "numerical", "c": "categorical"})
    assert e.levels == {"c": ["a", "b"]}
    assert [tuple(r) for r in later.select(*e.columns()).collect()] == [(2.0, None), (None, None), (3.0, 1.0)]
    assert train.select(*e.columns()).collect()[1][0] is None and e.unseen(later) == {"c": 1}
    assert Encoder(**e.to_dict()).levels == e.levels


def test_shapley_query_explains_the_default_number_of_rows(spark):
    from brindle.plans import queries

    path = "/root/testdata/sf0.01"
    rows = queries._trained(spark, path)[0].count()
    assert rows > 200 and queries.queries()["m17_shapley"](spark, path).count() == min(rows, 2000)


def test_shapley_by_all_subsets(spark):
    df = times(spark).withColumns({"z": F.col("x") * 2 + F.col("y"), "y": (F.col("x") + F.col("session") % 3 > 1).cast("int")})
    e = Encoder.fit(df, {"x": "numerical", "c": "categorical", "z": "numerical"})
    data = trees.encoded(df, e, F.col("y"), ["session"])
    model = trees.train(data, e, {"maxDepth": 3}, 2, 1)
    from pyspark.ml.functions import vector_to_array

    rows = trees.probability(model, data).select("margin", "p", vector_to_array(trees.VECTOR).alias("v")).limit(12).collect()
    x, group = np.array([r["v"] for r in rows]), [0, 0, 1, 2, 2]
    forest = trees.trees_of(model)
    values, base = trees.shapley(forest, x, group)
    assert np.allclose(values.sum(1) + base, [r["margin"] for r in rows])
    assert np.allclose([1 / (1 + math.exp(-r["margin"])) for r in rows], [r["p"] for r in rows])

    def expected(node, row, known):
        if node.left is None:
            return node.value
        if group[node.feature] in known:
            return expected(node.left if trees._goes(node, True, row[None])[0] else node.right, row, known)
        return (node.left.cover * expected(node.left, row, known) + node.right.cover * expected(node.right, row, known)) / node.cover

    game = lambda row, s: sum(w * expected(r, row, s) for w, r in forest)
    for row, got in zip(x[:4], values, strict=False):
        for f in range(3):
            others = [g for g in range(3) if g != f]
            want = sum(math.factorial(k) * math.factorial(2 - k) / 6 * (game(row, {*s, f}) - game(row, set(s))) for k in range(3) for s in itertools.combinations(others, k))
            assert got[f] == pytest.approx(want, abs=1e-9)
    scores = trees.importance(forest, [n for _, n in trees.columns_of(e)])
    assert set(scores) == {"x", "c", "z"} and scores["z"]["weight"] + scores["x"]["weight"] > 0


def test_search_is_seeded_and_finds():
    space = {"stepSize": {"type": "float", "low": 0.01, "high": 1.0, "log": True}, "maxDepth": {"type": "int", "low": 1, "high": 9}, "maxBins": {"type": "categorical", "choices": [16, 32]}}

    def go(seed):
        s = Search(space, seed)
        for _ in range(40):
            p = s.ask()
            assert 0.01 <= p["stepSize"] <= 1 and type(p["maxDepth"]) is int and p["maxBins"] in (16, 32)
            s.tell(p, abs(math.log(p["stepSize"] / 0.1)) + abs(p["maxDepth"] - 5))
        return s.trials

    assert go(1) == go(1) != go(2)
    assert min(v for _, v in go(1)) < 0.6


@pytest.fixture(scope="session")
def table(spark, small, tmp_path_factory) -> str:
    path = str(tmp_path_factory.mktemp("data") / "clicks.parquet")
    Q.clicks(spark, small).drop("p").write.parquet(path)
    return path


def read_csv(path: Path) -> list[dict]:
    with open(path, newline="") as f:
        return list(csv.DictReader(f))


def test_audit(spark, table, tmp_path):
    cfg = {"target": "y", "features": {"value": "numerical", "k": "numerical", "twice": "numerical", "kind": "categorical", "user": "categorical"}, "ignore": ["id"], "time_column": "t", "time_frequency": "W", "output_dir": str(tmp_path), "interactions": [["value", "kind"]], "statistics": {"exclude": ["hedges_g", "kurtosis"]}, "rules": {"redundancy": {"min_pair_rows": 100}}, "sample_rows": 900}
    out = audit(spark, table, cfg)
    summary = json.loads((out / "summary.json").read_text())
    rows = summary["rows"]
    assert summary["sample_rows"] == 900 and summary["decision_counts"]["exclude"] >= 1
    for i in range(5):
        own = read_csv(out / "feature_positive_rate" / f"f{i:04d}.csv")
        assert sum(int(r["rows"]) for r in own) == rows
        assert sum(int(r["rows"]) for r in read_csv(out / "time_feature_positive_rate" / f"f{i:04d}.csv")) == rows
    assert sum(int(r["rows"]) for r in read_csv(out / "joint_positive_rate" / "joint_000.csv")) == rows
    decisions = {r["feature"]: r["decision"] for r in read_csv(out / "feature_decisions.csv")}
    assert decisions["twice"] == "exclude" and decisions["value"] != "exclude"
    assert "hedges_g" not in read_csv(out / "feature_target.csv")[0] and "excess_kurtosis" not in read_csv(out / "numerical_univariate.csv")[0]
    assert len(read_csv(out / "feature_pairs.csv")) == 10
    chosen = json.loads((out / "selected_features.json").read_text())
    assert chosen["excluded_features"] == [n for n, a in decisions.items() if a == "exclude"]
    assert "{0, " in read_csv(out / "categorical_diversity.csv")[0]["metric"]
    assert "<svg" in (out / "report.html").read_text() and "| twice |" in (out / "report.md").read_text() and "Report:" in (out / "run.log").read_text()


def test_tuning(spark, table, tmp_path):
    cfg = {"target": "y", "time_column": "t", "features": {"value": "numerical", "kind": "categorical"}, "group_by": ["kind"], "output_dir": str(tmp_path), "tuning": {"n_trials": 2, "num_boost_round": 3, "early_stopping_rounds": 2}, "bootstrap": {"n_resamples": 10, "training_repeats": 1}, "report": {"shap_rows": 40, "save_predictions": True}}
    out = tune(spark, table, cfg)
    assert json.loads((out / "status.json").read_text()) == {"status": "complete"}
    assert [r["dataset"] for r in read_csv(out / "metrics.csv")] == ["validation (selection)", "test (held out)", "test constant refit-rate baseline"]
    assert len(read_csv(out / "trials.csv")) == 2 and len(read_csv(out / "bootstrap_intervals.csv")) == 6 and len(read_csv(out / "shap_values.csv")) == len(read_csv(out / "shap_features.csv")) == 40
    with sqlite3.connect(out / "study.sqlite3") as db:
        assert db.execute("SELECT count(*) FROM trials").fetchone() == (2,)
    saved = spark.read.parquet(str(out / "test_predictions.parquet"))
    again = predict(spark.read.parquet(table), out)
    both = saved.join(again.select("t", F.col(PREDICTION).alias("q")), "t")
    assert both.count() == saved.count() and both.where(F.abs(F.col(PREDICTION) - F.col("q")) > 1e-12).count() == 0
    # labels of the test part change nothing that was learned
    turned = str(tmp_path / "turned.parquet")
    last = json.loads((out / "summary.json").read_text())["split"]["validation_end"]
    spark.read.parquet(table).withColumn("y", F.when(F.col("t") > F.lit(last).cast("timestamp_ntz"), 1 - F.col("y")).otherwise(F.col("y"))).coalesce(1).write.parquet(turned)
    plain = str(tmp_path / "plain.parquet")
    spark.read.parquet(table).coalesce(1).write.parquet(plain)
    short = cfg | {"tuning": cfg["tuning"] | {"n_trials": 1}, "bootstrap": cfg["bootstrap"] | {"training_repeats": 0}, "group_by": []}
    a, b = tune(spark, plain, short), tune(spark, turned, short)
    assert (a / "best_params.json").read_text() == (b / "best_params.json").read_text()
    p, q = (sorted(tuple(r) for r in spark.read.parquet(str(x / "test_predictions.parquet")).select("t", F.round(PREDICTION, 9)).collect()) for x in (a, b))
    assert p == q


def test_failed_runs_leave_a_log(spark, table, tmp_path, capsys):
    cfg = {"target": "y", "time_column": "t", "features": {"value": "numerical"}, "output_dir": str(tmp_path), "split": {"entity_column": "user"}}
    with pytest.raises(splits.SplitError, match="several parts"):
        tune(spark, table, cfg, log_level="critical")
    (out,) = tmp_path.iterdir()
    assert json.loads((out / "status.json").read_text())["status"] == "failed" and "Traceback" in (out / "run.log").read_text()


def test_logging_is_put_back(tmp_path):
    log = logging.getLogger("brindle")
    before = (list(log.handlers), log.level, log.propagate)
    for k in range(2):
        out = run_directory(tmp_path / str(k))
        with logged(out, {"console_level": "CRITICAL", "file_level": "INFO"}) as own:
            own.info("told")
            own.debug("quiet")
        text = (out / "run.log").read_text()
        assert text.count("told") == 1 and "quiet" not in text
    assert (list(log.handlers), log.level, log.propagate) == before
    write_json(tmp_path / "x.json", {"a": float("nan"), "b": [np.float64(1.5), np.inf]})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": None, "b": [1.5, None]}


def test_command_line(tmp_path):
    (tmp_path / "bad.yaml").write_text(yaml.safe_dump(AUDIT | {"bins": 0}))
    got = subprocess.run([sys.executable, "-m", "brindle", "audit", "none.parquet", str(tmp_path / "bad.yaml")], capture_output=True, text=True, cwd=Path(__file__).parent.parent, timeout=120)
    assert got.returncode == 2 and "bins must be" in got.stderr


def test_stream_of_rates(spark, table, tmp_path):
    from brindle.streaming.rates import rated, window_counts

    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table)
    run = window_counts(stream, "t", "y").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    got = rated(spark.table("rates")).toPandas()
    assert got.rows.sum() == spark.read.parquet(table).count() and (got.positive_rate_low_iid <= got.positive_rate).all()


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['brindle.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'screen_positive_rate' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent, timeout=120)
