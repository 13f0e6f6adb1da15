"""The audit: profiles, associations, relations and decisions of declared features, as files."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import decisions, features, relations, target
from brindle.operators.features import CATEGORICAL, NUMERICAL, quoted
from brindle.plans import html
from brindle.plans.config import METRICS, audit_config, enabled, load_audit, policy
from brindle.plans.runs import levels, logged, run_directory, write_csv, write_json
from brindle.sources.parquet import check_target, declared, open_table

ORDER = "__row_order__"
FEATURE_METRICS = {"mi_nats": "mutual_information", "cramers_v_corrected": "cramers_v_target", "chi2_p_iid": "chi_square", "min_expected_count": "chi_square", "chi2_q_bh_iid": "chi_square", "point_biserial_r": "point_biserial", "spearman_target": "spearman_target", "raw_numeric_auc": "auc", "direction_free_auc": "auc", "flipped_auc": "auc", "ks_statistic": "ks", "cohens_d": "cohens_d", "hedges_g": "hedges_g"}
PAIR_METRICS = {"pearson_r": "pearson", "spearman_r": "spearman", "cramers_v_corrected": "cramers_v_pairs", "eta_squared": "eta_squared", "missingness_phi": "missingness_phi"}


@dataclass
class Audit:
    """Small result tables, as rows."""

    profiles: list[dict]
    targets: list[dict]
    labels: dict[str, dict[int, str]]
    rates: list[dict]
    pairs: list[dict]
    joint: list[dict] = field(default_factory=list)
    joint_rates: dict[str, list[dict]] = field(default_factory=dict)
    time: dict = field(default_factory=dict)
    group: dict | None = None
    decisions: list[dict] = field(default_factory=list)
    record: list[dict] = field(default_factory=list)
    diversity: list[dict] = field(default_factory=list)
    summary: dict = field(default_factory=dict)


def rows(df: DataFrame) -> list[dict]:
    """Result tables only, whose rows are features, buckets, pairs or periods."""
    return [r.asDict(recursive=True) for r in df.collect()]


def audit_frame(df: DataFrame, cfg: dict, log=None) -> Audit:
    """Every stage over a table with the configured columns, and ORDER for the place of a row."""
    say = log.info if log else lambda *a: None
    kinds = cfg["features"]
    numbers, cats = ([n for n, k in kinds.items() if k == x] for x in (NUMERICAL, CATEGORICAL))
    on = lambda m: enabled(cfg, m)
    y = quoted(cfg["target"]).cast("int")
    say("Profiles of %s features", len(kinds))
    profiles = []
    limits = {n: cfg["rules"][n]["threshold"] for n in ("near_constant", "missingness", "high_cardinality")}
    if numbers:
        p = features.numeric_profile(df, numbers, {m for m in METRICS["numerical_univariate"] if on(m)})
        profiles += [r | {"type": NUMERICAL} for r in rows(features.flags(p, limits))]
    if cats:
        p = features.categorical_profile(df, cats, cfg["rare_min_count"], cfg["max_categories"], {m for m in METRICS["categorical_univariate"] if on(m)})
        profiles += [r | {"type": CATEGORICAL} for r in rows(features.flags(p, limits))]
    place = {n: i for i, n in enumerate(kinds)}
    profiles.sort(key=lambda r: place[r["feature"]])
    say("Buckets and the target")
    codes, labels = features.bucket_codes(df, kinds, cfg["bins"], cfg["rare_min_count"], cfg["max_categories"], ORDER)
    total, positives = df.agg(F.count("*"), F.sum(y)).first()
    rates_df = target.positive_rates(target.long_codes(df, codes, y), ["feature", "bucket"], F.lit(positives / total), cfg["min_cell_count"], cfg["min_cell_events"]).persist()
    assoc = target.tail_probabilities(target.bucket_associations(rates_df), cfg["group_column"] is not None)
    sample = df
    if total > cfg["sample_rows"]:
        sample = target.sampled(df, cfg["sample_rows"], quoted(ORDER), cfg["seed"]).persist()
    t = {r["feature"]: r | {"type": kinds[r["feature"]], "analysis_rows": total} for r in rows(assoc)}
    if numbers:
        v = target.long_values(sample, numbers, y)
        for part in (target.standardized_difference(v), target.rank_separation(v), target.target_correlations(v)):
            for r in rows(part):
                t[r["feature"]] |= r
    flags = {r["feature"]: r["flags"] for r in profiles}
    targets = [{k: x for k, x in r.items() if k not in FEATURE_METRICS or on(FEATURE_METRICS[k])} | {"flags": flags[r["feature"]]} for r in t.values()]
    targets.sort(key=lambda r: place[r["feature"]])
    if on("mutual_information"):
        targets.sort(key=lambda r: -(r["mi_nats"] if r["mi_nats"] is not None else -math.inf))
    rate_rows = sorted(rows(rates_df), key=lambda r: (place[r["feature"]], r["bucket"]))
    out = Audit(profiles, targets, labels, rate_rows if on("positive_rate") else [], [])
    most = cfg["max_pairs"] if any(on(m) for m in METRICS["feature_pairs"]) else 0
    if most and len(kinds) > 1:
        say("Pairs")
        got = rows(relations.all_pairs(sample, kinds, codes, most, cfg["max_joint_cells"]).orderBy("place").drop("place"))
        out.pairs = [{k: x for k, x in r.items() if k not in PAIR_METRICS or on(PAIR_METRICS[k])} for r in got]
    for group in cfg["interactions"]:
        say("Together: %s", " + ".join(group))
        row, table = relations.interaction(df, group, codes, y, sample, cfg["max_joint_cells"], on("joint_positive_rate"), on("joint_information"))
        out.joint += [r | {f"feature_{i + 1}": n for i, n in enumerate(group)} for r in rows(row)]
        if table is not None:
            out.joint_rates[" + ".join(group)] = [r | {f"bucket_{i + 1}": labels[n][r[f"bucket_{i + 1}"]] for i, n in enumerate(group)} for r in rows(table)]
    say("Time and groups")
    time = relations.temporal(df, codes, cfg["time_column"], y, cfg["time_frequency"], cfg["max_time_periods"], on("time_positive_rate"), on("time_feature_positive_rate"), on("time_drift"))
    out.time = {k: rows(x) if isinstance(x, DataFrame) else x for k, x in time.items()}
    if cfg["group_column"]:
        out.group = {"column": cfg["group_column"]} | rows(relations.group_summary(df, cfg["group_column"], y))[0]
    say("Decisions")
    out.diversity = named_diversity(df.sparkSession, profiles)
    rules = policy(cfg)
    out.decisions, out.record = decisions.decide(decisions.facts_of(df.sparkSession, profiles, targets, rules), out.pairs, rules, targets)
    counts = {d: sum(r["decision"] == d for r in out.decisions) for d in decisions.RANK}
    out.summary = {
        "target": cfg["target"], "rows": total, "positives": positives, "negatives": total - positives, "positive_rate": positives / total,
        "features": len(kinds), "sample_rows": min(total, cfg["sample_rows"]), "seed": cfg["seed"],
        "sample_method": "the rows with the least MD5 of seed and place: uniform, without replacement",
        "pairs_possible": len(kinds) * (len(kinds) - 1) // 2, "pairs_computed": len(out.pairs),
        "time_status": out.time["status"], "time_missing_rows": out.time["missing_rows"], "group_summary": out.group,
        "enabled_statistics": [m for ms in METRICS.values() for m in ms if on(m)], "decision_counts": {d: n for d, n in counts.items() if n},
        "pvalue_policy": "chi_square is off" if not on("chi_square") else "none, as a group column is set" if cfg["group_column"] else "row-independent chi-square, where expected counts are at least 5",
        "limitations": [
            "Associations are of the data given; none measures a model on new data.",
            "Intervals take rows as independent; repeated groups make them too narrow.",
            "Information of many sparse cells is biased upwards, and a joint gain is no proof of an interaction.",
            "Decisions are configured screening, not causes, and do not change the data.",
            "Drift compares periods with all rows; it validates nothing.",
        ],
    }
    rates_df.unpersist()
    if sample is not df:
        sample.unpersist()
    return out


def named_diversity(spark: SparkSession, profiles: list[dict]) -> list[dict]:
    """Entropy and effective levels with their bounds in the metric's name, to six digits."""
    own = [p for p in profiles if p["type"] == CATEGORICAL and "entropy_nats_nonmissing" in p]
    schema = "feature string, unique_nonmissing long, entropy_nats_nonmissing double, effective_levels_nonmissing double"
    table = spark.createDataFrame([tuple(p[c.split()[0]] for c in schema.split(", ")) for p in own], schema)
    place = {p["feature"]: i for i, p in enumerate(own)}
    got = sorted(rows(features.diversity(table)), key=lambda r: (place[r["feature"]], r["metric"] != "entropy_nats_nonmissing"))
    bounds = lambda r: f"{r['low']:.6g}, {r['high']:.6g}" if r["high"] is not None else "undefined, undefined"
    return [{"feature": r["feature"], "metric": f"{r['metric']} {{{bounds(r)}}}", "value": r["value"]} for r in got]


def write_audit(out: Path, a: Audit, cfg: dict) -> None:
    names = {n: f"f{i:04d}" for i, n in enumerate(cfg["features"])}
    for kind in (NUMERICAL, CATEGORICAL):
        write_csv(out / f"{kind}_univariate.csv", [p for p in a.profiles if p["type"] == kind], None if any(p["type"] == kind for p in a.profiles) else ["feature", "type"])
    label = lambda r: r | {"bucket": a.labels[r["feature"]][r["bucket"]]}
    write_csv(out / "categorical_diversity.csv", a.diversity, ["feature", "metric", "value"])
    write_csv(out / "feature_target.csv", a.targets)
    write_csv(out / "feature_decisions.csv", a.decisions)
    write_json(out / "feature_decisions.json", a.decisions)
    write_csv(out / "rule_evaluations.csv", a.record)
    by = lambda d: [r["feature"] for r in a.decisions if r["decision"] == d]
    write_json(out / "selected_features.json", {"selected_features": decisions.selected(a.decisions), "excluded_features": by("exclude"), "review_features": by("review"), "policy": "Reviewed features are kept; the data are not changed."})
    write_csv(out / "feature_pairs.csv", a.pairs, None if a.pairs else ["feature_a", "feature_b", "sample_rows"])
    write_csv(out / "joint_information.csv", a.joint, None if a.joint else ["features", "status"])
    write_csv(out / "bucket_dictionary.csv", [{"feature": f, "bucket_code": c, "bucket_label": t} for f, x in a.labels.items() for c, t in x.items()])
    write_csv(out / "time_positive_rate.csv", sorted(a.time.get("rates", []), key=lambda r: r["period"]), None if a.time.get("rates") else ["period", "rows", "positives", "positive_rate"])
    write_csv(out / "time_feature_drift.csv", sorted(a.time.get("drift", []), key=lambda r: (r["feature"], r["period"])), None if a.time.get("drift") else ["feature", "period", "rows", "js_divergence_nats_vs_all"])
    for n, key in names.items():
        for folder, source in (("feature_positive_rate", a.rates), ("time_feature_positive_rate", a.time.get("feature_rates", []))):
            if own := [label(r) for r in source if r["feature"] == n]:
                write_csv(out / folder / f"{key}.csv", own)
    joint_files = {n: f"joint_{i:03d}.csv" for i, n in enumerate(a.joint_rates)}
    for n, f in joint_files.items():
        write_csv(out / "joint_positive_rate" / f, a.joint_rates[n])
    write_json(out / "summary.json", a.summary)
    write_json(out / "manifest.json", {"feature_files": {n: f"{k}.csv" for n, k in names.items()}, "joint_files": joint_files})
    (out / "config_used.yaml").write_text(yaml.safe_dump(cfg, sort_keys=False), encoding="utf-8")
    parts = [html.table("Summary", [{"what": k, "value": v} for k, v in a.summary.items()]), html.table("Decisions", a.decisions, "feature_decisions.csv"), html.table("Categorical diversity with bounds", a.diversity, "categorical_diversity.csv"), html.table("Numerical features", [p for p in a.profiles if p["type"] == NUMERICAL], "numerical_univariate.csv"), html.table("Categorical features", [p for p in a.profiles if p["type"] == CATEGORICAL], "categorical_univariate.csv"), html.table("Features and the target", a.targets, "feature_target.csv"), html.table("Pairs", a.pairs, "feature_pairs.csv"), html.table("Together", a.joint, "joint_information.csv"), html.table("Rules", a.record, "rule_evaluations.csv")]
    for n in names:
        own = [r for r in a.rates if r["feature"] == n]
        parts.append(html.curves(f"Rate by bucket: {n}", {"rate": [(i, r["positive_rate"]) for i, r in enumerate(own)], "low": [(i, r["positive_rate_low_iid"]) for i, r in enumerate(own)], "high": [(i, r["positive_rate_high_iid"]) for i, r in enumerate(own)]}))
    if a.time.get("rates"):
        own = sorted(a.time["rates"], key=lambda r: r["period"])
        parts += [html.curves("Rate by period", {"rate": [(i, r["positive_rate"]) for i, r in enumerate(own)]}), html.table("Drift", a.time.get("drift", []), "time_feature_drift.csv")]
    (out / "report.html").write_text(html.page(f"Audit of features for {cfg['target']}", parts), encoding="utf-8")
    text = f"# Audit of features for {html.markdown_cell(cfg['target'])}\n\n" + html.markdown_table(a.decisions, ["feature", "type", "decision", "reason"]) + "\n## Categorical diversity with bounds\n\n" + html.markdown_table(a.diversity, ["feature", "metric", "value"]) + "\n## Limits\n\n" + "".join(f"- {x}\n" for x in a.summary["limitations"])
    (out / "report.md").write_text(text, encoding="utf-8")


def audit(spark: SparkSession, dataset: str, config: str | dict, log_level: str | None = None, file_log_level: str | None = None) -> Path:
    """One Parquet table and a configuration (a YAML file, or a mapping) to a run's directory."""
    cfg = audit_config(config) if isinstance(config, dict) else load_audit(config)
    cfg["logging"] = levels(cfg["logging"], log_level, file_log_level)
    out = run_directory(cfg["output_dir"])
    with logged(out, cfg["logging"]) as log:
        log.info("Reading %s", dataset)
        table = open_table(spark, dataset)
        df = declared(table, cfg["target"], cfg["features"], [cfg["time_column"], cfg["group_column"]], cfg["ignore"], cfg["strict_schema"], ORDER)
        check_target(df, cfg["target"])
        a = audit_frame(df, cfg, log)
        a.summary |= {"dataset": str(dataset), "created_utc": datetime.now(timezone.utc).isoformat(), "schema_columns": table.columns, "ignored_columns": cfg["ignore"], "undeclared_columns_not_analyzed": sorted(set(table.columns) - set(df.columns) - set(cfg["ignore"]))}
        write_audit(out, a, cfg)
        log.info("Report: %s", out / "report.html")
    return out
