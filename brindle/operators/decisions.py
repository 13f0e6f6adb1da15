"""Keep, review or exclude: a table of rules, evaluated as columns of one plan over a row per feature.

``facts`` has what rules look at.  ``evaluations`` turns each rule into a status, an action, a sentence and its
evidence, all features at once.  What is left depends on the order of features and works on rows that were counted by
feature or pair: redundancy is one pass over the pairs sorted by preference, and ``decide`` puts the parts together.
An action only ever rises (keep < review < exclude) until an override sets it.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.special import finite
from brindle.operators.features import CATEGORICAL, NUMERICAL

RANK = {"keep": 0, "review": 1, "exclude": 2}

#: The rules with their default settings.
RULES: dict[str, dict] = {
    "all_missing": {"enabled": True, "action": "exclude"},
    "constant": {"enabled": True, "action": "exclude"},
    "missingness": {"enabled": True, "action": "review", "threshold": 0.8},
    "near_constant": {"enabled": True, "action": "review", "threshold": 0.995},
    "high_cardinality": {"enabled": True, "action": "review", "threshold": 1000},
    "weak_signal": {"enabled": True, "action": "review", "max_abs_d": 0.05, "max_auc_distance": 0.02, "max_mi": 0.0001},
    "direction": {"enabled": True, "action": "review", "min_abs_d": 0.05, "min_auc_distance": 0.02},
    "redundancy": {"enabled": True, "action": "exclude", "metric": "spearman", "threshold": 0.95, "sign": "absolute", "min_pair_rows": 1000, "min_pair_fraction": 0.5},
}
STRENGTH = ("mutual_information", "auc", "cohens_d", "ks", "cramers_v_target")
#: Rules whose exclusions protected features are spared.
SPARING = ("weak_signal", "redundancy")
#: A feature's numbers that rules look at, by the column of its profile or associations that they come from.
FACTS = {"distinct": "unique_nonmissing", "top": "dominant_fraction_nonmissing", "pooled": "pooled_row_fraction", "mi": "mi_nats", "d": "cohens_d", "auc": "raw_numeric_auc"}
#: Columns that decisions repeat.
TOLD = ("cohens_d", "hedges_g", "raw_numeric_auc", "direction_free_auc", "mi_nats")


@dataclass
class Policy:
    """What decisions depend on besides the tables."""

    features: dict[str, str]
    rules: dict[str, dict] = field(default_factory=lambda: {k: dict(v) for k, v in RULES.items()})
    off: set[str] = field(default_factory=set)  # metrics that are switched off
    expected: dict[str, str] = field(default_factory=dict)
    force_keep: list[str] = field(default_factory=list)
    force_exclude: list[str] = field(default_factory=list)
    prefer: list[str] = field(default_factory=list)
    interactions: list[list[str]] = field(default_factory=list)
    protect_interactions: bool = True

    @property
    def protected(self) -> set[str]:
        own = {n for g in self.interactions for n in g} if self.protect_interactions else set()
        return own | set(self.force_keep)

    def limit(self, rule: str, x: str | float) -> float:
        """A limit of a rule: a number, or the name of a setting."""
        return self.rules[rule][x] if isinstance(x, str) else x


@dataclass(frozen=True)
class Bound:
    """One comparison of a fact with a limit; ``key`` is the fact's name in the evidence."""

    fact: str
    sign: str
    limit: str | float
    key: str
    of: str | None = None  # the kind of features that it is for

    def holds(self, limit: float) -> Column:
        x = F.col(self.fact)
        return {"=": x == limit, ">=": x >= limit, "<": x < limit}[self.sign]


#: The rules that are bounds and nothing else: all must hold.
BOUNDS: dict[str, tuple[Bound, ...]] = {
    "all_missing": (Bound("distinct", "=", 0, "unique_usable_values"),),
    "constant": (Bound("distinct", "=", 1, "unique_usable_values"), Bound("missing", "=", 0, "missing_fraction")),
    "missingness": (Bound("missing", ">=", "threshold", "value"),),
    "near_constant": (Bound("top", ">=", "threshold", "value"),),
    "high_cardinality": (Bound("distinct", ">=", "threshold", "value", CATEGORICAL),),
    "weak_signal": (Bound("mi", "<", "max_mi", "mi_nats"), Bound("strength_d", "<", "max_abs_d", "abs_cohens_d", NUMERICAL), Bound("strength_auc", "<", "max_auc_distance", "auc_distance_from_half", NUMERICAL)),
}
#: What a rule that fired means to a reader.
MEANS = {
    "all_missing": "nothing to tell rows apart by",
    "constant": "the same value everywhere",
    "missingness": "look at why values are missing, which may tell something itself",
    "near_constant": "one value nearly everywhere, though missing values may tell something",
    "high_cardinality": "an identifier, or too sparse",
    "weak_signal": "weak alone, though it may matter with others",
}
#: The metrics that a rule needs, by kind, and the facts that they give.
NEEDS = {NUMERICAL: {"mutual_information": "mi", "cohens_d": "d", "auc": "auc"}, CATEGORICAL: {"mutual_information": "mi"}}

FACT_SCHEMA = "feature string, place int, kind string, expected string, protected boolean, missing double, " + ", ".join(f"{f} double" for f in FACTS)
RECORD = ("feature", "rule", "status", "requested_action", "effective_action", "related_feature", "reason", "evidence")


def facts_of(spark: SparkSession, profiles: list[dict], targets: list[dict], policy: Policy) -> DataFrame:
    """FACT_SCHEMA from result rows of the profiles and the associations."""
    profile, target = ({r["feature"]: r for r in x} for x in (profiles, targets))
    number = lambda x: float(x) if finite(x) else None
    rows = []
    for place, (n, kind) in enumerate(policy.features.items()):
        own = target[n] | profile[n]
        rows.append((n, place, kind, policy.expected.get(n), n in policy.protected, _missing(own), *[number(own.get(c)) for c in FACTS.values()]))
    return spark.createDataFrame(rows, FACT_SCHEMA)


def _missing(row: dict) -> float:
    return float(row["unusable_fraction"] if finite(row.get("unusable_fraction")) else row["missing_fraction"])


def facts_table(features: DataFrame, policy: Policy) -> DataFrame:
    """FACT_SCHEMA from a table of profiles beside associations, for any number of features."""
    names = spark_map({n: i for i, n in enumerate(policy.features)}, "int")
    col = lambda c: F.col(c).cast("double") if c in features.columns else F.lit(None).cast("double")
    missing = F.coalesce(col("unusable_fraction"), col("missing_fraction"))
    name = F.col("feature")
    return features.select(name, names[name].alias("place"), F.col("type").alias("kind"), spark_map(policy.expected, "string")[name].alias("expected"), name.isin(sorted(policy.protected)).alias("protected"), missing.alias("missing"), *[col(c).alias(f) for f, c in FACTS.items()])


def spark_map(values: dict, kind: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.create_map().cast(f"map<string,{kind}>")


def _evidence(values: dict[str, Column], nulls: bool = False) -> Column:
    """JSON of values by name; null ones only if ``nulls``."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(values.items())]), {"ignoreNullFields": str(not nulls).lower()})


def _bounded(rule: str, policy: Policy) -> dict[str, Column]:
    """status, reason and evidence of a rule of bounds."""
    bounds = [(b, policy.limit(rule, b.limit)) for b in BOUNDS[rule]]
    mine = lambda b: F.lit(True) if b.of is None else F.col("kind") == b.of
    kinds = {b.of for b, _ in bounds}
    if kinds == {CATEGORICAL}:  # a rule of one kind does not fire for the other
        hit = functools.reduce(Column.__and__, [mine(b) & b.holds(x) for b, x in bounds])
    else:
        hit = functools.reduce(Column.__and__, [F.when(mine(b), b.holds(x)).otherwise(True) for b, x in bounds])
    parts = [F.when(mine(b), F.concat(F.lit(f"{b.key.replace('_', ' ')} "), F.format_string("%.6g", b.fact), F.lit(f" {b.sign} {x:.6g}"))) for b, x in bounds]
    reason = F.concat(F.lit(f"{rule.replace('_', ' ').capitalize()}: "), F.concat_ws(" and ", *parts), F.lit(f"; {MEANS[rule]}."))
    fact = lambda b: F.col(b.fact).cast("long" if b.fact == "distinct" else "double")
    values = {b.key: F.when(mine(b), fact(b)) for b, _ in bounds} | {b.limit: F.when(mine(b), F.lit(x)) for b, x in bounds if isinstance(b.limit, str)}
    if "value" in values:
        values |= {"value": fact(bounds[0][0]), "threshold": F.lit(bounds[0][1]), "operator": F.lit(bounds[0][0].sign)}
    if rule == "weak_signal":
        values |= {"cohens_d": F.when(F.col("kind") == NUMERICAL, F.col("d")), "raw_auc": F.when(F.col("kind") == NUMERICAL, F.col("auc"))}
    status = F.when(F.coalesce(hit, F.lit(False)), "triggered").otherwise("not_triggered")
    return {"status": status, "reason": F.when(status == "triggered", reason).otherwise("The bounds do not hold."), "evidence": _evidence(values, "value" in values)}


def _weak(policy: Policy) -> dict[str, Column]:
    """The bounds of weak_signal, where what they need is on, defined and not pooled away."""
    out = _bounded("weak_signal", policy)
    number = F.col("kind") == NUMERICAL
    off = F.when(number, F.lit(", ".join(m for m in NEEDS[NUMERICAL] if m in policy.off))).otherwise(", ".join(m for m in NEEDS[CATEGORICAL] if m in policy.off))
    undefined = F.when(number, functools.reduce(Column.__or__, [F.col(f).isNull() for f in NEEDS[NUMERICAL].values()])).otherwise(F.col("mi").isNull())
    pooled = ~number & (F.coalesce("pooled", F.lit(0.0)) > 0.5)
    why = F.when(off != "", F.concat(F.lit("Statistics that it needs are off: "), off)).when(undefined, "A statistic that it needs is undefined.").when(pooled, "Pooled levels, which hold most rows, tell little of the original ones.")
    return {"status": F.when(why.isNotNull(), "skipped").otherwise(out["status"]), "reason": F.coalesce(why, out["reason"]), "evidence": F.when(why.isNotNull(), "{}").otherwise(out["evidence"]), "pooled": F.coalesce((off == "") & ~undefined & pooled, F.lit(False))}


def _direction(policy: Policy) -> dict[str, Column]:
    """The signs of Cohen's d and of the AUC, where they are large enough, against the expected sign and each other."""
    rule = policy.rules["direction"]
    sides = []
    for metric, fact, centre, least, key in (("cohens_d", "d", 0.0, rule["min_abs_d"], "cohens_d"), ("auc", "auc", 0.5, rule["min_auc_distance"], "raw_auc")):
        value = F.lit(None).cast("double") if metric in policy.off else F.col(fact)
        away = value - F.lit(centre)
        sides.append((key, value, F.when((F.abs(away) >= least) & (away != 0), F.when(away > 0, "positive").otherwise("negative"))))
    signs = F.array_compact(F.array(*[s for *_, s in sides]))
    expected = F.col("expected")
    wrong = F.coalesce(F.exists(signs, lambda s: s != expected), F.lit(False))
    torn = F.size(F.array_distinct(signs)) > 1
    seen = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), s) for k, _, s in sides])
    reason = F.when(wrong | torn, F.concat_ws("; ", F.concat(F.lit("Direction: "), seen), F.when(wrong, F.concat(F.lit("expected "), expected)), F.when(torn, "means and ranks disagree, look at skew and turning points"), F.lit("an association, not a cause.")))
    reason = F.when(F.col("kind") != NUMERICAL, "Levels have no order.").when(reason.isNotNull(), reason).when(F.size(signs) > 0, F.concat(seen, F.lit("; as expected, or nothing was."))).otherwise("No sign is large enough, or its statistics are off or undefined.")
    status = F.when(F.col("kind") != NUMERICAL, "not_applicable").when(wrong | torn, "triggered").when(F.size(signs) > 0, "not_triggered").otherwise("skipped")
    values = {"expected_direction": expected, "min_abs_d": F.lit(rule["min_abs_d"]), "min_auc_distance": F.lit(rule["min_auc_distance"])} | {k: v for k, v, _ in sides}
    return {"status": status, "reason": reason, "evidence": F.when(F.col("kind") != NUMERICAL, "{}").otherwise(_evidence(values))}


def evaluations(facts: DataFrame, policy: Policy) -> DataFrame:
    """facts -> (place, step, RECORD without overrides and redundancy): every rule of single features, in order."""
    facts = facts.withColumns({"strength_d": F.abs("d"), "strength_auc": F.abs(F.col("auc") - 0.5)})
    found = {rule: _weak(policy) if rule == "weak_signal" else _bounded(rule, policy) for rule in BOUNDS} | {"direction": _direction(policy)}
    rows = []
    for step, (rule, out) in enumerate(found.items()):
        own = policy.rules[rule]
        if not own["enabled"]:
            out = {"status": F.lit("disabled"), "reason": F.lit("The rule is switched off."), "evidence": F.lit("{}")}
        asked = own["action"]
        spared = F.lit(asked == "exclude" and rule in SPARING) & F.col("protected")
        done = F.when(out["status"] == "triggered", F.when(spared, "review").otherwise(asked)).otherwise("none")
        reason = F.when((out["status"] == "triggered") & spared, F.concat(out["reason"], F.lit(SPARED))).otherwise(out["reason"])
        rows.append(_row(2 * step, rule, out["status"], asked, done, reason, out["evidence"]))
        if "pooled" in out:
            rows.append(F.when(out["pooled"], _row(2 * step + 1, "coverage", F.lit("triggered"), "review", F.lit("review"), F.lit("Most rows are in pooled levels: keep more levels, or look at what they identify."), F.lit("{}"))))
    each = F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r")
    return facts.select("feature", "place", each).select("feature", "place", "r.*")


SPARED = " Reviewed, not excluded: force_keep or a configured combination protects it."


def _row(step: int, rule: str, status: Column, asked: str, done: Column, reason: Column, evidence: Column) -> Column:
    return F.struct(F.lit(step).alias("step"), F.lit(rule).alias("rule"), status.alias("status"), F.lit(asked).alias("requested_action"), done.alias("effective_action"), F.lit(None).cast("string").alias("related_feature"), reason.alias("reason"), evidence.alias("evidence"))


def _record(feature: str, rule: str, status: str, asked: str, reason: str, done: str | None = None, other: str | None = None, evidence: str = "{}") -> dict:
    return dict(zip(RECORD, (feature, rule, status, asked, done or (asked if status == "triggered" else "none"), other, reason, evidence), strict=True))


def preference(facts: list[dict], policy: Policy) -> list[str]:
    """Features in the order in which they stand for others."""
    place = {n: i for i, n in enumerate(policy.prefer)}
    strength = lambda f: abs(f["auc"] - 0.5) if f["auc"] is not None else 0.0
    return [f["feature"] for f in sorted(facts, key=lambda f: (f["feature"] not in policy.force_keep, place.get(f["feature"], len(place)), f["missing"], -strength(f), f["place"]))]


def redundancy(order: list[str], excluded: set[str], pairs: list[dict], policy: Policy) -> list[dict]:
    """Records of the rule, from one pass over the pairs in the order of preference.

    A pair counts if it has support; it hits if its correlation reaches the threshold.  The later feature of a hit gives
    way, unless the earlier one has given way itself.
    """
    rule, place = policy.rules["redundancy"], {n: i for i, n in enumerate(order)}
    column = f"{rule['metric']}_r"
    idle = {n: ("skipped", "Excluded already, so it stands for no other.") for n in order if n in excluded}
    for n in order:
        if n not in idle:
            if not rule["enabled"]:
                idle[n] = ("disabled", "The rule is switched off.")
            elif rule["metric"] in policy.off:
                idle[n] = ("skipped", f"Its statistic, {rule['metric']}, is off.")
            elif policy.features[n] != NUMERICAL:
                idle[n] = ("not_applicable", "The rule compares numbers with numbers.")
    turned = {"absolute": abs, "positive": lambda r: r, "negative": lambda r: -r}[rule["sign"]]
    edges = []
    for p in pairs:
        r, rows = p.get(column), p.get("valid_rows") or 0
        a, b = sorted((p["feature_a"], p["feature_b"]), key=place.__getitem__)
        if a not in idle and b not in idle and finite(r) and rows >= rule["min_pair_rows"] and rows >= rule["min_pair_fraction"] * max(1, p.get("sample_rows") or 0):
            edges.append((place[b], place[a], b, a, r, rows))
    gone, hits, met = set(), {}, set()
    spared = policy.protected if rule["action"] == "exclude" else set(order)
    for _, _, later, earlier, r, rows in sorted(edges):
        if earlier not in gone:
            met.add(later)
            if later not in hits and turned(r) >= rule["threshold"]:
                hits[later] = (earlier, r, rows)
                if later not in spared:
                    gone.add(later)
    out, standing = [], False
    for n in order:
        if n in idle:
            out.append(_record(n, "redundancy", idle[n][0], rule["action"], idle[n][1]))
            continue
        if n in hits:
            other, r, rows = hits[n]
            done = "review" if rule["action"] == "exclude" and n in policy.protected else rule["action"]
            reason = f"Redundancy: {rule['metric']} {r:+.6f} with '{other}', which is preferred ({rule['sign']}, at least {rule['threshold']:.6g}, {rows:,} rows with both)." + (SPARED if done != rule["action"] else "")
            told = {"metric": rule["metric"], "value": r, "threshold": rule["threshold"], "sign": rule["sign"], "valid_rows": rows, "retained_feature": other}
            out.append(_record(n, "redundancy", "triggered", rule["action"], reason, done, other, json.dumps(told, sort_keys=True, allow_nan=False)))
        elif n in met or not standing:
            out.append(_record(n, "redundancy", "not_triggered", rule["action"], "No preferred feature is that close."))
        else:
            out.append(_record(n, "redundancy", "skipped", rule["action"], "No pair with a preferred feature has support."))
        standing = standing or n not in gone
    return out


def decide(facts: DataFrame, pairs: list[dict], policy: Policy, associations: list[dict] = ()) -> tuple[list[dict], list[dict]]:
    """(decisions, record) from facts and rows of the pairs; rows of the associations are repeated beside the decisions."""
    rows = [r.asDict() for r in facts.orderBy("place").collect()]  # a row per feature
    record = [{k: r[k] for k in RECORD} for r in evaluations(facts, policy).orderBy("place", "step").collect()]
    rank = lambda rs: max([RANK[r["effective_action"]] for r in rs if r["effective_action"] != "none"], default=0)
    forced = {n: "exclude" for n in policy.force_exclude} | {n: "keep" for n in policy.force_keep}
    record += [_record(n, "override", "triggered", a, f"Listed in force_{a}" + (", which outweighs the rules." if a == "keep" else ".")) for n, a in forced.items()]
    by = lambda n: [r for r in record if r["feature"] == n]
    excluded = {n for n in policy.features if (RANK[forced[n]] if n in forced else rank(by(n))) == RANK["exclude"]}
    record += redundancy(preference(rows, policy), excluded, pairs, policy)
    if all(m in policy.off for m in STRENGTH):
        record += [_record(n, "coverage", "triggered", "review", "No statistic of strength is on, so nothing tells how relevant it is.") for n in policy.features]
    told, out, names = {r["feature"]: r for r in associations}, [], list(RANK)
    for f in rows:
        n, own = f["feature"], by(f["feature"])
        fired = [r for r in own if r["status"] == "triggered"]
        level = "keep" if forced.get(n) == "keep" else names[max(rank(own), RANK[forced.get(n, "keep")])]
        reasons = [r["reason"] for r in fired] or ["No rule fired; a candidate for a model."]
        if f["auc"] is not None and f["auc"] < 0.5:
            reasons.append(f"It ranks inversely: AUC {f['auc']:.4f}, {1 - f['auc']:.4f} if negated, which excludes nothing.")
        row = {"feature": n, "type": f["kind"], "decision": level, "expected_direction": f["expected"] or "unspecified", "related_features": "; ".join(r["related_feature"] for r in fired if r["related_feature"]), "reason": " ".join(reasons)}
        out.append(row | {c: told[n][c] for c in TOLD if n in told and c in told[n]})
    return out, record


def selected(decisions: list[dict]) -> list[str]:
    return [r["feature"] for r in decisions if r["decision"] in ("keep", "review")]
