"""SQL for DuckDB that gives the rows of the queries of the same names, written apart from the engine."""

from __future__ import annotations

NUMBERS = ["price", "qty", "disc", "tax"]
LEVELS = ["line", "supp", "status", "gone"]
RARE = 600


def r(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6) + 0.0"


ITEMS = """li AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 AND l_quantity = 1 THEN 'NaN'::DOUBLE WHEN l_linenumber = 6 AND l_quantity = 2 THEN 'Infinity'::DOUBLE ELSE l_extendedprice END AS price,
  l_quantity AS qty, l_discount AS disc, l_tax AS tax,
  CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber = 4 THEN '[missing]' ELSE CAST(l_linenumber AS VARCHAR) END AS line,
  CAST(l_suppkey AS VARCHAR) AS supp, l_linestatus AS status, CAST(NULL AS VARCHAR) AS gone, l_shipdate AS t, l_orderkey AS g FROM lineitem)"""
NUM = "nr AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({n} AS DOUBLE) AS raw, y FROM li" for n in NUMBERS) + "), x AS (SELECT feature, y, raw, CASE WHEN isfinite(raw) THEN raw END AS v FROM nr)"
LEV = "l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, {n} AS level FROM li" for n in LEVELS) + "), lr AS (SELECT feature, level, count(*) AS n, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, level) AS k FROM l WHERE level IS NOT NULL GROUP BY feature, level)"
P = {"min": 0, "p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "max": 1}

_numeric = {
    "rows": "count(*)",
    "finite_count": "count(v)",
    "missing_count": "count(*) FILTER (WHERE raw IS NULL OR isnan(raw))",
    "missing_fraction": r("avg(CASE WHEN raw IS NULL OR isnan(raw) THEN 1.0 ELSE 0 END)"),
    "nonfinite_nonmissing_count": "count(*) FILTER (WHERE isinf(raw))",
    "unusable_fraction": r("avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END)"),
    "unique_nonmissing": "count(DISTINCT v)",
    "zero_fraction_finite": r("avg(CASE WHEN v = 0 THEN 1.0 WHEN v IS NOT NULL THEN 0 END)"),
    "negative_fraction_finite": r("avg(CASE WHEN v < 0 THEN 1.0 WHEN v IS NOT NULL THEN 0 END)"),
    "mean": r("avg(v)"),
    "std": r("stddev_samp(v)"),
    "median": r("median(v)"),
    "iqr": r("quantile_cont(v, 0.75) - quantile_cont(v, 0.25)"),
    "mad_unscaled": r("mad(v)"),
    "skewness": r("skewness(v)"),
    "excess_kurtosis": r("kurtosis(v)"),
} | {n: r(f"quantile_cont(v, {p})") for n, p in P.items()}


def numeric(columns: list[str]) -> str:
    return f"WITH {ITEMS}, {NUM} SELECT feature, " + ", ".join(f"{_numeric[c]} AS {c}" for c in columns) + " FROM x GROUP BY feature"


ORACLES: dict[str, str] = {
    "u01_u02_numeric_counts": numeric(["rows", "finite_count", "missing_count", "missing_fraction", "nonfinite_nonmissing_count", "unusable_fraction"]),
    "u03_unique_nonmissing": numeric(["unique_nonmissing"]),
    "u04_dominant_fraction": f"WITH {ITEMS}, {NUM}, d AS (SELECT feature, v, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY feature, v) SELECT feature, {r('max(n) / sum(n)')} AS dominant_fraction_nonmissing FROM d GROUP BY feature",
    "u05_zero_negative_fraction": numeric(["zero_fraction_finite", "negative_fraction_finite"]),
    "u06_mean": numeric(["mean"]),
    "u07_std": numeric(["std"]),
    "u08_median": numeric(["median"]),
    "u09_quantiles": numeric(list(P)),
    "u10_iqr": numeric(["iqr"]),
    "u11_mad_unscaled": numeric(["mad_unscaled"]),
    "u12_skewness": numeric(["skewness"]),
    "u13_excess_kurtosis": numeric(["excess_kurtosis"]),
    "u14_iqr_outlier_fraction": f"WITH {ITEMS}, {NUM}, q AS (SELECT feature, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x GROUP BY feature) SELECT feature, {r('avg(CASE WHEN v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) THEN 1.0 ELSE 0 END)')} AS iqr_outlier_fraction FROM x JOIN q USING (feature) WHERE v IS NOT NULL GROUP BY feature",
}

# categories
_base = f"""WITH {ITEMS}, {LEV}, tot AS (SELECT feature, count(*) AS rows, count(level) AS n FROM l GROUP BY feature),
a AS (SELECT feature, count(*) AS k, max(n) AS top, count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE n < {RARE}) AS rare, coalesce(sum(n) FILTER (WHERE n < {RARE}), 0) AS rare_rows,
  coalesce(sum(n) FILTER (WHERE n < {RARE} OR k > 20), 0) AS pooled, count(*) FILTER (WHERE n >= {RARE} AND k <= 20) AS kept FROM lr GROUP BY feature),
h AS (SELECT lr.feature, -sum(lr.n / tot.n * ln(lr.n / tot.n)) AS e FROM lr JOIN tot USING (feature) GROUP BY lr.feature),
f AS (SELECT tot.feature, rows, n, rows - n AS missing, coalesce(k, 0) AS k, top, coalesce(single, 0) AS single, coalesce(rare, 0) AS rare, coalesce(rare_rows, 0) AS rare_rows, coalesce(pooled, 0) AS pooled, coalesce(kept, 0) AS kept, CASE WHEN n > 0 THEN greatest(e, 0) END AS e
  FROM tot LEFT JOIN a USING (feature) LEFT JOIN h USING (feature))"""
ORACLES |= {
    "c01_category_counts": f"{_base} SELECT feature, rows, missing AS missing_count, {r('missing / rows')} AS missing_fraction, k AS unique_nonmissing, {r('k / nullif(n, 0)')} AS unique_fraction_nonmissing, {r('top / nullif(n, 0)')} AS dominant_fraction_nonmissing FROM f",
    "c02_entropy": f"{_base} SELECT feature, {r('e')} AS entropy_nats_nonmissing FROM f",
    "c03_effective_levels": f"{_base} SELECT feature, {r('exp(e)')} AS effective_levels_nonmissing FROM f",
    "c04_singleton_levels": f"{_base} SELECT feature, single AS singleton_levels FROM f",
    "c05_rare_levels": f"{_base} SELECT feature, rare AS rare_levels, {r('rare_rows / rows')} AS rare_row_fraction FROM f",
    "c06_pooled_fraction": f"{_base} SELECT feature, {r('pooled / rows')} AS pooled_row_fraction, kept AS retained_levels FROM f",
    "c07_categorical_diversity": f"{_base} SELECT feature, 'entropy_nats_nonmissing' AS metric, {r('e')} AS value, 0.0::DOUBLE AS low, {r('ln(k)')} AS high FROM f WHERE k > 0 UNION ALL SELECT feature, 'effective_levels_nonmissing', {r('exp(e)')}, 1.0::DOUBLE, {r('k')} FROM f WHERE k > 0",
    "c08_flags": f"""{_base}, {NUM}, d AS (SELECT feature, v, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY feature, v), dm AS (SELECT feature, max(n) / sum(n) AS top FROM d GROUP BY feature),
nf AS (SELECT feature, count(v) AS there, count(DISTINCT v) AS k, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS gone, count(*) FILTER (WHERE isinf(raw)) AS inf FROM x GROUP BY feature)
SELECT feature, concat_ws('; ', CASE WHEN there = 0 THEN 'all_missing_or_nonfinite' WHEN k = 1 THEN CASE WHEN gone > 0 THEN 'constant_observed_values_with_missingness' ELSE 'constant' END END,
  CASE WHEN top >= 0.995 THEN 'near_constant_observed_values' END, CASE WHEN gone >= 0.1 THEN 'high_missingness' END, CASE WHEN inf > 0 THEN 'contains_infinity' END) AS flags FROM nf LEFT JOIN dm USING (feature)
UNION ALL SELECT feature, concat_ws('; ', CASE WHEN n = 0 THEN 'all_missing_or_nonfinite' WHEN k = 1 THEN CASE WHEN missing > 0 THEN 'constant_observed_values_with_missingness' ELSE 'constant' END END,
  CASE WHEN top / nullif(n, 0) >= 0.995 THEN 'near_constant_observed_values' END, CASE WHEN missing / rows >= 0.8 THEN 'high_missingness' END, CASE WHEN k >= 50 THEN 'high_cardinality' END,
  CASE WHEN k / nullif(n, 0) >= 0.95 THEN 'near_unique_review_identifier' END, CASE WHEN pooled / rows >= 0.5 THEN 'most_categories_pooled_signal_may_be_hidden' END) FROM f""",
}

# codes of every row: w(y, t, g, c_<feature>)
_tenths = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"


def _number_code(n: str) -> str:
    steps = " + ".join(f"coalesce(CAST({n} > q_{n}[{i}] AND {i} < len(q_{n}) AS INT), 0)" for i in range(2, 11))
    return f"CASE WHEN {n} IS NULL OR NOT isfinite({n}) THEN 0 WHEN len(d_{n}) <= 10 THEN list_position(d_{n}, {n}) ELSE 1 + {steps} END"


def _codes(names: list[str]) -> str:
    lists = ", ".join(f"(SELECT list_sort(list_distinct(quantile_cont(v, {_tenths}))) FROM x WHERE feature = '{n}') AS q_{n}, (SELECT list_sort(list(DISTINCT v)) FROM x WHERE feature = '{n}' AND v IS NOT NULL) AS d_{n}" for n in names if n in NUMBERS)
    joins = "".join(f" LEFT JOIN lr AS r_{n} ON r_{n}.feature = '{n}' AND r_{n}.level = li.{n} AND r_{n}.n >= {RARE} AND r_{n}.k <= 20" for n in names if n in LEVELS)
    cols = ", ".join(f"{_number_code(n)} AS c_{n}" if n in NUMBERS else f"CASE WHEN li.{n} IS NULL THEN 0 ELSE coalesce(r_{n}.k, 0) + 1 END AS c_{n}" for n in names)
    lists = f", b AS (SELECT {lists})" if lists else ""
    return f"{ITEMS}, {NUM}, {LEV}{lists}, w AS (SELECT y, t, g, {cols} FROM li{', b' if lists else ''}{joins})" if not (lists and joins) else f"{ITEMS}, {NUM}, {LEV}{lists}, w AS (SELECT y, t, g, {cols} FROM (SELECT * FROM li, b) AS li{joins})"


ALL = [*NUMBERS, *LEVELS]


def _long(names: list[str]) -> str:
    return "z AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST(c_{n} AS BIGINT) AS bucket, y, t FROM w" for n in names) + ")"


def _wilson(p: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054"
    rate, scale = f"({p} / {n})", f"(1 + {z} * {z} / {n})"
    mid = f"({rate} + {z} * {z} / (2 * {n})) / {scale}"
    half = f"{z} * sqrt({rate} * (1 - {rate}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / {scale}"
    return f"least(1, greatest(0, {mid} - {half}))", f"least(1, greatest(0, {mid} + {half}))"


def _rate_columns(overall: str) -> str:
    low, high = _wilson("positives", "rows")
    return f"rows, positives, rows - positives AS negatives, {r('positives / rows')} AS positive_rate, {r(f'positives / rows / {overall}')} AS lift, {r(low)} AS positive_rate_low_iid, {r(high)} AS positive_rate_high_iid, rows < 200 OR positives < 10 OR rows - positives < 10 AS low_support"


def _counted(keys: str, source: str) -> str:
    return f"SELECT {keys}, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives FROM {source} GROUP BY {keys}"


for _name, _names in {"b1_discrete_buckets": ["tax"], "b2_quantile_buckets": ["price", "qty", "disc"], "b3_category_pooling": ["supp", "status", "gone"], "b6_literal_missing_is_a_level": ["line"]}.items():
    ORACLES[_name] = f"WITH {_codes(_names)}, {_long(_names)} SELECT feature, bucket, count(*) AS rows FROM z GROUP BY feature, bucket"

ORACLES["b4_b5_bucket_dictionary"] = f"""WITH {ITEMS}, {NUM}, {LEV}, kept AS (SELECT feature, level, k FROM lr WHERE n >= {RARE} AND k <= 20), names AS (SELECT unnest(['line', 'status', 'gone']) AS feature)
SELECT 'tax' AS feature, dense_rank() OVER (ORDER BY v) AS bucket_code, 'value: ' || printf('%g', v) AS bucket_label FROM (SELECT DISTINCT v FROM x WHERE feature = 'tax' AND v IS NOT NULL)
UNION ALL SELECT 'tax', 0, '[missing or nonfinite]'
UNION ALL SELECT feature, 0, '[missing]' FROM names
UNION ALL SELECT feature, 1, '[other: ' || ((SELECT count(*) FROM lr WHERE lr.feature = names.feature) - (SELECT count(*) FROM kept WHERE kept.feature = names.feature)) || ' pooled levels]' FROM names
UNION ALL SELECT feature, k + 1, 'value: ' || level FROM kept JOIN names USING (feature)"""

_rates = f"WITH {_codes(ALL)}, {_long(ALL)}, c AS ({_counted('feature, bucket', 'z')})"
ORACLES["screen_positive_rate"] = f"{_rates} SELECT feature, bucket, {_rate_columns('(SELECT avg(y) FROM li)')} FROM c"


def _association(cells: str, by: str, row: str) -> str:
    """ct(by, row, label, n) -> ca(by, n, k, l, mi, chi, least)."""
    part = f"PARTITION BY {by}"
    return f"""ct AS ({cells}), cm AS (SELECT *, sum(n) OVER ({part}) AS t, sum(n) OVER ({part}, {row}) AS rt, sum(n) OVER ({part}, label) AS lt FROM ct WHERE n > 0),
cn AS (SELECT {by}, any_value(t) AS n, count(DISTINCT ({row})) AS k, count(DISTINCT label) AS l, sum(n / t * ln(n * t / (rt * lt))) AS mi, sum(n * n * t / (rt * lt)) - any_value(t) AS chi, min(rt) * min(lt) / any_value(t) AS least FROM cm GROUP BY {by}),
ca AS (SELECT {by}, n > 1 AND least(k, l) >= 2 AS ok, n, k, l, mi, greatest(chi, 0) AS chi, least, greatest(0, chi / n - (k - 1) * (l - 1) / (n - 1)) AS phi, least(k - (k - 1) * (k - 1) / (n - 1) - 1, l - (l - 1) * (l - 1) / (n - 1) - 1) AS den FROM cn)"""


_V = "CASE WHEN ok AND den > 0 THEN sqrt(phi / den) END"
_target_cells = "SELECT feature, bucket, 0 AS label, rows - positives AS n FROM c UNION ALL SELECT feature, bucket, 1, positives FROM c"
_assoc = f"{_rates}, {_association(_target_cells, 'feature', 'bucket')}"
_MI = "CASE WHEN ok THEN greatest(0, mi) ELSE 0 END"
ORACLES |= {
    "t03_mutual_information": f"{_assoc} SELECT feature, {r(_MI)} AS mi_nats FROM ca",
    "t04_cramers_v_target": f"{_assoc} SELECT feature, {r(_V)} AS cramers_v_corrected FROM ca",
    "t05_chi_square": f"{_assoc} SELECT feature, {r('CASE WHEN ok THEN chi END')} AS chi2, CASE WHEN ok THEN CAST((k - 1) * (l - 1) AS BIGINT) END AS freedom, {r('CASE WHEN ok THEN least END')} AS min_expected_count FROM ca",
}
_three = "z AS (" + " UNION ALL ".join(f"SELECT 'm{k}' AS feature, g * {k} % 7 % 3 AS bucket, y FROM li" for k in (1, 2, 3, 4, 5)) + ")"
ORACLES["t06_chi2_p_and_q"] = f"""WITH {ITEMS}, {_three}, c AS ({_counted('feature, bucket', 'z')}), {_association(_target_cells, 'feature', 'bucket')}, p AS (SELECT feature, chi, exp(-chi / 2) AS p FROM ca),
k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS a FROM p)
SELECT feature, {r('chi')} AS chi2, {r('p')} AS chi2_p_iid, {r('least(1, min(a) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS chi2_q_bh_iid FROM k"""

_values = f"WITH {ITEMS}, {NUM}, s AS (SELECT feature, v, y FROM x WHERE v IS NOT NULL)"
_SEP = """e AS (SELECT feature, v, sum(y) AS p, count(*) - sum(y) AS q FROM s GROUP BY feature, v),
o AS (SELECT *, sum(p) OVER o AS cp, sum(q) OVER o AS cq, sum(p) OVER a AS ap, sum(q) OVER a AS aq FROM e WINDOW o AS (PARTITION BY feature ORDER BY v), a AS (PARTITION BY feature)),
u AS (SELECT feature, sum(p * (cq - q / 2)) / (any_value(ap) * any_value(aq)) AS auc, max(abs(cp / ap - cq / aq)) AS ks FROM o GROUP BY feature)"""
_SEP_OUT = f"SELECT feature, {r('auc')} AS raw_numeric_auc, {r('greatest(auc, 1 - auc)')} AS direction_free_auc, {r('1 - auc')} AS flipped_auc, {r('ks')} AS ks_statistic FROM u"
_D = """dd AS (SELECT feature, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, avg(v) FILTER (WHERE y = 1) AS m1, avg(v) FILTER (WHERE y = 0) AS m0, var_samp(v) FILTER (WHERE y = 1) AS v1, var_samp(v) FILTER (WHERE y = 0) AS v0 FROM s GROUP BY feature),
de AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM dd)"""
ORACLES |= {
    "t07_t08_cohens_d_hedges_g": f"{_values}, {_D} SELECT feature, {r('d')} AS cohens_d, {r('d * (1 - 3 / (4.0 * (n1 + n0 - 2) - 1))')} AS hedges_g, 'computed' AS cohens_d_status, n1 AS sample_rows_y1, n0 AS sample_rows_y0, {r('m1')} AS sample_mean_y1, {r('m0')} AS sample_mean_y0 FROM de",
    "t09_t10_auc_ks": f"{_values}, {_SEP} {_SEP_OUT}",
    "t11_t12_t14_target_correlations": f"""{_values}, k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS rv, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM s)
SELECT feature, {r('corr(v, y)')} AS point_biserial_r, {r('corr(rv, ry)')} AS spearman_target, count(*) AS sample_rows_numeric_target FROM k GROUP BY feature""",
    "t13_association_order": f"{_assoc}, bn AS (SELECT feature, count(*) AS observed_buckets FROM c GROUP BY feature) SELECT feature, {r(_MI)} AS mi_nats, observed_buckets, row_number() OVER (ORDER BY round({_MI}, 9) DESC, list_position({ALL}, feature)) AS place FROM ca JOIN bn USING (feature)",
}

CLICKS = """ev AS (SELECT event_id AS id, CAST(event_type = 'purchase' AS INT) AS y, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN user_id % 10 = 3 THEN NULL ELSE value * 2 + 1 END AS twice,
  CAST(user_id % 7 AS VARCHAR) AS kind, CAST(user_id AS VARCHAR) AS "user", ts AS t, 1 / (1 + exp(1.2 - value / (1 + abs(value)) * 0.5)) AS p FROM events)"""
_sample = f"WITH {CLICKS}, sm AS (SELECT * FROM ev ORDER BY md5('42:' || id), id LIMIT 2000)"
_evnum = ["value", "k", "twice"]
ORACLES |= {
    "sample_by_hash": f"{_sample} SELECT id, CAST(y AS BIGINT) AS y, {r('value')} AS value FROM sm",
    "sampled_auc": f"{_sample}, s AS ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS feature, CAST({n} AS DOUBLE) AS v, y FROM sm WHERE {n} IS NOT NULL' for n in _evnum)}), {_SEP} {_SEP_OUT}",
}
_evpairs = [(a, b) for i, a in enumerate([*_evnum, "id"]) for b in [*_evnum, "id"][i + 1 :]]
ORACLES["r1_r2_numeric_pairs"] = f"""WITH {CLICKS}, s AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM ev WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _evpairs)}),
k AS (SELECT *, rank() OVER (PARTITION BY feature_a, feature_b ORDER BY a) + (count(*) OVER (PARTITION BY feature_a, feature_b, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY feature_a, feature_b ORDER BY b) + (count(*) OVER (PARTITION BY feature_a, feature_b, b) - 1) / 2 AS rb FROM s)
SELECT feature_a, feature_b, count(*) AS valid_rows, {r('corr(a, b)')} AS pearson_r, {r('corr(ra, rb)')} AS spearman_r FROM k GROUP BY feature_a, feature_b"""


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def _pair_cells(pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, c_{a} AS a, c_{b} AS label, count(*) AS n FROM w GROUP BY c_{a}, c_{b}" for a, b in pairs)


_KEYS = "feature_a, feature_b"


def _category_pairs(pairs: list[tuple[str, str]], most: int) -> str:
    return f"{_association(_pair_cells(pairs), _KEYS, 'a')}, rc AS (SELECT feature_a, feature_b, CASE WHEN k * l <= {most} THEN {_V} END AS v, n, CASE WHEN k * l > {most} THEN 'skipped_cell_limit' END AS status FROM ca)"


def _mixed(pairs: list[tuple[str, str]]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, c_{a} AS code, v_{b} AS v FROM wv WHERE v_{b} IS NOT NULL" for a, b in pairs)
    return f"""mr AS ({rows}), mg AS (SELECT {_KEYS}, code, count(*) AS n, avg(v) AS m FROM mr GROUP BY {_KEYS}, code), mt AS (SELECT {_KEYS}, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM mr GROUP BY {_KEYS}),
me AS (SELECT {_KEYS}, CASE WHEN any_value(mt.n) >= 2 AND any_value(mt.ss) > 0 THEN least(1, greatest(0, sum(mg.n * (mg.m - mt.m) * (mg.m - mt.m)) / any_value(mt.ss))) END AS eta, any_value(mt.n) AS n FROM mg JOIN mt USING ({_KEYS}) GROUP BY {_KEYS})"""


def _with_values(names: list[str]) -> str:
    """w with the finite values beside the codes."""
    return _codes(names).replace("w AS (SELECT y, t, g, ", "wv AS (SELECT y, t, g, " + ", ".join(f"CASE WHEN isfinite({n}) THEN {n} END AS v_{n}" for n in names if n in NUMBERS) + ", ") + ", w AS (SELECT * FROM wv)"


def _phi(pairs: list[tuple[str, str]]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CAST(c_{a} = 0 AS INT) AS a, CAST(c_{b} = 0 AS INT) AS b FROM w" for a, b in pairs)
    return f"ph AS (SELECT {_KEYS}, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS phi FROM ({rows}) GROUP BY {_KEYS})"


ORACLES["r3_category_pairs"] = f"WITH {_codes(LEVELS)}, {_category_pairs(_pairs(LEVELS), 100)} SELECT feature_a, feature_b, {r('v')} AS cramers_v_corrected, CAST(n AS BIGINT) AS valid_rows, status FROM rc"
ORACLES["r4_eta_squared"] = f"WITH {_with_values(ALL)}, {_mixed([(a, b) for a in ('line', 'status', 'gone') for b in ('price', 'qty')])} SELECT feature_a, feature_b, {r('eta')} AS eta_squared, n AS valid_rows FROM me"
ORACLES["r5_missingness_phi"] = f"WITH {_codes(ALL)}, {_phi(_pairs(['price', 'line', 'qty', 'gone']))} SELECT feature_a, feature_b, {r('phi')} AS missingness_phi FROM ph"
_first9 = _pairs(ALL)[:9]
_nn = [p for p in _first9 if p[0] in NUMBERS and p[1] in NUMBERS]
_nc = [(b, a) for a, b in _first9 if a in NUMBERS and b in LEVELS]
ORACLES["r6_all_pairs"] = f"""WITH {_with_values(ALL)}, {_mixed(_nc)}, {_phi(_first9)},
pp AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, v_{a} AS a, v_{b} AS b FROM wv WHERE v_{a} IS NOT NULL AND v_{b} IS NOT NULL" for a, b in _nn)}),
pk AS (SELECT *, rank() OVER (PARTITION BY {_KEYS} ORDER BY a) + (count(*) OVER (PARTITION BY {_KEYS}, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY {_KEYS} ORDER BY b) + (count(*) OVER (PARTITION BY {_KEYS}, b) - 1) / 2 AS rb FROM pp),
pn AS (SELECT {_KEYS}, count(*) AS n, corr(a, b) AS pr, corr(ra, rb) AS sr FROM pk GROUP BY {_KEYS}),
nm AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', '{'numerical' if a in NUMBERS else 'categorical'}', '{'numerical' if b in NUMBERS else 'categorical'}')" for a, b in _first9)}) AS q(feature_a, feature_b, type_a, type_b))
SELECT nm.feature_a, nm.feature_b, type_a, type_b, coalesce(pn.n, me.n) AS valid_rows, {r('pr')} AS pearson_r, {r('sr')} AS spearman_r, {r('eta')} AS eta_squared, {r('phi')} AS missingness_phi, (SELECT count(*) FROM li) AS sample_rows
FROM nm LEFT JOIN pn USING ({_KEYS}) LEFT JOIN me ON me.feature_a = nm.feature_b AND me.feature_b = nm.feature_a LEFT JOIN ph ON ph.feature_a = nm.feature_a AND ph.feature_b = nm.feature_b"""

JOINT = ["tax", "line", "status"]
_jc = f"WITH {_codes(ALL)}, jr AS (SELECT CAST(c_tax AS BIGINT) AS bucket_1, CAST(c_line AS BIGINT) AS bucket_2, CAST(c_status AS BIGINT) AS bucket_3, y FROM w), c AS ({_counted('bucket_1, bucket_2, bucket_3', 'jr')})"
ORACLES["j1_joint_positive_rate"] = f"{_jc} SELECT bucket_1, bucket_2, bucket_3, {_rate_columns('(SELECT avg(y) FROM li)')} FROM c"


def _mi_of(names: list[str]) -> str:
    keys = ", ".join(f"c_{n}" for n in names)
    return f"(SELECT greatest(0, sum(n / t * ln(n * t / (a * b)))) FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY {keys}) AS a, sum(n) OVER (PARTITION BY y) AS b FROM (SELECT {keys}, y, count(*) AS n FROM w GROUP BY {keys}, y)))"


ORACLES["j3_j4_joint_information"] = f"""WITH {_codes(ALL)}, m AS (SELECT {_mi_of(JOINT)} AS j, {', '.join(f'{_mi_of([n])} AS s{i}' for i, n in enumerate(JOINT))}, {', '.join(f'{_mi_of([x for x in JOINT if x != n])} AS o{i}' for i, n in enumerate(JOINT))})
SELECT '{' + '.join(JOINT)}' AS features, (SELECT count(*) FROM w) AS sample_rows, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(f'c_{n}' for n in JOINT)} FROM w)) AS observed_sample_cells,
{r('j')} AS joint_mi_nats, {r('greatest(s0, s1, s2)')} AS best_single_mi_nats, {r('greatest(0, j - greatest(s0, s1, s2))')} AS gain_over_best_single_nats, {', '.join(f'{r(f"greatest(0, j - o{i})")} AS conditional_mi_{i + 1}_nats' for i in range(3))} FROM m"""
ORACLES["j2_j5_j6_interaction_status"] = f"""{_jc} SELECT '{' + '.join(JOINT)}' AS features, 'computed' AS status, {' * '.join(f'(SELECT count(DISTINCT c_{n}) FROM w)' for n in JOINT)} AS possible_cells, count(*) AS observed_full_cells, {r('coalesce(sum(rows) FILTER (WHERE rows < 200 OR positives < 10 OR rows - positives < 10), 0) / sum(rows)')} AS low_support_row_fraction FROM c
UNION ALL SELECT 'price + supp', 'skipped_cell_limit', {' * '.join(f'(SELECT count(DISTINCT c_{n}) FROM w)' for n in ('price', 'supp'))}, NULL, NULL"""


def _period(t: str, f: str) -> str:
    text = {"D": f"strftime({t}, '%Y-%m-%d')", "M": f"strftime({t}, '%Y-%m')", "W": f"strftime(date_trunc('week', {t}), '%Y-%m-%d') || '/' || strftime(date_trunc('week', {t}) + INTERVAL 6 DAY, '%Y-%m-%d')"}[f]
    return f"coalesce({text}, '[missing]')"


for _f in "DWM":
    _p = _period("CASE WHEN line = '1' THEN NULL ELSE t END", _f)
    ORACLES[f"w1_w3_time_positive_rate_{_f.lower()}"] = f"WITH {ITEMS}, pr AS (SELECT {_p} AS period, y FROM li), c AS ({_counted('period', 'pr')}) SELECT period, {_rate_columns('(SELECT avg(y) FROM li)')} FROM c"
_many = "CASE WHEN {n} > 120 THEN 'skipped_period_limit_choose_coarser_frequency' ELSE 'computed' END"
ORACLES["w2_w6_time_status"] = f"WITH {ITEMS} " + " UNION ALL ".join(f"SELECT '{f}' AS frequency, {_many.format(n=f'count(DISTINCT {_period(chr(116), f)})')} AS status, count(*) FILTER (WHERE t IS NULL) AS missing_rows FROM li" for f in "DWM") + " UNION ALL SELECT 'none', 'not_requested', 0"
ORACLES["w4_time_feature_positive_rate"] = f"WITH {_codes(ALL)}, {_long(['tax', 'status'])}, zp AS (SELECT feature, {_period('t', 'M')} AS period, bucket, y FROM z), c AS ({_counted('feature, period, bucket', 'zp')}) SELECT feature, period, bucket, {_rate_columns('(SELECT avg(y) FROM li)')} FROM c"
ORACLES["w5_time_drift"] = f"""WITH {_codes(ALL)}, {_long(['tax', 'line', 'supp'])}, zp AS (SELECT feature, {_period('t', 'M')} AS period, bucket FROM z), n AS (SELECT feature, period, bucket, count(*) AS n FROM zp GROUP BY ALL),
q AS (SELECT feature, bucket, sum(n) / sum(sum(n)) OVER (PARTITION BY feature) AS q FROM n GROUP BY feature, bucket), pt AS (SELECT feature, period, sum(n) AS rows FROM n GROUP BY feature, period),
full_ AS (SELECT pt.feature, pt.period, pt.rows, q.q, coalesce(n.n, 0) / pt.rows AS p FROM pt JOIN q ON q.feature = pt.feature LEFT JOIN n ON n.feature = pt.feature AND n.period = pt.period AND n.bucket = q.bucket)
SELECT feature, period, CAST(any_value(rows) AS BIGINT) AS rows, {r('greatest(0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + q * ln(2 * q / (p + q))) / 2)')} AS js_divergence_nats_vs_all FROM full_ GROUP BY feature, period"""
ORACLES["g1_group_summary"] = f"""WITH {ITEMS}, gs AS (SELECT CASE WHEN g % 10 <> 0 THEN g END AS g, count(*) AS n, sum(y) AS p FROM li GROUP BY 1)
SELECT count(*) AS groups_including_missing, CAST(coalesce(sum(n) FILTER (WHERE g IS NULL), 0) AS BIGINT) AS missing_group_rows, {r('median(n)')} AS median_rows_per_group, max(n) AS max_rows_per_group, {r('avg(CASE WHEN p > 0 THEN 1.0 ELSE 0 END)')} AS fraction_groups_with_positives FROM gs"""

ORACLES["d01_d07_rule_hits"] = f"""{_assoc}, s AS (SELECT feature, v, y FROM x WHERE v IS NOT NULL), {_D}, {_SEP},
dq AS (SELECT feature, max(n) / sum(n) AS top FROM (SELECT feature, CAST(v AS VARCHAR) AS v, count(*) AS n FROM s GROUP BY feature, v UNION ALL SELECT feature, level, n FROM lr) GROUP BY feature),
ft AS (SELECT feature, 'numerical' AS type, count(DISTINCT v) AS k, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS gone, 0.0 AS pooled FROM x GROUP BY feature
  UNION ALL SELECT l.feature, 'categorical', count(DISTINCT l.level), avg(CASE WHEN l.level IS NULL THEN 1.0 ELSE 0 END), avg(CASE WHEN l.level IS NOT NULL AND (lr.n < {RARE} OR lr.k > 20) THEN 1.0 ELSE 0 END) FROM l LEFT JOIN lr ON lr.feature = l.feature AND lr.level = l.level GROUP BY l.feature),
fa AS (SELECT ft.*, dq.top, {_MI} AS m, de.d, u.auc FROM ft LEFT JOIN dq USING (feature) LEFT JOIN ca USING (feature) LEFT JOIN de USING (feature) LEFT JOIN u USING (feature))
""" + " UNION ALL ".join(
    f"SELECT feature, '{n}' AS rule, coalesce({h}, false) AS hit FROM fa"
    for n, h in {
        "all_missing": "k = 0",
        "constant": "k = 1 AND gone = 0",
        "missingness": "gone >= 0.1",
        "near_constant": "top >= 0.5",
        "high_cardinality": "type = 'categorical' AND k >= 100",
        "weak_signal": "m < 0.0001 AND CASE WHEN type = 'numerical' THEN abs(d) < 0.05 AND abs(auc - 0.5) < 0.02 ELSE pooled <= 0.5 END",
        "direction": "type = 'numerical' AND d <> 0 AND auc <> 0.5 AND sign(d) <> sign(auc - 0.5)",
    }.items()
)

# tuning
_split = f"""{CLICKS}, tt AS (SELECT t, row_number() OVER (ORDER BY t) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM ev)),
ab AS (SELECT max(t) FILTER (WHERE k = CAST(floor(n * 0.6) AS BIGINT)) AS a, max(t) FILTER (WHERE k = CAST(floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT)) AS b FROM tt),
ti AS (SELECT t, row_number() OVER (ORDER BY t) AS k, count(*) OVER () AS n FROM tt, ab WHERE t <= a), ee AS (SELECT max(t) FILTER (WHERE k = CAST(floor(n * (1 - 0.15::DOUBLE)) AS BIGINT)) AS e FROM ti),
mm AS (SELECT ev.*, t <= a AS train, t > a + INTERVAL 1 DAY AND t <= b AS validation, t > b + INTERVAL 1 DAY AS test, t <= e AS fit, t > e + INTERVAL 1 DAY AND t <= a AS early_stop FROM ev, ab, ee)"""
_parts = ("train", "validation", "test", "fit", "early_stop")
ORACLES["m01_m02_split_summary"] = f"WITH {_split} " + " UNION ALL ".join(f"SELECT '{p}' AS split, count(*) AS rows, CAST(sum(y) AS BIGINT) AS actual_clicks, {r('avg(y)')} AS positive_rate, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS \"end\" FROM mm WHERE {p}" for p in _parts)
ORACLES["m02_gap_rows"] = f"WITH {_split} SELECT count(*) FILTER (WHERE NOT (train OR validation OR test)) AS excluded_gap_rows, count(*) FILTER (WHERE train AND NOT (fit OR early_stop)) AS inner_gap_rows FROM mm"
ORACLES["m03_crossing_entities"] = f"""WITH {_split}, lv AS (SELECT "user" AS entity, 'outer' AS level, CASE WHEN train THEN 1 WHEN validation THEN 2 WHEN test THEN 3 END AS part FROM mm UNION ALL SELECT "user", 'inner', CASE WHEN fit THEN 1 WHEN early_stop THEN 2 END FROM mm)
SELECT entity, level, count(DISTINCT part) AS parts FROM lv WHERE part IS NOT NULL GROUP BY entity, level HAVING count(DISTINCT part) > 1"""
_seen = "SELECT DISTINCT \"{c}\" AS level FROM mm WHERE train AND CAST(\"user\" AS BIGINT) % 3 <> 0"
ORACLES["m04_encoder"] = f"""WITH {_split}, vs AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS place FROM ({_seen.format(c='user')}))
SELECT ev.id, {r('CAST(CAST(value AS FLOAT) AS DOUBLE)')} AS f0, {r('vs.place')} AS f1 FROM ev LEFT JOIN vs ON vs.level = ev."user" """
ORACLES["m05_unseen_categories"] = f"WITH {_split} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS rows FROM mm WHERE test AND \"{c}\" IS NOT NULL AND \"{c}\" NOT IN ({_seen.format(c=c)})" for c in ("user", "kind"))


def _evaluation(source: str, p: str, base: float, keys: str = "") -> str:
    """SELECT list and FROM of the metrics of ``source`` (y, p columns), by optional keys."""
    group = f" GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""(SELECT {lead}count(*) AS n, sum(y) AS a, sum({p}) AS e, sum({p} * (1 - {p})) AS v, sum(-(y * ln({p}) + (1 - y) * ln(1 - {p}))) AS loss, sum((y - {p}) * (y - {p})) AS sq, sum(-(y * ln({base}) + (1 - y) * ln(1 - {base}))) AS bl FROM {source}{group}),
(SELECT {lead}sum(pp * (cn - (nn - pp) / 2 - (cp0))) / nullif(any_value(ap) * any_value(an), 0) AS auc, sum(pp * dp / dn) / nullif(any_value(ap), 0) AS ap_ FROM (
  SELECT {lead}pp, nn, sum(nn - pp) OVER (w_up) AS cn, 0 AS cp0, sum(pp) OVER (w_all) AS ap, sum(nn - pp) OVER (w_all) AS an, sum(pp) OVER (w_down) AS dp, sum(nn) OVER (w_down) AS dn FROM (SELECT {lead}{p} AS s, sum(y) AS pp, count(*) AS nn FROM {source} GROUP BY {lead}{p})
  WINDOW w_up AS ({part} ORDER BY s), w_down AS ({part} ORDER BY s DESC), w_all AS ({part})){group})"""


def _metrics() -> str:
    h = "-(CASE WHEN a > 0 THEN a / n * ln(a / n) ELSE 0 END + CASE WHEN a < n THEN (1 - a / n) * ln(1 - a / n) ELSE 0 END)"
    err = "CASE WHEN a > 0 THEN 100 * (e - a) / a END"
    return f"""{r('loss / n')} AS logloss, {r(f'CASE WHEN a > 0 AND a < n THEN loss / n / ({h}) END')} AS ne, {r('loss / bl')} AS ne_train_baseline, {r('sq / n')} AS brier, {r('(a - e) / sqrt(v)')} AS z_score, {r(err)} AS click_error_pct,
CAST(n AS BIGINT) AS rows, CAST(a AS BIGINT) AS actual_clicks, {r('e')} AS expected_clicks, {r('a / n')} AS actual_rate, {r('e / n')} AS predicted_rate, {r('e - a')} AS click_error, {r(f'abs({err})')} AS abs_click_error_pct, {r('bl / n')} AS baseline_logloss,
CASE WHEN a > 0 AND a < n THEN 'ok' ELSE 'undefined_single_class' END AS ne_status, CASE WHEN a > 0 THEN 'ok' ELSE 'undefined_zero_actual_clicks' END AS click_error_pct_status, 'iid_bernoulli_approximation' AS z_score_status, {r('auc')} AS roc_auc, {r('CASE WHEN a < n THEN ap_ END')} AS average_precision"""


def _evaluated(source: str, p: str, base: float, keys: str = "", extra: str = "") -> str:
    a, b = _evaluation(source, p, base, keys).split("),\n(", 1)
    join = f"{a}) AS m JOIN ({b} AS k ON " + (f"m.{keys} IS NOT DISTINCT FROM k.{keys}" if keys else "true")
    return f"SELECT {f'm.{keys}, ' if keys else ''}{_metrics()}{extra} FROM {join}"


ORACLES["m10_m11_m18_evaluation"] = f"WITH {CLICKS} {_evaluated('ev', 'p', 0.25, extra=', ' + repr('score') + ' AS dataset')} UNION ALL {_evaluated('ev', '0.25::DOUBLE', 0.25, extra=', ' + repr('constant') + ' AS dataset')}"
ORACLES["m13_group_metrics"] = f"WITH {CLICKS}, eg AS (SELECT * REPLACE (CASE WHEN kind <> '6' THEN kind END AS kind) FROM ev) {_evaluated('eg', 'p', 0.25, 'kind', ', n < 1400 OR a < 10 AS low_support')}"
ORACLES["m12_units"] = f"""WITH {CLICKS} SELECT CAST(floor(epoch_us(t) / 86400000000) AS BIGINT) AS unit, min(id) AS first, {r('count(*)')} AS n, {r('sum(y)')} AS y, {r('sum(p)')} AS p, {r('sum(p * (1 - p))')} AS v, {r('sum(-(y * ln(p) + (1 - y) * ln(1 - p)))')} AS loss, {r('sum((y - p) * (y - p))')} AS square, {r('sum(-(y * ln(0.25) + (1 - y) * ln(0.75)))')} AS base FROM ev GROUP BY 1"""
_cal = " + ".join(f"coalesce(CAST(p > q[{i}] AND {i} < len(q) AS INT), 0)" for i in range(2, 11))
ORACLES["m14_calibration"] = f"WITH {CLICKS}, qq AS (SELECT list_sort(list_distinct(quantile_cont(p, {_tenths}))) AS q FROM ev), bb AS (SELECT 1 + {_cal} AS bin, y, p FROM ev, qq) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS rows, {r('avg(y)')} AS actual_rate, {r('avg(p)')} AS predicted_rate FROM bb GROUP BY bin"
ORACLES["m15_daily"] = f"WITH {CLICKS} SELECT strftime(t, '%Y-%m-%d') AS period, count(*) AS rows, CAST(sum(y) AS BIGINT) AS actual_clicks, {r('sum(p)')} AS expected_clicks FROM ev GROUP BY 1"
_checks = ["y", *NUMBERS, *LEVELS]
ORACLES["p3_p4_s1_validation"] = f"WITH {ITEMS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count(*) AS rows, count(*) - count({n}) AS nulls, " + (f"count(*) FILTER (WHERE isnan({n})) AS nans, count(*) FILTER (WHERE isinf({n})) AS infinities" if n in NUMBERS else "CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS infinities") + f", count(DISTINCT {n}) AS distinct_values FROM li" for n in _checks
)
ORACLES["m19_best_so_far"] = f"""WITH {CLICKS}, d AS (SELECT CAST(floor(epoch_us(t) / 86400000000) AS BIGINT) AS unit, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS x FROM ev GROUP BY 1) SELECT unit, {r('x')} AS logloss, {r('min(x) OVER (ORDER BY unit)')} AS best FROM d"""
ORACLES["m20_top_features"] = f"{_assoc} SELECT feature, {r(f'round({_MI}, 9)')} AS mi_nats FROM ca ORDER BY round({_MI}, 9) DESC, feature LIMIT 3"

# the whole of the decisions, over events
_en, _el = ["value", "k", "twice", "id"], ["kind", "user"]
_order = {n: i for i, n in enumerate(["value", "k", "twice", "kind", "user", "id"])}
_evx = "x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({n} AS DOUBLE) AS v, y FROM ev" for n in _en) + ")"
_evl = "l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, \"{n}\" AS level, y FROM ev" for n in _el) + "), lr AS (SELECT feature, level, count(*) AS n, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, level) AS k FROM l WHERE level IS NOT NULL GROUP BY feature, level)"
_over = " + ".join(f"coalesce(CAST(v > q[{i}] AND {i} < len(q) AS INT), 0)" for i in range(2, 11))
_evcells = f"""qs AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, {_tenths}))) AS q, count(DISTINCT v) AS k FROM x GROUP BY feature),
zz AS (SELECT feature, CASE WHEN v IS NULL THEN 0 WHEN qs.k <= 10 THEN 1 + v ELSE 1 + {_over} END AS bucket, y FROM x JOIN qs USING (feature) UNION ALL SELECT l.feature, CASE WHEN l.level IS NULL THEN 0 WHEN lr.n >= 100 AND lr.k <= 20 THEN lr.k + 1 ELSE 1 END, y FROM l LEFT JOIN lr ON lr.feature = l.feature AND lr.level = l.level),
c AS ({_counted('feature, bucket', 'zz')})"""
_evpp = " UNION ALL ".join(f"SELECT '{a}' AS fa, '{b}' AS fb, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM ev WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _pairs(_en))
ORACLES["d08_d15_decisions"] = f"""WITH RECURSIVE {CLICKS}, {_evx}, {_evl}, {_evcells}, {_association(_target_cells, 'feature', 'bucket')}, s AS (SELECT feature, v, y FROM x WHERE v IS NOT NULL), {_D}, {_SEP},
dq AS (SELECT feature, max(n) / sum(n) AS top FROM (SELECT feature, CAST(v AS VARCHAR) AS v, count(*) AS n FROM s GROUP BY feature, v UNION ALL SELECT feature, level, n FROM lr) GROUP BY feature),
ft AS (SELECT feature, true AS number, count(DISTINCT v) AS k, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS gone, 0.0 AS pooled FROM x GROUP BY feature
  UNION ALL SELECT l.feature, false, count(DISTINCT l.level), avg(CASE WHEN l.level IS NULL THEN 1.0 ELSE 0 END), avg(CASE WHEN l.level IS NOT NULL AND (lr.n < 100 OR lr.k > 20) THEN 1.0 ELSE 0 END) FROM l LEFT JOIN lr ON lr.feature = l.feature AND lr.level = l.level GROUP BY l.feature),
fa AS (SELECT ft.*, top, {_MI} AS m, d, auc, CASE feature {' '.join(f"WHEN '{n}' THEN {i}" for n, i in _order.items())} END AS place, CASE WHEN abs(d) >= 0.05 THEN sign(d) END AS sd, CASE WHEN abs(auc - 0.5) >= 0.02 THEN sign(auc - 0.5) END AS sa
  FROM ft LEFT JOIN dq USING (feature) LEFT JOIN ca USING (feature) LEFT JOIN de USING (feature) LEFT JOIN u USING (feature)),
rl AS (SELECT *, CASE WHEN number THEN m < 0.0001 AND abs(d) < 0.05 AND abs(auc - 0.5) < 0.02 ELSE pooled <= 0.5 AND m < 0.0001 END AS weak, number AND (coalesce(sd <> sa, false) OR feature = 'value' AND (coalesce(sd < 0, false) OR coalesce(sa < 0, false))) AS turned FROM fa),
hits AS (SELECT feature, unnest(list_filter([CASE WHEN k = 0 THEN 'all_missing' END, CASE WHEN k = 1 AND gone = 0 THEN 'constant' END, CASE WHEN NOT number AND pooled > 0.5 THEN 'coverage' END, CASE WHEN turned THEN 'direction' END, CASE WHEN NOT number AND k >= 1000 THEN 'high_cardinality' END, CASE WHEN gone >= 0.8 THEN 'missingness' END,
  CASE WHEN top >= 0.995 THEN 'near_constant' END, CASE WHEN feature IN ('id', 'user') THEN 'override' END, CASE WHEN coalesce(weak, false) THEN 'weak_signal' END], lambda h: h IS NOT NULL)) AS rule FROM rl),
base AS (SELECT rl.*, feature = 'id' OR (feature <> 'user' AND (k = 0 OR (k = 1 AND gone = 0))) AS excluded, row_number() OVER (ORDER BY feature <> 'user', CASE WHEN feature = 'k' THEN 0 ELSE 1 END, gone, -coalesce(abs(auc - 0.5), 0), place) AS rk FROM rl),
pk AS (SELECT *, rank() OVER (PARTITION BY fa, fb ORDER BY a) + (count(*) OVER (PARTITION BY fa, fb, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY fa, fb ORDER BY b) + (count(*) OVER (PARTITION BY fa, fb, b) - 1) / 2 AS rb FROM ({_evpp})),
pc AS (SELECT fa, fb, count(*) AS n, corr(ra, rb) AS r FROM pk GROUP BY fa, fb),
ed AS (SELECT fa AS one, fb AS other FROM pc WHERE n >= 1000 AND n >= 0.5 * (SELECT count(*) FROM ev) AND abs(r) >= 0.95 UNION ALL SELECT fb, fa FROM pc WHERE n >= 1000 AND n >= 0.5 * (SELECT count(*) FROM ev) AND abs(r) >= 0.95),
walk AS (SELECT 0::BIGINT AS rk, []::VARCHAR[] AS kept, ''::VARCHAR AS feature, NULL::VARCHAR AS match
  UNION ALL SELECT b.rk, CASE WHEN NOT b.number OR b.excluded OR (h.at IS NOT NULL AND b.feature NOT IN ('value', 'kind', 'user')) THEN w.kept ELSE list_append(w.kept, b.feature) END, b.feature, CASE WHEN b.number AND NOT b.excluded THEN w.kept[h.at] END
  FROM walk w JOIN base b ON b.rk = w.rk + 1, LATERAL (SELECT min(list_position(w.kept, e.other)) FILTER (WHERE list_contains(w.kept, e.other)) AS at FROM ed e WHERE e.one = b.feature) h),
fired AS (SELECT feature, rule FROM hits UNION ALL SELECT feature, 'redundancy' FROM walk WHERE match IS NOT NULL)
SELECT b.feature, CASE WHEN b.feature = 'user' THEN 'keep' WHEN b.excluded OR (w.match IS NOT NULL AND b.feature NOT IN ('value', 'kind')) THEN 'exclude' WHEN w.match IS NOT NULL OR EXISTS (SELECT 1 FROM hits WHERE hits.feature = b.feature AND rule <> 'override') THEN 'review' ELSE 'keep' END AS decision,
  CASE WHEN b.feature = 'value' THEN 'positive' ELSE 'unspecified' END AS expected_direction, coalesce(w.match, '') AS related_features, coalesce((SELECT string_agg(rule, ', ' ORDER BY rule) FROM fired WHERE fired.feature = b.feature), '') AS fired,
  b.feature = 'user' OR NOT (b.excluded OR (w.match IS NOT NULL AND b.feature NOT IN ('value', 'kind'))) AS selected
FROM base b JOIN walk w ON w.feature = b.feature"""
