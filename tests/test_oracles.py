"""Every query that has SQL gives the rows of its SQL."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from brindle.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="session")
def con(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 5) + 0.0 if isinstance(x, float) else x.item() if hasattr(x, "item") else x


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, small, con, name):
    got, want = queries.queries()[name](spark, small).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-5) for p, q in zip(x, y, strict=True)), (x, y)


def test_queries_without_sql_run(spark, small):
    left = set(queries.queries()) - set(queries.oracle_sql())
    assert left == {"m06_m09_training", "m07_m08_search", "m09_m16_refits", "m12_bootstrap", "m13_group_bootstrap", "m17_shapley"}


def test_search_and_refits(spark, small):
    trials = queries.queries()["m07_m08_search"](spark, small).orderBy("number").toPandas()
    assert len(trials) == 2 and (trials.value.cummin() - trials.best_so_far).abs().max() < 1e-9
    assert ((trials.validation_logloss + trials.bootstrap_logloss_std - trials.value).abs() < 3e-6).all() and (trials.bootstrap_logloss_std > 0).all()
    refits = queries.queries()["m09_m16_refits"](spark, small).orderBy("repeat").toPandas()
    assert list(refits.repeat) == [-1, 0, 1] and (refits.status == "ok").all() and (refits.mean_abs_prediction_change[1:] > 0).all()
