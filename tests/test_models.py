"""Grids of models from one scan against models fitted one by one, with numpy, on the rows that each needs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from bookflow.operators import models, splits, stats

T0 = dt.datetime(2024, 1, 1)
SETS = {"one": ["a"], "two": ["a", "b"], "all": ["a", "b", "c"]}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for key, n, shift in (("A", 500, 0.0), ("B", 300, 1e6), (None, 200, 5.0)):
        for i in range(n):
            a, b = rng.normal(), rng.normal()
            c = None if i % 7 == 2 else float(shift + a + b + rng.normal())
            y = a - 0.5 * b + rng.normal()
            rows.append((key, T0 + dt.timedelta(minutes=i), a, None if i % 13 == 5 else b, c, None if i >= n - 5 else y, None if i >= n - 20 else 2 * y + rng.normal(), float(y > 0)))
    cols = ["k", "timestamp", "a", "b", "c", "y_return_1s", "y_return_5s", "up"]
    return spark.createDataFrame(rows, "k string, timestamp timestamp, a double, b double, c double, y_return_1s double, y_return_5s double, up double").repartition(4), pd.DataFrame(rows, columns=cols)


def direct(rows, features, target):
    """Intercept and weights of the ridge on standardised features."""
    rows = rows.dropna(subset=[*features, target])
    x, y = rows[features].to_numpy(float), rows[target].to_numpy(float)
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + np.eye(len(features)), z.T @ (y - y.mean()))
    return len(rows), y.mean() - (w / sd) @ mean, w / sd


def test_grid_equals_models_one_by_one(table):
    df, plain = table
    targets = {"1s": "y_return_1s", "5s": "y_return_5s"}
    got = {(r["k"], r["horizon"], r["feature_set"]): r for r in models.fitted_grid(df, targets, SETS, ["ridge"], ["k"]).collect()}
    assert len(got) == 18
    for (k, h, s), r in got.items():
        rows = plain[plain.k.isna()] if k is None else plain[plain.k == k]
        n, intercept, w = direct(rows, SETS[s], targets[h])
        assert r["train_size"] == n and np.allclose(r["__w"][: len(w)], w, rtol=1e-5) and abs(r["__b"] - intercept) < 1e-5 * (1 + abs(intercept))
    worst = models.optimality(df, ["1s", "5s"], SETS, keys=["k"]).agg({"violation": "max", "*": "count"}).first()
    assert worst[0] < 1e-6 and worst[1] == 54


def test_folds_equal_models_of_their_rows(table):
    df, plain = table
    got = models.fold_grid(df.filter("k = 'A'"), {"1s": "y_return_1s"}, {"two": SETS["two"]}, ["ridge"], keys=["k"]).collect()
    bounds = {r["fold"]: r for r in splits.fold_table(df.sparkSession.createDataFrame([("A", 500)], "k string, n long"), keys=["k"]).collect()}
    rows = plain[plain.k == "A"].reset_index(drop=True)
    assert len(got) == 5
    for r in got:
        f = bounds[r["fold"]]
        n, intercept, w = direct(rows[: f["train_to"]], ["a", "b"], "y_return_1s")
        test = rows[f["test_from"] : f["test_to"]].dropna(subset=["a", "b", "y_return_1s"])
        pred = intercept + test[["a", "b"]].to_numpy(float) @ w
        assert r["train_size"] == n and r["test_size"] == len(test) and abs(r["mse"] - np.mean((test.y_return_1s - pred) ** 2)) < 1e-9
        assert abs(r["spearman_ic"] - pd.Series(pred).rank().corr(test.y_return_1s.reset_index(drop=True).astype(float).rank())) < 1e-9


def test_logistic_models_meet_their_condition(table):
    df, plain = table
    for r in models.logistic_models(df, "up", ["a", "b"], ["k"]).collect():
        rows = (plain[plain.k.isna()] if r["k"] is None else plain[plain.k == r["k"]]).dropna(subset=["a", "b", "up"])
        x, y = rows[["a", "b"]].to_numpy(float), rows.up.to_numpy(float)
        p = 1 / (1 + np.exp(-(r["intercept"] + x @ np.array(r["weights"]))))
        z = (x - x.mean(0)) / x.std(0)
        assert np.abs(z.T @ (p - y) + np.array(r["scaled"])).max() < 1e-5 and abs((p - y).sum()) < 1e-5 and r["n"] == len(rows) and r["gradient"] < 1e-9
    got = models.predict(df, models.fit_logistic(df, "up", ["a"]))
    assert got.filter("y_pred <= 0 or y_pred >= 1").count() == 0


def test_pairwise_correlations(table):
    df, plain = table
    cols = ["a", "b", "c", "y_return_5s"]
    got = stats.correlation_matrix(df.withColumn("one", models.F.lit(3.0)), [*cols, "one"], ["k"]).collect()
    want = {k: g[cols].astype(float).corr() for k, g in plain.groupby("k", dropna=False)}
    assert len(got) == 75 and all(r["corr"] is None for r in got if "one" in (r["a"], r["b"]))
    for r in got:
        if "one" not in (r["a"], r["b"]):
            w = next(v for k, v in want.items() if k == r["k"] or (r["k"] is None and k != k))
            assert abs(r["corr"] - w.loc[r["a"], r["b"]]) < 1e-6
