"""Ranks and quantiles from counts: ties, NULLs, many ranges, brackets; and where the rows of a hot value go."""

import numpy as np
import pandas as pd
import pytest

from bookflow.operators import ranks, stats


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k, n in (("A", 4000), ("B", 37), ("C", 1), (None, 300)):
        zeros = rng.random(n) < 0.95
        for i in range(n):
            x = None if i % 11 == 3 else 0.0 if zeros[i] else float(rng.normal())
            rows.append((k, i, x, float(rng.integers(0, 9)), float(rng.normal())))
    rows += [("D", i, None, 1.0, 2.0) for i in range(5)]
    return spark.createDataFrame(rows, "k string, i long, x double, few double, y double").repartition(5), pd.DataFrame(rows, columns=["k", "i", "x", "few", "y"])


@pytest.mark.parametrize("rows_per_range", [100_000, 40])
def test_ranks(monkeypatch, table, rows_per_range):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", rows_per_range)
    df, plain = table
    got = ranks.average_ranks(df, ["k"], {"x": "rx", "few": "rf", "y": "ry"}).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    want = plain.sort_values(["k", "i"]).reset_index(drop=True)
    for c, r in (("x", "rx"), ("few", "rf"), ("y", "ry")):
        assert np.allclose(got[r].astype(float), want.groupby("k", dropna=False)[c].rank().astype(float), equal_nan=True), c
    masked = ranks.masked_ranks(df, ["k"], "y", {"all": None, "some": ranks.F.col("few") > 4}).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    assert np.allclose(masked["all"].astype(float), want.groupby("k", dropna=False)["y"].rank()) and masked.loc[masked.few <= 4, "some"].isna().all()
    assert np.allclose(masked.loc[masked.few > 4, "some"].astype(float), want[want.few > 4].groupby("k", dropna=False)["y"].rank())


def test_a_hot_value_is_spread(monkeypatch, spark):
    """19 of 20 rows share a value: no window may hold more than a tenth of the rows."""
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 40)
    df = spark.range(20_000).select(ranks.F.lit("A").alias("k"), "id", ranks.F.when(ranks.F.col("id") % 20 == 0, ranks.F.rand(1)).otherwise(0.0).alias("x"))
    values = {"x": {"r": ranks._flag("x")}}
    coded = ranks._coded(df, ranks.rank_facts(df, ["k"], values), ["k"], values)
    salt = ranks.F.when(ranks.F.col("__code0") % 2 == 1, ranks.F.pmod(ranks.F.xxhash64("k", "id", "x"), ranks.F.lit(ranks.SALTS))).otherwise(0)
    sizes = [r["count"] for r in coded.groupBy("__code0", salt).count().collect()]
    assert max(sizes) <= 2000 and len(sizes) > ranks.SALTS
    out = ranks.average_rank(df, ["k"], "x")
    assert out.filter("x = 0").agg({"rank": "min"}).first()[0] == out.filter("x = 0").agg({"rank": "max"}).first()[0] and "__salt" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("small", "accuracy"), [(100_000, 10_000), (1000, 500)])
def test_quantiles(monkeypatch, table, small, accuracy):
    monkeypatch.setattr(ranks, "SMALL", small)
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    df, plain = table
    probs = [0.9, 0.0, 0.1, 1 / 3, 0.5, 1.0, 0.999]
    for c in ("x", "few", "y"):
        got = {r["k"]: r["q"] for r in ranks.exact_quantiles(df, ["k"], c, probs).collect()}
        spark_own = {r["k"]: r["q"] for r in df.groupBy("k").agg(ranks.F.percentile(c, ranks.F.array(*map(ranks.F.lit, probs))).alias("q")).collect()}
        assert got == spark_own, c
        assert np.allclose(got["A"], np.quantile(plain[(plain.k == "A") & plain[c].notna()][c], probs))


def test_quantiles_gather_only_brackets(monkeypatch, spark):
    monkeypatch.setattr(ranks, "SMALL", 1000)
    monkeypatch.setattr(ranks, "ACCURACY", 1000)
    df = spark.range(50_000).select(ranks.F.lit("A").alias("k"), ranks.F.rand(3).alias("x"))
    assert ranks.exact_quantiles(df, ["k"], "x", [0.5]).first()["q"] == df.agg(ranks.F.percentile("x", ranks.F.array(ranks.F.lit(0.5)))).first()[0]
    edges = stats.quantile_bins(df, ["k"], "x", 5).groupBy("bin").count().collect()
    assert {r["count"] for r in edges} == {10_000}
    assert ranks.exact_quantiles(df.limit(0), ["k"], "x", [0.5]).collect() == []


def test_facts_of_few_keys_are_broadcast(monkeypatch, spark):
    """A join with the facts of two keys sorted all rows of a key in one task."""
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 40)
    monkeypatch.setattr(ranks, "SMALL", 1000)
    monkeypatch.setattr(ranks, "ACCURACY", 500)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.range(6000).select((ranks.F.col("id") % 2).alias("k"), (ranks.F.col("id") % 7).cast("double").alias("x"), (ranks.F.col("id") % 3 == 0).cast("int").alias("y"))
        made = [
            ranks.average_rank(df, ["k"], "x"), stats.quantile_bins(df, ["k"], "x", 5), stats.decile_returns(df, "x", "y", 3, ["k"]),
            stats.box_stats(df, ["x"], ["k"]), stats.classification_metrics(df, ["k"], "y", "x"),
        ]
        for out in made:
            rows = out.collect()
            assert rows and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        ranked = made[0].toPandas()
        assert np.allclose(ranked["rank"], ranked.groupby("k")["x"].rank())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
