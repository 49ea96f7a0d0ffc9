"""Queries over models, folds and the backtest grid whose results follow from closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.config import SCENARIOS
from bookflow.jobs import oracles as O  # noqa: N812
from bookflow.jobs import queries as Q  # noqa: N812
from bookflow.jobs.fixtures import CONFIG
from bookflow.jobs.queries import _FOLDS, _RN, H, Y, _r, query, shown
from bookflow.operators import backtest, features, models, signal, splits

_FIT = """SELECT {by}, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS cxy, stddev_pop(x) AS sx FROM {rows} GROUP BY {by}"""
#: Slope of one feature under each model; the feature is standardised, its weight divided by the deviation.
_SLOPE = {
    "linear": "cxy / vx",
    "ridge": f"cxy / vx / (1 + {models.RIDGE}::DOUBLE / n)",
    "lasso": f"sign(cxy) * greatest(abs(cxy / sx) - {models.LASSO}::DOUBLE, 0) / sx",
}


def _fitted(by: str, name: str = "fit") -> str:
    return " UNION ALL ".join(f"SELECT {by}, n, '{m}' AS model, CASE WHEN vx > 0 THEN {s} ELSE 0 END AS slope, my - (CASE WHEN vx > 0 THEN {s} ELSE 0 END) * mx AS intercept FROM {name}" for m, s in _SLOPE.items())


@query(f"WITH fit AS ({_FIT.format(by='l_returnflag', rows='(SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem)')}), m AS ({_fitted('l_returnflag')}) SELECT l_returnflag, model, {_r('intercept', 'intercept', 3)}, {_r('slope', 'slope', 5)}, n FROM m")
def regularised_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear, ridge and lasso of one feature from one Gram matrix for each key."""
    rows = models.design(Q.lineitem(spark, sf_dir), "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    out = []
    for (key,), g in models.grams(rows, ["l_quantity"], ["l_returnflag"]).items():
        for name in models.MODELS:
            m = models.solve(g, ["l_quantity"], ["l_quantity"], name)
            out.append((key, name, round(m.intercept, 3), round(m.weights[0], 5), g.n))
    return spark.createDataFrame(out, "l_returnflag string, model string, intercept double, slope double, n double")


@query(
    """WITH s AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b, corr(l_quantity, l_discount) AS c, stddev_pop(l_extendedprice) AS sy FROM lineitem)
    SELECT 'l_quantity' AS feature, round(sy * (a - c * b) / (1 - c * c), 3) AS coefficient FROM s UNION ALL SELECT 'l_discount', round(sy * (b - c * a) / (1 - c * c), 3) FROM s"""
)
def ranked_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.lineitem(spark, sf_dir)
    return models.ranked_coefficients(rows, models.fit_linear(rows, "l_extendedprice", ["l_discount", "l_quantity"])).select("feature", F.round("coefficient", 3).alias("coefficient"))


@query("SELECT l_orderkey, l_linenumber, round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) + l_quantity * (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem), 4) AS y_pred FROM lineitem")
def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.lineitem(spark, sf_dir)
    return models.predict(rows, models.fit_linear(rows, "l_extendedprice", ["l_quantity"])).select("l_orderkey", "l_linenumber", F.round("y_pred", 4).alias("y_pred"))


@query(
    f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem WHERE l_orderkey % 5 < 4),
    t AS (SELECT 'linear' AS model, l_extendedprice AS y, i + s * l_quantity AS p FROM lineitem, f WHERE l_orderkey % 5 = 4)
    SELECT model, round(corr(y, p), 7) AS pearson_ic, round(corr(rx, ry), 7) AS spearman_ic, round(avg((y - p) ** 2), 2) AS mse, round(avg(abs(y - p)), 4) AS mae, count(*) AS n FROM {Q._ranked("t", "model", "y", "p")} GROUP BY model"""
)
def train_and_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.lineitem(spark, sf_dir)
    _, metrics, _ = models.train_and_evaluate(rows.filter("l_orderkey % 5 < 4"), rows.filter("l_orderkey % 5 = 4"), "l_extendedprice", ["l_quantity"], "linear")
    return metrics.select("model", F.round("pearson_ic", 7).alias("pearson_ic"), F.round("spearman_ic", 7).alias("spearman_ic"), F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), "n")


@query(f"WITH {O.TO_FEATURES} SELECT symbol, us, {_r('obi_1', 'obi_1')}, {_r('weighted_obi / 2', 'y_pred')} FROM features WHERE hour % 3 = 0")
def attach_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Q.feature_table(spark, sf_dir)
    preds = table.filter("hour % 3 = 0").select("symbol", "timestamp", (F.col("weighted_obi") / 2).alias("y_pred"))
    return shown(models.attach_predictions(table, preds).select("symbol", "timestamp", "obi_1", "y_pred"))


_BOOK = ["spread", "relative_spread", "obi_1", "obi_3", "obi_5", "weighted_obi", "microprice_deviation", "bid_depth_total", "ask_depth_total", "total_depth", "top_bid_depth", "top_ask_depth", "bid_depth_slope", "ask_depth_slope", *[f"depth_imbalance_{i}" for i in range(1, 6)]]
_TRADE = [f"{c}_{w}" for c in ("trade_imbalance", "signed_volume", "total_volume") for w in ("10min", "50min", "100min")] + ["num_trades_10min", "avg_trade_size_10min", "large_trade_10min", "volume_shock_10min", "volume_shock_50min"]
_MOVES = [f"return_lag_{w}" for w in ("10min", "50min", "100min", "300min")] + [f"realized_vol_{w}" for w in ("100min", "300min", "600min")] + [f"zscore_{c}" for c in ("return_lag_10min", "spread", "total_volume_10min", "obi_1")]


@query(
    f"WITH {O.TO_FEATURES} "
    + " UNION ALL ".join(f"SELECT symbol, '{g}' AS feature_group, '{c}' AS feature, count({c}) AS n FROM features GROUP BY symbol" for g, cols in (("orderbook", _BOOK), ("trade", _TRADE), ("return_vol", _MOVES), ("all", _BOOK + _TRADE + _MOVES)) for c in cols)
)
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of each feature group, with the number of values that are set."""
    table = Q.feature_table(spark, sf_dir)
    chosen = [(g, c) for g in features.feature_groups(CONFIG) for c in features.feature_columns(table, g, CONFIG)]
    counts = table.groupBy("symbol").agg(*[F.count(c).alias(c) for c in dict.fromkeys(c for _, c in chosen)])
    return counts.select("symbol", F.inline(F.array(*[F.struct(F.lit(g).alias("feature_group"), F.lit(c).alias("feature"), F.col(c).alias("n")) for g, c in chosen])))


# ---- one feature over folds and splits ----

_ONE = {"imbalance": ["obi_1"]}
_SPLIT = f"{_RN}, sp AS (SELECT symbol, obi_1::DOUBLE AS x, {{y}} AS y, CASE WHEN rn < floor(n_rows * 0.6::DOUBLE) THEN 'train' WHEN rn < floor(n_rows * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM rn)"
_METRICS = "CASE WHEN stddev_pop(p) > 1e-15 THEN corr(y, p) END AS pearson_ic, CASE WHEN stddev_pop(ry) > 0 THEN corr(rx, ry) END AS spearman_ic, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae, count(*) AS n"


def _grid_sql(h: str) -> str:
    y = f"y_return_{h}"
    return f"""SELECT * FROM (WITH {O.TO_FEATURES}, {_SPLIT.format(y=y)}, tr AS (SELECT symbol, x, y FROM sp WHERE split = 'train' AND x IS NOT NULL AND y IS NOT NULL), fit AS ({_FIT.format(by="symbol", rows="tr")}),
    m AS ({_fitted("symbol")}), te AS (SELECT symbol, model, y, intercept + slope * x AS p FROM sp JOIN m USING (symbol) WHERE split = 'test' AND model <> 'lasso' AND x IS NOT NULL AND y IS NOT NULL),
    me AS (SELECT symbol, model, {_METRICS} FROM {Q._ranked("te", "symbol, model", "y", "p")} GROUP BY ALL)
    SELECT symbol, '{h}' AS horizon, 'imbalance' AS feature_set, model, n, {_r("pearson_ic", "pearson_ic", 6)}, {_r("spearman_ic", "spearman_ic", 6)}, {_r("mse", "mse", 9)}, {_r("mae", "mae", 9)} FROM me)"""


def _rounded_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6 if "_ic" in c or c.startswith("ic_") else 9) + F.lit(0.0) for c, k in df.dtypes if k == "double"})


@query(" UNION ALL ".join(_grid_sql(h) for h in CONFIG.horizons))
def model_grid_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_grid of one feature over all horizons. Lasso weights are zero here, so its predictions are constant and left out."""
    parts = splits.chronological_split(Q.feature_table(spark, sf_dir))
    out = models.model_grid(parts.filter("split = 'train'"), parts.filter("split = 'test'"), CONFIG.horizons, _ONE)
    return _rounded_metrics(out.filter("model <> 'lasso'").drop("decile_spread"))


_FOLD_ROWS = f"""{_FOLDS}, fr AS (SELECT symbol, fold, CASE WHEN rn < train_to THEN 'train' WHEN rn >= start THEN 'test' END AS role, obi_1::DOUBLE AS x, {Y} AS y FROM rn JOIN folds USING (symbol) WHERE rn < stop AND obi_1 IS NOT NULL AND {Y} IS NOT NULL),
fit AS ({_FIT.format(by="symbol, fold", rows="(SELECT * FROM fr WHERE role = 'train')")}), m AS ({_fitted("symbol, fold")}),
te AS (SELECT symbol, fold, model, fr.y, intercept + slope * x AS p, m.n::BIGINT AS train_size FROM fr JOIN m USING (symbol, fold) WHERE role = 'test' AND model <> 'lasso' AND m.n >= 30),
me AS (SELECT symbol, fold, model, train_size, {_METRICS} FROM {Q._ranked("te", "symbol, fold, model, train_size", "y", "p")} GROUP BY ALL HAVING count(*) >= 10)"""


@query(f"WITH {O.TO_FEATURES}, {_FOLD_ROWS} SELECT symbol, fold, model, train_size, {_r('pearson_ic', 'pearson_ic', 6)}, {_r('spearman_ic', 'spearman_ic', 6)}, {_r('mse', 'mse')}, {_r('mae', 'mae')}, n AS test_size FROM me")
def fold_metrics_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.fold_metrics(Q.feature_table(spark, sf_dir), Y, _ONE["imbalance"], ("linear", "ridge"))
    return _rounded_metrics(out.drop("decile_spread"))


_SUMMED = ", ".join(f"{_r(f'avg({c})', f'mean_{c}', 6 if '_ic' in c else 9)}, {_r(f'stddev_samp({c})', f'std_{c}', 6 if '_ic' in c else 9)}" for c in ("pearson_ic", "spearman_ic", "mse", "mae"))


@query(
    f"WITH {O.TO_FEATURES}, {_FOLD_ROWS} SELECT symbol, '{H}' AS horizon, 'imbalance' AS feature_set, model, {_SUMMED}, {_r('avg(pearson_ic) / (stddev_samp(pearson_ic) / sqrt(count(pearson_ic)))', 'ic_tstat', 4)}, {_r('avg(pearson_ic) / stddev_samp(pearson_ic)', 'ic_ir', 4)}, count(*) AS n_folds, sum(n)::BIGINT AS total_test_rows FROM me GROUP BY ALL"
)
def walk_forward_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.walk_forward(Q.feature_table(spark, sf_dir), [H], _ONE, ("linear", "ridge")).drop("mean_decile_spread", "std_decile_spread")
    return out.withColumns({c: F.round(c, 4 if c in ("ic_tstat", "ic_ir") else 6 if "_ic" in c else 9) + F.lit(0.0) for c, k in out.dtypes if k == "double"})


# ---- p-values and regimes with few values ----

#: Two-sided p-value of a correlation by Simpson's rule over the density of Student's t.
_P = """CASE WHEN {r} IS NULL OR n < 3 THEN NULL ELSE greatest(0, 1 - 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi() * (n - 2)) * (abs({r}) * sqrt((n - 2) / (1 - {r} * {r})) / 3000) *
  list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(abs({r}) * sqrt((n - 2) / (1 - {r} * {r})) * i / 1000, 2) / (n - 2), -(n - 1) / 2.0)))) END"""


@query(f"WITH {O.TO_FEATURES}, ic AS ({Q._IC}) SELECT symbol, feature, horizon, n, {_r(_P.format(r='pearson_ic'), 'pearson_pval', 5)}, {_r(_P.format(r='spearman_ic'), 'spearman_pval', 5)} FROM ic")
def ic_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Q._ic(spark, sf_dir).drop("pearson_ic", "spearman_ic"), 5)


_FEW = "(SELECT l_returnflag AS symbol, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linestatus = 'O' THEN 2.0 ELSE 1.0 END AS spread, 5.0 AS total_depth, l_extendedprice AS vol FROM lineitem)"


@query(
    f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY spread, id) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM {_FEW} t),
    s AS (SELECT symbol, count(DISTINCT spread) AS m, quantile_cont(vol::DOUBLE, [0, CAST(1 AS DOUBLE) / 3, CAST(2 AS DOUBLE) / 3, 1]) AS e FROM d GROUP BY symbol)
    SELECT symbol, id, CASE WHEN vol <= e[2] THEN 'low_vol' WHEN vol <= e[3] THEN 'mid_vol' ELSE 'high_vol' END AS vol_regime,
      (['tight', 'mid', 'wide'])[(least(m - 1, greatest(0, ceil((r - 1) * m / greatest(n - 1, 1)::DOUBLE) - 1)) + 1)::INT] AS spread_regime, 'thin' AS liq_regime FROM d JOIN s USING (symbol)"""
)
def regimes_of_few_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of one or two values are cut by their rank in order of value and time."""
    rows = Q.lineitem(spark, sf_dir).select(
        F.col("l_returnflag").alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linestatus") == "O", 2.0).otherwise(1.0).alias("spread"),
        F.lit(5.0).alias("total_depth"), F.col("l_extendedprice").alias("vol"),
    )
    timed = rows.withColumn("timestamp", F.timestamp_micros("id"))
    return signal.regimes(timed, "vol").select("symbol", "id", "vol_regime", "spread_regime", "liq_regime")


# ---- drawdowns and the grid of horizons ----


@query(f"{Q._RECURSIVE}, {Q._CURVE} SELECT symbol, cost_scenario, us, {_r('drawdown', 'drawdown', 5)} FROM dd")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = backtest.drawdown(backtest.equity_curve(backtest.by_scenario(Q._bt(spark, sf_dir), list(SCENARIOS))))
    return shown(curve.select("symbol", "cost_scenario", "timestamp", "drawdown"), 5)


@query(f"{Q._RECURSIVE}, {Q._CURVE} SELECT symbol, cost_scenario, {_r('min(drawdown)', 'max_drawdown', 5)} FROM dd GROUP BY ALL")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(backtest.backtest_summary(Q._bt(spark, sf_dir)).select("symbol", "cost_scenario", "max_drawdown"), 5)


def _held(h: str) -> str:
    """The backtest of one horizon: the walk over entries, and sums of each scenario."""
    n = CONFIG.steps(h)
    held = Q._HELD.replace("w.rn + 5", f"w.rn + {n}").replace("rn + 5", f"rn + {n}").replace(Y, f"y_return_{h}")
    return f"""SELECT * FROM (WITH RECURSIVE {O.TO_FEATURES}, {held}, {Q._SUM.replace(", sum(traded)", ", min(drawdown) AS dd_min, sum(traded)")}
    SELECT '{h}' AS horizon, symbol, cost_scenario, n_trades, n_active, {_r("total_pnl * 1e4", "total_pnl_bps", 2)}, {_r("mean_return_per_trade * 1e4", "mean_return_bps", 2)}, {_r("sharpe", "sharpe", 2)}, {_r("hit_rate * 100", "hit_pct", 1)}, {_r("dd_min * 100", "max_drawdown_pct", 2)} FROM su)"""


@query(" UNION ALL ".join(_held(h) for h in CONFIG.horizons))
def backtest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(backtest.format_summary(backtest.backtest_grid(Q.predictions(spark, sf_dir), CONFIG)), 4)
