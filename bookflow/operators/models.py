"""Linear models from Gram matrices.

One pass over the rows gives sums of products for all targets and feature sets of
each asset and fold, over the rows where a set and a target are complete. The
sums are additive: an expanding train set is a prefix sum, and scaling comes from
the same sums. The matrices are tiny; grids solve them in tasks, and predictions
are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions.numeric import correlation
from bookflow.operators.ranks import any_larger, joined
from bookflow.operators.splits import fold_table, with_row_number
from bookflow.operators.stats import decile_spread, ic_ir, ic_tstat, regression_metrics
from bookflow.operators.sums import centred, summed_vectors, typed

RIDGE, LASSO, LASSO_STEPS = 1.0, 0.01, 5000
MODELS = ("linear", "ridge", "lasso")
LEAST_TRAIN, LEAST_TEST = 30, 10


def design(df: DataFrame, target: str, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Features as doubles and the target, rows with a NULL left out."""
    cols = [F.col(c).cast("double").alias(c) for c in features]
    return df.select(*keep, *cols, F.col(target).cast("double").alias("__y")).dropna(subset=[*features, "__y"])


@dataclass(frozen=True)
class Gram:
    """n, sums and products of (features, target) about a fixed centre."""

    n: float
    sums: np.ndarray
    products: np.ndarray
    centre: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.n + other.n, self.sums + other.sums, self.products + other.products, self.centre)

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Means, and covariances about them (divided by n)."""
        mean = self.sums / self.n
        return mean + self.centre, self.products / self.n - np.outer(mean, mean)


def masked_grams(df: DataFrame, targets: dict[str, str], sets: dict[str, Sequence[str]], keys: Sequence[str], features: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """One scan for all targets and feature sets: keys, within, horizon, feature_set, vec (n, sums, products about the key's centre) and centre, over the rows where the set and the target are set."""
    at = {s: [features.index(f) for f in fs] for s, fs in sets.items()}

    def part(x: np.ndarray) -> dict[tuple, np.ndarray]:
        out = {}
        for s, cols in at.items():
            whole = x[~np.isnan(x[:, cols]).any(axis=1)]
            for j, h in enumerate(targets):
                y = len(features) + j
                a = whole[~np.isnan(whole[:, y])][:, [*cols, y]]
                out[h, s] = np.concatenate([[float(len(a))], a.sum(axis=0), (a.T @ a).ravel()])
        return out

    columns = [*features, *targets.values()]
    rows, centres = centred(df, columns, keys, within)
    return joined(summed_vectors(rows, columns, [*keys, *within], part, ("horizon", "feature_set")), centres, keys)


def as_gram(vec: Sequence[float], centre: np.ndarray) -> Gram:
    k = len(centre)
    v = np.asarray(vec, float)
    return Gram(float(v[0]), v[1 : k + 1], v[k + 1 :].reshape(k, k), centre)


def grams(rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> dict[tuple, Gram]:
    """The Gram of each key of `design` rows, at the driver, for models that are asked for one by one."""
    found = masked_grams(rows, {"y": "__y"}, {"x": list(features)}, keys, list(features)).collect()
    return {tuple(r[k] for k in keys): as_gram(r["vec"], np.array(r["centre"])) for r in found if r["vec"][0] > 0}


@dataclass(frozen=True)
class Linear:
    """A fitted model: intercept, weights of the raw features, and weights of the standardised ones."""

    name: str
    features: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]
    scaled: tuple[float, ...]


def solve(gram: Gram, features: Sequence[str], chosen: Sequence[str], name: str) -> Linear:
    """Fit linear, ridge or lasso on standardised features (population deviation), intercept free."""
    at = [list(features).index(c) for c in chosen]
    mean, cov = gram.moments()
    sd = np.sqrt(np.maximum(np.diag(cov)[at], 0))
    sd = np.where(sd > 1e-12 * np.maximum(np.abs(mean[at]), 1e-300), sd, 1.0)
    a = cov[np.ix_(at, at)] / np.outer(sd, sd)
    b = cov[at, -1] / sd
    if name == "linear":
        w = np.linalg.lstsq(a, b, rcond=1e-10)[0]
    elif name == "ridge":
        w = np.linalg.solve(a + RIDGE / gram.n * np.eye(len(at)), b)
    else:
        w = _lasso(a, b, LASSO)
    raw = w / sd
    return Linear(name, tuple(chosen), float(mean[-1] - raw @ mean[at]), tuple(raw.tolist()), tuple(w.tolist()))


def _lasso(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """Coordinate descent on covariances: minimise (1/2) w'aw - b'w + alpha |w|."""
    w = np.zeros(len(b))
    for _ in range(LASSO_STEPS):
        most = 0.0
        for j in range(len(b)):
            if a[j, j] <= 0:
                continue
            rest = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / a[j, j]
            most, w[j] = max(most, abs(new - w[j])), new
        if most < 1e-12:
            break
    return w


def fit_linear(df: DataFrame, target: str, features: Sequence[str]) -> Linear:
    return _fit_one(df, target, features, "linear")


def fit_ridge(df: DataFrame, target: str, features: Sequence[str]) -> Linear:
    return _fit_one(df, target, features, "ridge")


def fit_lasso(df: DataFrame, target: str, features: Sequence[str]) -> Linear:
    return _fit_one(df, target, features, "lasso")


def _fit_one(df: DataFrame, target: str, features: Sequence[str], name: str) -> Linear:
    rows = design(df, target, features).withColumn("__all", F.lit(1))
    return solve(grams(rows, features, ["__all"])[(1,)], features, features, name)


def logistic_models(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = ("symbol",), c: float = 1.0, steps: int = 50, near: float = 1e-9) -> DataFrame:
    """L2 logistic regressions on standardised features, one for each key, all in the same jobs.

    Newton's method: a step adds up gradients and weighted Gram matrices of all keys
    in one scan; a step that makes a key's loss worse is halved. The driver holds
    the weights of each key. Returns keys, n, intercept, weights (of raw features),
    scaled and gradient, the largest part of the gradient over n at the end.
    """
    names, k = list(features), len(features)
    rows = design(df, target, names, keys)
    spread = grams(rows, names, keys)
    moments = {}
    for key, g in spread.items():
        mean, cov = g.moments()
        sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
        moments[key] = mean[:-1], np.where(sd > 1e-12 * np.maximum(np.abs(mean[:-1]), 1e-300), sd, 1.0)
    weights = {key: np.zeros(k + 1) for key in spread}
    accepted: dict[tuple, tuple[float, np.ndarray]] = {}  # loss and weights that the last step started from
    open_keys, result = set(spread), {}
    for _ in range(steps):
        now = {key: weights[key] for key in open_keys}
        found = {tuple(r[x] for x in keys): np.asarray(r["vec"]) for r in _newton_sums(rows, names, keys, now, moments).collect()}
        for key in list(open_keys):
            v, w = found[key], weights[key]
            penalty = np.append(w[:-1], 0.0) / c
            loss, grad, hess = v[0] + w[:-1] @ w[:-1] / (2 * c), v[1 : k + 2] + penalty, v[k + 2 :].reshape(k + 1, k + 1) + np.diag(np.append(np.ones(k), 1e-12)) / c
            if key in accepted and loss > accepted[key][0] + 1e-12 * abs(loss):
                weights[key] = (w + accepted[key][1]) / 2
                continue
            accepted[key] = loss, w
            result[key] = w, float(np.abs(grad).max() / spread[key].n)
            if result[key][1] < near:
                open_keys.discard(key)
            else:
                weights[key] = w - np.linalg.solve(hess, grad)
        if not open_keys:
            break
    table = []
    for key, (w, gradient) in result.items():
        mean, sd = moments[key]
        raw = w[:-1] / sd
        table.append((*key, int(spread[key].n), float(w[-1] - raw @ mean), raw.tolist(), w[:-1].tolist(), gradient))
    return df.sparkSession.createDataFrame(table, typed(rows, keys) + ", n long, intercept double, weights array<double>, scaled array<double>, gradient double")


def _newton_sums(rows: DataFrame, features: Sequence[str], keys: Sequence[str], weights: dict[tuple, np.ndarray], moments: dict[tuple, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Loss, gradient and weighted Gram matrix of each key whose weights are given, as one vector."""
    numbered = {key: i for i, key in enumerate(weights)}
    spark = rows.sparkSession
    known = spark.createDataFrame([(*key, i) for key, i in numbered.items()], typed(rows, keys) + ", __no int")
    at = list(weights.values())
    scale = [moments[key] for key in numbered]

    def part(x: np.ndarray) -> dict[tuple, np.ndarray]:
        if not len(x):
            return {}
        no = int(x[0, -1])
        mean, sd = scale[no]
        z, y = np.column_stack([(x[:, : len(features)] - mean) / sd, np.ones(len(x))]), x[:, len(features)]
        score = z @ at[no]
        p = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
        loss = np.logaddexp(0, score) - y * score
        return {("sums",): np.concatenate([[loss.sum()], z.T @ (p - y), (z.T @ (z * (p * (1 - p))[:, None])).ravel()])}

    return summed_vectors(joined(rows, known, keys), [*features, "__y", "__no"], keys, part, ("kind",))


def fit_logistic(df: DataFrame, target: str, features: Sequence[str], c: float = 1.0) -> Linear:
    """logistic_models of one key."""
    found = logistic_models(df.withColumn("__all", F.lit(1)), target, features, ["__all"], c).first()
    return Linear("logistic", tuple(features), found["intercept"], tuple(found["weights"]), tuple(found["scaled"]))


def with_probabilities(df: DataFrame, found: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",), name: str = "y_pred") -> DataFrame:
    """Adds the probability that the key's model of logistic_models gives; rows without a feature or a model are left out."""
    value = F.col("__b")
    for i, f in enumerate(features):
        value = value + F.col(f).cast("double") * F.col("__w")[i]
    known = found.select(*keys, F.col("intercept").alias("__b"), F.col("weights").alias("__w"))
    return joined(df, known, keys).withColumn(name, 1 / (1 + F.exp(-value))).filter(F.col(name).isNotNull()).drop("__b", "__w")


def score(model: Linear) -> Column:
    """The model's linear prediction as a column expression, NULL where a feature is."""
    out = F.lit(model.intercept)
    for f, w in zip(model.features, model.weights, strict=True):
        out = out + F.col(f).cast("double") * F.lit(w)
    return out


def predict(df: DataFrame, model: Linear, name: str = "y_pred") -> DataFrame:
    """Adds predictions, probabilities for a logistic model, and drops rows without one."""
    value = 1 / (1 + F.exp(-score(model))) if model.name == "logistic" else score(model)
    return df.withColumn(name, value).filter(F.col(name).isNotNull())


def ranked_coefficients(df: DataFrame, model: Linear) -> DataFrame:
    """feature and coefficient of the standardised features, largest absolute value first."""
    spark = df.sparkSession
    return spark.createDataFrame(list(zip(model.features, model.scaled, strict=True)), "feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")))


def evaluated(scored: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """Regression metrics and decile spread of predictions, by keys."""
    rows = scored.withColumn("y_true", F.col(target))
    large = any_larger(rows, keys)
    return joined(regression_metrics(rows, keys, large=large), decile_spread(rows, keys, large=large), keys, "left")


def train_and_evaluate(train: DataFrame, test: DataFrame, target: str, features: Sequence[str], name: str = "ridge") -> tuple[Linear, DataFrame, DataFrame] | None:
    """Model, metrics and predictions; None with fewer than 30 usable train or 10 usable test rows."""
    if design(train, target, features).limit(LEAST_TRAIN).count() < LEAST_TRAIN or design(test, target, features).limit(LEAST_TEST).count() < LEAST_TEST:
        return None
    model = _fit_one(train, target, features, name) if name != "logistic" else fit_logistic(train, target, features)
    scored = predict(test, model).filter(F.col(target).isNotNull())
    return model, evaluated(scored.withColumn("model", F.lit(name)), target, ["model"]), scored


def _solver(features: Sequence[str], sets: dict[str, Sequence[str]], names: Sequence[str], order: Sequence[str], keys: Sequence[str]):
    """Solves every model of a gram row, or of the running sums over folds where rows have a fold. Weights are in the order of all features."""
    ends = len(features)

    def models_of(h_no: int, s: str, vec: np.ndarray, centre: np.ndarray) -> Iterator[tuple[str, Linear, np.ndarray]]:
        cols = [features.index(f) for f in sets[s]]
        gram = as_gram(vec, centre[[*cols, ends + h_no]])
        if gram.n >= LEAST_TRAIN:
            for name in names:
                m = solve(gram, list(sets[s]), list(sets[s]), name)
                wide = np.zeros(ends)
                wide[cols] = m.weights
                yield name, m, wide

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        total = None
        for r in frame.sort_values("fold").to_dict("records") if "fold" in frame else frame.to_dict("records"):
            total = np.asarray(r["vec"]) if total is None or "fold" not in r else total + np.asarray(r["vec"])
            for name, m, wide in models_of(order.index(r["horizon"]), r["feature_set"], total, np.asarray(r["centre"])):
                kept = {k: r[k] for k in (*keys, "horizon", "feature_set", *(["fold"] if "fold" in r else []))}
                out.append({**kept, "model": name, "train_size": int(total[0]), "__b": m.intercept, "__w": wide.tolist()})
        names_ = [*keys, "horizon", "feature_set", *(["fold"] if "fold" in frame else []), "model", "train_size", "__b", "__w"]
        return pd.DataFrame(out, columns=names_)

    return of


COEFS = "horizon string, feature_set string, {fold}model string, train_size long, __b double, __w array<double>"


def fitted_grid(train: DataFrame, targets: dict[str, str], sets: dict[str, Sequence[str]], names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Every model of every key, target and feature set: keys, horizon, feature_set, model, train_size, __b and __w. One scan; matrices are solved in tasks."""
    features = list(dict.fromkeys(f for fs in sets.values() for f in fs))
    found, of = masked_grams(train, targets, sets, keys, features), _solver(features, sets, names, list(targets), keys)

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield of(frame)

    return found.mapInPandas(solved, typed(train, keys) + ", " + COEFS.format(fold=""))


def scored_grid(rows: DataFrame, coefs: DataFrame, targets: dict[str, str], sets: dict[str, Sequence[str]], on: Sequence[str]) -> DataFrame:
    """Each row with each target and model whose features it has: on, horizon, feature_set, model, train_size, y_true, y_pred and the features.

    The product is an expression over all features, with weight 0 outside a set.
    """
    features = list(dict.fromkeys(f for fs in sets.values() for f in fs))
    cols = [F.col(f).cast("double").alias(f) for f in features]
    cells = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(y).cast("double").alias("y_true")) for h, y in targets.items()]))
    complete = F.array(*[reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fs]) for fs in sets.values()]).alias("__complete")
    long = rows.select(*on, *cols, complete, cells).filter("y_true is not null")
    place = F.array_position(F.array(*map(F.lit, sets)), F.col("feature_set")).cast("int") - 1
    value = F.col("__b")
    for i, f in enumerate(features):
        value = value + F.coalesce(F.col(f), F.lit(0.0)) * F.col("__w")[i]
    both = joined(long, coefs, [*on, "horizon"]).filter(F.get("__complete", place))
    return both.withColumn("y_pred", value).drop("__b", "__complete")


_METRICS = ("n", "pearson_ic", "spearman_ic", "mse", "mae", "decile_spread")


def model_grid(train: DataFrame, test: DataFrame, horizons: Sequence[str], feature_sets: dict[str, Sequence[str]], names: Sequence[str] = MODELS, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Metrics for every asset, horizon, feature set and model: one scan of the train rows for all Gram matrices, one of the test rows for all predictions."""
    targets = {h: f"y_return_{h}" for h in horizons}
    scored = scored_grid(test, fitted_grid(train, targets, feature_sets, names, keys), targets, feature_sets, keys)
    by = [*keys, "horizon", "feature_set", "model"]
    rows = scored.select(*by, "y_true", "y_pred")
    large = any_larger(test, keys)
    return joined(regression_metrics(rows, by, large=large), decile_spread(rows, by, large=large), by, "left").select(*by, *_METRICS)


def optimality(train: DataFrame, horizons: Sequence[str], feature_sets: dict[str, Sequence[str]], names: Sequence[str] = MODELS, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """How far the fitted models are from their conditions of optimality, from the rows themselves: train_size and violation, in deviations of the target, for each model.

    With standardised features the mean product of feature and residual is 0 for
    linear, weight * RIDGE / n for ridge, and for lasso LASSO with the weight's sign, or within LASSO for weight 0.
    """
    targets = {h: f"y_return_{h}" for h in horizons}
    scored = scored_grid(train, fitted_grid(train, targets, feature_sets, names, keys), targets, feature_sets, keys)
    features = list(dict.fromkeys(f for fs in feature_sets.values() for f in fs))
    by, e = [*keys, "horizon", "feature_set", "model"], F.col("y_true") - F.col("y_pred")
    sums = scored.groupBy(*by).agg(F.max("train_size").alias("train_size"), F.count(F.lit(1)).alias("n"), F.avg(e).alias("e"), F.first("__w").alias("w"), F.stddev_pop("y_true").alias("sy"),
                                   *[x for i, f in enumerate(features) for x in (F.covar_pop(F.col(f), e).alias(f"c{i}"), F.stddev_pop(f).alias(f"s{i}"))])
    parts = [F.abs("e")]
    for i, f in enumerate(features):
        inside = reduce(lambda a, b: a | b, [F.col("feature_set") == s for s, fs in feature_sets.items() if f in fs])
        w, g = F.col("w")[i] * F.col(f"s{i}"), F.col(f"c{i}") / F.col(f"s{i}")
        lasso = F.when(w == 0, F.greatest(F.abs(g) - LASSO, F.lit(0.0))).otherwise(F.abs(g - LASSO * F.signum(w)))
        gap = F.when(F.col("model") == "linear", F.abs(g)).when(F.col("model") == "ridge", F.abs(g - w * RIDGE / F.col("n"))).otherwise(lasso)
        parts.append(F.when(inside & (F.col(f"s{i}") > 1e-12), gap).otherwise(0.0))
    return sums.select(*by, "train_size", "n", (F.greatest(*parts) / F.col("sy")).alias("violation"))


def fold_grid(df: DataFrame, targets: dict[str, str], feature_sets: dict[str, Sequence[str]], names: Sequence[str] = MODELS, n_folds: int = 5, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Walk-forward metrics of each fold, target, feature set and model.

    Train sets expand, so a row is counted once, with the first fold that trains on
    it, and a fold's Gram matrix is the sum over the folds up to it. Fold bounds are arrays of columns.
    """
    numbered = with_row_number(df, keys)
    folds = fold_table(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), n_folds, keys=keys)
    bounds = folds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fold", "train_to", "test_from", "test_to"))).alias("__f"))
    rows = joined(numbered, bounds, keys)
    rn = F.col("rn")
    train = rows.withColumn("fold", F.size(F.filter("__f", lambda f: f["train_to"] <= rn))).filter(F.col("fold") < F.size("__f"))
    features = list(dict.fromkeys(f for fs in feature_sets.values() for f in fs))
    found, of = masked_grams(train, targets, feature_sets, keys, features, ["fold"]), _solver(features, feature_sets, names, list(targets), keys)
    coefs = found.groupBy(*keys, "horizon", "feature_set").applyInPandas(of, typed(df, keys) + ", " + COEFS.format(fold="fold int, "))
    at = F.size(F.filter("__f", lambda f: f["test_from"] <= rn)) - 1
    test = rows.withColumn("fold", at).filter((at >= 0) & (rn < F.get("__f", at)["test_to"]))
    scored = scored_grid(test, coefs, targets, feature_sets, [*keys, "fold"])
    by = [*keys, "fold", "horizon", "feature_set", "model", "train_size"]
    out = scored.select(*by, "y_true", "y_pred")
    large = any_larger(df, keys)  # more than a fold has
    return joined(regression_metrics(out, by, large=large), decile_spread(out, by, large=large), by, "left").select(*by, *_METRICS).withColumnRenamed("n", "test_size")


def fold_metrics(df: DataFrame, target: str, features: Sequence[str], names: Sequence[str] = MODELS, n_folds: int = 5, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """fold_grid of one target and feature set."""
    return fold_grid(df, {"y": target}, {"x": features}, names, n_folds, keys).drop("horizon", "feature_set")


def fold_summary(metrics: DataFrame, keys: Sequence[str] = ("symbol", "model")) -> DataFrame:
    """Mean and deviation over folds, t-statistic and information ratio of the IC, folds and test rows."""
    parts = [x for c in ("pearson_ic", "spearman_ic", "mse", "mae", "decile_spread") for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))]
    return metrics.groupBy(*keys).agg(*parts, ic_tstat(F.col("pearson_ic")).alias("ic_tstat"), ic_ir(F.col("pearson_ic")).alias("ic_ir"), F.count(F.lit(1)).alias("n_folds"), F.sum("test_size").alias("total_test_rows"))


def walk_forward(df: DataFrame, horizons: Sequence[str], feature_sets: dict[str, Sequence[str]], names: Sequence[str] = MODELS, n_folds: int = 5, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """fold_summary for every horizon, feature set and model."""
    by = [*keys, "horizon", "feature_set", "model"]
    return fold_summary(fold_grid(df, {h: f"y_return_{h}" for h in horizons}, feature_sets, names, n_folds, keys), by)


def attach_predictions(df: DataFrame, preds: DataFrame, on: Sequence[str] = ("symbol", "timestamp")) -> DataFrame:
    """Rows that have a prediction, with it."""
    return df.join(preds, list(on))


def prediction_correlation(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(correlation(F.col(a), F.col(b)).alias("corr"))
