"""Quantile bins, correlations, describe tables and metrics, all grouped by keys; ranks and quantiles come from `ranks`."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookflow.functions.numeric import correlation
from bookflow.operators.ranks import SMALL, any_larger, average_rank, average_ranks, exact_quantiles, joined, settled
from bookflow.operators.sums import centred, summed_vectors, typed


def small_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """As average_rank, in one window for each key; for keys whose rows are few by construction."""
    w = Window.partitionBy(*keys)
    low, same = F.rank().over(w.orderBy(F.col(value).asc_nulls_last())), F.count(value).over(Window.partitionBy(*keys, value))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), low + (same - 1) / 2.0))


def average_rank_by_counts(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """As average_rank, by a running count over the distinct values; for columns with many repeats and large keys."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.select(*keys, value, (upto - F.col("__n") + (F.col("__n") + 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value], "left")


def quantile_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int, name: str = "bin", large: bool | None = None) -> DataFrame:
    """Adds the quantile bin of `value`, from 1: right-closed, the lowest value included, equal edges merged. Not ntile: ties stay together."""
    large = any_larger(df, keys, SMALL) if large is None else large
    edges = exact_quantiles(df, keys, value, [i / bins for i in range(bins + 1)], large=large).select(*keys, F.array_distinct("q").alias("__edges"))
    below = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    at = F.when(F.col(value).isNotNull() & (F.size("__edges") > 1), F.greatest(below, F.lit(1)))
    return joined(df, settled(edges) if large else edges, keys).withColumn(name, at).drop("__edges")


def decile_returns(df: DataFrame, feature: str, target: str, n_bins: int = 10, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean, deviation and count of the target in each quantile bin of the feature; keys with fewer than 5 rows a bin give none."""
    both = df.filter(F.col(feature).isNotNull() & F.col(target).isNotNull()).select(*keys, feature, target)
    sizes = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= n_bins * 5)
    large = any_larger(both, keys)
    enough = joined(both, settled(sizes) if large else sizes, keys).drop("__n")
    return (
        quantile_bins(enough, keys, feature, n_bins, "decile", large).filter("decile is not null").groupBy(*keys, "decile")
        .agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"), F.count(target).alias("count"))
    )


def top_minus_bottom(deciles: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return deciles.groupBy(*keys).agg((F.max_by("mean", "decile") - F.min_by("mean", "decile")).alias("top_minus_bottom"))


def unpivoted(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])).alias("__x")).select(*keys, f"__x.{name}", f"__x.{value}")


def summary_table(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column."""
    v, long, by = F.col("value"), unpivoted(df, keys, cols), [*keys, "feature"]
    facts = long.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    out = joined(facts, exact_quantiles(long, by, "value", [0.25, 0.5, 0.75], large=any_larger(df, keys)), by)
    return out.select(*keys, "feature", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def correlation_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(a, b, corr) of all ordered pairs over the rows where both are set; NULL where one of them is constant there.

    From one scan: counts, sums, squares and products of all pairs are matrices that tasks add up.
    """
    names, k = list(cols), len(cols)

    def part(x: np.ndarray) -> dict[tuple, np.ndarray]:
        known = ~np.isnan(x)
        v, x = known.astype(float), np.where(known, x, 0.0)
        return {("pairs",): np.concatenate([(v.T @ v).ravel(), (x.T @ v).ravel(), ((x * x).T @ v).ravel(), (x.T @ x).ravel()])}

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                n, s, q, p = np.asarray(r["vec"]).reshape(4, k, k)
                with np.errstate(divide="ignore", invalid="ignore"):
                    var = q / n - (s / n) ** 2
                    var = np.where(var > 1e-14 * q / n, var, np.nan)
                    corr = (p / n - s * s.T / n**2) / np.sqrt(var * var.T)
                yield pd.DataFrame({**{c: [r[c]] * (k * k) for c in keys}, "a": np.repeat(names, k), "b": names * k, "corr": corr.ravel()})

    sums = summed_vectors(centred(df, names, keys)[0], names, keys, part, ("kind",))
    out = sums.mapInPandas(cells, typed(df, keys) + ", a string, b string, corr double")
    return out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def histogram(df: DataFrame, cols: Sequence[str], bins: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Counts in equal-width bins between each column's minimum and maximum, which is in the last bin; empty bins are left out."""
    long = unpivoted(df, keys, cols).filter("value is not null")
    ends = long.groupBy(*keys, "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    joined = long.join(ends, [*keys, "feature"])
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1)).otherwise(F.lit(1)).cast("int")
    return joined.groupBy(*keys, "feature", "lo", "hi", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Quartiles and whiskers (the furthest values within 1.5 interquartile ranges)."""
    long = unpivoted(df, keys, metrics, "metric").filter("value is not null")
    large = any_larger(df, keys)
    q = exact_quantiles(long, [*keys, "metric"], "value", [0.25, 0.5, 0.75], large=large).select(*keys, "metric", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return joined(long, settled(q) if large else q, [*keys, "metric"]).filter(inside).groupBy(*keys, "metric", "q1", "median", "q3").agg(F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"))


def regression_metrics(df: DataFrame, keys: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred", least: int = 10, large: bool | None = None) -> DataFrame:
    """Pearson and Spearman correlation, mean squared and absolute error of the rows where both are set; keys with fewer rows give none."""
    both = df.filter(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()).select(*keys, F.col(y_true).alias("__y"), F.col(y_pred).alias("__p"))
    ranked = average_ranks(both, keys, {"__y": "__ry", "__p": "__rp"}, large)
    gap = F.col("__y") - F.col("__p")
    return ranked.groupBy(*keys).agg(
        correlation(F.col("__y"), F.col("__p")).alias("pearson_ic"), correlation(F.col("__ry"), F.col("__rp")).alias("spearman_ic"),
        F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), F.count(F.lit(1)).alias("n"),
    ).filter(F.col("n") >= least)


def classification_metrics(df: DataFrame, keys: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred", least: int = 10) -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC area; undefined ratios are 0, the area of one class NULL.

    Predictions are cut at 0.5 if none is above 1, else at 0.
    """
    both = df.filter(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()).select(*keys, F.col(y_true).cast("int").alias("__y"), F.col(y_pred).alias("__p"))
    cuts, large = both.groupBy(*keys).agg(F.when(F.max("__p") <= 1.0, 0.5).otherwise(0.0).alias("__cut")), any_larger(both, keys)
    ranked = joined(average_rank(both, keys, "__p", "__rp", large), settled(cuts) if large else cuts, keys)
    yes, hit = F.col("__p") > F.col("__cut"), F.col("__y") == 1
    count = lambda c: F.count(F.when(c, 1))
    agg = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), count(yes & hit).alias("tp"), count(yes & ~hit).alias("fp"), count(~yes & hit).alias("fn"), count(~yes & ~hit).alias("tn"), F.sum(F.when(hit, F.col("__rp"))).alias("ranks")
    )
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ones, zeros = tp + fn, fp + tn
    return agg.filter(F.col("n") >= least).select(
        *keys, ((tp + tn) / F.col("n")).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, ones).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"), "n",
        F.when((ones > 0) & (zeros > 0), (F.col("ranks") - ones * (ones + 1) / 2) / (ones * zeros)).alias("auc"),
    )


def decile_spread(df: DataFrame, keys: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred", n_bins: int = 10, large: bool | None = None) -> DataFrame:
    """Mean target of the top prediction bin minus that of the bottom one; NULL below 3 rows a bin or two bins."""
    both = df.filter(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull())
    binned = quantile_bins(both, keys, y_pred, n_bins, "__bin", large)
    per_bin = binned.groupBy(*keys, "__bin").agg(F.avg(y_true).alias("__m"), F.count(F.lit(1)).alias("__n"))
    spread = F.max_by("__m", "__bin") - F.min_by("__m", "__bin")
    return per_bin.groupBy(*keys).agg(F.when((F.sum("__n") >= 3 * n_bins) & (F.count("__bin") >= 2), spread).alias("decile_spread"))


def ic_tstat(ic: Column) -> Column:
    """Aggregate: mean over standard error of a series of ICs, three at least."""
    return F.when((F.count(ic) >= 3) & (F.stddev_samp(ic) > 0), F.avg(ic) / (F.stddev_samp(ic) / F.sqrt(F.count(ic))))


def ic_ir(ic: Column) -> Column:
    """Aggregate: mean over deviation of a series of ICs, three at least."""
    return F.when((F.count(ic) >= 3) & (F.stddev_samp(ic) > 0), F.avg(ic) / F.stddev_samp(ic))


def sharpe(ret: Column, periods_per_year: float = 252 * 86400) -> Column:
    """Aggregate: annualised mean over population deviation."""
    return F.when((F.count(ret) >= 2) & (F.stddev_pop(ret) > 0), F.avg(ret) / F.stddev_pop(ret) * periods_per_year**0.5)


def hit_rate(ret: Column) -> Column:
    """Aggregate: share of positive returns among those that are set."""
    return F.avg(F.when(ret.isNotNull(), (ret > 0).cast("int")))


def turnover(df: DataFrame, keys: Sequence[str], position: str = "position", order: str = "timestamp") -> DataFrame:
    """Mean absolute change of position from row to row; 0 for a single row."""
    change = F.abs(F.col(position) - F.lag(position).over(Window.partitionBy(*keys).orderBy(order)))
    return df.withColumn("__change", change).groupBy(*keys).agg(F.coalesce(F.avg("__change"), F.lit(0.0)).alias("turnover"))
