"""Signal tables: information coefficients, decay, regimes and rolling ICs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookflow.config import UNITS
from bookflow.functions.numeric import correlation
from bookflow.operators.ranks import any_larger, average_ranks, exact_quantiles, joined, masked_ranks, nth_values, settled
from bookflow.operators.splits import with_row_number
from bookflow.operators.stats import small_rank, unpivoted

LEAST = 30


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    value = 1.0
    for k in range(300, 0, -1):  # from the inside out
        m = k // 2
        if k % 2:
            part = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            part = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + part / value
    return float(front / value)


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs, by Student's t with n - 2 degrees."""
    if r is None or np.isnan(r) or n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def _with_p_values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for kind in ("pearson", "spearman"):
            pdf[f"{kind}_pval"] = [correlation_p_value(r, n) for r, n in zip(pdf[f"{kind}_ic"], pdf["n"], strict=True)]
        yield pdf


def ic_table(df: DataFrame, features: Sequence[str], horizons: Sequence[str], keys: Sequence[str] = ("symbol",), least: int = LEAST) -> DataFrame:
    """Pearson and Spearman IC with p-values of each feature and horizon, over the rows where both are set; needs `least` rows.

    A target is ranked once for all features that are set on every row of the key,
    and such a feature once for all horizons, in one order with a count for each.
    Features with gaps are ranked with each target by themselves. The table is read
    several times, so it should be a stored one.
    """
    used, ys = [f for f in features if f in df.columns], [f"y_return_{h}" for h in horizons]
    keep = df.select(*keys, *[F.col(f).cast("double").alias(f"x {f}") for f in used], *ys)
    gaps = keep.groupBy(*keys).agg(F.array(*[F.count(F.col(f"x {f}")) == F.count(F.lit(1)) for f in used]).alias("__full"))
    by, large = [*keys, "feature"], any_larger(keep, keys)
    at = F.posexplode(F.array(*[F.col(f"x {f}") for f in used])).alias("__at", "x")
    name = F.get(F.array(*map(F.lit, used)), F.col("__at")).alias("feature")

    ranked_y = average_ranks(keep, keys, {y: f"ry {y}" for y in ys}, large)
    complete = lambda rows, kept: joined(rows, gaps, keys).select(*keys, *kept, "__full", at).filter(F.get("__full", F.col("__at"))).select(*keys, name, "x", *kept)
    full, plain = complete(ranked_y, [*ys, *[f"ry {y}" for y in ys]]), complete(keep, ys)
    ranked = masked_ranks(full, by, "x", {f"rx {y}": F.col(y).isNotNull() for y in ys}, plain, large)
    sums = [F.struct(F.lit(h).alias("horizon"), correlation(F.col("x"), F.col(y)).alias("pearson_ic"), correlation(F.col(f"rx {y}"), F.col(f"ry {y}")).alias("spearman_ic"), F.count(F.col(f"rx {y}")).alias("n")) for h, y in zip(horizons, ys, strict=True)]
    first = ranked.groupBy(*by).agg(F.array(*sums).alias("__s")).select(*by, F.inline("__s"))

    cells = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(y).alias("y")) for h, y in zip(horizons, ys, strict=True)]))
    partial = joined(keep, gaps, keys).select(*keys, *ys, "__full", at).filter(~F.get("__full", F.col("__at")) & F.col("x").isNotNull()).select(*keys, name, "x", cells).filter("y is not null")
    pairs = [*by, "horizon"]
    both = average_ranks(partial, pairs, {"x": "rx", "y": "ry"}, large)
    second = both.groupBy(*pairs).agg(correlation(F.col("x"), F.col("y")).alias("pearson_ic"), correlation(F.col("rx"), F.col("ry")).alias("spearman_ic"), F.count(F.lit(1)).alias("n"))

    out = first.unionByName(second).filter(F.col("n") >= least)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInPandas(_with_p_values, head + ", pearson_pval double, spearman_pval double")


def signal_decay(ic: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """IC by horizon in seconds, for each feature; horizons are durations such as 500ms, 30s or 10min."""
    number, unit = F.regexp_extract("horizon", r"^(\d+)", 1).cast("double"), F.lower(F.regexp_extract("horizon", r"([A-Za-z]+)$", 1))
    scale = F.create_map(*[F.lit(x) for u, us in UNITS.items() for x in (u, us / 1e6)])
    return ic.select(*keys, "feature", (number * scale[unit]).alias("seconds"), "pearson_ic", "spearman_ic")


def top_features(ic: DataFrame, horizon: str, n: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The n features with the largest absolute Spearman IC at a horizon."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(F.abs("spearman_ic")), "feature")
    return ic.filter(F.col("horizon") == horizon).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


# Labels of the terciles.
REGIMES = {"vol_regime": ("low_vol", "mid_vol", "high_vol"), "spread_regime": ("tight", "mid", "wide"), "liq_regime": ("thin", "mid", "deep")}


def _first_label(df: DataFrame, facts: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Where a column of two values is cut in order of value, time and a hash of the row: keys and __v, __t, __h, the value, time and hash up to which rows get the first label, and __g, how many of the rows at __h do (NULL: all).

    `facts` has n, the rows with a value, low and high, the values, and n_low. Only counts are taken; no rows of a value are ordered.
    """
    first = F.floor((F.col("n") + 1) / 2)
    inside = F.when(F.col("n_low") >= first, F.struct(F.col("low").alias("__v"), first.alias("__c"))).otherwise(F.struct(F.col("high").alias("__v"), (first - F.col("n_low")).alias("__c")))
    places = settled(facts.select(*keys, inside.alias("__i")).select(*keys, "__i.*"))
    rows = joined(df, places, keys).filter(F.col(column) == F.col("__v"))
    times = nth_values(rows.select(*keys, _time().alias("__us"), "__c"), keys, "__us", "__c").withColumnsRenamed({"__v": "__t", "__left": "__few"})
    cut = settled(joined(places.drop("__c"), times, keys))
    tied = cut.filter("__few < __same")
    if tied.isEmpty():
        return cut.select(*keys, "__v", "__t", F.lit(None).cast("double").alias("__h"), F.lit(None).cast("long").alias("__g"))
    open_rows = joined(df, F.broadcast(tied), keys).filter((F.col(column) == F.col("__v")) & (_time() == F.col("__t")))
    hashes = nth_values(open_rows.select(*keys, _row_hash(df).alias("__hash"), "__few"), keys, "__hash", "__few")
    cells = hashes.select(*keys, F.col("__v").alias("__h"), F.when(F.col("__left") < F.col("__same"), F.col("__left")).alias("__g"))
    return settled(joined(cut.drop("__few", "__same"), cells, keys, "left"))


def _time() -> Column:
    """Microseconds, exact as a double up to the year 2255; rows without a time come first."""
    return F.coalesce(F.unix_micros("timestamp").cast("double"), F.lit(float("-inf")))


def _row_hash(df: DataFrame) -> Column:
    """53 bits of a hash of the row, which a double holds."""
    return F.shiftright(F.xxhash64(*[f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]), 11).cast("double")


def regimes(df: DataFrame, volatility: str = "realized_vol_30s", keys: Sequence[str] = ("symbol",), large: bool | None = None) -> DataFrame:
    """Adds tercile labels of volatility, spread and depth, where these columns exist.

    Terciles are right-closed quantile bins. Where edges coincide there are no
    labels, unless the column has fewer than three values: then rows are cut by
    their rank in order of value and time, with as many labels as values. Rows of
    one value and time are ordered by a hash of the row, so every run cuts them
    alike. The place of the cut is found by counts; only rows that are equal in
    all columns and lie on it are numbered.
    """
    sources = {"vol_regime": volatility, "spread_regime": "spread", "liq_regime": "total_depth"}
    used = {k: c for k, c in sources.items() if c in df.columns}
    names = {c: k for k, c in used.items()}
    long, by, v = unpivoted(df, keys, list(names)), [*keys, "feature"], F.col("value")
    large = any_larger(df, keys) if large is None else large
    cuts = exact_quantiles(long, by, "value", [0.0, 1 / 3, 2 / 3, 1.0], large=large)
    ends = settled(long.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n")))
    counted = joined(long, ends, by).groupBy(*by).agg(F.first("low").alias("low"), F.first("high").alias("high"), F.first("n").alias("n"), F.count(F.when(v == F.col("low"), 1)).alias("n_low"), F.count(F.when((v > F.col("low")) & (v < F.col("high")), 1)).alias("n_between"))
    distinct = F.when(F.col("n") == 0, 0).when(F.col("low") == F.col("high"), 1).when(F.col("n_between") == 0, 2).otherwise(3)
    table = settled(joined(cuts, counted.withColumn("d", distinct), by))  # read again for each column below
    of = lambda c, x: F.first(F.when(F.col("feature") == c, F.col(x)), ignorenulls=True)
    out = joined(df, settled(table.groupBy(*keys).agg(*[of(c, x).alias(f"__{x}_{k}") for c, k in names.items() for x in ("q", "d")])), keys)
    hashed, numbered = _row_hash(df), []
    for k, c in used.items():
        edges, labels, x, d = F.col(f"__q_{k}"), REGIMES[k], F.col(c), F.col(f"__d_{k}")
        label = F.when(x <= edges[1], labels[0]).when(x <= edges[2], labels[1]).when(x.isNotNull(), labels[2])
        value = F.when(F.size(F.array_distinct(edges)) == 4, label)
        value = F.when(d == 1, F.when(x.isNotNull(), labels[0])).otherwise(value)
        two = table.filter((F.col("feature") == c) & (F.col("d") == 2))
        if not two.isEmpty():
            cut = _first_label(df, two, keys, c)
            out = joined(out, cut.withColumnsRenamed({f"__{p}": f"__{p}_{k}" for p in "vthg"}), keys, "left")
            at, t, h, g = [F.col(f"__{p}_{k}") for p in "vthg"]
            before = (x < at) | ((x == at) & ((_time() < t) | ((_time() == t) & (h.isNull() | (hashed <= h)))))
            value = F.when(d == 2, F.when(x.isNotNull(), F.when(before, labels[0]).otherwise(labels[1]))).otherwise(value)
            if not cut.filter("__g is not null").isEmpty():
                out = out.withColumn(f"__on_{k}", F.coalesce(g.isNotNull() & (x == at) & (_time() == t) & (hashed == h), F.lit(False)))
                numbered.append(k)
        out = out.withColumn(f"__label_{k}", value)
    if numbered:
        on = reduce(lambda a, b: a | b, [F.col(f"__on_{k}") for k in numbered])
        some = out.filter(on)
        for k in numbered:
            equal = Window.partitionBy(*keys, F.when(~F.col(f"__on_{k}"), hashed)).orderBy(F.lit(1))
            late = F.col(f"__on_{k}") & (F.row_number().over(equal) > F.col(f"__g_{k}"))
            some = some.withColumn(f"__label_{k}", F.when(late, REGIMES[k][1]).otherwise(F.col(f"__label_{k}")))
        out = out.filter(~on).unionByName(some)
    return out.select(*[c for c in df.columns if c not in used], *[F.col(f"__label_{k}").alias(k) for k in used])


def regime_ic(df: DataFrame, target: str, regime_cols: Sequence[str], y_pred: str = "y_pred", keys: Sequence[str] = ("symbol",), least: int = LEAST, large: bool | None = None) -> DataFrame:
    """n, ICs, mean and population deviation of the target in each regime of each column; ranks are taken inside the regime."""
    cells = F.array(*[F.struct(F.lit(c).alias("regime_type"), F.col(c).cast("string").alias("regime")) for c in regime_cols])
    long = df.filter(F.col(target).isNotNull() & F.col(y_pred).isNotNull()).select(*keys, F.col(target).alias("y"), F.col(y_pred).alias("p"), F.inline(cells)).filter("regime is not null")
    by = [*keys, "regime_type", "regime"]
    ranked = average_ranks(long, by, {"y": "ry", "p": "rp"}, any_larger(df, keys) if large is None else large)
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), correlation(F.col("y"), F.col("p")).alias("pearson_ic"), correlation(F.col("ry"), F.col("rp")).alias("spearman_ic"), F.avg("y").alias("mean_return"), F.stddev_pop("y").alias("std_return")
    ).filter(F.col("n") >= least)


def robustness(df: DataFrame, target: str, y_pred: str = "y_pred", volatility: str = "realized_vol_30s", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """regime_ic over volatility, spread, liquidity and hour, in one job."""
    large = any_larger(df, keys)
    named = regimes(df, volatility, keys, large)
    return regime_ic(named, target, [c for c in (*REGIMES, "hour") if c in named.columns], y_pred, keys, large=large)


def rolling_ic(df: DataFrame, feature: str, target: str, window: int = 300, step: int = 60, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Spearman IC of rows [step * j, step * j + window) in time, for each j whose window ends before the last row.

    Each row goes to the few windows that hold it, so the cost is rows times window / step.
    """
    rows = df.filter(F.col(feature).isNotNull() & F.col(target).isNotNull()).select(*keys, "timestamp", F.col(feature).alias("x"), F.col(target).alias("y"))
    numbered = with_row_number(rows, keys).withColumnsRenamed({"rn": "r", "n_rows": "n"})
    low = F.greatest(F.lit(0), F.ceil((F.col("r") - window + 1) / step)).cast("int")
    high = F.floor(F.col("r") / step).cast("int")
    dealt = numbered.withColumn("j", F.explode(F.when(low <= high, F.sequence(low, high)))).filter(window + F.col("j") * step < F.col("n"))
    by = [*keys, "j"]
    ranked = small_rank(small_rank(dealt, by, "x", "rx"), by, "y", "ry")
    return ranked.groupBy(*by).agg(correlation(F.col("rx"), F.col("ry")).alias("ic"), F.max("timestamp").alias("until"))


def positive_share(rolling: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return rolling.groupBy(*keys).agg(F.avg((F.col("ic") > 0).cast("int")).alias("share_positive"), F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_windows"))
