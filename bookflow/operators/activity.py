"""Trading activity and time-of-day profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.config import micros
from bookflow.functions.numeric import floor_to, micros_of, time_of


def trade_activity(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows, time range, volume, trades a second and the share of trades that buyers started."""
    us = micros_of(F.col("timestamp"))
    seconds = (F.max(us) - F.min(us)) / 1e6
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.sum("quantity").alias("volume"),
        F.when(F.max(us) > F.min(us), F.count(F.lit(1)) / seconds).alias("trades_per_second"), F.avg((~F.col("is_buyer_maker")).cast("int")).alias("buyer_share"),
    )


def volume_by_interval(trades: DataFrame, interval: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Volume of every interval between the first and the last trade; empty intervals have 0."""
    step = micros(interval)
    binned = trades.groupBy(*keys, floor_to(micros_of(F.col("timestamp")), step).alias("__at")).agg(F.sum("quantity").alias("volume"))
    ends = binned.groupBy(*keys).agg(F.min("__at").alias("a"), F.max("__at").alias("z"))
    grid = ends.select(*keys, F.explode(F.sequence("a", "z", F.lit(step))).alias("__at"))
    return grid.join(binned, [*keys, "__at"], "left").select(*keys, time_of(F.col("__at")).alias("timestamp"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def hourly_profile(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Means of the metrics by hour, hours with a NULL mean left out; keys with fewer than two hours give none."""
    hours = df.groupBy(*keys).agg(F.count_distinct("hour").alias("__h"))
    means = df.groupBy(*keys, "hour").agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics]).dropna(subset=[f"mean_{m}" for m in metrics])
    return means.join(hours.filter("__h >= 2"), list(keys)).drop("__h")
