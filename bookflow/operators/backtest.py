"""Quantile positions, non-overlapping holds, costs, equity and summaries, per asset and horizon."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookflow.config import SCENARIOS, Config, Cost
from bookflow.operators.ranks import exact_quantiles, joined
from bookflow.operators.splits import numbered_in_block, with_previous

KEYS = ("symbol",)


def positions(df: DataFrame, long_q: float = 0.9, short_q: float = 0.1, y_pred: str = "y_pred", keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds raw_position: -1 at or below the lower quantile of predictions, 1 at or above the upper one, else 0; short wins ties."""
    cuts = exact_quantiles(df, keys, y_pred, [short_q, long_q], "__q")
    p = F.col(y_pred)
    return joined(df, cuts, keys).withColumn("raw_position", F.when(p <= F.col("__q")[0], -1).when(p >= F.col("__q")[1], 1).otherwise(0)).drop("__q")


def _day_signals(frame: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(frame["at"].iloc[k], np.int64), np.asarray(frame["side"].iloc[k], np.int64)


def _next_entries(at: np.ndarray, hold: int) -> np.ndarray:
    """For each signal of a day the number of the first one that may enter after it; len(at) for none."""
    return np.searchsorted(at, at + hold)


def _transfers(hold: int):
    """A day as a function: rows still held at its start -> rows held on and side at its end."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held_out, side_out = [], []
            for k in range(len(frame)):
                (at, side), n = _day_signals(frame, k), int(frame["n"].iloc[k])
                after = _next_entries(at, hold)
                last = np.append(np.where(after < len(at), after, np.arange(len(at))), len(at))
                while (last != last[last]).any():  # the last entry of the chain from each signal, by doubling the pointers
                    last = last[last]
                held = np.arange(hold)  # rows still held at the start: 0 if free
                first = np.searchsorted(at, held)
                entered = first < len(at)
                final = last[np.minimum(first, len(at))]
                ends = np.append(at, 0)[final] + hold
                out = np.where(entered, ends - n, held - n)
                held_out.append(np.maximum(out, 0))
                # 0: free, 2: what was held goes on
                side_out.append(np.where(out <= 0, 0, np.where(entered, np.append(side, 0)[final], 2)))
            yield frame.drop(columns=["at", "side", "n"]).assign(held_out=held_out, side_out=side_out)

    return of


def _starts(keys: Sequence[str]):
    """Rows still held, and the side, at the start of each day: days of a key come in order, and only the state of the last one is kept."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, held, side = None, 0, 0
        for frame in frames:
            starts = []
            for *key, held_out, side_out in zip(*(frame[k] for k in keys), frame["held_out"], frame["side_out"], strict=True):
                if key != before:
                    before, held, side = key, 0, 0
                starts.append((held, side))
                side = side if side_out[held] == 2 else int(side_out[held])
                held = int(held_out[held])
            yield frame.drop(columns=["held_out", "side_out"]).assign(held=[h for h, _ in starts], held_side=[s for _, s in starts])

    return of


def _positions(hold: int):
    """The position of every row of a day, from what is held at its start."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for k in range(len(frame)):
                (at, side), n, held = _day_signals(frame, k), int(frame["n"].iloc[k]), int(frame["held"].iloc[k])
                after, entries, i = _next_entries(at, hold), [], int(np.searchsorted(at, held))
                while i < len(at):
                    entries.append(i)
                    i = int(after[i])
                change = np.zeros(n + 1, np.int64)
                stops = np.minimum(at[entries] + hold, n)
                np.add.at(change, at[entries], side[entries])
                np.add.at(change, stops, -side[entries])
                out = np.cumsum(change[:-1])
                out[:held] = frame["held_side"].iloc[k]
                made.append(out.astype(np.int8))
            yield frame.drop(columns=["at", "side", "n", "held", "held_side"]).assign(positions=made)

    return of


def non_overlapping(df: DataFrame, hold: int, keys: Sequence[str] = KEYS, block: str = "1d") -> DataFrame:
    """Adds position: each signal is held for `hold` rows, signals inside a hold are ignored.

    Time is cut into blocks, a day unless given. A block is a function of the rows
    still held at its start, found by doubling pointers from each signal to the next
    that may enter; the functions of a key's blocks are applied in order, by a scan
    that keeps one state; then every block's positions follow by themselves. No
    window and no array spans more than a block of a key, and rows cross the network once.
    """
    names = list(keys)
    in_block = numbered_in_block(df, keys, block=block)
    signal = F.col("raw_position") != 0
    days = in_block.groupBy(*names, "__block").agg(F.sort_array(F.collect_list(F.when(signal, F.struct(F.col("__in").cast("int").alias("at"), F.col("raw_position").cast("int").alias("side"))))).alias("s"), F.count(F.lit(1)).alias("n"))
    days = days.select(*names, "__block", "n", F.col("s.at").alias("at"), F.col("s.side").alias("side"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in days.select(*names, "__block").schema.fields)
    functions = days.mapInPandas(_transfers(hold), head + ", held_out array<long>, side_out array<long>")
    ordered = functions.repartition(*names).sortWithinPartitions(*names, "__block")
    starts = ordered.mapInPandas(_starts(names), head + ", held long, held_side long")
    placed = days.join(starts, [*names, "__block"]).mapInPandas(_positions(hold), head + ", positions array<byte>")
    out = in_block.join(placed, [*names, "__block"]).withColumn("position", F.get("positions", F.col("__in")).cast("int"))
    return out.drop("__block", "__in", "positions")


def with_traded(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds traded: 1 where the position differs from the row before; the position before the first row is 0."""
    found = with_previous(df, "position", "__position_before", keys)
    return found.withColumn("traded", (F.col("position") != F.coalesce("__position_before", F.lit(0))).cast("int")).drop("__position_before")


def cost_of(c: Cost) -> Column:
    """Round-trip cost in return space: fees and slippage twice, and a multiple of the relative spread."""
    relative = F.when(F.col("mid_price") > 0, F.col("spread") / F.col("mid_price")).otherwise(0.0)
    return F.lit(2 * c.fee_bps / 1e4 + 2 * c.slippage_bps / 1e4) + F.lit(float(c.spread_multiplier)) * relative


def trade_costs(df: DataFrame, scenarios: dict[str, Cost] | None = None) -> DataFrame:
    return df.withColumns({f"cost_{k}": cost_of(c) for k, c in (scenarios or SCENARIOS).items()})


def gross_returns(df: DataFrame, horizon: str) -> DataFrame:
    """Adds gross_return: position times forward return on every held row, so the returns of a hold overlap."""
    return df.withColumn("gross_return", F.col("position") * F.col(f"y_return_{horizon}"))


def apply_costs(df: DataFrame, scenarios: dict[str, Cost] | None = None) -> DataFrame:
    return df.withColumns({f"net_return_{k}": F.col("gross_return") - F.col("traded") * cost_of(c) for k, c in (scenarios or SCENARIOS).items()})


def backtest(df: DataFrame, horizon: str, hold: int, scenarios: dict[str, Cost] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positions, trades, gross and net returns for one horizon; `df` has predictions, targets, spread and mid price."""
    held = non_overlapping(positions(df, keys=keys), hold, keys)
    return apply_costs(gross_returns(with_traded(held, keys), horizon), scenarios)


def by_scenario(bt: DataFrame, scenarios: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each row and scenario: cost_scenario and ret."""
    cells = [F.struct(F.lit("gross").alias("cost_scenario"), F.col("gross_return").alias("ret"))] + [F.struct(F.lit(f"net_{k}").alias("cost_scenario"), F.col(f"net_return_{k}").alias("ret")) for k in scenarios]
    return bt.select(*keys, "timestamp", "position", "traded", F.inline(F.array(*cells)))


def equity_curve(returns: DataFrame, keys: Sequence[str] = (*KEYS, "cost_scenario"), by_day: bool = True) -> DataFrame:
    """Adds cum: the running sum of returns, NULL as 0.

    Days are summed first; a window then holds one day of one key, and the sums of
    the days before are added. Without by_day one window holds a key.
    """
    if not by_day:
        w = Window.partitionBy(*keys).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
        return returns.withColumn("cum", F.sum(F.coalesce("ret", F.lit(0.0))).over(w))
    dated = returns.withColumn("__day", F.to_date("timestamp")).withColumn("__r", F.coalesce("ret", F.lit(0.0)))
    days = dated.groupBy(*keys, "__day").agg(F.sum("__r").alias("__s"))
    w = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(*keys, "__day", F.coalesce(F.sum("__s").over(w), F.lit(0.0)).alias("__before"))
    inside = F.sum("__r").over(Window.partitionBy(*keys, "__day").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0))
    return dated.withColumn("__in", inside).join(carried, [*keys, "__day"]).withColumn("cum", F.col("__before") + F.col("__in")).drop("__day", "__r", "__in", "__before")


def drawdown(curve: DataFrame, mode: str = "backtest", keys: Sequence[str] = (*KEYS, "cost_scenario"), by_day: bool = True) -> DataFrame:
    """Adds peak and drawdown of cum. "backtest" divides by the peak's size and gives 0 at peak 0; "metric" divides by the signed peak, by 1 at peak 0.

    by_day as in equity_curve; the maxima of the days before are carried in.
    """
    if by_day:
        dated = curve.withColumn("__day", F.to_date("timestamp"))
        days = dated.groupBy(*keys, "__day").agg(F.max("cum").alias("__m"))
        w = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
        carried = days.select(*keys, "__day", F.max("__m").over(w).alias("__before"))
        inside = F.max("cum").over(Window.partitionBy(*keys, "__day").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0))
        out = dated.withColumn("__in", inside).join(carried, [*keys, "__day"]).withColumn("peak", F.greatest("__in", "__before")).drop("__day", "__in", "__before")
    else:
        w = Window.partitionBy(*keys).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
        out = curve.withColumn("peak", F.max("cum").over(w))
    gap = F.col("cum") - F.col("peak")
    value = F.when(F.col("peak") != 0, gap / F.abs("peak")).otherwise(0.0) if mode == "backtest" else gap / F.when(F.col("peak") != 0, F.col("peak")).otherwise(1.0)
    return out.withColumn("drawdown", value)


def backtest_summary(bt: DataFrame, scenarios: Sequence[str] = tuple(SCENARIOS), keys: Sequence[str] = KEYS, by_day: bool = True) -> DataFrame:
    """Profit, mean active return, Sharpe ratio, hit rate, drawdown, trades and active rows of each scenario."""
    by = [*keys, "cost_scenario"]
    curve = drawdown(equity_curve(by_scenario(bt, scenarios, keys), by, by_day), "backtest", by, by_day)
    active = F.when((F.col("position") != 0) & F.col("ret").isNotNull(), F.col("ret"))
    sd = F.stddev_pop(active)
    return curve.groupBy(*by).agg(
        F.coalesce(F.sum("ret"), F.lit(0.0)).alias("total_pnl"), F.coalesce(F.avg(active), F.lit(0.0)).alias("mean_return_per_trade"),
        F.when((F.count(active) > 1) & (sd > 0), F.avg(active) / sd * 86400**0.5).otherwise(0.0).alias("sharpe"),
        F.coalesce(F.avg(F.when(active.isNotNull(), (active > 0).cast("int"))), F.lit(0.0)).alias("hit_rate"),
        F.min("drawdown").alias("max_drawdown"), F.sum("traded").alias("n_trades"), F.count(F.when(F.col("position") != 0, 1)).alias("n_active"),
    )


def backtest_grid(df: DataFrame, cfg: Config | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """backtest_summary for every horizon."""
    cfg, out = cfg or Config(), None
    for h in cfg.horizons:
        one = backtest_summary(backtest(df, h, cfg.steps(h), cfg.scenarios, keys), tuple(cfg.scenarios), keys).select(F.lit(h).alias("horizon"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def cost_sensitivity(summary: DataFrame, metric: str = "sharpe", scenarios: Sequence[str] = ("gross", *[f"net_{k}" for k in SCENARIOS]), keys: Sequence[str] = KEYS) -> DataFrame:
    """The metric by horizon and scenario, missing as 0."""
    return summary.groupBy(*keys, "horizon").pivot("cost_scenario", list(scenarios)).agg(F.first(metric)).fillna(0.0)


def cross_asset(summary: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gross and medium-cost Sharpe ratio, hit rate and trades of each asset and horizon."""
    of = lambda c, s: F.max(F.when(F.col("cost_scenario") == s, F.col(c)))
    return summary.groupBy(*keys, "horizon").agg(of("sharpe", "gross").alias("gross_sharpe"), of("sharpe", "net_medium").alias("medium_sharpe"), of("hit_rate", "gross").alias("hit_rate"), of("n_trades", "gross").alias("n_trades"))


def format_summary(summary: DataFrame) -> DataFrame:
    """The summary in basis points and per cent, rounded for reading."""
    others = [c for c in summary.columns if c not in {"total_pnl", "mean_return_per_trade", "sharpe", "hit_rate", "max_drawdown"}]
    return summary.select(
        *others, F.round(F.col("total_pnl") * 1e4, 2).alias("total_pnl_bps"), F.round(F.col("mean_return_per_trade") * 1e4, 2).alias("mean_return_bps"),
        F.round("sharpe", 2).alias("sharpe"), F.round(F.col("hit_rate") * 100, 1).alias("hit_pct"), F.round(F.col("max_drawdown") * 100, 2).alias("max_drawdown_pct"),
    )
