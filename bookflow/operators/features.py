"""Trade-flow, return, volatility, z-score and time features, and forward targets.

Every window has the same partitioning and order (a block of a session in time),
so a feature table needs one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from bookflow.config import Config, micros
from bookflow.operators.book import book_features
from bookflow.operators.splits import in_blocks

SESSION = ("symbol", "date")


def _order(session: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*session).orderBy("timestamp")


def _if_enough(value: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(frame) >= least, value)


def _steps(duration: str, freq: str) -> int:
    return micros(duration) // micros(freq)


def large_trade(df: DataFrame, windows: Sequence[str], threshold: float = 3.0, lookback: int = 300, min_periods: int = 10, session: Sequence[str] = SESSION) -> DataFrame:
    """large_trade_w: is the average trade size above `threshold` times its rolling median? 0 where that is undefined."""
    frame = _order(session).rowsBetween(-(lookback - 1), 0)
    new = {}
    for w in windows:
        x = F.col(f"avg_trade_size_{w}")
        middle = _if_enough(F.percentile(x, F.lit(0.5)).over(frame), x, frame, min_periods)
        new[f"large_trade_{w}"] = F.coalesce((x > threshold * middle).cast("int"), F.lit(0))
    return df.withColumns(new)


def volume_shock(df: DataFrame, windows: Sequence[str], lookback: int = 300, min_periods: int = 10, session: Sequence[str] = SESSION) -> DataFrame:
    """volume_shock_w: volume over its rolling mean, minus 1; 0 where the mean is undefined or 0."""
    frame = _order(session).rowsBetween(-(lookback - 1), 0)
    new = {}
    for w in windows:
        x = F.col(f"total_volume_{w}")
        mean = _if_enough(F.avg(x).over(frame), x, frame, min_periods)
        new[f"volume_shock_{w}"] = F.when(mean > 0, x / mean - 1).otherwise(0.0)
    return df.withColumns(new)


def trade_features(df: DataFrame, cfg: Config | None = None) -> DataFrame:
    cfg = cfg or Config()
    out = large_trade(df, cfg.trade_windows, lookback=cfg.lookback, min_periods=cfg.min_periods, session=cfg.session)
    return volume_shock(out, cfg.trade_windows, cfg.lookback, cfg.min_periods, cfg.session)


def lagged_returns(df: DataFrame, lags: Sequence[str], freq: str, session: Sequence[str] = SESSION) -> DataFrame:
    """return_lag_k: log return of the mid price over the last k."""
    mid, w = F.col("mid_price"), _order(session)
    return df.withColumns({f"return_lag_{k}": F.ln(mid / F.lag(mid, _steps(k, freq)).over(w)) for k in lags})


def realized_vol(df: DataFrame, windows: Sequence[str], freq: str, session: Sequence[str] = SESSION) -> DataFrame:
    """realized_vol_w: rolling deviation of the one-step log return, two returns at least."""
    step = f"return_lag_{freq}"
    if step not in df.columns:
        df = lagged_returns(df, [freq], freq, session)
    x, order = F.col(step), _order(session)
    new = {}
    for w in windows:
        frame = order.rowsBetween(-(_steps(w, freq) - 1), 0)
        new[f"realized_vol_{w}"] = _if_enough(F.stddev_samp(x).over(frame), x, frame, 2)
    return df.withColumns(new)


def rolling_zscores(df: DataFrame, columns: Sequence[str], lookback: int = 300, min_periods: int = 10, session: Sequence[str] = SESSION) -> DataFrame:
    """zscore_c: distance from the rolling mean in rolling deviations; 0 where the deviation is undefined or 0."""
    frame = _order(session).rowsBetween(-(lookback - 1), 0)
    new = {}
    for c in columns:
        x = F.col(c)
        std = _if_enough(F.stddev_samp(x).over(frame), x, frame, max(min_periods, 2))
        new[f"zscore_{c}"] = F.when(std > 0, (x - F.avg(x).over(frame)) / std).otherwise(0.0)
    return df.withColumns(new)


def time_features(df: DataFrame) -> DataFrame:
    """hour, minute, day_of_week (Monday is 0) and the part of the trading day."""
    hour = F.hour("timestamp")
    part = (
        F.when(hour <= 4, "asia_late").when(hour <= 8, "asia_early").when(hour <= 12, "europe_am").when(hour <= 16, "us_am").when(hour <= 20, "us_pm").otherwise("asia_evening")
    )
    return df.withColumns({"hour": hour, "minute": F.minute("timestamp"), "day_of_week": F.weekday("timestamp"), "session": F.when(hour.isNotNull(), part)})


def future_returns(df: DataFrame, horizons: Sequence[str], freq: str, session: Sequence[str] = SESSION) -> DataFrame:
    """y_return_h and y_price_change_h: what the mid price does over the next h; NULL where the session ends before."""
    mid, w = F.col("mid_price"), _order(session)
    new = {}
    for h in horizons:
        after = F.lead(mid, _steps(h, freq)).over(w)
        new |= {f"y_return_{h}": F.ln(after / mid), f"y_price_change_{h}": after - mid}
    return df.withColumns(new)


def direction_targets(df: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """y_direction_h: 1 if the future return is positive, else 0; NULL without a future."""
    return df.withColumns({f"y_direction_{h}": (F.col(f"y_return_{h}") > 0).cast("int") for h in horizons})


def half_spread_targets(df: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """y_half_spread_h: 1, -1 or 0 as the price change is above, below or within half the spread; NULL without a future."""
    half = F.col("spread") * 0.5
    new = {}
    for h in horizons:
        change = F.col(f"y_price_change_{h}")
        new[f"y_half_spread_{h}"] = F.when(change.isNull(), F.lit(None).cast("int")).when(change > half, 1).when(change < -half, -1).otherwise(0)
    return df.withColumns(new)


def targets(df: DataFrame, horizons: Sequence[str], freq: str, session: Sequence[str] = SESSION) -> DataFrame:
    return half_spread_targets(direction_targets(future_returns(df, horizons, freq, session), horizons), horizons)


def reach(cfg: Config) -> tuple[int, int]:
    """Rows that the features of a row look back and ahead at most; z-scores look back over lagged returns."""
    steps = [_steps(d, cfg.frequency) for d in (*cfg.return_lags, *cfg.volatility_windows)]
    return cfg.lookback + max(steps) + 1, max(_steps(h, cfg.frequency) for h in cfg.horizons)


def build_features(aligned: DataFrame, cfg: Config | None = None) -> DataFrame:
    """The feature table: book, trade flow, returns, volatility, z-scores, time, targets. Windows hold a block of a session and its halo."""
    cfg = cfg or Config()
    before, after = reach(cfg)
    blocks = replace(cfg, session=(*cfg.session, "__block"))
    out = book_features(in_blocks(aligned, cfg.session, cfg.block_rows, before, after), cfg.imbalance_levels, cfg.levels)
    out = trade_features(out, blocks)
    out = realized_vol(lagged_returns(out, cfg.return_lags, cfg.frequency, blocks.session), cfg.volatility_windows, cfg.frequency, blocks.session)
    scored = [c for c in (f"return_lag_{cfg.return_lags[0]}", "spread", f"total_volume_{cfg.trade_windows[0]}", "obi_1") if c in out.columns]
    out = rolling_zscores(out, scored, cfg.lookback, cfg.min_periods, blocks.session)
    return targets(time_features(out), cfg.horizons, cfg.frequency, blocks.session).filter("__own").drop("__block", "__own")


def feature_groups(cfg: Config | None = None) -> dict[str, list[str]]:
    """Names of the model's features: orderbook, trade, return_vol, and all of them."""
    cfg = cfg or Config()
    book = ["spread", "relative_spread", *[f"obi_{n}" for n in cfg.imbalance_levels], "weighted_obi", "microprice_deviation", "bid_depth_total", "ask_depth_total", "total_depth",
            "top_bid_depth", "top_ask_depth", "bid_depth_slope", "ask_depth_slope", *[f"depth_imbalance_{i}" for i in range(1, cfg.levels + 1)]]
    first, *_ = cfg.trade_windows
    trade = [f"{c}_{w}" for c in ("trade_imbalance", "signed_volume", "total_volume") for w in cfg.trade_windows]
    trade += [f"num_trades_{first}", f"avg_trade_size_{first}", f"large_trade_{first}", *[f"volume_shock_{w}" for w in cfg.trade_windows[:2]]]
    moves = [*[f"return_lag_{k}" for k in cfg.return_lags], *[f"realized_vol_{w}" for w in cfg.volatility_windows]]
    moves += [f"zscore_{c}" for c in (f"return_lag_{cfg.return_lags[0]}", "spread", f"total_volume_{cfg.trade_windows[0]}", "obi_1")]
    return {"orderbook": book, "trade": trade, "return_vol": moves, "all": book + trade + moves}


def feature_columns(df: DataFrame, group: str = "all", cfg: Config | None = None) -> list[str]:
    return [c for c in feature_groups(cfg)[group] if c in df.columns]
