"""Features of one book snapshot: plain projections, one select for all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions.numeric import plain_sum, ratio, total


def _sizes(df: DataFrame, side: str, levels: int) -> list[Column]:
    return [F.col(f"{side}_size_{i}") for i in range(1, levels + 1) if f"{side}_size_{i}" in df.columns]


def mid_columns() -> dict[str, Column]:
    return {"mid_price": (F.col("bid_price_1") + F.col("ask_price_1")) / 2}


def spread_columns() -> dict[str, Column]:
    spread, mid = F.col("ask_price_1") - F.col("bid_price_1"), (F.col("bid_price_1") + F.col("ask_price_1")) / 2
    return {"spread": spread, "relative_spread": ratio(spread, mid)}


def obi_columns(df: DataFrame, levels: Sequence[int] = (1, 3, 5)) -> dict[str, Column]:
    """Size imbalance of the first n levels; missing levels are skipped, an empty book gives 0."""
    out = {}
    for n in levels:
        bid, ask = total(_sizes(df, "bid", n)), total(_sizes(df, "ask", n))
        out[f"obi_{n}"] = ratio(bid - ask, bid + ask)
    return out


def weighted_obi_columns(df: DataFrame, max_level: int = 5) -> dict[str, Column]:
    """Imbalance with level weights 1/i; a missing level gives 0."""
    side = {s: plain_sum([F.col(f"{s}_size_{i}") * (1.0 / i) for i in range(1, max_level + 1) if f"{s}_size_{i}" in df.columns]) for s in ("bid", "ask")}
    return {"weighted_obi": ratio(side["bid"] - side["ask"], side["bid"] + side["ask"])}


def microprice_columns() -> dict[str, Column]:
    bid, ask, b, a = (F.col(c) for c in ("bid_price_1", "ask_price_1", "bid_size_1", "ask_size_1"))
    mid = (bid + ask) / 2
    micro = F.when(b + a > 0, (ask * b + bid * a) / (b + a)).otherwise(mid)
    return {"microprice": micro, "microprice_deviation": (micro - mid) / mid}


def depth_columns(df: DataFrame, max_level: int = 5) -> dict[str, Column]:
    """Total and top depth, slope of depth over levels and imbalance of each level."""
    bid, ask = total(_sizes(df, "bid", max_level)), total(_sizes(df, "ask", max_level))
    out = {"bid_depth_total": bid, "ask_depth_total": ask, "total_depth": bid + ask, "top_bid_depth": F.col("bid_size_1"), "top_ask_depth": F.col("ask_size_1")}
    max_level = min(len(_sizes(df, "bid", max_level)), len(_sizes(df, "ask", max_level)))
    if max_level > 1:
        out |= {f"{s}_depth_slope": (F.col(f"{s}_size_1") - F.col(f"{s}_size_{max_level}")) / (max_level - 1) for s in ("bid", "ask")}
    for i in range(1, max_level + 1):
        b, a = F.col(f"bid_size_{i}"), F.col(f"ask_size_{i}")
        out[f"depth_imbalance_{i}"] = ratio(b - a, b + a)
    return out


def mid_price(df: DataFrame) -> DataFrame:
    return df.withColumns(mid_columns())


def spread(df: DataFrame) -> DataFrame:
    return df.withColumns(spread_columns())


def obi(df: DataFrame, levels: Sequence[int] = (1, 3, 5)) -> DataFrame:
    return df.withColumns(obi_columns(df, levels))


def weighted_obi(df: DataFrame, max_level: int = 5) -> DataFrame:
    return df.withColumns(weighted_obi_columns(df, max_level))


def microprice(df: DataFrame) -> DataFrame:
    return df.withColumns(microprice_columns())


def depth(df: DataFrame, max_level: int = 5) -> DataFrame:
    return df.withColumns(depth_columns(df, max_level))


def book_features(df: DataFrame, imbalance_levels: Sequence[int] = (1, 3, 5), levels: int = 5) -> DataFrame:
    """All book features in one projection."""
    return df.withColumns(
        mid_columns() | spread_columns() | obi_columns(df, imbalance_levels) | weighted_obi_columns(df, levels) | microprice_columns() | depth_columns(df, levels)
    )
