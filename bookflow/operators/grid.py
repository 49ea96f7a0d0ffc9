"""Regular time grid: downsampling, as-of fill, trade bars and their alignment.

Grid times are whole multiples of the step in epoch microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookflow.config import Config, micros
from bookflow.functions.numeric import ceil_to, floor_to, micros_of, ratio, time_of
from bookflow.operators.ranks import joined
from bookflow.operators.splits import in_blocks

SESSION = ("symbol", "date")
BAR = ("total_volume", "buy_volume", "sell_volume", "num_trades", "dollar_volume")


def downsample_books(df: DataFrame, interval: str, session: Sequence[str] = SESSION) -> DataFrame:
    """Last value that is not NULL of each column in each interval, labelled by its start; needs a best bid.

    Partial maxima are taken before the shuffle.
    """
    values = [c for c in df.columns if c not in {*session, "timestamp"}]
    order = F.struct("timestamp", "seq")
    start = floor_to(micros_of(F.col("timestamp")), micros(interval))
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in values]
    out = df.withColumn("__start", start).groupBy(*session, "__start").agg(*last)
    return out.filter(F.col("bid_price_1").isNotNull()).select(*session, time_of(F.col("__start")).alias("timestamp"), *values)


def time_grid(df: DataFrame, freq: str, session: Sequence[str] = SESSION) -> DataFrame:
    """Grid times of each session from the first timestamp, rounded up, to the last, rounded down."""
    step = micros(freq)
    us = micros_of(F.col("timestamp"))
    ends = df.groupBy(*session).agg(ceil_to(F.min(us), step).alias("__from"), floor_to(F.max(us), step).alias("__to")).filter("__from <= __to")
    return ends.select(*session, F.explode(F.sequence("__from", "__to", F.lit(step))).alias("__at")).select(*session, time_of(F.col("__at")).alias("timestamp"))


def resample_books(df: DataFrame, freq: str, session: Sequence[str] = SESSION, block_rows: int = 16_384) -> DataFrame:
    """The latest snapshot at or before each grid time (an as-of join without a range join).

    Snapshots shrink to the last one of each step first. Grid times are cut into
    blocks of `block_rows` steps. A block starts with the last snapshot of the
    blocks before it, which a scan over blocks carries on; inside it a window
    fills. So a window has a block of grid times, or one row for each block of a
    session. NULLs inside the chosen snapshot stay; grid times without a best bid
    are left out.
    """
    step = micros(freq)
    values = [c for c in df.columns if c not in {*session, "timestamp"}]
    at = ceil_to(micros_of(F.col("timestamp")), step)
    lasts = df.withColumn("__at", at).groupBy(*session, "__at").agg(F.max_by(F.struct(*values), F.struct("timestamp", "seq")).alias("__row")).withColumn("__block", F.floor(F.col("__at") / (step * block_rows)))
    grid = time_grid(df, freq, session).withColumn("__at", micros_of(F.col("timestamp"))).withColumn("__block", F.floor(F.col("__at") / (step * block_rows)))
    by = [*session, "__block"]
    ends = joined(grid.select(*by).distinct(), lasts.groupBy(*by).agg(F.max_by("__row", "__at").alias("__end")), by, "left")
    earlier = Window.partitionBy(*session).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    inside = F.last("__row", ignorenulls=True).over(Window.partitionBy(*by).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0))
    filled = joined(joined(grid, lasts.drop("__block"), [*session, "__at"], "left").withColumn("__inside", inside), carried, by, "left")
    row = F.coalesce("__inside", "__carried")
    return filled.withColumn("__row", row).select(*session, "timestamp", *[F.col("__row")[c].alias(c) for c in values]).filter(F.col("bid_price_1").isNotNull())


def trade_bars(trades: DataFrame, freq: str, label: str = "left", session: Sequence[str] = SESSION) -> DataFrame:
    """Volume, buy and sell volume, number and dollar volume of the trades of each step.

    label "left": the bar at t holds [t, t + freq); "right": (t - freq, t], which
    knows nothing after t. Bars are summed before the shuffle.
    """
    step = micros(freq)
    us = micros_of(F.col("timestamp"))
    at = floor_to(us, step) if label == "left" else ceil_to(us, step)
    q, maker = F.col("quantity"), F.col("is_buyer_maker")
    return (
        trades.withColumn("__at", at)
        .groupBy(*session, "__at")
        .agg(
            F.sum(q).alias("total_volume"),
            F.sum(F.when(~maker, q).otherwise(0.0)).alias("buy_volume"),
            F.sum(F.when(maker, q).otherwise(0.0)).alias("sell_volume"),
            F.count(q).alias("num_trades"),
            F.sum(F.col("price") * q).alias("dollar_volume"),
        )
        .select(*session, time_of(F.col("__at")).alias("timestamp"), *BAR)
    )


def rolling_trades(bars_on_grid: DataFrame, windows: Sequence[str], freq: str, session: Sequence[str] = SESSION, block_rows: int = 16_384) -> DataFrame:
    """Rolling sums over rows of the bar columns and the measures made of them, for each window.

    A missing bar counts as no trades. vwap is NULL where nothing was traded, but
    0 in a session without any trade. Windows hold a block of a session and its halo.
    """
    step = micros(freq)
    base = bars_on_grid.fillna(0, subset=list(BAR))
    kept = [c for c in bars_on_grid.columns if c not in BAR]
    traded = base.groupBy(*session).agg((F.max("num_trades") > 0).alias("__any"))
    longest = max(max(1, micros(w) // step) for w in windows)
    base = joined(in_blocks(base, session, block_rows, longest - 1), traded, session)
    order = Window.partitionBy(*session, "__block").orderBy("timestamp")
    sums = {}
    for w in windows:
        frame = order.rowsBetween(-(max(1, micros(w) // step) - 1), 0)
        sums |= {f"__{c}_{w}": F.sum(F.col(c).cast("double")).over(frame) for c in BAR}
    out = base.select(*kept, "__any", "__own", *[v.alias(k) for k, v in sums.items()]).filter("__own")
    made = []
    for w in windows:
        all_, buy, sell, n, dollar = (F.col(f"__{c}_{w}") for c in BAR)
        made += [
            all_.alias(f"total_volume_{w}"), buy.alias(f"buy_volume_{w}"), sell.alias(f"sell_volume_{w}"), (buy - sell).alias(f"signed_volume_{w}"), n.alias(f"num_trades_{w}"),
            ratio(buy - sell, all_).alias(f"trade_imbalance_{w}"), ratio(all_, n).alias(f"avg_trade_size_{w}"),
            ratio(dollar, all_, F.when(F.col("__any"), F.lit(None).cast("double")).otherwise(0.0)).alias(f"vwap_{w}"),
        ]
    return out.select(*kept, *made)


def resample_and_align(books: DataFrame, trades: DataFrame, cfg: Config | None = None, label: str = "left") -> DataFrame:
    """Books on the grid with the trade windows of each grid time."""
    cfg = cfg or Config()
    grid = resample_books(books, cfg.frequency, cfg.session, cfg.block_rows)
    bars = trade_bars(trades, cfg.frequency, label, cfg.session)
    with_bars = grid.join(bars, [*cfg.session, "timestamp"], "left")
    return rolling_trades(with_bars, cfg.trade_windows, cfg.frequency, cfg.session, cfg.block_rows)
