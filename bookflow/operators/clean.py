"""Cleaning of book snapshots and trades, step by step, with reports.

Rows carry an arrival number `seq`. Each step sees the survivors of the steps
before it. A row keeps the number of the first step that it fails, so a report
needs one aggregation, not a count for each step.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookflow.operators.ranks import any_larger, exact_quantiles, joined, settled

SESSION = ("symbol", "date")
# Names of the steps in the reports.
BOOK_STEPS = ("duplicate_timestamps", "missing_top_of_book", "crossed_books", "zero_negative_spread", "outlier_spreads", "invalid_prices", "negative_sizes", "book_ordering")
TRADE_STEPS = ("duplicate_trade_ids", "missing_fields", "invalid_price_or_qty", "outlier_prices", "time_range_alignment")
TOP = ("bid_price_1", "bid_size_1", "ask_price_1", "ask_size_1")
CHUNK = 200_000


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _levels(df: DataFrame, kind: str, levels: int) -> list[str]:
    return [c for i in range(1, levels + 1) for c in (f"bid_{kind}_{i}", f"ask_{kind}_{i}") if c in df.columns]


def is_last_of_timestamp(session: Sequence[str] = SESSION) -> Column:
    """Is this the last arrival at its timestamp, or without one? Windows hold one timestamp, so a long session is many tasks."""
    w = Window.partitionBy(*session, "timestamp").orderBy("seq")
    return F.col("timestamp").isNull() | F.lead(F.lit(1)).over(w).isNull()


def drop_duplicate_snapshots(df: DataFrame, session: Sequence[str] = SESSION) -> DataFrame:
    """Keep the last arrival of each timestamp."""
    return df.withColumn("__last", is_last_of_timestamp(session)).filter("__last").drop("__last")


def drop_missing_top(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[c for c in TOP if c in df.columns])


def drop_crossed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("bid_price_1") < F.col("ask_price_1"))


def drop_nonpositive_spread(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ask_price_1") - F.col("bid_price_1") > 0)


def median_of(df: DataFrame, value: str, session: Sequence[str], large: bool | None = None) -> DataFrame:
    """One row for each session: __median, exact, from counts."""
    return exact_quantiles(df, session, value, [0.5], large=large).select(*session, F.col("q")[0].alias("__median"))


def drop_wide_spreads(df: DataFrame, max_spread_multiple: float = 10.0, session: Sequence[str] = SESSION) -> DataFrame:
    """Drop spreads above a multiple of the session's median; a median of 0 or less drops nothing."""
    spread = F.col("ask_price_1") - F.col("bid_price_1")
    middle = median_of(df.withColumn("__spread", spread), "__spread", session)
    return joined(df, middle, session).filter((F.col("__median") <= 0) | (spread <= F.col("__median") * max_spread_multiple)).drop("__median")


def drop_bad_prices(df: DataFrame, levels: int) -> DataFrame:
    return df.filter(_all([F.col(c) > 0 for c in _levels(df, "price", levels)]))


def drop_bad_sizes(df: DataFrame, levels: int) -> DataFrame:
    return df.filter(_all([F.col(c) >= 0 for c in _levels(df, "size", levels)]))


def _ordered(df: DataFrame, levels: int) -> Column:
    parts = []
    for i in range(1, levels):
        for side in ("bid", "ask"):
            near, far = f"{side}_price_{i}", f"{side}_price_{i + 1}"
            if near in df.columns and far in df.columns:
                parts.append(F.col(near) >= F.col(far) if side == "bid" else F.col(near) <= F.col(far))
    return _all(parts)


def drop_misordered(df: DataFrame, levels: int) -> DataFrame:
    """Keep books whose bids don't rise and whose asks don't fall with the level."""
    return df.filter(_ordered(df, levels))


def book_failures(df: DataFrame, levels: int = 5, max_spread_multiple: float = 10.0, session: Sequence[str] = SESSION) -> DataFrame:
    """Adds failed_step: the number of the first book step that a row fails, from 1, or NULL."""
    spread = F.col("ask_price_1") - F.col("bid_price_1")
    early = (
        F.when(~F.col("__last"), 1)
        .when(~_all([F.col(c).isNotNull() for c in TOP if c in df.columns]), 2)
        .when(~_true(F.col("bid_price_1") < F.col("ask_price_1")), 3)
        .when(~_true(spread > 0), 4)
    )
    marked = df.withColumn("__last", is_last_of_timestamp(session)).withColumn("__early", early)
    middle = settled(median_of(marked.withColumn("__spread", F.when(F.col("__early").isNull(), spread)), "__spread", session, any_larger(df, session)))
    late = (
        F.when(~_true((F.col("__median") <= 0) | (spread <= F.col("__median") * max_spread_multiple)), 5)
        .when(~_true(_all([F.col(c) > 0 for c in _levels(df, "price", levels)])), 6)
        .when(~_true(_all([F.col(c) >= 0 for c in _levels(df, "size", levels)])), 7)
        .when(~_true(_ordered(df, levels)), 8)
    )
    return joined(marked, middle, session).withColumn("failed_step", F.coalesce("__early", late)).drop("__last", "__early", "__median")


def drop_duplicate_trades(df: DataFrame, session: Sequence[str] = SESSION) -> DataFrame:
    """Keep the first of each trade id in time."""
    w = Window.partitionBy(*session, "trade_id").orderBy("timestamp", "seq")
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def drop_missing_trades(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["timestamp", "price", "quantity"])


def drop_nonpositive_trades(df: DataFrame) -> DataFrame:
    return df.filter((F.col("price") > 0) & (F.col("quantity") > 0))


def rolling_median_std(df: DataFrame, value: str, before: int, after: int, min_periods: int, session: Sequence[str] = SESSION, chunk: int = CHUNK) -> DataFrame:
    """Adds roll_median and roll_std of a frame of rows around each row, and session_rows.

    Sessions are cut into chunks of rows that carry the neighbouring rows their
    frames need, so one large session is many tasks. A task holds a chunk as an
    Arrow table; only the value becomes a pandas series.
    """
    w = Window.partitionBy(*session)
    numbered = df.withColumn("__rn", F.row_number().over(w.orderBy("timestamp", "seq")) - 1).withColumn("session_rows", F.count(F.lit(1)).over(w))
    low = F.greatest(F.lit(0), F.floor((F.col("__rn") - after) / chunk)).cast("int")
    high = F.floor((F.col("__rn") + before) / chunk).cast("int")
    dealt = numbered.withColumn("__own", F.floor(F.col("__rn") / chunk).cast("int")).withColumn("__chunk", F.explode(F.sequence(low, high)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("__rn").schema.fields)

    def roll(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["__rn"]))
        x = table[value].to_pandas()
        padded = pd.concat([x, pd.Series([float("nan")] * after)], ignore_index=True)
        rolled = padded.rolling(before + after + 1, min_periods=min_periods)
        for name, found in (("roll_median", rolled.median()), ("roll_std", rolled.std())):
            table = table.append_column(name, pa.array(found.to_numpy()[after:], from_pandas=True))
        own = table.filter(pc.equal(table["__own"], table["__chunk"])).drop_columns(["__rn", "__own", "__chunk"])
        for i, f in enumerate(own.schema):
            if pa.types.is_floating(f.type):  # NaN is no value
                own = own.set_column(i, f.name, pc.if_else(pc.is_nan(own[f.name]), pa.scalar(None, f.type), own[f.name]))
        return own

    return dealt.groupBy(*session, "__chunk").applyInArrow(roll, fields + ", roll_median double, roll_std double")


def drop_price_outliers(df: DataFrame, window: int = 1000, min_periods: int = 10, n_std: float = 5.0, guard: int = 100, session: Sequence[str] = SESSION, chunk: int = CHUNK) -> DataFrame:
    """Drop prices further than n_std rolling deviations from the centred rolling median, in sessions of more than `guard` rows."""
    flagged = _outliers(df, window, min_periods, n_std, guard, session, chunk)
    return flagged.filter(~F.col("outlier")).drop("outlier")


def _outliers(df: DataFrame, window: int, min_periods: int, n_std: float, guard: int, session: Sequence[str], chunk: int) -> DataFrame:
    rolled = rolling_median_std(df, "price", window // 2, (window - 1) // 2, min_periods, session, chunk)
    fine = _true(F.abs(F.col("price") - F.col("roll_median")) <= n_std * F.col("roll_std"))
    return rolled.withColumn("outlier", (F.col("session_rows") > guard) & ~fine).drop("roll_median", "roll_std", "session_rows")


def book_range(books: DataFrame, session: Sequence[str] = SESSION) -> DataFrame:
    return books.groupBy(*session).agg(F.min("timestamp").alias("__from"), F.max("timestamp").alias("__to"))


def clip_to_books(trades: DataFrame, books: DataFrame, session: Sequence[str] = SESSION) -> DataFrame:
    """Keep trades between the first and the last book of their session; sessions without books keep none."""
    inside = trades.join(book_range(books, session), list(session))
    return inside.filter(F.col("timestamp").between(F.col("__from"), F.col("__to"))).select(*trades.columns)


def trade_failures(trades: DataFrame, books: DataFrame, session: Sequence[str] = SESSION, window: int = 1000, min_periods: int = 10, n_std: float = 5.0, guard: int = 100, chunk: int = CHUNK) -> DataFrame:
    """Adds failed_step: the number of the first trade step that a row fails, from 1, or NULL. `books` are clean."""
    w = Window.partitionBy(*session, "trade_id").orderBy("timestamp", "seq")
    early = (
        F.when(F.row_number().over(w) > 1, 1)
        .when(F.col("timestamp").isNull() | F.col("price").isNull() | F.col("quantity").isNull(), 2)
        .when(~((F.col("price") > 0) & (F.col("quantity") > 0)), 3)
    )
    marked = trades.withColumn("failed_step", early)
    failed, rest = marked.filter("failed_step is not null"), marked.filter("failed_step is null")
    flagged = _outliers(rest.drop("failed_step"), window, min_periods, n_std, guard, session, chunk)
    ranged = flagged.join(settled(book_range(books, session)), list(session), "left")
    inside = _true(F.col("timestamp").between(F.col("__from"), F.col("__to")))
    late = F.when(F.col("outlier"), 4).when(~inside, 5)
    return failed.unionByName(ranged.withColumn("failed_step", late).select(*marked.columns))


def survivors(flagged: DataFrame) -> DataFrame:
    return flagged.filter("failed_step is null").drop("failed_step")


def clean_books(df: DataFrame, levels: int = 5, session: Sequence[str] = SESSION) -> DataFrame:
    return survivors(book_failures(df, levels, session=session))


def clean_trades(df: DataFrame, books: DataFrame, session: Sequence[str] = SESSION) -> DataFrame:
    return survivors(trade_failures(df, books, session))


def cleaning_report(flagged: DataFrame, steps: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """step_no, step, rows_before, rows_after, rows_removed and pct_removed for each key, and the total removed so far."""
    counts = flagged.groupBy(*keys, "failed_step").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("rows"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("failed_step", F.lit(0)).alias("k"), "n"))).alias("by_step"))
    listed = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step")) for i, s in enumerate(steps, 1)])
    out = whole.select(*keys, "rows", "by_step", F.inline(listed)).withColumn("rows_removed", F.coalesce(F.try_element_at("by_step", F.col("step_no")), F.lit(0)).cast("long"))
    w = Window.partitionBy(*keys).orderBy("step_no")
    out = out.withColumn("total_removed", F.sum("rows_removed").over(w))
    after = F.col("rows") - F.col("total_removed")
    before = after + F.col("rows_removed")
    return out.select(
        *keys, "step_no", "step", before.alias("rows_before"), after.alias("rows_after"), "rows_removed",
        F.round(100.0 * F.col("rows_removed") / F.greatest(before, F.lit(1)), 4).alias("pct_removed"), "total_removed",
    )


def clean(books: DataFrame, trades: DataFrame, levels: int = 5, session: Sequence[str] = SESSION) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Clean books, clean trades and the two reports."""
    flagged_books = book_failures(books, levels, session=session)
    good = survivors(flagged_books)
    flagged_trades = trade_failures(trades, good, session)
    return good, survivors(flagged_trades), cleaning_report(flagged_books, BOOK_STEPS), cleaning_report(flagged_trades, TRADE_STEPS)

