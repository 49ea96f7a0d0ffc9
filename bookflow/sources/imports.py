"""CSV imports of vendor and exchange archives into books and trades.

A gzip file is one task; downstream shuffles by session deal the rows out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.operators.grid import downsample_books
from bookflow.operators.ranks import joined

NAME = r"_(\d{4}-\d{2}-\d{2})_([^_/.]+)\.csv(?:\.gz)?$"


def _from_name(df: DataFrame) -> DataFrame:
    """Adds symbol and date from names like ..._2024-01-31_BTCUSDT.csv.gz, and the arrival number."""
    name = F.col("_metadata.file_name")
    return df.select("*", F.regexp_extract(name, NAME, 2).alias("symbol"), F.to_date(F.nullif(F.regexp_extract(name, NAME, 1), F.lit(""))).alias("date"), F.monotonically_increasing_id().alias("seq"))


def _number(c: Column) -> Column:
    """A double, NULL for NaN and for text that is no number."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def import_book_csv(spark: SparkSession, path: str, levels: int = 10, sample_interval: str | None = "1s") -> DataFrame:
    """Vendor depth CSV with asks[i].price and so on, from 0: books with levels from 1, downsampled on request."""
    raw = _from_name(spark.read.csv(path, header=True))
    cols = [F.timestamp_micros(F.col("timestamp").cast("long")).alias("timestamp")]
    for i in range(levels):
        for side in ("bid", "ask"):
            for theirs, ours in (("price", "price"), ("amount", "size")):
                if f"{side}s[{i}].{theirs}" in raw.columns:
                    cols.append(_number(F.col(f"`{side}s[{i}].{theirs}`")).alias(f"{side}_{ours}_{i + 1}"))
    books = raw.select("symbol", "date", "seq", *cols)
    return downsample_books(books, sample_interval) if sample_interval else books


def import_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """Vendor trades CSV (timestamp in microseconds, id, side, price, amount)."""
    raw = _from_name(spark.read.csv(path, header=True))
    price, amount = _number(F.col("price")), _number(F.col("amount"))
    return raw.select(
        "symbol", "date", "seq", F.timestamp_micros(F.col("timestamp").cast("long")).alias("timestamp"), F.col("id").cast("long").alias("trade_id"), price.alias("price"),
        amount.alias("quantity"), (F.col("side") == "sell").alias("is_buyer_maker"), (price * amount).alias("quote_quantity"),
    )


# Columns of the archives' trade files.
HEADED = {"trade_id": "id", "price": "price", "quantity": "qty", "timestamp_ms": "time", "is_buyer_maker": "is_buyer_maker"}
HEADLESS = ("trade_id", "price", "quantity", "quote_quantity", "timestamp_ms", "is_buyer_maker", "is_best_match")


def import_archive_trades(spark: SparkSession, path: str, market: str) -> DataFrame:
    """Exchange archive trades: market "futures" has a header, "spot" seven columns without one."""
    if market == "futures":
        raw = _from_name(spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True))
        named = {ours: F.col(theirs) for ours, theirs in HEADED.items()}
    elif market == "spot":
        raw = _from_name(spark.read.schema(", ".join(f"{c} string" for c in HEADLESS)).csv(path))
        named = {c: F.col(c) for c in HEADED}
    else:
        raise ValueError(f"market is futures or spot, not {market!r}")
    return raw.select(
        "symbol", "date", "seq", F.timestamp_millis(named["timestamp_ms"].cast("long")).alias("timestamp"), named["trade_id"].cast("long").alias("trade_id"),
        _number(named["price"]).alias("price"), _number(named["quantity"]).alias("quantity"), (F.lower(F.trim(named["is_buyer_maker"])) == "true").alias("is_buyer_maker"),
    )


#: Columns before the levels, by what is left of a row's number of columns after whole levels of four: a time; a time and an update id; a symbol, a time and two update ids.
LEADING = {1: 1, 2: 2, 0: 4}


def _depth_layouts(lines: DataFrame) -> DataFrame:
    """For each file its usual number of columns, the columns before the levels, and which of the first two columns is a time in milliseconds."""
    count = F.size("v")
    is_time = lambda i: F.count(F.get("v", F.lit(i)).try_cast("long"))
    facts = lines.groupBy("file").agg(F.mode(count).alias("width"), (is_time(1) > is_time(0)).cast("int").alias("time_at"))
    leading = F.coalesce(F.create_map(*[F.lit(x) for pair in LEADING.items() for x in pair])[F.col("width") % 4], F.lit(1))
    # a first column that is no time is a symbol, with four columns before the levels; a row that starts with its time has no four
    first_level = F.when(F.col("time_at") == 1, 4).when(leading == 4, 1).otherwise(leading)
    return facts.select("file", "time_at", first_level.alias("lead"), F.floor((F.col("width") - first_level) / 4).alias("file_levels"))


def import_archive_depth(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """Exchange archive depth, CSV without a header: bids by level, then asks; what is no number becomes NULL.

    The layout is told for each file from its own rows, in the same job, so files of
    a folder may differ: in the columns before the levels, and in their number of
    levels. Levels that a file doesn't have are NULL, further ones are left out.
    """
    text = _from_name(spark.read.text(path).select("*", "_metadata", F.col("_metadata.file_path").alias("file")))
    lines = text.filter(F.trim("value") != "").withColumn("v", F.split("value", ","))
    rows = joined(lines, _depth_layouts(lines), ["file"])
    cell = lambda at: F.get("v", at.cast("int"))
    at = lambda side, i, k: F.col("lead") + 2 * (F.lit(i - 1) + (F.col("file_levels") if side == "ask" else 0)) + k
    value = lambda side, i, k: F.when(F.col("file_levels") >= i, _number(F.trim(cell(at(side, i, k)))))
    cells = [value(side, i, k).alias(f"{side}_{name}_{i}") for i in range(1, levels + 1) for side in ("bid", "ask") for k, name in enumerate(("price", "size"))]
    return rows.select("symbol", "date", "seq", F.timestamp_millis(F.trim(cell(F.col("time_at"))).try_cast("long")).alias("timestamp"), *cells)


def import_directory(spark: SparkSession, path: str, symbols: Sequence[str], levels: int = 10, sample_interval: str | None = "1s") -> tuple[DataFrame, DataFrame]:
    """Books and trades of all vendor files in a folder whose name gives one of the symbols."""
    chosen = F.col("symbol").isin(list(symbols))
    books = import_book_csv(spark, f"{path}/*book_snapshot*.csv*", levels, sample_interval).filter(chosen)
    return books, import_trades_csv(spark, f"{path}/*_trades_*.csv*").filter(chosen)


def import_summary(books: DataFrame, trades: DataFrame) -> DataFrame:
    """Rows of books and trades for each symbol and date."""
    by = ["symbol", "date"]
    b = books.groupBy(*by).agg(F.count(F.lit(1)).alias("book_rows"))
    t = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("trade_rows"))
    return b.join(t, by, "full").select(*by, F.coalesce("book_rows", F.lit(0)).alias("book_rows"), F.coalesce("trade_rows", F.lit(0)).alias("trade_rows"))
