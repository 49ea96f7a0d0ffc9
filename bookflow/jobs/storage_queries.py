"""Queries over sources and sinks: tables, vendor and archive files and streams are written from the fixtures and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.jobs import oracles as O  # noqa: N812
from bookflow.jobs.fixtures import LEVELS, raw_books, raw_trades
from bookflow.jobs.queries import query, shown, trade_messages
from bookflow.sources import imports, tables
from bookflow.streaming import capture

DEPTH = 2
_COLS = [f"{s}_{k}_{i}" for i in range(1, DEPTH + 1) for s in ("bid", "ask") for k in ("price", "size")]
FROM, TO = "2024-01-05", "2024-01-20"


def folder(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dated(df: DataFrame) -> DataFrame:
    """The day as text, which compares across engines."""
    return df.withColumn("day", F.col("date").cast("string"))


def one_file_a_day(df: DataFrame, path: str, name: str) -> None:
    """Write a stage with one file for each symbol and date."""
    tables.write_stage(df.repartition("symbol", "date"), path, name)


@query(f"WITH {O.FX} SELECT symbol, seq, date::VARCHAR AS day, {', '.join(_COLS)} FROM fx_books WHERE symbol IN ('S0', 'S2') AND date BETWEEN DATE '{FROM}' AND DATE '{TO}'")
def read_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "books")
    one_file_a_day(raw_books(spark, sf_dir), path, "orderbook")
    return dated(tables.read_books(spark, path, ["S0", "S2"], FROM, TO)).select("symbol", "seq", "day", *_COLS)


@query(f"WITH {O.FX} SELECT symbol, seq, date::VARCHAR AS day, trade_id, price, quantity FROM fx_trades WHERE date >= DATE '{FROM}'")
def read_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "trades")
    one_file_a_day(raw_trades(spark, sf_dir), path, "trades")
    return dated(tables.read_trades(spark, path, start=FROM)).select("symbol", "seq", "day", "trade_id", "price", "quantity")


@query(f"WITH {O.FX} SELECT symbol, seq, CASE WHEN symbol = 'S1' THEN quantity + 1 ELSE quantity END AS quantity FROM fx_trades")
def write_stage_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second write replaces the days of one symbol and leaves the others."""
    path, trades = folder(spark, "stage"), raw_trades(spark, sf_dir)
    one_file_a_day(trades, path, "trades")
    one_file_a_day(trades.filter("symbol = 'S1'").withColumn("quantity", F.col("quantity") + 1), path, "trades")
    return tables.read_stage(spark, path, "trades").select("symbol", "seq", "quantity")


_INVENTORY = " UNION ALL ".join(
    f"SELECT s AS symbol, '{kind}' AS data_type, count(DISTINCT date)::INT AS n_dates, min(date)::VARCHAR AS first, max(date)::VARCHAR AS last, count(DISTINCT date) AS num_files FROM (VALUES ('S0'), ('S3'), ('S9')) t(s) LEFT JOIN {table} ON symbol = s GROUP BY s"
    for kind, table in (("orderbook", "fx_books"), ("trades", "fx_trades"))
)


@query(f"WITH {O.FX} {_INVENTORY}")
def data_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "inventory")
    one_file_a_day(raw_books(spark, sf_dir), path, "orderbook")
    one_file_a_day(raw_trades(spark, sf_dir), path, "trades")
    found = tables.data_inventory(tables.read_books(spark, path), tables.read_trades(spark, path), ["S0", "S3", "S9"])
    return found.select("symbol", "data_type", F.size("dates").alias("n_dates"), F.array_min("dates").cast("string").alias("first"), F.array_max("dates").cast("string").alias("last"), "num_files")


@query(f"WITH {O.FX} SELECT symbol, count(*)::VARCHAR AS n, count(price)::VARCHAR AS priced FROM fx_trades GROUP BY symbol")
def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "report")
    tables.write_report(raw_trades(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced")), path)
    return spark.read.csv(path, header=True)


@query(f"WITH {O.FX} SELECT symbol, date::VARCHAR AS day, trade_id, price, NULL::DOUBLE AS quantity FROM fx_trades WHERE date < DATE '{FROM}' UNION ALL SELECT symbol, date::VARCHAR, trade_id, NULL, quantity FROM fx_trades WHERE date >= DATE '{FROM}'")
def union_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = dated(raw_trades(spark, sf_dir))
    early, late = trades.filter(F.col("date") < F.lit(FROM).cast("date")), trades.filter(F.col("date") >= F.lit(FROM).cast("date"))
    return tables.union_tables([early.select("symbol", "day", "trade_id", "price"), late.select("quantity", "trade_id", "day", "symbol")])


# ---- vendor and archive files ----


def named_files(df: DataFrame, path: str, stem: str, header: bool, gzip: bool = False) -> None:
    """CSV files named <stem>_<date>_<symbol>.csv, or .csv.gz, with the other columns; Spark writes them, the driver renames one file for each symbol and day."""
    spark = df.sparkSession
    df.repartition("symbol", "date").sortWithinPartitions("symbol", "date").write.partitionBy("symbol", "date").csv(f"{path}-{stem}", header=header, compression="gzip" if gzip else "none")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target)
    for day in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}-{stem}/symbol=*/date=*/*.csv*")) or []:
        file = day.getPath()
        date, symbol = (p.getName().split("=")[1] for p in (file.getParent(), file.getParent().getParent()))
        fs.rename(file, jvm.org.apache.hadoop.fs.Path(f"{path}/{stem}_{date}_{symbol}.csv{'.gz' if gzip else ''}"))


def vendor_books(books: DataFrame) -> DataFrame:
    cells = [F.col(f"{s}_{ours}_{i + 1}").cast("string").alias(f"{s}s[{i}].{theirs}") for i in range(DEPTH) for s in ("ask", "bid") for theirs, ours in (("price", "price"), ("amount", "size"))]
    return books.select("symbol", "date", F.unix_micros("timestamp").alias("timestamp"), *cells)


def vendor_trades(trades: DataFrame) -> DataFrame:
    side = F.when(F.col("is_buyer_maker"), "sell").otherwise("buy")
    return trades.select("symbol", "date", F.unix_micros("timestamp").alias("timestamp"), F.col("trade_id").alias("id"), side.alias("side"), F.coalesce(F.col("price").cast("string"), F.lit("NaN")).alias("price"), F.col("quantity").alias("amount"))


@query(f"WITH {O.FX} SELECT symbol, date::VARCHAR AS day, epoch_us(ts) AS us, {', '.join(_COLS)} FROM fx_books")
def import_book_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "vendor")
    named_files(vendor_books(raw_books(spark, sf_dir)), path, "exchange_book_snapshot_2", True, gzip=True)
    return shown(dated(imports.import_book_csv(spark, f"{path}/*book_snapshot*.csv*", DEPTH, None)).select("symbol", "day", "timestamp", *_COLS))


@query(f"WITH {O.FX} SELECT symbol, date::VARCHAR AS day, epoch_us(ts) AS us, trade_id, price, quantity, is_buyer_maker, price * quantity AS quote_quantity FROM fx_trades")
def import_trades_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "vendor")
    named_files(vendor_trades(raw_trades(spark, sf_dir)), path, "exchange_trades", True, gzip=True)
    return shown(dated(imports.import_trades_csv(spark, f"{path}/*_trades_*.csv*")).drop("seq"))


@query(
    f"WITH {O.FX}, b AS (SELECT symbol, date, count(DISTINCT epoch_us(ts) // 1000000) AS n FROM fx_books WHERE symbol <> 'S3' GROUP BY ALL), t AS (SELECT symbol, date, count(*) AS n FROM fx_trades WHERE symbol <> 'S3' GROUP BY ALL) SELECT symbol, date::VARCHAR AS day, coalesce(b.n, 0) AS book_rows, coalesce(t.n, 0) AS trade_rows FROM b FULL JOIN t USING (symbol, date)"
)
def import_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "vendor")
    named_files(vendor_books(raw_books(spark, sf_dir)), path, "exchange_book_snapshot_2", True, gzip=True)
    named_files(vendor_trades(raw_trades(spark, sf_dir)), path, "exchange_trades", True, gzip=True)
    books, trades = imports.import_directory(spark, path, ["S0", "S1", "S2"], DEPTH)
    return dated(imports.import_summary(books, trades)).select("symbol", "day", "book_rows", "trade_rows")


_MS = "epoch_us(ts) // 1000 * 1000 AS us"


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {O.FX} SELECT '{m}' AS market, symbol, date::VARCHAR AS day, {_MS}, trade_id, price, quantity, is_buyer_maker FROM fx_trades)" for m in ("futures", "spot")))
def import_archive_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, trades = None, raw_trades(spark, sf_dir)
    ms, quote = F.unix_millis("timestamp"), F.col("price") * F.col("quantity")
    for market in ("futures", "spot"):
        path = folder(spark, market)
        if market == "futures":
            rows = trades.select("symbol", "date", F.col("trade_id").alias("id"), "price", F.col("quantity").alias("qty"), quote.alias("quote_qty"), ms.alias("time"), "is_buyer_maker")
        else:
            rows = trades.select("symbol", "date", "trade_id", "price", "quantity", quote.alias("quote"), ms.alias("ms"), F.initcap(F.col("is_buyer_maker").cast("string")).alias("maker"), F.lit("True").alias("best"))
        named_files(rows, path, "archive", market == "futures")
        one = shown(dated(imports.import_archive_trades(spark, f"{path}/*.csv", market)).drop("seq")).select(F.lit(market).alias("market"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {O.FX} SELECT symbol, date::VARCHAR AS day, {_MS}, {', '.join(_COLS)} FROM fx_books")
def import_archive_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four layouts in one folder: three ways to begin a row, and one with more levels than are asked for."""
    path, ms, seq = folder(spark, "depth"), F.unix_millis("timestamp").alias("ms"), F.col("seq").alias("update")
    leading = {"S0": [F.col("symbol").alias("name"), ms, seq, F.col("seq").alias("last")], "S1": [ms, seq], "S2": [ms], "S3": [ms, seq]}
    for symbol, first in leading.items():
        sides = [F.coalesce(F.col(f"{s}_{k}_{i}").cast("string"), F.lit("none")).alias(f"{s}_{k}_{i}") for s in ("bid", "ask") for i in range(1, (LEVELS if symbol == "S3" else DEPTH) + 1) for k in ("price", "size")]
        named_files(raw_books(spark, sf_dir).filter(F.col("symbol") == symbol).select("symbol", "date", *first, *sides), path, f"depth_{symbol}", False, gzip=symbol == "S1")
    return shown(dated(imports.import_archive_depth(spark, f"{path}/*.csv*", DEPTH)).select("symbol", "day", "timestamp", *_COLS))


# ---- live messages ----


def depth_messages(books: DataFrame) -> DataFrame:
    """Snapshots as live JSON messages."""
    side = lambda s: F.array(*[F.array(*[F.coalesce(F.col(f"{s}_{k}_{i}").cast("string"), F.lit("")) for k in ("price", "size")]) for i in range(1, LEVELS + 1)])
    message = F.to_json(F.struct(F.concat(F.lower("symbol"), F.lit("@depth20@100ms")).alias("stream"), F.struct(F.col("seq").alias("lastUpdateId"), side("bid").alias("bids"), side("ask").alias("asks")).alias("data")))
    return books.select(message.alias("value"), F.col("timestamp").alias("received"))


def message_stream(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """Messages as files that a stream reads."""
    path = folder(spark, "messages")
    messages.write.parquet(path)
    return spark.readStream.schema(T.StructType(messages.schema.fields)).parquet(path)


@query(f"WITH {O.FX} SELECT symbol, epoch_us(ts) AS us, {', '.join(c for i in range(1, LEVELS + 1) for c in (f'bid_price_{i}', f'bid_size_{i}', f'ask_price_{i}', f'ask_size_{i}'))} FROM fx_books")
def parsed_depth_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(capture.parse_stream(depth_messages(raw_books(spark, sf_dir)), LEVELS)[0])


@query(f"WITH {O.FX} SELECT DISTINCT symbol, trade_id, price FROM fx_trades")
def captured_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of messages, repeats dropped, appended to files by symbol and date; the run takes what is there and stops."""
    _, trades = capture.parse_stream(message_stream(spark, trade_messages(raw_trades(spark, sf_dir))))
    path = folder(spark, "captured")
    capture.write_stream(capture.dedup_trades(trades), path, folder(spark, "capture-state"), None).awaitTermination()
    return spark.read.parquet(path).select("symbol", "trade_id", "price")


@query(f"WITH {O.FX} SELECT symbol, epoch_us(ts) AS us, {', '.join(_COLS)} FROM fx_books WHERE bid_size_1 IS NOT NULL")
def captured_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, _ = capture.parse_stream(message_stream(spark, depth_messages(raw_books(spark, sf_dir).filter("bid_size_1 is not null"))), DEPTH)
    path = folder(spark, "captured")
    capture.write_stream(books, path, folder(spark, "capture-state"), None).awaitTermination()
    return shown(spark.read.parquet(path).select("symbol", "timestamp", *_COLS))


_HOUR = 3_600_000_000


@query(
    f"""WITH {O.FX}, s AS (SELECT symbol, unnest([epoch_us(ts) // {_HOUR} * {_HOUR}, epoch_us(ts) // {_HOUR} * {_HOUR} - {_HOUR}]) AS us, price, quantity AS q, is_buyer_maker AS m FROM fx_trades)
    SELECT symbol, us AS start, us + {2 * _HOUR} AS end, sum(q) AS total_volume, sum(CASE WHEN NOT m THEN q ELSE 0 END) AS buy_volume, sum(CASE WHEN m THEN q ELSE 0 END) AS sell_volume, count(q) AS num_trades, sum(price * q) AS dollar_volume FROM s GROUP BY ALL"""
)
def streamed_trade_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, trades = capture.parse_stream(message_stream(spark, trade_messages(raw_trades(spark, sf_dir))))
    bars, path = capture.stream_trade_bars(trades, ["2 hours"], "1 hour")["2 hours"], folder(spark, "bars")
    write = lambda df, batch: df.write.mode("overwrite").parquet(path)
    bars.writeStream.outputMode("complete").option("checkpointLocation", folder(spark, "bars-state")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return shown(spark.read.parquet(path))
