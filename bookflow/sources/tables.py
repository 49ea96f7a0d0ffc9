"""Stored tables: books, trades, aligned and feature tables, reports and the inventory.

Datasets are partitioned by symbol and date, so a choice of symbols and dates
prunes folders; nothing is sorted on reading.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("symbol", "date")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, in a local session without it a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def _chosen(df: DataFrame, symbols: Sequence[str] | None, start: str | None, end: str | None) -> DataFrame:
    if symbols:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    if start:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    return df


def read_books(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Book snapshots under <path>/orderbook for symbols and dates, both ends included."""
    return _chosen(spark.read.parquet(f"{path}/orderbook"), symbols, start, end)


def read_trades(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Trades under <path>/trades, chosen as in read_books."""
    return _chosen(spark.read.parquet(f"{path}/trades"), symbols, start, end)


def read_by_name(spark: SparkSession, pattern: str, kind: str) -> DataFrame:
    """Files laid out as .../<symbol>/<kind>/<date>.parquet; symbol and date come from the path."""
    raw = spark.read.parquet(pattern)
    path = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(path, rf"([^/]+)/{kind}/[^/]+$", 1).alias("symbol"), F.to_date(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})\.parquet$", 1)).alias("date"), "*")


def read_stage(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_stage(df: DataFrame, path: str, name: str) -> None:
    """Write a table by symbol and date; only the partitions in `df` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(f"{path}/{name}")


def write_report(df: DataFrame, path: str) -> None:
    """Write a small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def data_inventory(books: DataFrame, trades: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Dates and number of files of each symbol and data type; asked symbols without data have none."""
    out = None
    for kind, df in (("orderbook", books), ("trades", trades)):
        file = F.col("__file") if "__file" in df.columns else F.input_file_name()
        one = df.select("symbol", "date", file.alias("__file")).groupBy("symbol").agg(F.array_sort(F.collect_set("date")).alias("dates"), F.count_distinct("__file").alias("num_files"))
        if symbols:
            asked = df.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
            one = asked.join(one, "symbol", "left").select("symbol", F.coalesce("dates", F.array().cast("array<date>")).alias("dates"), F.coalesce("num_files", F.lit(0)).alias("num_files"))
        one = one.withColumn("data_type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Daily tables as one, columns matched by name, missing ones NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
