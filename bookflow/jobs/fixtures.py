"""Books and trades made of the `events` table, with planted defects; the same SQL runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.config import Config

LEVELS = 5
#: Events are minutes apart, so a step is ten minutes; step counts equal the defaults.
CONFIG = Config(
    frequency="10min", trade_windows=("10min", "50min", "100min"), volatility_windows=("100min", "300min", "600min"), return_lags=("10min", "50min", "100min", "300min"),
    horizons=("10min", "50min", "100min", "300min"),
)
BY_SYMBOL = ("symbol",)
QUARTER = "CAST(0.25 AS DOUBLE)"

_BASE = f"""SELECT event_id, ts, user_id, event_type, concat('S', user_id % 4) AS symbol, CAST(ts AS DATE) AS date,
  1000 + {QUARTER} * ((event_id * 37) % 160) AS px FROM events"""


def _book_columns() -> str:
    out = []
    for i in range(1, LEVELS + 1):
        bid = f"px - {QUARTER} * {i - 1}"
        ask = f"px + {QUARTER} * (1 + event_id % 3) + {QUARTER} * {i - 1} + CASE WHEN event_id % 83 = 5 THEN 20 ELSE 0 END"
        if i == 1:
            ask = f"CASE WHEN event_id % 97 = 13 THEN px - {QUARTER} ELSE {ask} END"
        if i == 2:
            bid = f"CASE WHEN event_id % 71 = 11 THEN px + {QUARTER} ELSE {bid} END"
        if i == 3:
            bid = f"CASE WHEN event_id % 79 = 3 THEN -1 ELSE {bid} END"
        bid_size = f"1 + (event_id * {2 * i + 1} + user_id) % 50"
        ask_size = f"1 + (event_id * {2 * i + 7} + 3 * user_id) % 50"
        if i == 1:
            bid_size = f"CASE WHEN event_id % 89 = 7 THEN NULL ELSE {bid_size} END"
        if i == 2:
            ask_size = f"CASE WHEN event_id % 73 = 2 THEN -1 ELSE {ask_size} END"
        for name, expr in (("bid_price", bid), ("bid_size", bid_size), ("ask_price", ask), ("ask_size", ask_size)):
            out.append(f"CAST({expr} AS DOUBLE) AS {name}_{i}")
    return ", ".join(out)


_COLS = [f"{s}_{k}_{i}" for i in range(1, LEVELS + 1) for s in ("bid", "ask") for k in ("price", "size")]
_COPY = ", ".join(f"{c} + 1 AS {c}" if "_size_" in c else c for c in _COLS)
BOOKS_CTE = f"""ev AS ({_BASE}), b0 AS (SELECT symbol, date, event_id AS seq, ts, {_book_columns()} FROM ev WHERE event_type IN ('view', 'click', 'error')),
fx_books AS (SELECT symbol, date, seq, ts, {", ".join(_COLS)} FROM b0 UNION ALL SELECT symbol, date, seq + 1000000000 AS seq, ts, {_COPY} FROM b0 WHERE seq % 61 = 9)"""
TRADES_CTE = """t0 AS (SELECT symbol, date, event_id AS seq, ts, event_id AS trade_id, CAST(CASE WHEN event_id % 53 = 6 THEN NULL WHEN event_id % 211 = 17 THEN px * 10 ELSE px END AS DOUBLE) AS price,
  CAST(CASE WHEN event_id % 47 = 8 THEN 0 ELSE 1 + event_id % 20 END AS DOUBLE) AS quantity, event_type = 'signup' AS is_buyer_maker FROM ev WHERE event_type IN ('purchase', 'signup')),
fx_trades AS (SELECT * FROM t0 UNION ALL SELECT symbol, date, seq + 1000000000 AS seq, ts + INTERVAL '1' SECOND AS ts, trade_id, price, quantity + 1 AS quantity, is_buyer_maker FROM t0 WHERE seq % 59 = 4)"""


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = spark.sql(f"WITH {BOOKS_CTE}, {TRADES_CTE} SELECT * FROM {name}".replace("FROM events", "FROM {events}"), events=events)
    return made.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("ts", "timestamp")


def raw_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "fx_books")


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "fx_trades")
