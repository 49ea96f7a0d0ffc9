"""Live capture as Structured Streaming: parse messages, drop repeated trades, append files, make bars.

`raw` has `value`, a JSON message {"stream": ..., "data": {...}}, and
`received`, the time of arrival as the queue or the file gives it, so a replay
gives equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Field names differ in case only (T is the time, t the id), so the data is read as a map.
MESSAGE = "stream string, data map<string, string>"
SIDE = "array<array<string>>"


def parse_messages(raw: DataFrame) -> DataFrame:
    """symbol, channel and data of each message; messages that don't parse are left out."""
    m = F.from_json("value", MESSAGE)
    parsed = raw.select("received", m.alias("m")).filter(F.col("m.stream").isNotNull())
    parts = F.split("m.stream", "@")
    return parsed.select("received", F.upper(parts[0]).alias("symbol"), F.regexp_extract(parts[1], "^[a-z]+", 0).alias("channel"), F.col("m.data").alias("data"))


def parse_stream(raw: DataFrame, levels: int = 10) -> tuple[DataFrame, DataFrame]:
    """Books (time of arrival) and trades (time of the trade) of a stream of messages."""
    messages, data = parse_messages(raw), F.col("data")
    side = {s: F.from_json(F.col("data")[f"{s}s"], SIDE) for s in ("bid", "ask")}
    cells = [
        F.get(F.get(side[s], i - 1), j).try_cast("double").alias(f"{s}_{k}_{i}") for i in range(1, levels + 1) for s in ("bid", "ask") for j, k in ((0, "price"), (1, "size"))
    ]
    books = messages.filter(F.col("channel") == "depth").select("symbol", F.col("received").alias("timestamp"), *cells)
    trades = messages.filter(F.col("channel") == "trade").select(
        "symbol", F.timestamp_millis(data["T"].try_cast("long")).alias("timestamp"), data["t"].try_cast("long").alias("trade_id"), data["p"].try_cast("double").alias("price"),
        data["q"].try_cast("double").alias("quantity"), data["m"].try_cast("boolean").alias("is_buyer_maker"),
    )
    return books, trades


#: For a bounded memory: how many ids stay when they are cut, and the parts that a symbol's ids are dealt to.
KEPT_IDS, ID_PARTS = 50_000, 16
#: Where a stream's state lies: on local disks, with a bounded cache, so that many ids need no heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}
NO_ID = -(1 << 63)


def new_ids(seen: list[int], ids: Sequence[int], most: int, kept: int) -> tuple[list[bool], list[int]]:
    """Which ids are new after `seen`, and what is remembered then: the last `kept` of them once they are more than `most`."""
    known, out, remembered = set(seen), [], list(seen)
    for i in ids:
        out.append(i not in known)
        if out[-1]:
            known.add(i)
            remembered.append(i)
    return out, remembered[-kept:] if len(remembered) > most else remembered


def _only_new(most: int, kept: int):
    def of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        for frame in frames:
            new, seen = new_ids(seen, frame["__id"].tolist(), most, kept)
            yield frame[new]
        state.update((seen,))

    return of


def dedup_trades(trades: DataFrame, most: int | None = None, kept: int = KEPT_IDS, parts: int = ID_PARTS) -> DataFrame:
    """Each trade id of a symbol once, in order of arrival, however late it comes again; rows without an id share one.

    Every id is a state of its own, so none is forgotten and a busy symbol has as
    many tasks as there are; the state grows with the ids of the stream.

    `most` bounds it instead: a symbol's ids are dealt to `parts` states that
    remember their last ids, more than most / parts are cut to kept / parts, and an
    id that comes again after so many others is new again.
    """
    if most is None:
        return trades.dropDuplicates(["symbol", "trade_id"])
    others = [c for c in trades.columns if c not in {"timestamp", "trade_id"}]
    dealt = trades.select(*others, F.unix_micros("timestamp").alias("__us"), F.coalesce("trade_id", F.lit(NO_ID)).alias("__id")).withColumn("__part", F.pmod("__id", F.lit(parts)))
    rule = _only_new(max(1, most // parts), max(1, kept // parts))
    out = dealt.groupBy("symbol", "__part").applyInPandasWithState(rule, dealt.schema, "ids array<long>", "append", GroupStateTimeout.NoTimeout)
    restored = out.withColumn("timestamp", F.timestamp_micros("__us")).withColumn("trade_id", F.when(F.col("__id") != NO_ID, F.col("__id")))
    return restored.select(*trades.columns)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state as STATE says, unless the session names a store; its settings come back after them."""
    old = {k: spark.conf.get(k, None) for k in STATE}
    chosen = spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith(".HDFSBackedStateStoreProvider")
    for k, v in STATE.items() if chosen else ():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items() if chosen else ():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_stream(df: DataFrame, path: str, checkpoint: str, trigger: str | None = "60 seconds") -> StreamingQuery:
    """Append to Parquet by symbol and by each row's own date, a batch's rows of a day in one file; trigger None takes what is there and stops."""
    dated = df.withColumn("date", F.to_date("timestamp")).repartition("symbol", "date")
    writer = dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("symbol", "date").outputMode("append")
    with state_on_disk(df.sparkSession):
        return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def stream_trade_bars(trades: DataFrame, windows: Sequence[str], step: str, watermark: str = "10 minutes") -> dict[str, DataFrame]:
    """Bars of each window length, sliding by `step`: a window that starts at s ends as the batch window of row s + w - step."""
    timed = trades.withWatermark("timestamp", watermark)
    q, maker, out = F.col("quantity"), F.col("is_buyer_maker"), {}
    for w in windows:
        span = F.window("timestamp", w, step) if w != step else F.window("timestamp", w)
        out[w] = (
            timed.groupBy(span, "symbol")
            .agg(
                F.sum(q).alias("total_volume"), F.sum(F.when(~maker, q).otherwise(0.0)).alias("buy_volume"), F.sum(F.when(maker, q).otherwise(0.0)).alias("sell_volume"),
                F.count(q).alias("num_trades"), F.sum(F.col("price") * q).alias("dollar_volume"),
            )
            .select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total_volume", "buy_volume", "sell_volume", "num_trades", "dollar_volume")
        )
    return out
