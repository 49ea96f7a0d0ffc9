"""Registered queries: the operators over the fixture tables, each with equal SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.config import SCENARIOS
from bookflow.jobs import oracles as O  # noqa: N812
from bookflow.jobs.fixtures import BY_SYMBOL, CONFIG, LEVELS, raw_books, raw_trades
from bookflow.operators import activity, backtest, book, clean, features, grid, models, ranks, signal, splits, stats
from bookflow.sources.tables import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
H = "50min"
Y = f"y_return_{H}"
FREQ = CONFIG.frequency


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def shown(df: DataFrame, digits: int = 9) -> DataFrame:
    """Times as microseconds, doubles rounded and without negative zero, so that results compare across engines."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            cols.append(F.unix_micros(c).alias("us" if f.name == "timestamp" else f.name))
        elif isinstance(f.dataType, T.DoubleType):
            cols.append((F.round(c, digits) + F.lit(0.0)).alias(f.name))
        elif f.name == "date":
            continue
        else:
            cols.append(c)
    return df.select(*cols)


def rounded(select: str, cols: Sequence[str], digits: int = 9) -> str:
    return select.format(", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols))


def _r(expr: str, name: str, digits: int = 9) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


# ---- stages over the fixtures ----

#: Folders of the stages that this session has written, by session, folder of the tables and stage.
_WRITTEN: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def kept(stage: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A stage that many queries start from, written once for each session and folder of tables, as a job's stages are.

    Queries then plan and read a table, and a lost executor doesn't repeat the stages before.
    """

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, stage.__name__)
        if key not in _WRITTEN:
            df, path = stage(spark, sf_dir), f"{shared_folder(spark)}/stage-{stage.__name__.strip('_')}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            _WRITTEN[key] = path, df.schema
        path, schema = _WRITTEN[key]
        return spark.read.schema(schema).parquet(path)

    return get


@kept
def good_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_books(raw_books(spark, sf_dir), LEVELS, BY_SYMBOL)


@kept
def good_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_trades(raw_trades(spark, sf_dir), good_books(spark, sf_dir), BY_SYMBOL)


@kept
def aligned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.resample_and_align(good_books(spark, sf_dir), good_trades(spark, sf_dir), CONFIG)


@kept
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_features(aligned_table(spark, sf_dir), CONFIG)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(spark, sf_dir).withColumn("y_pred", F.col("obi_1"))


# ---- cleaning ----

_STEPS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "drop_duplicate_snapshots": (lambda df: clean.drop_duplicate_snapshots(df, BY_SYMBOL), "SELECT symbol, seq FROM bf1 WHERE NOT dup"),
    "drop_missing_top": (clean.drop_missing_top, f"SELECT symbol, seq FROM fx_books WHERE {O.TOP}"),
    "drop_crossed": (clean.drop_crossed, "SELECT symbol, seq FROM fx_books WHERE bid_price_1 < ask_price_1"),
    "drop_nonpositive_spread": (clean.drop_nonpositive_spread, "SELECT symbol, seq FROM fx_books WHERE ask_price_1 - bid_price_1 > 0"),
    "drop_wide_spreads": (
        lambda df: clean.drop_wide_spreads(df, session=BY_SYMBOL),
        "SELECT symbol, seq FROM (SELECT *, median(ask_price_1 - bid_price_1) OVER (PARTITION BY symbol) AS m FROM fx_books) WHERE m <= 0 OR ask_price_1 - bid_price_1 <= 10 * m",
    ),
    "drop_bad_prices": (lambda df: clean.drop_bad_prices(df, LEVELS), f"SELECT symbol, seq FROM fx_books WHERE {O.OK_PRICES}"),
    "drop_bad_sizes": (lambda df: clean.drop_bad_sizes(df, LEVELS), f"SELECT symbol, seq FROM fx_books WHERE {O.OK_SIZES}"),
    "drop_misordered": (lambda df: clean.drop_misordered(df, LEVELS), f"SELECT symbol, seq FROM fx_books WHERE {O.OK_ORDER}"),
}
for _name, (_step, _sql) in _STEPS.items():
    query(f"WITH {O.CLEAN} {_sql}", _name)(lambda spark, sf_dir, step=_step: step(raw_books(spark, sf_dir)).select("symbol", "seq"))

_TRADE_STEPS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "drop_duplicate_trades": (lambda df: clean.drop_duplicate_trades(df, BY_SYMBOL), "SELECT symbol, seq FROM fx_trades QUALIFY row_number() OVER (PARTITION BY symbol, trade_id ORDER BY ts, seq) = 1"),
    "drop_missing_trades": (clean.drop_missing_trades, "SELECT symbol, seq FROM fx_trades WHERE price IS NOT NULL AND quantity IS NOT NULL AND ts IS NOT NULL"),
    "drop_nonpositive_trades": (clean.drop_nonpositive_trades, "SELECT symbol, seq FROM fx_trades WHERE price > 0 AND quantity > 0"),
    "drop_price_outliers": (
        lambda df: clean.drop_price_outliers(clean.drop_nonpositive_trades(df), session=BY_SYMBOL, chunk=700),
        f", pos AS (SELECT * FROM fx_trades WHERE price > 0 AND quantity > 0), {O.OUTLIERS.format(name='po', source='pos')} SELECT symbol, seq FROM po WHERE NOT outlier",
    ),
}
for _name, (_step, _sql) in _TRADE_STEPS.items():
    query(f"WITH {O.CLEAN} {_sql}", _name)(lambda spark, sf_dir, step=_step: step(raw_trades(spark, sf_dir)).select("symbol", "seq"))


@query(f"WITH {O.CLEAN}, d AS (SELECT symbol, date, min(ts) + INTERVAL 6 HOUR AS a, max(ts) - INTERVAL 6 HOUR AS z FROM books GROUP BY ALL) SELECT t.symbol, t.seq FROM fx_trades t JOIN d USING (symbol, date) WHERE t.ts BETWEEN d.a AND d.z")
def clip_to_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = good_books(spark, sf_dir)
    ends = b.groupBy("symbol", "date").agg((F.min("timestamp") + F.expr("INTERVAL 6 HOURS")).alias("a"), (F.max("timestamp") - F.expr("INTERVAL 6 HOURS")).alias("z"))
    inner = ends.filter("a <= z").select("symbol", "date", F.explode(F.array("a", "z")).alias("timestamp"))
    return clean.clip_to_books(raw_trades(spark, sf_dir), inner).select("symbol", "seq")


@query(f"WITH {O.CLEAN} SELECT symbol, epoch_us(ts) AS us, seq, {', '.join(f'{s}_{k}_{i}' for i in range(1, LEVELS + 1) for s in ('bid', 'ask') for k in ('price', 'size'))} FROM books")
def clean_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(good_books(spark, sf_dir))


@query(f"WITH {O.CLEAN} SELECT symbol, epoch_us(ts) AS us, seq, trade_id, price, quantity, is_buyer_maker FROM trades")
def clean_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(good_trades(spark, sf_dir))


def _report_sql(flags: str, steps: Sequence[str]) -> str:
    listed = ", ".join(f"({i}, '{s}')" for i, s in enumerate(steps, 1))
    return f"""WITH {O.CLEAN}, steps(step_no, step) AS (VALUES {listed}), n AS (SELECT symbol, failed_step, count(*) AS n FROM {flags} GROUP BY ALL), w AS (SELECT symbol, sum(n) AS total FROM n GROUP BY symbol),
    r AS (SELECT w.symbol, step_no, step, total, coalesce(n.n, 0) AS removed FROM w CROSS JOIN steps LEFT JOIN n ON n.symbol = w.symbol AND n.failed_step = step_no),
    c AS (SELECT *, sum(removed) OVER (PARTITION BY symbol ORDER BY step_no) AS cum FROM r)
    SELECT symbol, step_no, step, (total - cum + removed)::BIGINT AS rows_before, (total - cum)::BIGINT AS rows_after, removed::BIGINT AS rows_removed, round(100.0::DOUBLE * removed / greatest(total - cum + removed, 1), 4) AS pct_removed, cum::BIGINT AS total_removed FROM c"""


@query(_report_sql("book_flags", clean.BOOK_STEPS))
def book_cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cleaning_report(clean.book_failures(raw_books(spark, sf_dir), LEVELS, session=BY_SYMBOL), clean.BOOK_STEPS)


@query(_report_sql("trade_flags", clean.TRADE_STEPS))
def trade_cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cleaning_report(clean.trade_failures(raw_trades(spark, sf_dir), good_books(spark, sf_dir), BY_SYMBOL), clean.TRADE_STEPS)


# ---- grid ----


@query(
    f"WITH {O.FX} SELECT symbol, epoch_us(ts) // 3600000000 * 3600000000 AS us, "
    + ", ".join(f"arg_max({c}, (ts, seq)) FILTER ({c} IS NOT NULL) AS {c}" for c in ("bid_price_1", "bid_size_1", "ask_size_2"))
    + " FROM fx_books GROUP BY symbol, date, us HAVING count(bid_price_1) > 0"
)
def downsample_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(grid.downsample_books(raw_books(spark, sf_dir), "1h").select("symbol", "timestamp", "bid_price_1", "bid_size_1", "ask_size_2"))


@query(f"WITH {O.TO_GRID} SELECT symbol, us FROM grid")
def time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(grid.time_grid(good_books(spark, sf_dir), FREQ).select("symbol", "timestamp"))


@query(f"WITH {O.TO_GRID} SELECT symbol, us, seq, bid_price_1, ask_price_1, bid_size_1, ask_size_5 FROM on_grid")
def resample_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(grid.resample_books(good_books(spark, sf_dir), FREQ).select("symbol", "timestamp", "seq", "bid_price_1", "ask_price_1", "bid_size_1", "ask_size_5"))


@query(f"WITH {O.CLEAN}, {O.BARS} SELECT * EXCLUDE (date) FROM bars")
def trade_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(grid.trade_bars(good_trades(spark, sf_dir), FREQ))


@query(f"WITH {O.CLEAN}, {O.BARS.replace(f'epoch_us(ts) // {O.STEP} * {O.STEP}', f'(epoch_us(ts) + {O.STEP - 1}) // {O.STEP} * {O.STEP}')} SELECT * EXCLUDE (date) FROM bars")
def trade_bars_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(grid.trade_bars(good_trades(spark, sf_dir), FREQ, "right"))


@query(rounded(f"WITH {O.TO_ALIGNED} SELECT symbol, us, seq, bid_price_1, ask_price_1, {{}} FROM aligned", O.TRADE_COLUMNS))
def resample_and_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(aligned_table(spark, sf_dir).select("symbol", "timestamp", "seq", "bid_price_1", "ask_price_1", *O.TRADE_COLUMNS))


# ---- features ----


@query(f"WITH {O.CLEAN} SELECT symbol, seq, {', '.join(_r(e, k) for k, e in O.BOOK.items())} FROM books")
def book_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(book.book_features(good_books(spark, sf_dir), CONFIG.imbalance_levels, LEVELS).select("symbol", "seq", *O.BOOK))


@query(f"WITH {O.CLEAN}, h AS (SELECT symbol, seq, hour(ts)::INT AS hour, minute(ts)::INT AS minute, (isodow(ts) - 1)::INT AS day_of_week FROM books) SELECT *, {O.PART_OF_DAY} AS session FROM h")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.time_features(good_books(spark, sf_dir)).select("symbol", "seq", "hour", "minute", "day_of_week", "session")


_GROUPS = {
    "trade_flow_features": [f"{c}_{w}" for c in ("large_trade", "volume_shock") for w in CONFIG.trade_windows],
    "return_features": [*[f"return_lag_{k}" for k in CONFIG.return_lags], *[f"realized_vol_{w}" for w in CONFIG.volatility_windows]],
    "zscore_features": [f"zscore_{c}" for c in ("return_lag_10min", "spread", "total_volume_10min", "obi_1")],
    "targets": [f"{c}_{h}" for c in ("y_return", "y_price_change", "y_direction", "y_half_spread") for h in CONFIG.horizons],
}


def _typed(c: str) -> str:
    whole = c.startswith(("large_trade", "y_direction", "y_half_spread"))
    return f"{c}::INT AS {c}" if whole else _r(c, c)


for _name, _cols in _GROUPS.items():
    query(f"WITH {O.TO_FEATURES} SELECT symbol, us, {', '.join(map(_typed, _cols))} FROM features", _name)(
        lambda spark, sf_dir, cols=_cols: shown(feature_table(spark, sf_dir).select("symbol", "timestamp", *cols))
    )

_ALL = features.feature_groups(CONFIG)["all"]


@query(f"WITH {O.TO_FEATURES} SELECT symbol, us, session, hour, {', '.join(map(_typed, _ALL))} FROM features")
def build_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(feature_table(spark, sf_dir).select("symbol", "timestamp", "session", "hour", *_ALL))


# ---- deciles, summaries, correlations ----


def _decile_sql(source: str, key: str, x: str, y: str, bins: int) -> str:
    points = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""dq AS (SELECT {key} AS k, {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL), de AS (SELECT k, list_distinct(quantile_cont(x::DOUBLE, [{points}])) AS e, count(*) AS n FROM dq GROUP BY k),
    db AS (SELECT k, x, y, greatest(len(list_filter(e, lambda v: v < x)), 1)::INT AS decile, n FROM dq JOIN de USING (k) WHERE len(e) > 1)"""


@query(f"WITH {O.TO_FEATURES}, {_decile_sql('features', 'symbol', 'obi_1', Y, 10)} SELECT k AS symbol, decile, {_r('avg(y)', 'mean')}, {_r('stddev_samp(y)', 'std')}, count(*) AS count FROM db WHERE n >= 50 GROUP BY ALL")
def imbalance_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stats.decile_returns(feature_table(spark, sf_dir), "obi_1", Y))


@query(f"WITH {O.TO_FEATURES}, {_decile_sql('features', 'symbol', 'obi_1', Y, 10)}, m AS (SELECT k, decile, avg(y) AS mean FROM db WHERE n >= 50 GROUP BY ALL) SELECT k AS symbol, {_r('arg_max(mean, decile) - arg_min(mean, decile)', 'top_minus_bottom')} FROM m GROUP BY k")
def top_minus_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stats.top_minus_bottom(stats.decile_returns(feature_table(spark, sf_dir), "obi_1", Y)))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


@query(f"WITH {_decile_sql('lineitem', 'l_returnflag', 'l_quantity', 'l_extendedprice', 7)} SELECT k AS l_returnflag, decile, {_r('avg(y)', 'mean', 4)}, count(*) AS count FROM db GROUP BY ALL")
def tied_quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stats.decile_returns(lineitem(spark, sf_dir), "l_quantity", "l_extendedprice", 7, ["l_returnflag"]).drop("std"), 4)


_RANK = "rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0"


@query(f"SELECT l_orderkey, l_linenumber, ({_RANK})::DOUBLE AS rank FROM lineitem")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.average_rank(lineitem(spark, sf_dir), ["l_returnflag"], "l_discount").select("l_orderkey", "l_linenumber", "rank")


@query(f"SELECT l_orderkey, l_linenumber, ({_RANK})::DOUBLE AS rank FROM lineitem")
def average_rank_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.average_rank_by_counts(lineitem(spark, sf_dir), ["l_returnflag"], "l_discount").select("l_orderkey", "l_linenumber", "rank")


_SUMMARY = [*_ALL, *[f"y_return_{h}" for h in CONFIG.horizons]]


@query(
    f"WITH {O.TO_FEATURES} "
    + " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS feature, count({c}) AS count, {_r(f'avg({c})', 'mean')}, {_r(f'stddev_samp({c})', 'std')}, {_r(f'min({c})', 'min')}, {_r(f'quantile_cont({c}, 0.25)', 'p25')}, {_r(f'quantile_cont({c}, 0.5)', 'p50')}, {_r(f'quantile_cont({c}, 0.75)', 'p75')}, {_r(f'max({c})', 'max')} FROM features GROUP BY symbol"
        for c in _SUMMARY
    )
)
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stats.summary_table(feature_table(spark, sf_dir), _SUMMARY))


# Columns of the correlation overview, with the steps of this grid.
_CORR = [
    "obi_1", "obi_3", "obi_5", "weighted_obi", "microprice_deviation", "spread", "relative_spread", "bid_depth_total", "ask_depth_total", "trade_imbalance_10min", "signed_volume_10min", "total_volume_10min",
    "return_lag_10min", "realized_vol_100min", "y_return_10min", "y_return_50min", "y_return_100min",
]


@query(f"WITH {O.TO_FEATURES} " + " UNION ALL ".join(f"SELECT symbol, '{a}' AS a, '{b}' AS b, {_r(f'corr({a}, {b})', 'corr', 7)} FROM features GROUP BY symbol" for a in _CORR for b in _CORR))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stats.correlation_matrix(feature_table(spark, sf_dir), _CORR), 7)


@query(
    """WITH e AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
    SELECT l_returnflag, 'l_extendedprice' AS feature, lo, hi, least(40, floor((l_extendedprice - lo) / ((hi - lo) / 40)) + 1)::INT AS bin, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL"""
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(lineitem(spark, sf_dir), ["l_extendedprice"], 40, ["l_returnflag"])


@query(
    """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
    SELECT l_returnflag, 'l_extendedprice' AS metric, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(l_extendedprice) AS whisker_low, max(l_extendedprice) AS whisker_high
    FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL"""
)
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stats.box_stats(lineitem(spark, sf_dir), ["l_extendedprice"], ["l_returnflag"]), 6)


# ---- metrics ----


def _ranked(source: str, by: str, x: str, y: str) -> str:
    rank = lambda c, n: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0 AS {n}"
    return f"(SELECT *, {rank(x, 'rx')}, {rank(y, 'ry')} FROM (SELECT * FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"


@query(
    f"WITH {O.TO_FEATURES} SELECT symbol, {_r(f'corr({Y}, obi_1)', 'pearson_ic', 7)}, {_r('corr(rx, ry)', 'spearman_ic', 7)}, {_r(f'avg(({Y} - obi_1) ** 2)', 'mse', 7)}, {_r(f'avg(abs({Y} - obi_1))', 'mae', 7)}, count(*) AS n FROM {_ranked('features', 'symbol', 'obi_1', Y)} GROUP BY symbol HAVING count(*) >= 10"
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stats.regression_metrics(predictions(spark, sf_dir), ["symbol"], Y), 7)


@query(
    """WITH x AS (SELECT l_returnflag AS k, (l_linestatus = 'O')::INT AS y, l_discount * 8 AS p FROM lineitem), c AS (SELECT *, CASE WHEN max(p) OVER (PARTITION BY k) <= 1 THEN 0.5 ELSE 0 END AS cut,
      rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0 AS r FROM x),
    a AS (SELECT k, count(*) AS n, count(*) FILTER (p > cut AND y = 1)::DOUBLE AS tp, count(*) FILTER (p > cut AND y = 0)::DOUBLE AS fp, count(*) FILTER (p <= cut AND y = 1)::DOUBLE AS fn, count(*) FILTER (p <= cut AND y = 0)::DOUBLE AS tn,
      sum(r) FILTER (y = 1) AS ranks FROM c GROUP BY k)
    SELECT k AS l_returnflag, round((tp + tn) / n, 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, n, round(CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN (ranks - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn)) END, 9) AS auc FROM a WHERE n >= 10"""
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).select("l_returnflag", (F.col("l_linestatus") == "O").cast("int").alias("y_true"), (F.col("l_discount") * 8).alias("y_pred"))
    return shown(stats.classification_metrics(rows, ["l_returnflag"]))


@query(
    f"WITH {O.TO_FEATURES}, {_decile_sql('features', 'symbol', 'obi_1', Y, 10)}, m AS (SELECT k, decile, avg(y) AS a, count(*) AS n FROM db GROUP BY ALL) SELECT k AS symbol, {_r('CASE WHEN sum(n) >= 30 AND count(*) >= 2 THEN arg_max(a, decile) - arg_min(a, decile) END', 'decile_spread')} FROM m GROUP BY k"
)
def decile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stats.decile_spread(predictions(spark, sf_dir), ["symbol"], Y))


@query(
    f"""WITH {O.TO_FEATURES}, d AS (SELECT symbol, date, corr({Y}, obi_1) AS ic FROM features WHERE {Y} IS NOT NULL GROUP BY ALL)
    SELECT symbol, {_r("avg(ic) / (stddev_samp(ic) / sqrt(count(ic)))", "ic_tstat", 6)}, {_r("avg(ic) / stddev_samp(ic)", "ic_ir", 6)} FROM d GROUP BY symbol"""
)
def ic_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bookflow.functions.numeric import correlation

    daily = feature_table(spark, sf_dir).groupBy("symbol", "date").agg(correlation(F.col(Y), F.col("obi_1")).alias("ic"))
    return shown(daily.groupBy("symbol").agg(stats.ic_tstat(F.col("ic")).alias("ic_tstat"), stats.ic_ir(F.col("ic")).alias("ic_ir")), 6)


@query(f"WITH {O.TO_FEATURES} SELECT symbol, {_r(f'avg({Y}) / stddev_pop({Y}) * sqrt(252 * 86400)', 'sharpe', 5)}, {_r(f'avg(({Y} > 0)::INT)', 'hit_rate')} FROM features GROUP BY symbol")
def return_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feature_table(spark, sf_dir).groupBy("symbol").agg(F.round(stats.sharpe(F.col(Y)), 5).alias("sharpe"), F.round(stats.hit_rate(F.col(Y)), 9).alias("hit_rate"))
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("sharpe", "hit_rate")})


# ---- signal tables ----

_FEATS = features.feature_groups(CONFIG)["all"]
_IC = " UNION ALL ".join(
    f"SELECT symbol, '{f}' AS feature, '{h}' AS horizon, CASE WHEN stddev_pop({f}) > 0 AND stddev_pop(y_return_{h}) > 0 THEN corr({f}, y_return_{h}) END AS pearson_ic, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS spearman_ic, count(*) AS n FROM {_ranked(f'(SELECT symbol, round({f}, 9) AS {f}, y_return_{h} FROM features)', 'symbol', f, f'y_return_{h}')} GROUP BY symbol HAVING count(*) >= 30"
    for f in _FEATS
    for h in CONFIG.horizons
)


def _ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_table(spark, sf_dir)
    return signal.ic_table(rows.withColumns({f: F.round(f, 9) for f in _FEATS}), _FEATS, CONFIG.horizons)  # equal values shall be ties in any engine


@query(f"WITH {O.TO_FEATURES}, ic AS ({_IC}) SELECT symbol, feature, horizon, {_r('pearson_ic', 'pearson_ic', 7)}, {_r('spearman_ic', 'spearman_ic', 7)}, n FROM ic")
def ic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_ic(spark, sf_dir).drop("pearson_pval", "spearman_pval"), 7)


@query(f"WITH {O.TO_FEATURES}, ic AS ({_IC}) SELECT symbol, feature, CAST(replace(horizon, 'min', '') AS DOUBLE) * 60 AS seconds, {_r('pearson_ic', 'pearson_ic', 7)}, {_r('spearman_ic', 'spearman_ic', 7)} FROM ic")
def signal_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(signal.signal_decay(_ic(spark, sf_dir)), 7)


@query(
    f"WITH {O.TO_FEATURES}, ic AS ({_IC}), t AS (SELECT symbol, feature, spearman_ic, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(spearman_ic), 12) DESC NULLS LAST, feature) AS place FROM ic WHERE horizon = '{H}') SELECT symbol, feature, place::INT AS place, {_r('spearman_ic', 'spearman_ic', 7)} FROM t WHERE place <= 3"
)
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(signal.top_features(_ic(spark, sf_dir), H, 3).select("symbol", "feature", "place", "spearman_ic"), 7)


_VOL = "realized_vol_300min"
_TERCILE = "CASE WHEN len(list_distinct({e})) = 4 THEN CASE WHEN {c} <= {e}[2] THEN '{a}' WHEN {c} <= {e}[3] THEN '{b}' WHEN {c} IS NOT NULL THEN '{d}' END END"
_REG = f"""re AS (SELECT symbol, {", ".join(f"quantile_cont({c}, [0, CAST(1 AS DOUBLE) / 3, CAST(2 AS DOUBLE) / 3, 1]) AS e{i}, count(DISTINCT {c}) AS d{i}" for i, c in enumerate((_VOL, "spread", "total_depth")))} FROM features GROUP BY symbol),
rg AS (SELECT f.*, {_TERCILE.format(e="e0", c=_VOL, a="low_vol", b="mid_vol", d="high_vol")} AS vol_regime, {_TERCILE.format(e="e1", c="spread", a="tight", b="mid", d="wide")} AS spread_regime,
{_TERCILE.format(e="e2", c="total_depth", a="thin", b="mid", d="deep")} AS liq_regime FROM features f JOIN re USING (symbol))"""


@query(f"WITH {O.TO_FEATURES}, {_REG} SELECT symbol, us, vol_regime, spread_regime, liq_regime FROM rg")
def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(signal.regimes(feature_table(spark, sf_dir), _VOL).select("symbol", "timestamp", "vol_regime", "spread_regime", "liq_regime"))


_REGIME_ROWS = " UNION ALL ".join(f"SELECT symbol, '{c}' AS regime_type, {c}::VARCHAR AS regime, {Y} AS y, obi_1 AS p FROM rg WHERE {c} IS NOT NULL" for c in ("vol_regime", "spread_regime", "liq_regime", "hour"))


@query(
    f"WITH {O.TO_FEATURES}, {_REG}, rr AS ({_REGIME_ROWS}) SELECT symbol, regime_type, regime, count(*) AS n, {_r('corr(y, p)', 'pearson_ic', 7)}, {_r('corr(rx, ry)', 'spearman_ic', 7)}, {_r('avg(y)', 'mean_return')}, {_r('stddev_pop(y)', 'std_return')} FROM {_ranked('rr', 'symbol, regime_type, regime', 'y', 'p')} GROUP BY ALL HAVING count(*) >= 30"
)
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seven(signal.robustness(predictions(spark, sf_dir), Y, volatility=_VOL))


def _seven(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 7 if c.endswith("_ic") else 9) + F.lit(0.0) for c, k in df.dtypes if k == "double"})


@query(
    f"""WITH {O.TO_FEATURES}, n AS (SELECT symbol, us, obi_1 AS x, {Y} AS y, row_number() OVER (PARTITION BY symbol ORDER BY us) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n FROM features WHERE {Y} IS NOT NULL),
    j AS (SELECT n.*, unnest(range(greatest(0, (r - 299 + 59) // 60), r // 60 + 1)) AS j FROM n), k AS (SELECT * FROM j WHERE j * 60 <= r AND r < j * 60 + 300 AND 300 + j * 60 < n)
    SELECT symbol, j::INT AS j, {_r("corr(rx, ry)", "ic", 7)}, max(us) AS until FROM {_ranked("k", "symbol, j", "x", "y")} GROUP BY ALL"""
)
def rolling_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(signal.rolling_ic(feature_table(spark, sf_dir), "obi_1", Y), 7)


# ---- activity ----


@query(
    f"WITH {O.CLEAN} SELECT symbol, count(*) AS n_trades, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, sum(quantity) AS volume, {_r('count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)', 'trades_per_second')}, {_r('avg((NOT is_buyer_maker)::INT)', 'buyer_share')} FROM trades GROUP BY symbol"
)
def trade_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(activity.trade_activity(good_trades(spark, sf_dir)))


@query(
    f"WITH {O.CLEAN}, v AS (SELECT symbol, epoch_us(ts) // 3600000000 * 3600000000 AS us, sum(quantity) AS volume FROM trades GROUP BY ALL), g AS (SELECT symbol, unnest(range(min(us), max(us) + 1, 3600000000)) AS us FROM v GROUP BY symbol) SELECT symbol, us, coalesce(volume, 0.0) AS volume FROM g LEFT JOIN v USING (symbol, us)"
)
def volume_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(activity.volume_by_interval(good_trades(spark, sf_dir), "1h"))


_HOURLY = ["total_volume_10min", "realized_vol_100min", "spread", "total_depth"]


@query(f"WITH {O.TO_FEATURES} SELECT symbol, hour, {', '.join(_r(f'avg({c})', f'mean_{c}') for c in _HOURLY)} FROM features GROUP BY ALL")
def hourly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(activity.hourly_profile(feature_table(spark, sf_dir), _HOURLY))


# ---- splits ----

_RN = "rn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n_rows FROM features)"


@query(
    f"WITH {O.TO_FEATURES}, {_RN} SELECT symbol, us, rn, CASE WHEN rn < floor(n_rows * 0.6::DOUBLE) THEN 'train' WHEN rn < floor(n_rows * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM rn"
)
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(splits.chronological_split(feature_table(spark, sf_dir)).select("symbol", "timestamp", "rn", "split"))


_FOLDS = f"""{_RN}, fn AS (SELECT DISTINCT symbol, n_rows AS n FROM rn), fs AS (SELECT *, CASE WHEN trunc(n * (1.0::DOUBLE - 0.6::DOUBLE - 0.2::DOUBLE) / 5) < 20 THEN greatest(20, n // 7) ELSE trunc(n * (1.0::DOUBLE - 0.6::DOUBLE - 0.2::DOUBLE) / 5) END::BIGINT AS size FROM fn),
fi AS (SELECT *, n - i * size AS stop, n - i * size - size AS start FROM fs, range(5) t(i)), ff AS (SELECT *, start - greatest(10, trunc(start * 0.2::DOUBLE / (0.6::DOUBLE + 0.2::DOUBLE)))::BIGINT AS train_to FROM fi WHERE start > 0),
folds AS (SELECT symbol, train_to, start, stop, (row_number() OVER (PARTITION BY symbol ORDER BY start) - 1)::INT AS fold FROM ff WHERE train_to >= 30)"""


@query(
    f"WITH {O.TO_FEATURES}, {_FOLDS} SELECT symbol, fold, CASE WHEN rn < train_to THEN 'train' WHEN rn < start THEN 'validation' ELSE 'test' END AS role, count(*) AS n, sum(rn)::BIGINT AS sum_rn FROM rn JOIN folds USING (symbol) WHERE rn < stop GROUP BY ALL"
)
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.walk_forward_folds(feature_table(spark, sf_dir))
    return rows.groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("rn").alias("sum_rn"))


_DAY = 86_400_000_000


@query(
    f"""WITH {O.TO_FEATURES}, sp AS (SELECT symbol, min(us) AS t0, max(us) AS t1 FROM features GROUP BY symbol), st AS (SELECT symbol, unnest(range(t0, t1 - {9 * _DAY} + 1, {2 * _DAY})) AS start FROM sp WHERE t0 + {9 * _DAY} <= t1),
    r AS (SELECT symbol, start, us, CASE WHEN us < start + {5 * _DAY} THEN 'train' WHEN us < start + {7 * _DAY} THEN 'validation' ELSE 'test' END AS role FROM features JOIN st USING (symbol) WHERE us >= start AND us < start + {9 * _DAY}),
    g AS (SELECT symbol, start FROM r GROUP BY ALL HAVING count(*) FILTER (role = 'train') > 50 AND count(*) FILTER (role = 'validation') > 10 AND count(*) FILTER (role = 'test') > 10),
    f AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY start) - 1)::INT AS fold FROM g) SELECT symbol, fold, role, count(*) AS n, min(us) AS from_us FROM r JOIN f USING (symbol, start) GROUP BY ALL"""
)
def walk_forward_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.walk_forward_time(feature_table(spark, sf_dir), 5 * 86400, 2 * 86400, 2 * 86400)
    return rows.groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("timestamp")).alias("from_us"))


# ---- models ----


@query("SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1")
def ols_by_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.design(lineitem(spark, sf_dir), "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    out = []
    for (key,), g in models.grams(rows, ["l_quantity"], ["l_returnflag"]).items():
        m = models.solve(g, ["l_quantity"], ["l_quantity"], "linear")
        out.append((key, round(m.intercept, 4), round(m.weights[0], 6), g.n))
    return spark.createDataFrame(out, "l_returnflag string, intercept double, slope double, n double")


_MODEL_SETS = features.feature_groups(CONFIG)


def _complete(cols: Sequence[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


@query()
def model_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = splits.chronological_split(feature_table(spark, sf_dir))
    return shown(models.model_grid(parts.filter("split = 'train'"), parts.filter("split = 'test'"), CONFIG.horizons, _MODEL_SETS), 6)


_TRAIN_ROWS = f"{_RN}, tr AS MATERIALIZED (SELECT * FROM rn WHERE rn < floor(n_rows * 0.6::DOUBLE))"


@query(
    f"WITH {O.TO_FEATURES}, {_TRAIN_ROWS}, c AS ("
    + " UNION ALL ".join(f"SELECT symbol, '{h}' AS horizon, '{s}' AS feature_set, count(*) AS train_size FROM tr WHERE {_complete(cols)} AND y_return_{h} IS NOT NULL GROUP BY symbol" for s, cols in _MODEL_SETS.items() for h in CONFIG.horizons)
    + ") SELECT symbol, horizon, feature_set, model, train_size, train_size AS n, 0.0::DOUBLE AS violation FROM c, (VALUES ('linear'), ('ridge'), ('lasso')) m(model) WHERE train_size >= 30"
)
def model_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model of the grid meets its conditions of optimality on its train rows."""
    parts = splits.chronological_split(feature_table(spark, sf_dir))
    return shown(models.optimality(parts.filter("split = 'train'"), CONFIG.horizons, _MODEL_SETS), 6)


@query()
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(models.walk_forward(feature_table(spark, sf_dir), CONFIG.horizons, _MODEL_SETS), 6)


@query()
def logistic_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each symbol, fitted in the same jobs; metrics of its probabilities."""
    parts = splits.chronological_split(feature_table(spark, sf_dir))
    target, cols = f"y_direction_{H}", _MODEL_SETS["return_vol"]
    scored = models.with_probabilities(parts.filter("split = 'test'"), models.logistic_models(parts.filter("split = 'train'"), target, cols), cols)
    return shown(stats.classification_metrics(scored, ["symbol"], target), 4)


#: One feature and an intercept, by Newton's method in SQL; the feature is standardised.
_NEWTON = f"""{_TRAIN_ROWS}, lx AS (SELECT symbol, obi_1::DOUBLE AS x, y_direction_{H}::DOUBLE AS y FROM tr WHERE obi_1 IS NOT NULL AND y_direction_{H} IS NOT NULL),
lm AS (SELECT symbol, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM lx GROUP BY symbol), lz AS MATERIALIZED (SELECT symbol, (x - m) / s AS z, y FROM lx JOIN lm USING (symbol)),
it AS (SELECT symbol, 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM lm UNION ALL
  SELECT symbol, i + 1, w - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (SELECT symbol, i, w, b, sum((p - y) * z) + w AS g1, sum(p - y) AS g2, sum(p * (1 - p) * z * z) + 1 AS h11, sum(p * (1 - p) * z) AS h12, sum(p * (1 - p)) AS h22
    FROM (SELECT it.symbol, i, w, b, z, y, 1 / (1 + exp(-(w * z + b))) AS p FROM it JOIN lz ON it.symbol = lz.symbol WHERE i < 12) GROUP BY symbol, i, w, b)),
lw AS (SELECT symbol, n, w / s AS weight, b - w / s * m AS intercept, w AS scaled FROM it JOIN lm USING (symbol) WHERE i = 12)"""


@query(f"WITH RECURSIVE {O.TO_FEATURES}, {_NEWTON} SELECT symbol, n, {_r('intercept', 'intercept', 6)}, {_r('weight', 'weight', 6)}, {_r('scaled', 'scaled', 6)}, 0.0::DOUBLE AS gradient FROM lw")
def logistic_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = splits.chronological_split(feature_table(spark, sf_dir)).filter("split = 'train'")
    found = models.logistic_models(train, f"y_direction_{H}", ["obi_1"])
    return shown(found.select("symbol", "n", "intercept", F.col("weights")[0].alias("weight"), F.col("scaled")[0].alias("scaled"), "gradient"), 6)


@query(
    f"WITH RECURSIVE {O.TO_FEATURES}, {_NEWTON} SELECT symbol, us, {_r('1 / (1 + exp(-(intercept + weight * obi_1)))', 'y_pred', 6)} FROM rn JOIN lw USING (symbol) WHERE rn >= floor(n_rows * (0.6::DOUBLE + 0.2::DOUBLE)) AND obi_1 IS NOT NULL"
)
def logistic_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = splits.chronological_split(feature_table(spark, sf_dir))
    found = models.logistic_models(parts.filter("split = 'train'"), f"y_direction_{H}", ["obi_1"])
    return shown(models.with_probabilities(parts.filter("split = 'test'"), found, ["obi_1"]).select("symbol", "timestamp", "y_pred"), 6)


# ---- backtest ----

_POS = f"""{_RN}, q AS (SELECT symbol, quantile_cont(obi_1, 0.1) AS lo, quantile_cont(obi_1, 0.9) AS hi FROM features GROUP BY symbol),
pos AS MATERIALIZED (SELECT rn.*, CASE WHEN obi_1 <= lo THEN -1 WHEN obi_1 >= hi THEN 1 ELSE 0 END AS raw_position FROM rn JOIN q USING (symbol))"""


@query(f"WITH {O.TO_FEATURES}, {_POS} SELECT symbol, us, raw_position::INT AS raw_position FROM pos")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(backtest.positions(predictions(spark, sf_dir)).select("symbol", "timestamp", "raw_position"))


_HELD = f"""{_POS}, sig AS MATERIALIZED (SELECT symbol, rn, raw_position FROM pos WHERE raw_position <> 0),
walk(symbol, rn, side) AS (SELECT symbol, min(rn), arg_min(raw_position, rn) FROM sig GROUP BY symbol
  UNION ALL SELECT w.symbol, n.rn, n.raw_position FROM walk w, LATERAL (SELECT s.rn, s.raw_position FROM sig s WHERE s.symbol = w.symbol AND s.rn >= w.rn + 5 ORDER BY s.rn LIMIT 1) n),
held AS (SELECT symbol, unnest(range(rn, rn + 5)) AS rn, side FROM walk),
pt AS (SELECT pos.*, coalesce(side, 0)::INT AS position FROM pos LEFT JOIN held USING (symbol, rn)),
bt AS MATERIALIZED (SELECT *, (position <> lag(position, 1, 0) OVER (PARTITION BY symbol ORDER BY rn))::INT AS traded, position * {Y} AS gross FROM pt)"""
_RECURSIVE = f"WITH RECURSIVE {O.TO_FEATURES}, {_HELD}"


@kept
def _bt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.backtest(predictions(spark, sf_dir), H, CONFIG.steps(H))


@query(f"{_RECURSIVE} SELECT symbol, us, position, traded FROM bt")
def non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_bt(spark, sf_dir).select("symbol", "timestamp", "position", "traded"))


def _cost(name: str) -> str:
    c = SCENARIOS[name]
    return f"({2 * c.fee_bps / 1e4 + 2 * c.slippage_bps / 1e4!r}::DOUBLE + {float(c.spread_multiplier)!r}::DOUBLE * CASE WHEN mid_price > 0 THEN spread / mid_price ELSE 0 END)"


@query(f"WITH {O.TO_FEATURES} SELECT symbol, us, {', '.join(_r(_cost(k), f'cost_{k}') for k in SCENARIOS)} FROM features")
def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(backtest.trade_costs(feature_table(spark, sf_dir)).select("symbol", "timestamp", *[f"cost_{k}" for k in SCENARIOS]))


_SC = "sc AS (SELECT symbol, us, position, traded, 'gross' AS cost_scenario, gross AS ret FROM bt " + " ".join(f"UNION ALL SELECT symbol, us, position, traded, 'net_{k}', gross - traded * {_cost(k)} FROM bt" for k in SCENARIOS) + ")"
_CURVE = f"""{_SC}, cu AS (SELECT *, sum(coalesce(ret, 0)) OVER (PARTITION BY symbol, cost_scenario ORDER BY us) AS cum FROM sc), pk AS (SELECT *, max(cum) OVER (PARTITION BY symbol, cost_scenario ORDER BY us) AS peak FROM cu),
dd AS (SELECT *, CASE WHEN abs(peak) > 1e-12 THEN (cum - peak) / abs(peak) ELSE 0 END AS drawdown FROM pk)"""


@query(f"{_RECURSIVE}, {_CURVE} SELECT symbol, cost_scenario, us, {_r('cum', 'cum')}, {_r('peak', 'peak')} FROM dd")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = backtest.drawdown(backtest.equity_curve(backtest.by_scenario(_bt(spark, sf_dir), list(SCENARIOS))))
    return shown(curve.select("symbol", "cost_scenario", "timestamp", "cum", "peak"))


_SUM = f"""{_CURVE}, su AS (SELECT symbol, cost_scenario, coalesce(sum(ret), 0) AS total_pnl, coalesce(avg(ret) FILTER (position <> 0), 0) AS mean_return_per_trade,
coalesce(CASE WHEN count(ret) FILTER (position <> 0) > 1 AND stddev_pop(ret) FILTER (position <> 0) > 0 THEN avg(ret) FILTER (position <> 0) / stddev_pop(ret) FILTER (position <> 0) * sqrt(86400) END, 0) AS sharpe,
coalesce(avg((ret > 0)::INT) FILTER (position <> 0), 0) AS hit_rate, sum(traded)::BIGINT AS n_trades, count(*) FILTER (position <> 0) AS n_active FROM dd GROUP BY ALL)"""


@query(f"{_RECURSIVE}, {_SUM} SELECT symbol, cost_scenario, {_r('total_pnl', 'total_pnl')}, {_r('mean_return_per_trade', 'mean_return_per_trade')}, {_r('sharpe', 'sharpe', 6)}, {_r('hit_rate', 'hit_rate')}, n_trades, n_active FROM su")
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backtest.backtest_summary(_bt(spark, sf_dir)).drop("max_drawdown")
    return out.withColumns({c: F.round(c, 6 if c == "sharpe" else 9) + F.lit(0.0) for c, k in out.dtypes if k == "double"})


@query(f"{_RECURSIVE}, {_SUM} SELECT symbol, '{H}' AS horizon, {', '.join(_r(f'''max(sharpe) FILTER (cost_scenario = '{s}')''', s, 6) for s in ('gross', *[f'net_{k}' for k in SCENARIOS]))} FROM su GROUP BY symbol")
def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = backtest.backtest_summary(_bt(spark, sf_dir)).withColumn("horizon", F.lit(H))
    return shown(backtest.cost_sensitivity(summary), 6)


@query(
    f"{_RECURSIVE}, {_SUM} SELECT symbol, '{H}' AS horizon, {_r('''max(sharpe) FILTER (cost_scenario = 'gross')''', 'gross_sharpe', 6)}, {_r('''max(sharpe) FILTER (cost_scenario = 'net_medium')''', 'medium_sharpe', 6)}, {_r('''max(hit_rate) FILTER (cost_scenario = 'gross')''', 'hit_rate', 6)}, max(n_trades) AS n_trades FROM su GROUP BY symbol"
)
def cross_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(backtest.cross_asset(backtest.backtest_summary(_bt(spark, sf_dir)).withColumn("horizon", F.lit(H))), 6)


@query(f"{_RECURSIVE} SELECT symbol, {_r('avg(abs(d))', 'turnover')} FROM (SELECT symbol, position - lag(position) OVER (PARTITION BY symbol ORDER BY rn) AS d FROM bt) GROUP BY symbol")
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stats.turnover(_bt(spark, sf_dir), ["symbol"]))


# ---- live messages, read as a batch ----


@query(
    f"WITH {O.FX} SELECT symbol, epoch_us(ts) // 1000 * 1000 AS us, trade_id, price, quantity, is_buyer_maker FROM fx_trades"
)
def parsed_trade_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bookflow.streaming.capture import parse_stream

    return shown(parse_stream(trade_messages(raw_trades(spark, sf_dir)))[1])


def trade_messages(trades: DataFrame) -> DataFrame:
    """Trades as live JSON messages; a row without a price makes a message without one."""
    data = F.struct(F.unix_millis("timestamp").alias("T"), F.col("price").cast("string").alias("p"), F.col("quantity").cast("string").alias("q"), F.col("is_buyer_maker").alias("m"), F.col("trade_id").alias("t"))
    message = F.to_json(F.struct(F.concat(F.lower("symbol"), F.lit("@trade")).alias("stream"), data.alias("data")))
    return trades.select(message.alias("value"), F.col("timestamp").alias("received"))
