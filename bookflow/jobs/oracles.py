"""DuckDB SQL of the stages that the registered queries share: fixtures, clean tables, grid, features."""

from __future__ import annotations

from bookflow.jobs.fixtures import BOOKS_CTE, CONFIG, LEVELS, TRADES_CTE

STEP = 600_000_000
FX = f"{BOOKS_CTE}, {TRADES_CTE}"
_PRICES = [f"{s}_price_{i}" for i in range(1, LEVELS + 1) for s in ("bid", "ask")]
_SIZES = [f"{s}_size_{i}" for i in range(1, LEVELS + 1) for s in ("bid", "ask")]
OK_PRICES = "(" + " AND ".join(f"{c} > 0" for c in _PRICES) + ")"
OK_SIZES = "(" + " AND ".join(f"{c} >= 0" for c in _SIZES) + ")"
OK_ORDER = "(" + " AND ".join(f"bid_price_{i} >= bid_price_{i + 1} AND ask_price_{i} <= ask_price_{i + 1}" for i in range(1, LEVELS)) + ")"
TOP = "(bid_price_1 IS NOT NULL AND bid_size_1 IS NOT NULL AND ask_price_1 IS NOT NULL AND ask_size_1 IS NOT NULL)"

BOOK_FLAGS = f"""bf1 AS (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) IS NOT DISTINCT FROM ts AS dup, ask_price_1 - bid_price_1 AS sp FROM fx_books),
bf2 AS (SELECT *, CASE WHEN dup THEN 1 WHEN NOT {TOP} THEN 2 WHEN NOT coalesce(bid_price_1 < ask_price_1, FALSE) THEN 3 WHEN NOT coalesce(sp > 0, FALSE) THEN 4 END AS early FROM bf1),
bf3 AS (SELECT *, median(CASE WHEN early IS NULL THEN sp END) OVER (PARTITION BY symbol) AS med FROM bf2),
book_flags AS (SELECT * EXCLUDE (dup, sp, early, med), coalesce(early, CASE WHEN NOT coalesce(med <= 0 OR sp <= 10 * med, FALSE) THEN 5 WHEN NOT coalesce({OK_PRICES}, FALSE) THEN 6
  WHEN NOT coalesce({OK_SIZES}, FALSE) THEN 7 WHEN NOT coalesce({OK_ORDER}, FALSE) THEN 8 END) AS failed_step FROM bf3),
books AS MATERIALIZED (SELECT * EXCLUDE (failed_step) FROM book_flags WHERE failed_step IS NULL)"""
OUTLIERS = """{name}_r AS (SELECT *, median(price) OVER f AS med, stddev_samp(price) OVER f AS sd, count(*) OVER (PARTITION BY symbol) AS n FROM {source}
  WINDOW f AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 500 PRECEDING AND 499 FOLLOWING)),
{name} AS (SELECT * EXCLUDE (med, sd, n), n > 100 AND NOT coalesce(abs(price - med) <= 5 * sd, FALSE) AS outlier FROM {name}_r)"""
TRADE_FLAGS = f"""tf1 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol, trade_id ORDER BY ts, seq) > 1 THEN 1 WHEN ts IS NULL OR price IS NULL OR quantity IS NULL THEN 2
  WHEN NOT (price > 0 AND quantity > 0) THEN 3 END AS early FROM fx_trades),
tf2 AS (SELECT * FROM tf1 WHERE early IS NULL), {OUTLIERS.format(name="tf3", source="tf2")},
span AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM books GROUP BY symbol),
trade_flags AS (SELECT * EXCLUDE (early), early AS failed_step FROM tf1 WHERE early IS NOT NULL
  UNION ALL SELECT tf3.* EXCLUDE (early, outlier), CASE WHEN outlier THEN 4 WHEN NOT coalesce(ts BETWEEN a AND z, FALSE) THEN 5 END AS failed_step FROM tf3 LEFT JOIN span USING (symbol)),
trades AS MATERIALIZED (SELECT * EXCLUDE (failed_step) FROM trade_flags WHERE failed_step IS NULL)"""
CLEAN = f"{FX}, {BOOK_FLAGS}, {TRADE_FLAGS}"

_VALUES = ["seq", *[c for i in range(1, LEVELS + 1) for c in (f"bid_price_{i}", f"bid_size_{i}", f"ask_price_{i}", f"ask_size_{i}")]]
GRID = f"""ends AS (SELECT symbol, date, -(-epoch_us(min(ts)) // {STEP}) * {STEP} AS a, epoch_us(max(ts)) // {STEP} * {STEP} AS z FROM books GROUP BY ALL),
grid AS (SELECT symbol, date, unnest(range(a, z + 1, {STEP})) AS us FROM ends WHERE a <= z),
bk AS (SELECT *, epoch_us(ts) AS at FROM books QUALIFY row_number() OVER (PARTITION BY symbol, date, ts ORDER BY seq DESC) = 1),
on_grid AS MATERIALIZED (SELECT g.symbol, g.date, g.us, {", ".join(f"b.{c}" for c in _VALUES)} FROM grid g ASOF JOIN bk b ON g.symbol = b.symbol AND g.date = b.date AND g.us >= b.at WHERE b.bid_price_1 IS NOT NULL)"""
# -(-x // s) above is a ceiling: integer division floors towards zero for the positive times used here
GRID = GRID.replace(f"-(-epoch_us(min(ts)) // {STEP}) * {STEP}", f"(epoch_us(min(ts)) + {STEP - 1}) // {STEP} * {STEP}")
BARS = f"""bars AS (SELECT symbol, date, epoch_us(ts) // {STEP} * {STEP} AS us, sum(quantity) AS total_volume, sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END) AS buy_volume,
  sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END) AS sell_volume, count(quantity) AS num_trades, sum(price * quantity) AS dollar_volume FROM trades GROUP BY ALL)"""


def _aligned() -> str:
    joined = f"""{BARS}, al0 AS (SELECT g.*, coalesce(total_volume, 0) AS tv, coalesce(buy_volume, 0) AS bv, coalesce(sell_volume, 0) AS sv, coalesce(num_trades, 0) AS nt, coalesce(dollar_volume, 0) AS dv,
      max(coalesce(num_trades, 0)) OVER (PARTITION BY g.symbol, g.date) > 0 AS has_any FROM on_grid g LEFT JOIN bars USING (symbol, date, us)),"""
    sums, cols, frames = [], [], []
    for w, n in zip(CONFIG.trade_windows, (1, 5, 10), strict=True):
        frames.append(f"f{n} AS (PARTITION BY symbol, date ORDER BY us ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
        sums += [f"sum({c})::DOUBLE OVER f{n} AS {c}{n}".replace(f"sum({c})::DOUBLE OVER f{n}", f"CAST(sum({c}) OVER f{n} AS DOUBLE)") for c in ("tv", "bv", "sv", "nt", "dv")]
        cols += [f"tv{n} AS total_volume_{w}", f"bv{n} AS buy_volume_{w}", f"sv{n} AS sell_volume_{w}", f"bv{n} - sv{n} AS signed_volume_{w}", f"nt{n} AS num_trades_{w}",
                 f"CASE WHEN tv{n} > 0 THEN (bv{n} - sv{n}) / tv{n} ELSE 0 END AS trade_imbalance_{w}", f"CASE WHEN nt{n} > 0 THEN tv{n} / nt{n} ELSE 0 END AS avg_trade_size_{w}",
                 f"CASE WHEN tv{n} > 0 THEN dv{n} / tv{n} WHEN NOT has_any THEN 0 END AS vwap_{w}"]
    keep = "symbol, date, us, " + ", ".join(_VALUES)
    return f"{joined} al1 AS (SELECT {keep}, has_any, {', '.join(sums)} FROM al0 WINDOW {', '.join(frames)}), aligned AS MATERIALIZED (SELECT {keep}, {', '.join(cols)} FROM al1)"


ALIGNED = _aligned()
TRADE_COLUMNS = [f"{c}_{w}" for w in CONFIG.trade_windows for c in ("total_volume", "buy_volume", "sell_volume", "signed_volume", "num_trades", "trade_imbalance", "avg_trade_size", "vwap")]


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN ({num}) / ({den}) ELSE 0 END"


def book_expressions() -> dict[str, str]:
    side = lambda s, n: "(" + " + ".join(f"coalesce({s}_size_{i}, 0)" for i in range(1, n + 1)) + ")"
    weighted = lambda s: "(" + " + ".join(f"{s}_size_{i} * CAST({1 / i!r} AS DOUBLE)" for i in range(1, LEVELS + 1)) + ")"
    mid = "((bid_price_1 + ask_price_1) / 2)"
    micro = f"(CASE WHEN bid_size_1 + ask_size_1 > 0 THEN (ask_price_1 * bid_size_1 + bid_price_1 * ask_size_1) / (bid_size_1 + ask_size_1) ELSE {mid} END)"
    out = {"mid_price": mid, "spread": "(ask_price_1 - bid_price_1)", "relative_spread": _ratio("ask_price_1 - bid_price_1", mid)}
    out |= {f"obi_{n}": _ratio(f"{side('bid', n)} - {side('ask', n)}", f"({side('bid', n)} + {side('ask', n)})") for n in CONFIG.imbalance_levels}
    out |= {"weighted_obi": _ratio(f"{weighted('bid')} - {weighted('ask')}", f"({weighted('bid')} + {weighted('ask')})"), "microprice": micro, "microprice_deviation": f"({micro} - {mid}) / {mid}"}
    out |= {"bid_depth_total": side("bid", LEVELS), "ask_depth_total": side("ask", LEVELS), "total_depth": f"({side('bid', LEVELS)} + {side('ask', LEVELS)})", "top_bid_depth": "bid_size_1", "top_ask_depth": "ask_size_1"}
    out |= {f"{s}_depth_slope": f"({s}_size_1 - {s}_size_{LEVELS}) / {LEVELS - 1}" for s in ("bid", "ask")}
    out |= {f"depth_imbalance_{i}": _ratio(f"bid_size_{i} - ask_size_{i}", f"(bid_size_{i} + ask_size_{i})") for i in range(1, LEVELS + 1)}
    return out


BOOK = book_expressions()
LOOK = "ROWS BETWEEN 299 PRECEDING AND CURRENT ROW"
_ORDER = "PARTITION BY symbol, date ORDER BY us"
_STEPS = dict(zip(CONFIG.return_lags, (1, 5, 10, 30), strict=True))
_VOL = dict(zip(CONFIG.volatility_windows, (10, 30, 60), strict=True))
_Z = ("return_lag_10min", "spread", "total_volume_10min", "obi_1")
PART_OF_DAY = "CASE WHEN hour <= 4 THEN 'asia_late' WHEN hour <= 8 THEN 'asia_early' WHEN hour <= 12 THEN 'europe_am' WHEN hour <= 16 THEN 'us_am' WHEN hour <= 20 THEN 'us_pm' ELSE 'asia_evening' END"


def _features() -> str:
    f1 = f"f1 AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in BOOK.items())} FROM aligned)"
    large = [f"coalesce(CAST(CASE WHEN count(avg_trade_size_{w}) OVER look >= 10 THEN avg_trade_size_{w} > 3 * median(avg_trade_size_{w}) OVER look END AS INT), 0) AS large_trade_{w}" for w in CONFIG.trade_windows]
    shock = [
        f"CASE WHEN count(total_volume_{w}) OVER look >= 10 AND avg(total_volume_{w}) OVER look > 0 THEN total_volume_{w} / avg(total_volume_{w}) OVER look - 1 ELSE 0 END AS volume_shock_{w}" for w in CONFIG.trade_windows
    ]
    lags = [f"ln(mid_price / lag(mid_price, {n}) OVER o) AS return_lag_{k}" for k, n in _STEPS.items()]
    f2 = f"f2 AS (SELECT *, {', '.join(large + shock + lags)} FROM f1 WINDOW o AS ({_ORDER}), look AS ({_ORDER} {LOOK}))"
    vol = [f"CASE WHEN count(return_lag_10min) OVER v{n} >= 2 THEN stddev_samp(return_lag_10min) OVER v{n} END AS realized_vol_{w}" for w, n in _VOL.items()]
    z = [f"CASE WHEN count({c}) OVER look >= 10 AND stddev_samp({c}) OVER look > 0 THEN ({c} - avg({c}) OVER look) / stddev_samp({c}) OVER look ELSE 0 END AS zscore_{c}" for c in _Z]
    fwd = [x for k, n in _STEPS.items() for x in (f"ln(lead(mid_price, {n}) OVER o / mid_price) AS y_return_{k}", f"lead(mid_price, {n}) OVER o - mid_price AS y_price_change_{k}")]
    when = ["CAST(us // 3600000000 % 24 AS INT) AS hour", "CAST(us // 60000000 % 60 AS INT) AS minute", "CAST((us // 86400000000 + 3) % 7 AS INT) AS day_of_week"]
    frames = [f"v{n} AS ({_ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in _VOL.values()]
    f3 = f"f3 AS (SELECT *, {', '.join(vol + z + fwd + when)} FROM f2 WINDOW o AS ({_ORDER}), look AS ({_ORDER} {LOOK}), {', '.join(frames)})"
    last = [f"CAST(y_return_{k} > 0 AS INT) AS y_direction_{k}" for k in _STEPS]
    last += [f"CASE WHEN y_price_change_{k} IS NULL THEN NULL WHEN y_price_change_{k} > 0.5 * spread THEN 1 WHEN y_price_change_{k} < -0.5 * spread THEN -1 ELSE 0 END AS y_half_spread_{k}" for k in _STEPS]
    return f"{f1}, {f2}, {f3}, features AS MATERIALIZED (SELECT *, {PART_OF_DAY} AS session, {', '.join(last)} FROM f3)"


FEATURES = _features()
TO_GRID = f"{CLEAN}, {GRID}"
TO_ALIGNED = f"{TO_GRID}, {ALIGNED}"
TO_FEATURES = f"{TO_ALIGNED}, {FEATURES}"
