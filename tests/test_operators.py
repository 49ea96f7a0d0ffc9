"""Edge rules of the book and trade operators on hand-made frames."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest

from bookflow.config import SCENARIOS, Config, micros
from bookflow.operators import backtest, book, clean, features, grid, models, ranks, signal, splits, stats
from bookflow.sources import imports, tables
from bookflow.streaming import capture

T0 = dt.datetime(2024, 1, 1)
DAY = T0.date()
BOOK = "symbol string, date date, seq long, timestamp timestamp, " + ", ".join(f"{s}_{k}_{i} double" for i in (1, 2, 3) for s in ("bid", "ask") for k in ("price", "size"))


def book_row(seq, second, bid=100.0, ask=101.0, size=5.0, **changed):
    row = {"symbol": "A", "date": DAY, "seq": seq, "timestamp": T0 + dt.timedelta(seconds=second)}
    for i in (1, 2, 3):
        row |= {f"bid_price_{i}": bid - i + 1, f"bid_size_{i}": size, f"ask_price_{i}": ask + i - 1, f"ask_size_{i}": size}
    return row | changed


def books(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], BOOK)


def test_durations():
    assert micros("500ms") == 500_000 and micros("10min") == 600_000_000 and Config().steps("30s") == 30
    with pytest.raises(ValueError):
        micros("soon")


def test_book_edges(spark):
    rows = [book_row(1, 0, size=0.0), book_row(2, 1, bid_size_2=None)]
    empty, partial = book.book_features(books(spark, rows), (1, 3), 3).orderBy("seq").collect()
    assert empty["obi_1"] == empty["weighted_obi"] == empty["depth_imbalance_1"] == 0 and empty["microprice"] == empty["mid_price"] == 100.5
    assert partial["obi_3"] == (10 - 15) / 25 and partial["weighted_obi"] == 0


def test_cleaning_steps_add_up(spark):
    rows = [book_row(1, 0), book_row(2, 0, size=6.0), book_row(3, 1, bid_size_1=None), book_row(4, 2, bid=102.0), book_row(5, 3, ask=150.0), book_row(6, 4, bid_price_3=float("nan")),
            book_row(7, 5, ask_size_2=-1.0), book_row(8, 6, bid_price_2=101.0), book_row(9, 7), book_row(10, 8)]
    flagged = clean.book_failures(books(spark, rows), 3)
    got = {r["seq"]: r["failed_step"] for r in flagged.collect()}
    assert got[1] == 1 and got[2] is None and got[3] == 2 and got[4] == 3 and got[5] == 5 and got[7] == 7 and got[8] == 8 and got[9] is None
    report = clean.cleaning_report(flagged, clean.BOOK_STEPS).orderBy("step_no").collect()
    assert report[0]["rows_before"] == 10 and report[-1]["total_removed"] == 10 - report[-1]["rows_after"]
    assert all(a["rows_after"] == b["rows_before"] for a, b in zip(report, report[1:], strict=False))


def test_downsample_takes_last_value_of_each_column(spark):
    rows = [book_row(1, 0.1, bid_size_1=7.0), book_row(2, 0.5, bid=99.0, bid_size_1=None)]
    (got,) = grid.downsample_books(books(spark, rows), "1s").collect()
    assert got["bid_price_1"] == 99.0 and got["bid_size_1"] == 7.0 and got["timestamp"] == T0


def test_fill_is_row_level_and_bars_align(spark):
    b = books(spark, [book_row(1, 0.2), book_row(2, 2.5, bid=99.0, bid_size_2=None), book_row(3, 5.0)])
    filled = grid.resample_books(b, "1s").orderBy("timestamp").collect()
    assert [r["timestamp"].second for r in filled] == [1, 2, 3, 4, 5] and [r["bid_price_1"] for r in filled] == [100, 100, 99, 99, 100] and filled[2]["bid_size_2"] is None
    t = spark.createDataFrame([("A", DAY, 1, T0 + dt.timedelta(seconds=2.3), 1, 10.0, 3.0, True), ("A", DAY, 2, T0 + dt.timedelta(seconds=2.9), 2, 20.0, 1.0, False)],
                              "symbol string, date date, seq long, timestamp timestamp, trade_id long, price double, quantity double, is_buyer_maker boolean")
    out = grid.resample_and_align(b, t, Config(trade_windows=("1s", "2s"), levels=3)).orderBy("timestamp").collect()
    assert [r["total_volume_1s"] for r in out] == [0, 4, 0, 0, 0] and [r["total_volume_2s"] for r in out] == [0, 4, 4, 0, 0]
    assert out[1]["vwap_1s"] == 12.5 and out[0]["vwap_1s"] is None and out[1]["trade_imbalance_1s"] == -0.5
    right = {r["timestamp"].second: r["total_volume"] for r in grid.trade_bars(t, "1s", "right").collect()}
    assert right == {3: 4.0}
    none = grid.resample_and_align(b, t.limit(0), Config(trade_windows=("1s",), levels=3)).collect()
    assert {r["vwap_1s"] for r in none} == {0.0}


def test_chunks_do_not_change_rolling_values(spark):
    rng = np.random.default_rng(0)
    rows = [("A", DAY, k, T0 + dt.timedelta(seconds=k), float(100 + rng.normal())) for k in range(400)]
    df = spark.createDataFrame(rows, "symbol string, date date, seq long, timestamp timestamp, price double")
    whole, cut = (clean.rolling_median_std(df, "price", 50, 49, 10, chunk=c).orderBy("seq").toPandas() for c in (10_000, 37))
    assert np.allclose(whole.roll_median, cut.roll_median) and np.allclose(whole.roll_std, cut.roll_std) and len(cut) == 400


def frame(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("A", DAY, T0 + dt.timedelta(seconds=k), float(100 + k % 7), float(rng.normal()), float(rng.normal())) for k in range(n)]
    return spark.createDataFrame(rows, "symbol string, date date, timestamp timestamp, mid_price double, x double, y double")


def test_targets_end_with_the_session_and_nothing_looks_ahead(spark):
    df = frame(spark).withColumn("spread", grid.F.lit(1.0))
    out = features.targets(features.realized_vol(features.lagged_returns(df, ["1s", "5s"], "1s"), ["10s"], "1s"), ["5s"], "1s").orderBy("timestamp").toPandas()
    assert out.y_return_5s.isna().sum() == 5 and out.y_direction_5s.isna().sum() == 5 and out.return_lag_5s.isna().sum() == 5
    cut = features.realized_vol(features.lagged_returns(df.limit(30), ["1s", "5s"], "1s"), ["10s"], "1s").orderBy("timestamp").toPandas()
    assert np.allclose(out.realized_vol_10s[:30].to_numpy(float), cut.realized_vol_10s.to_numpy(float), equal_nan=True)


def test_blocks_do_not_change_features(spark):
    """A table built in blocks of 7 and of 50 rows equals one of whole sessions, for books with gaps and a session without trades."""
    rng = np.random.default_rng(6)
    rows = [book_row(k, t, bid=100.0 + float(rng.integers(0, 3)), size=float(rng.integers(1, 9)), date=DAY if t < 400 else DAY + dt.timedelta(days=1)) for k, t in enumerate(sorted(rng.choice(700, 260, replace=False).tolist()))]
    rows = [r | ({"bid_price_1": None} if k % 41 == 7 else {}) for k, r in enumerate(rows)]
    b = books(spark, rows)
    t = spark.createDataFrame([("A", DAY, k, T0 + dt.timedelta(seconds=float(rng.random() * 400)), k, 10.0, float(rng.integers(1, 5)), bool(k % 2)) for k in range(150)],
                              "symbol string, date date, seq long, timestamp timestamp, trade_id long, price double, quantity double, is_buyer_maker boolean")
    out = []
    for block_rows in (16_384, 50, 7):
        cfg = Config(levels=3, imbalance_levels=(1, 3), lookback=40, trade_windows=("1s", "5s", "13s"), block_rows=block_rows)
        out.append(features.build_features(grid.resample_and_align(b, t, cfg), cfg).orderBy("date", "timestamp").toPandas())
    assert len(out[0]) > 600 and list(out[0].columns) == list(out[1].columns)
    for other in out[1:]:
        pd.testing.assert_frame_equal(out[0], other, check_exact=False, rtol=1e-12)
    plan = features.build_features(grid.resample_and_align(b, t, cfg), cfg)._jdf.queryExecution().executedPlan().toString()
    assert "__block" in plan and features.in_blocks(b, ["symbol", "date"], 7, 0).select("date", "__block").distinct().count() > 30


def test_hours(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in (0, 4, 5, 8, 9, 12, 13, 16, 17, 20, 21, 23)], "timestamp timestamp")
    got = [r["session"] for r in features.time_features(df).orderBy("timestamp").collect()]
    assert got == [s for s in ("asia_late", "asia_early", "europe_am", "us_am", "us_pm", "asia_evening") for _ in (0, 1)]


def test_quantile_ties(spark):
    df = spark.createDataFrame([("A", float(v)) for v in (1, 1, 1, 2, 3, 4, 5, 6, 7, 8)], "symbol string, x double")
    got = [r["bin"] - 1 for r in stats.quantile_bins(df, ["symbol"], "x", 5).orderBy("x").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_constant_predictions_and_small_samples(spark):
    df = frame(spark).withColumn("c", grid.F.lit(1.0))
    (row,) = stats.regression_metrics(df, ["symbol"], "y", "c").collect()
    assert row["pearson_ic"] is None and row["n"] == 60
    assert stats.regression_metrics(df.limit(9), ["symbol"], "y", "x").count() == 0
    assert stats.decile_spread(df.limit(29), ["symbol"], "y", "x").first()["decile_spread"] is None
    assert {r["raw_position"] for r in backtest.positions(df, y_pred="c").collect()} == {-1}


def test_p_values():
    assert abs(signal.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-12 and abs(signal.incomplete_beta(0.5, 0.5, 0.25) - 1 / 3) < 1e-12
    assert abs(signal.correlation_p_value(0.3, 50) - 0.0342862) < 1e-6 and signal.correlation_p_value(1.0, 9) == 0


def test_regimes_with_few_values(spark):
    df = frame(spark).withColumn("spread", grid.F.when(grid.F.col("x") > 0, 2.0).otherwise(1.0)).withColumn("total_depth", grid.F.lit(5.0))
    got = signal.regimes(df, "x").toPandas()
    assert set(got.vol_regime) == {"low_vol", "mid_vol", "high_vol"} and set(got.spread_regime) == {"tight", "mid"} and set(got.liq_regime) == {"thin"}


def test_chunks_of_trades_stay_arrow_tables(spark):
    """A chunk's rows become no Python objects; chunks, gaps and NaN change no value."""
    x = np.random.default_rng(5).normal(size=90)
    rows = [("A", DAY, T0 + dt.timedelta(seconds=i), i, None if i == 7 else float("nan") if i == 8 else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, date date, timestamp timestamp, seq long, price double")
    got = clean.rolling_median_std(df, "price", 6, 5, 4, chunk=20)
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().toString()
    got = got.toPandas().sort_values("seq").reset_index(drop=True)
    plain = pd.concat([pd.Series([r[4] for r in rows], dtype=float), pd.Series([np.nan] * 5)], ignore_index=True).rolling(12, min_periods=4)
    assert len(got) == 90 and set(got.session_rows) == {90} and got.price.isna().sum() == 2
    for name, want in (("roll_median", plain.median()), ("roll_std", plain.std())):
        assert np.allclose(got[name], want[5:], equal_nan=True)


def test_regimes_cut_rows_of_one_time_alike(spark):
    """Ties in time that lie on the cut: the same rows get the first label in whatever order the table comes."""
    rows = [("A", i, T0, 1.0 + (i % 4 == 0), float(i * 7 % 13)) for i in range(101)]
    found = []
    for order in (rows, rows[::-1]):
        got = signal.regimes(spark.createDataFrame(order, "symbol string, id int, timestamp timestamp, spread double, x double").coalesce(1), "x")
        found.append({r["id"] for r in got.filter("spread_regime = 'tight'").collect()})
    assert found[0] == found[1] and len(found[0]) == 51 and not any(i % 4 == 0 for i in found[0])


def test_regimes_cut_in_order_of_value_and_time(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 20)
    rng = np.random.default_rng(3)
    rows = [("B", i, T0 + dt.timedelta(seconds=int(rng.integers(0, 60))), float(rng.integers(1, 3)), 5.0) for i in range(200)]
    rows += [("C", 0, T0, 2.0, 5.0)] * 7 + [("D", 0, T0, 1.0, None)] * 2 + [("D", 0, T0, 2.0, None)] * 7  # equal rows
    rows += [(None, 0, None, 1.0, None), (None, 1, T0, 1.0, None), (None, 2, T0, 2.0, None)]  # no time, no key
    got = signal.regimes(spark.createDataFrame(rows, "symbol string, id int, timestamp timestamp, spread double, total_depth double"), "x").toPandas()
    assert len(got) == len(rows) and set(got[got.symbol == "C"].spread_regime) == {"tight"} and got[got.symbol == "D"].liq_regime.isna().all()
    for key in ("B", "D", None):
        table = got[got.symbol.isna()] if key is None else got[got.symbol == key]
        tight, mid = table[table.spread_regime == "tight"], table[table.spread_regime == "mid"]
        places = lambda t: list(zip(t.spread, t.timestamp.fillna(pd.Timestamp(0)), strict=True))
        assert len(tight) == (len(table) + 1) // 2 and len(tight) + len(mid) == len(table) and max(places(tight)) <= min(places(mid))


def test_holds_match_a_plain_scan(spark):
    rng = np.random.default_rng(7)
    for hold in (1, 3, 5):
        raw = rng.choice([-1, 0, 0, 1], 80).tolist()
        want, k = [0] * 80, 0
        while k < 80:
            if raw[k]:
                for j in range(k, min(k + hold, 80)):
                    want[j] = raw[k]
                k += hold
            else:
                k += 1
        df = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=30 * i), v) for i, v in enumerate(raw)], "symbol string, timestamp timestamp, raw_position int")
        for block in ("1d", "1h", "3h"):  # a hold may span whole blocks
            assert [r["position"] for r in backtest.non_overlapping(df, hold, block=block).orderBy("timestamp").collect()] == want


def test_holds_of_persistent_signals_pass_blocks_as_functions():
    """Blocks of a million signals each: every state at the start has its state at the end, as a plain walk finds it."""
    n, hold = 1_000_000, 7
    day = pd.DataFrame({"symbol": ["A"], "n": [n], "at": [np.arange(n)], "side": [np.where(np.arange(n) % 3, 1, -1)]})
    (got,) = backtest._transfers(hold)(iter([day]))
    for held in range(hold):
        last = held + (n - 1 - held) // hold * hold
        assert got.held_out[0][held] == last + hold - n and got.side_out[0][held] == (0 if last + hold == n else 1 if last % 3 else -1)
    (made,) = backtest._positions(hold)(iter([day.assign(held=3, held_side=-1)]))
    assert made.positions[0][:4].tolist() == [-1, -1, -1, -1] and len(made.positions[0]) == n and set(np.unique(made.positions[0])) == {-1, 1}


def test_folds_by_time_match_a_plain_version(spark):
    rng = np.random.default_rng(1)
    at = sorted(rng.choice(20_000, 3000, replace=False).tolist())
    df = spark.createDataFrame([("A", T0 + dt.timedelta(seconds=k)) for k in at], "symbol string, timestamp timestamp")
    for train, val, test, step in ((3000, 500, 500, None), (3000, 700, 400, 150), (2000, 500, 500, 5000)):
        spans, start, fold, want = train + val + test, at[0], 0, []
        while start + spans <= at[-1]:
            roles = [(k, "train" if k < start + train else "validation" if k < start + train + val else "test") for k in at if start <= k < start + spans]
            count = {r: sum(x == r for _, x in roles) for r in ("train", "validation", "test")}
            if count["train"] > 50 and count["validation"] > 10 and count["test"] > 10:
                want += [(fold, k, r) for k, r in roles]
                fold += 1
            start += step or test
        got = [(r["fold"], int((r["timestamp"] - T0).total_seconds()), r["role"]) for r in splits.walk_forward_time(df, train, val, test, step).collect()]
        assert sorted(got) == sorted(want) and want


def test_costs_and_drawdown(spark):
    df = spark.createDataFrame([(1.0, 1000.0)], "spread double, mid_price double")
    assert abs(backtest.trade_costs(df).first()["cost_medium"] - 1.6e-3) < 1e-15 and set(SCENARIOS) == {"zero", "low", "medium", "high"}
    days = [T0 + dt.timedelta(hours=9 * k) for k in range(8)]
    ret = spark.createDataFrame([("A", "gross", t, v) for t, v in zip(days, [-1.0, -1.0, 3.0, None, -0.5, 1.0, -2.0, 0.25], strict=True)], "symbol string, cost_scenario string, timestamp timestamp, ret double")
    plain, dealt = (backtest.drawdown(backtest.equity_curve(ret, by_day=b), by_day=b).orderBy("timestamp").toPandas() for b in (False, True))
    assert np.allclose(plain.cum, dealt.cum) and np.allclose(plain.peak, dealt.peak) and np.allclose(plain.drawdown, dealt.drawdown)
    assert plain.drawdown[1] == -1.0


def test_folds(spark):
    got = splits.fold_table(spark.createDataFrame([("A", 604_797), ("B", 20), ("C", 1000), ("D", 130)], "symbol string, n long")).orderBy("symbol", "fold").collect()
    of = lambda s: [r for r in got if r["symbol"] == s]
    assert of("A")[-1]["test_to"] == 604_797 and all(r["test_to"] - r["test_from"] == 24_191 for r in of("A"))
    assert of("B") == [] and [r["fold"] for r in of("C")] == [0, 1, 2, 3, 4]
    # short histories have spans of 20 rows; a validation part has 10 rows at least
    assert [tuple(r)[1:] for r in of("D")] == [(0, 38, 50, 70), (1, 53, 70, 90), (2, 68, 90, 110), (3, 83, 110, 130)][-len(of("D")) :]


def test_gram_models_equal_direct_solutions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) * [1, 1e-4, 50] + [0, 1, 1000]
    y = x @ [0.5, 20.0, 0.01] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, t double").repartition(3)
    z = (x - x.mean(0)) / x.std(0)
    ridge = models.fit_ridge(df, "t", ["a", "b", "c"])
    assert np.allclose(ridge.scaled, np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())), rtol=1e-6)
    ols = models.fit_linear(df, "t", ["a", "b", "c"])
    assert np.allclose(ols.scaled, np.linalg.lstsq(z, y - y.mean(), rcond=None)[0], rtol=1e-6)
    assert np.allclose(models.predict(df, ols).toPandas().y_pred.mean(), y.mean())
    lasso = np.array(models.fit_lasso(df, "t", ["a", "b", "c"]).scaled)
    grad = z.T @ (y - y.mean() - z @ lasso) / 200
    assert np.all(np.abs(grad[lasso == 0]) <= 0.01 + 1e-9) and np.allclose(grad[lasso != 0], 0.01 * np.sign(lasso[lasso != 0]), atol=1e-8)


def test_imports(spark, tmp_path):
    (tmp_path / "x_book_snapshot_2_2024-01-01_BTC.csv").write_text("timestamp,asks[0].price,asks[0].amount,bids[0].price,bids[0].amount\n1704067200000000,101,1,100,2\n1704067200500000,102,nan,99,3\n")
    (tmp_path / "x_trades_2024-01-01_BTC.csv").write_text("timestamp,id,side,price,amount\n1704067200100000,5,sell,100,2\n1704067200200000,6,buy,bad,2\n")
    b, t = imports.import_directory(spark, str(tmp_path), ["BTC"], 1)
    (row,) = b.collect()
    assert row["symbol"] == "BTC" and row["ask_price_1"] == 102 and row["ask_size_1"] == 1 and row["bid_size_1"] == 3
    got = {r["trade_id"]: r for r in t.collect()}
    assert got[5]["is_buyer_maker"] and got[5]["quote_quantity"] == 200 and got[6]["price"] is None
    assert imports.import_summary(b, t).first().asDict() == {"symbol": "BTC", "date": DAY, "book_rows": 1, "trade_rows": 2}
    (tmp_path / "f_2024-01-01_ETH.csv").write_text("id,price,qty,quote_qty,time,is_buyer_maker\n1,2.5,3,7.5,1704067200000,true\n")
    assert imports.import_archive_trades(spark, str(tmp_path / "f_2024-01-01_ETH.csv"), "futures").first()["is_buyer_maker"]
    (tmp_path / "d_2024-01-01_ETH.csv").write_text("1704067200000,9,100,1,101,2\n1704067201000,10,oops,1,101,2\n")
    depth = imports.import_archive_depth(spark, str(tmp_path / "d_2024-01-01_ETH.csv"), 1).orderBy("timestamp").collect()
    assert depth[0]["bid_price_1"] == 100 and depth[1]["bid_price_1"] is None and depth[0]["ask_size_1"] == 2
    (tmp_path / "d_2024-01-02_ETH.csv").write_text("ETH,1704067200000,9,9,100,1,99,5,101,2,102,6\n\nETH,1704067201000,10,10,100,1,99,5,101\n")
    (tmp_path / "d_2024-01-03_ETH.csv").write_text("1704067200000,100,1,101,2\n")
    every = {(r["date"].day, r["timestamp"].second): r for r in imports.import_archive_depth(spark, str(tmp_path / "d_*.csv"), 2).collect()}
    assert len(every) == 5 and every[1, 0]["bid_price_2"] is None and every[3, 0]["ask_size_1"] == 2
    assert [every[2, 0][f"{s}_price_{i}"] for s in ("bid", "ask") for i in (1, 2)] == [100, 99, 101, 102] and every[2, 1]["ask_price_1"] == 101 and every[2, 1]["ask_size_2"] is None
    import gzip

    with gzip.open(tmp_path / "x_trades_2024-01-05_BTC.csv.gz", "wt") as f:
        f.write("timestamp,id,side,price,amount\n1704412800000000,7,sell,100,2\n")
    assert imports.import_trades_csv(spark, str(tmp_path / "*_trades_*.csv.gz")).first()["date"] == dt.date(2024, 1, 5)


def test_tables_round_trip(spark, tmp_path):
    b = books(spark, [book_row(1, 0), book_row(2, 1)])
    tables.write_stage(b, str(tmp_path), "orderbook")
    assert tables.read_books(spark, str(tmp_path), ["A"], "2024-01-01", "2024-01-01").count() == 2
    assert tables.read_books(spark, str(tmp_path), start="2024-01-02").count() == 0
    inv = {r["data_type"]: r for r in tables.data_inventory(tables.read_stage(spark, str(tmp_path), "orderbook"), b.limit(0), ["A", "B"]).filter("symbol = 'A'").collect()}
    assert inv["orderbook"]["dates"] == [DAY] and inv["trades"]["num_files"] == 0
    tables.write_report(b.groupBy("symbol").count(), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).first()["count"] == "2"


def test_stream_equals_batch(spark, tmp_path):
    message = '{"stream":"btc@trade","data":{"T":%d,"p":"10","q":"2","m":%s,"t":%d}}'
    at = [1704067200000 + 400 * k for k in range(10)]
    lines = [message % (t, "true" if k % 2 else "false", k) for k, t in enumerate(at)] + [message % (at[0], "false", 0), '{"stream":"btc@depth10@100ms","data":{"bids":[["1","2"]],"asks":[["3","4"]]}}', "junk"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines[:7]))
    (tmp_path / "in" / "b.txt").write_text("\n".join(lines[7:]))
    received = grid.F.lit(T0).alias("received")
    raw = spark.readStream.text(str(tmp_path / "in")).select("value", received)
    _, trades = capture.parse_stream(raw, 1)
    q = capture.write_stream(capture.dedup_trades(trades), str(tmp_path / "out"), str(tmp_path / "c1"), None)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    b, t = capture.parse_stream(spark.read.text(str(tmp_path / "in")).select("value", received), 1)
    assert b.first()["ask_size_1"] == 4 and t.count() == 11
    bars = capture.stream_trade_bars(trades, ["1 second", "2 seconds"], "1 second")["2 seconds"]
    q = bars.writeStream.format("memory").queryName("bars2").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["end"]: r["total_volume"] for r in spark.table("bars2").collect()}
    assert sum(got.values()) == 2 * 22 and len(got) == 5


def test_late_repeats_are_dropped_and_state_is_bounded(spark, tmp_path):
    """Ids come again in a later batch, a day behind the newest trade; the state holds no more than it may."""
    fields = "symbol string, timestamp timestamp, trade_id long, price double, is_buyer_maker boolean"
    batches = [[(k, 0) for k in range(40)], [(k, 100_000) for k in range(40, 60)] + [(k, 0) for k in range(5)] + [(None, 0), (None, 0)], [(k, 0) for k in range(60)] + [(1 << 60, 1), (1 + (1 << 60), 1)]]
    (tmp_path / "in").mkdir()
    out = []
    for n, batch in enumerate(batches):
        rows = [("A", T0 + dt.timedelta(seconds=s), k, 1.0, None) for k, s in batch]
        spark.createDataFrame(rows, fields).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema(fields).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        write = lambda df, _: out.extend(r["trade_id"] for r in df.collect())
        q = capture.dedup_trades(stream, 1000, 500, 4).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(x for x in out if x is not None) == [*range(60), 1 << 60, 1 + (1 << 60)] and out.count(None) == 1
    seen, most = [], 0
    for k in range(0, 5000, 50):
        new, seen = capture.new_ids(seen, range(k, k + 50), 100, 50)
        most = max(most, len(seen))
        assert all(new)
    assert most <= 100 and seen[-1] == 4999 and capture.new_ids(seen, [4999, 0], 100, 50)[0] == [False, True]


def test_every_late_repeat_is_dropped_unless_a_bound_is_asked_for(spark, tmp_path):
    """A symbol's state once held 6,250 ids a part: the first of 7,000 ids of a part came twice."""
    ids = grid.F.col("id") * 16
    rows = spark.range(7000).union(spark.range(100)).coalesce(1).select(grid.F.lit("A").alias("symbol"), grid.F.timestamp_seconds("id").alias("timestamp"), ids.alias("trade_id"))
    for n, part in enumerate((rows, rows.filter("trade_id < 800"))):
        part.write.parquet(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        capture.write_stream(capture.dedup_trades(stream), str(tmp_path / "out"), str(tmp_path / "state"), None).awaitTermination(120)
    got = [r["trade_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [16 * k for k in range(7000)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith(".HDFSBackedStateStoreProvider")


def test_long_sessions_are_many_tasks(spark):
    """Windows over a whole session found repeated timestamps, and a join on few keys sorted a key's rows in one task."""
    rows = [("A", DAY, n, T0 + dt.timedelta(seconds=n // 2)) for n in range(400)] + [("A", DAY, 400 + n, None) for n in range(2)]
    df = spark.createDataFrame(rows, "symbol string, date date, seq long, timestamp timestamp")
    last = clean.drop_duplicate_snapshots(df)
    assert {r["seq"] for r in last.collect()} == {*range(1, 400, 2), 400, 401}
    assert re.search(r"\[symbol#\d+, date#\d+, timestamp#\d+\]", last._jdf.queryExecution().optimizedPlan().toString())
    folds = splits.walk_forward_folds(df.filter("timestamp is not null"))
    assert folds.count() > 0 and "strategy=broadcast" in folds._jdf.queryExecution().optimizedPlan().toString()
