"""The time-series engine against plain Python and pandas twins, on small series with gaps, zeros and missing values."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions import clean, windows
from tidebar.functions.ewm import Ewm, ewm, span
from tidebar.operators import backtest as bt
from tidebar.operators import bars as bar_ops
from tidebar.operators import decide, features, sequences

T0 = dt.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(n, seed=0, symbol="a", zeros=(), step=1.0):
    rng = random.Random(seed)
    rows, p = [], 100.0
    for i in range(n):
        p = max(1.0, p + rng.uniform(-step, step))
        c = 0.0 if i in zeros else round(p, 3)
        rows.append((symbol, T0 + dt.timedelta(hours=i), c, c + rng.random(), max(0.0, c - rng.random()), c, float(rng.randrange(10))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, BARS)


def close(a, b, tol=1e-7):
    a, b = np.array(a, float), np.array(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    ok = ~np.isnan(a)
    assert np.abs(a[ok] - b[ok]).max(initial=0) < tol


def ordered(df, *cols):
    return df.orderBy("symbol", "ts").toPandas()[list(cols)]


def test_v2_is_pandas_v2(spark):
    rows = walk(300, 1, zeros=(40, 41, 90)) + walk(10, 2, "short")
    got = ordered(features.add_features_v2(frame(spark, rows)).where("symbol = 'a'"), *clean.FEATURE_COLS)
    df = pd.DataFrame([r[2:] for r in rows if r[0] == "a"], columns=["open", "high", "low", "close", "volume"])
    ret = df.close.pct_change()
    want = pd.DataFrame({"returns": ret.replace([np.inf, -np.inf], np.nan).fillna(0)})
    filled = ret.fillna(0)
    want["vol_14"] = filled.rolling(14).std().replace([np.inf, -np.inf], np.nan).fillna(0)
    d = df.close.diff()
    g, lo = d.clip(lower=0).rolling(14).mean(), (-d.clip(upper=0)).rolling(14).mean()
    want["rsi"] = (100 - 100 / (1 + g / lo.where(lo.abs() > 1e-12))).fillna(50)
    m = df.close.ewm(span=12, adjust=False).mean() - df.close.ewm(span=26, adjust=False).mean()
    want["macd"] = m - m.ewm(span=9, adjust=False).mean()
    tr = pd.concat([df.high - df.low, (df.high - df.close.shift()).abs(), (df.low - df.close.shift()).abs()], axis=1).max(axis=1)
    want["atr"] = tr.rolling(14).mean().fillna(0)
    for c in ("returns", "rsi", "macd", "atr"):
        close(got[c], want[c])
    close(got["vol_14"][200:], want["vol_14"][200:])


def test_chunked_is_unchunked(spark):
    rows = frame(spark, walk(700, 3) + walk(300, 4, "b"))
    old = features.CHUNK
    try:
        features.CHUNK = 64
        a = ordered(features.add_features_v2(rows, parallel="chunk"), *clean.FEATURE_COLS)
    finally:
        features.CHUNK = old
    b = ordered(features.add_features_v2(rows), *clean.FEATURE_COLS)
    for c in clean.FEATURE_COLS:
        close(a[c], b[c])


def spaced(rows, minutes, keep=lambda i: True):
    """The rows with other times, and some of them left out."""
    return [(r[0], T0 + dt.timedelta(minutes=minutes * i), *r[2:]) for i, r in enumerate(rows) if keep(i)]


@pytest.mark.parametrize(("minutes", "bar", "gaps"), [(1, 3600, False), (5, 300, True), (1440, 3600, True)])
def test_bars_of_any_length(spark, minutes, bar, gaps):
    """Chunks and averages count rows: neither the bar's length nor gaps nor a ``bar`` that isn't theirs change a feature."""
    keep = (lambda i: i % 24 < 7 and not 200 < i < 400) if gaps else lambda i: True
    rows = spaced(walk(900, 11), minutes, keep)
    df, plain_ = frame(spark, rows), pd.DataFrame([r[2:] for r in rows], columns=["open", "high", "low", "close", "volume"])
    line = plain_.close.ewm(span=12, adjust=False).mean() - plain_.close.ewm(span=26, adjust=False).mean()
    want = ordered(features.add_features_v2(df, bar), *clean.FEATURE_COLS)
    close(want["macd"], line - line.ewm(span=9, adjust=False).mean())
    got = ordered(features.add_features_v2(df, bar, parallel="chunk", rows=64), *clean.FEATURE_COLS)
    v1, v1_chunked = (ordered(features.add_features_v1(df, bar, parallel=p, rows=64), *clean.FEATURE_COLS) for p in (None, "chunk"))
    for c in clean.FEATURE_COLS:
        close(got[c], want[c])
        close(v1_chunked[c], v1[c])


@pytest.mark.parametrize("rows", [8, 256])
def test_ewm_is_pandas(spark, rows):
    data = walk(600, 5)
    out = ewm(frame(spark, data), [Ewm("a", "close", span(12)), Ewm("b", "close", 1 / 14, "adjusted", 14), Ewm("c", "close", span(26), "seeded", 26)], rows=rows)
    got, x = ordered(out, "a", "b", "c"), pd.Series([r[5] for r in data])
    close(got["a"], x.ewm(span=12, adjust=False).mean())
    close(got["b"], x.ewm(alpha=1 / 14, adjust=True, min_periods=14).mean())
    seeded = pd.concat([pd.Series([x[:26].mean()]), x[26:]]).ewm(span=26, adjust=False).mean()
    close(got["c"], [np.nan] * 25 + list(seeded))


def test_lookback_sequences_start_anew(spark):
    rows = walk(140, 6)
    got = sequences.sequence_lookback(features.add_features_v2(frame(spark, rows))).orderBy("ts").collect()
    assert len(got) == 40
    for i in (100, 117, 139):
        window = frame(spark, rows[i - 100 : i])
        want = features.add_features_v2(window).orderBy("ts").toPandas()[list(clean.FEATURE_COLS)].to_numpy()[-32:]
        assert np.allclose(np.array(got[i - 100]["seq"]), want.astype(np.float32), rtol=1e-4, atol=1e-4)


def test_lookback_sequences_of_v1_start_anew(spark):
    rows = walk(140, 16)
    got = sequences.sequence_lookback_v1(features.add_features_v1(frame(spark, rows))).orderBy("ts").collect()
    assert len(got) == 40
    for i in (100, 121, 139):
        want = features.add_features_v1(frame(spark, rows[i - 100 : i])).orderBy("ts").toPandas()[list(clean.FEATURE_COLS)].to_numpy()[-32:]
        assert np.allclose(np.array(got[i - 100]["seq"]), want.astype(np.float32), rtol=1e-4, atol=1e-4)


def test_sequences_need_all_steps(spark):
    f = features.add_features_v2(frame(spark, walk(31, 7) + walk(33, 8, "b")))
    assert [r["symbol"] for r in sequences.sequence_tail(f).collect()] == ["b"]
    assert sequences.sequence_sliding(f).count() == 2


def replay(rows, thr, c, capital=10_000.0):
    """A backtest bar by bar."""
    cap, pos, entry, equity, trades, pnls = capital, 0.0, 0.0, [], [], []
    for ts, price, s in rows:
        equity.append(cap + pos * price)
        ok = s is not None and not math.isnan(s) and price > 0
        if ok and s > thr and pos == 0:
            pos, cap, entry = cap * (1 - c) / price, 0.0, price
            trades.append(("BUY", price))
        elif ok and s < 1 - thr and pos > 0:
            pnls.append((price - entry) * pos - pos * price * c)
            cap, pos = pos * price * (1 - c), 0.0
            trades.append(("SELL", price))
    last = rows[-1][1]
    if pos:
        pnls.append((last - entry) * pos - pos * last * c)
    equity[-1] = cap + pos * last
    return equity, trades, pnls


@pytest.mark.parametrize(("thr", "bar", "size"), [(0.51, None, 1), (0.9, 3600, 37), (0.4, None, 1), (0.4, 3600, 7), (0.51, 3600, 64)])
def test_backtest_is_a_loop(spark, thr, bar, size):
    rng = random.Random(9)
    data = [("a", T0 + dt.timedelta(hours=i), 0.0 if i == 300 else 50 + rng.random(), None if i % 17 == 0 else float("nan") if i % 19 == 0 else 0.51 if i % 23 == 0 else rng.random()) for i in range(500)]
    scored = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, close double, score double")
    params = spark.createDataFrame([(0, 10_000.0, 0.001, thr)], "param_id int, initial_capital double, transaction_cost double, prediction_threshold double")
    out = bt.backtest(scored, params, bar=bar, size=size)
    equity, trades, pnls = replay([(r[1], r[2], r[3]) for r in data[100:]], thr, 0.001)
    close(out.orderBy("ts").toPandas()["equity"], equity, 1e-6)
    assert [(r["type"], r["price"]) for r in bt.trade_log(out).orderBy("ts").collect()] == trades
    close([r["pnl"] for r in bt.round_trips(out).orderBy("ts", "is_open").collect()], pnls, 1e-6)
    m = bt.metrics(out, 1.0, size=max(size, 5)).first()
    e, r = pd.Series(equity), pd.Series(equity).pct_change().replace([np.inf, -np.inf], np.nan).dropna()
    close([m["sharpe"], m["max_drawdown"], m["final_capital"]], [r.mean() / r.std(), (e / e.cummax() - 1).min(), equity[-1]], 1e-6)
    assert (m["n_trades"], m["wins"], m["losses"]) == (sum(t == "BUY" for t, _ in trades), sum(p > 0 for p in pnls), sum(p <= 0 for p in pnls))


def test_grid_is_each_setting_alone(spark):
    """Settings that share a threshold share a ledger; a missing threshold never trades."""
    rng = random.Random(2)
    scored = spark.createDataFrame([("ab"[i % 2], T0 + dt.timedelta(hours=i), 50 + rng.random(), rng.random()) for i in range(400)], "symbol string, ts timestamp_ntz, close double, score double").cache()
    schema = "param_id int, initial_capital double, transaction_cost double, prediction_threshold double"
    sets = [(0, 100.0, 0.001, 0.6), (1, 200.0, 0.001, 0.6), (2, 100.0, 0.01, 0.6), (3, 100.0, 0.0, 0.45), (4, 100.0, 0.001, None)]
    grid = bt.backtest(scored, spark.createDataFrame(sets, schema))
    assert grid._jdf.queryExecution().optimizedPlan().toString().count("Window ") <= bt.backtest(scored, spark.createDataFrame(sets[:1], schema))._jdf.queryExecution().optimizedPlan().toString().count("Window ")
    got = {(r["param_id"], r["symbol"], r["ts"]): (r["state"], round(r["equity"], 9)) for r in grid.collect()}
    want = {(r["param_id"], r["symbol"], r["ts"]): (r["state"], round(r["equity"], 9)) for s in sets for r in bt.backtest(scored, spark.createDataFrame([s], schema)).collect()}
    assert got == want and {e for (p, _, _), (s, e) in got.items() if p == 4} == {100.0}


def test_backtest_guards(spark):
    rows = [("a", T0 + dt.timedelta(hours=i), 1.0, 0.9) for i in range(100)] + [("b", T0 + dt.timedelta(hours=i), 1.0, 0.5) for i in range(101)]
    params = spark.createDataFrame([(0, 10_000.0, 0.001, 0.51)], "param_id int, initial_capital double, transaction_cost double, prediction_threshold double")
    out = bt.backtest(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, score double"), params)
    assert [r["symbol"] for r in out.collect()] == ["b"]
    m = bt.format_metrics(bt.metrics(out)).first()
    assert (m["sharpe"], m["win_rate"], m["total_return"]) == ("N/A", "0.00%", "0.00%")


def test_signals_are_strict(spark):
    df = spark.createDataFrame([(0.51,), (0.52,), (0.49,), (0.48,), (None,), (float("nan"),)], "s double")
    assert [r[0] for r in df.select(bt.classify(F.col("s"), F.lit(0.51))).collect()] == [0, 1, 0, -1, 0, 0]


def test_cleaning(spark):
    df = spark.createDataFrame([("a", "abc"), ("a", ""), ("a", "1e3"), ("a", None), ("a", "NaN"), ("a", "Infinity")], "symbol string, open string")
    assert [r["open"] for r in clean.to_numeric(df, ["open"]).collect()] == [None, None, 1000.0, None, None, float("inf")]
    assert [r["open"] for r in clean.scrub(clean.to_numeric(df, ["open"]), ["open"]).collect()] == [0.0, 0.0, 1000.0, 0.0, 0.0, 0.0]


def test_gaps_and_edges(spark):
    rows = [("a", T0, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", T0 + dt.timedelta(minutes=4, seconds=59), 2.0, 2.0, 2.0, 2.0, 1.0), ("a", T0 + dt.timedelta(minutes=15), 3.0, 3.0, 3.0, 3.0, 1.0)]
    five = bar_ops.resample(frame(spark, rows), "5 minutes")
    assert [(r["open"], r["close"], r["volume"]) for r in five.orderBy("ts").collect()] == [(1.0, 2.0, 2.0), (3.0, 3.0, 1.0)]
    assert [r["close"] for r in bar_ops.fill_gaps(five, "5 minutes", "ffill").orderBy("ts").collect()] == [2.0, 2.0, 2.0, 3.0]
    assert [r["close"] for r in bar_ops.fill_gaps(five, "5 minutes", "zero").orderBy("ts").collect()] == [2.0, 0.0, 0.0, 3.0]


def test_constant_and_empty_series(spark):
    flat = [("a", T0 + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(40)]
    assert {r["rsi"] for r in features.add_features_v2(frame(spark, flat)).collect()} == {50.0}
    for f in (features.add_features_v1, features.add_features_v2):
        out = f(frame(spark, []))
        assert out.count() == 0 and out.columns == [*clean.KEYS, *clean.FEATURE_COLS]


def test_zero_to_zero_and_zero_to_price(spark):
    df = frame(spark, walk(6, zeros=(2, 3)))
    raw = ordered(df.withColumn("r", windows.raw_change("close")), "r")["r"]
    assert raw[0] == 0 and raw[2] == -1 and raw[3] == 0 and np.isnan(raw[4])


def test_headroom_is_the_loop(spark):
    rng = random.Random(1)
    names = [f"s{i}" for i in range(6)]
    totals, cands, want = [], [], {}
    for a in range(60):
        total = rng.choice([0.0, 199.9, 200.0, 150.0, rng.uniform(0, 260)])
        mine = [s for s in names if rng.random() < 0.7]
        totals.append((a, total))
        cands += [(a, 1, s) for s in mine]
        run, locked = total, total >= 200
        for s in mine:
            ok = not locked and 200 - run >= 50
            locked = locked or not ok
            run += 50 * ok
            want[a, s] = ok
    uni = spark.createDataFrame(list(zip(names, range(6))), "symbol string, priority int")
    out = decide.headroom_budget(spark.createDataFrame(cands, "account long, cycle int, symbol string"), spark.createDataFrame(totals, "account long, total double"), uni)
    assert {(r["account"], r["symbol"]): r["accepted"] for r in out.collect()} == want


def one_by_one(rows):
    """Each symbol's ticks by the rule, one after another."""
    out, state = [], {}
    for s, ts, i, score in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        side, *state[s] = decide.step(*state.get(s, (False, float("-inf"))), (ts - dt.datetime(1970, 1, 1)).total_seconds(), score)
        out += [(s, i, side)] if side else []
    return sorted(out)


@pytest.mark.parametrize(("stretch", "gap"), [("1 hour", 97), ("1 hour", 7), ("6 hours", 97), ("2 hours", 1500)])
def test_cooldown_by_stretches_is_one_by_one(spark, stretch, gap):
    """Ties, pauses that reach over several stretches, stretches without a tick, a symbol that never acts, ticks without time or score."""
    rng = random.Random(gap)
    rows, at = [], {s: dt.datetime(2024, 1, 1) for s in ("A", "BB", "CCC")}
    for i in range(900):
        s = rng.choice(["A", "A", "A", "BB", "CCC"])
        at[s] += dt.timedelta(seconds=rng.choice([0, gap, gap * 3, 0, gap * (200 if rng.random() < 0.02 else 1)]))
        rows.append((s, at[s], i, rng.choice([0.9, None, 0.62, 0.2, float("nan"), 0.7, 0.5])))
    rows += [("D", dt.datetime(2024, 1, 1, h), 1000 + h, 0.1) for h in range(9)] + [("A", None, 2000, 0.9)]
    out = decide.cooldown(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, score double").repartition(5), stretch)
    assert sorted((r["symbol"], r["seq"], r["side"]) for r in out.collect()) == one_by_one(rows)


def test_stretches_are_as_long_as_a_pause(spark):
    with pytest.raises(ValueError, match="pause"):
        decide.cooldown(spark.createDataFrame([], "symbol string, ts timestamp_ntz, seq long, score double"), "30 minutes")


def test_cooldown_ends_exactly(spark):
    at = [(0, 0.9), (599, 0.1), (600, 0.1), (4199, 0.9), (4200, 0.9)]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=s), i, v) for i, (s, v) in enumerate(at)], "symbol string, ts timestamp_ntz, seq long, score double")
    assert [(r["seq"], r["side"]) for r in decide.cooldown(df).orderBy("seq").collect()] == [(0, "BUY"), (2, "SELL"), (4, "BUY")]


def test_order_size(spark):
    df = spark.createDataFrame([(10.0,), (0.0,), (-1.0,), (None,)], "p double")
    assert [r[0] for r in df.select(decide.size_order(F.col("p"))).collect()] == [5.0, None, None, None]
