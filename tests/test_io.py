"""Readers, writers and streams on small files."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tidebar.operators import backtest as bt
from tidebar.operators.bars import from_ticks
from tidebar.sources import bars as io
from tidebar.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
TICKS = "symbol string, ts timestamp_ntz, price double, volume double, seq long"


def ticks(n, seed=1):
    return [("ab"[i % 2], T0 + dt.timedelta(minutes=7 * i), float((i * seed * 37) % 101), 1.0, i) for i in range(n)]


def files(spark, rows, parts, path):
    """One file for each part, with rising modification times."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], TICKS).coalesce(1).write.parquet(f"{path}/{k}")
        for f in os.listdir(f"{path}/{k}"):
            if f.endswith(".parquet"):
                os.utime(f"{path}/{k}/{f}", (time.time() - 1000 + 10 * k,) * 2)


def test_bars_round_trip(spark, tmp_path):
    rows = [("a", T0, 1.0, float("nan"), None, 1.0, 2.0), ("b", T0, 1.0, 2.0, 0.5, float("inf"), 2.0)]
    df = spark.createDataFrame(rows, io.BARS)
    for fmt in ("parquet", "json", "csv"):
        df.write.format(fmt).save(f"{tmp_path}/{fmt}")
        back = {r["symbol"]: r for r in io.read_bars(spark, f"{tmp_path}/{fmt}", fmt).collect()}
        assert back["a"]["high"] is None and back["a"]["low"] is None and back["b"]["close"] == float("inf")
    assert io.stream_bars(spark, f"{tmp_path}/parquet").isStreaming


def test_positions_and_sinks(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.0, 10.0), (1, "b", 0.0, 0.0)], io.POSITIONS).write.parquet(f"{tmp_path}/p")
    assert [r["symbol"] for r in io.read_positions(spark, f"{tmp_path}/p").collect()] == ["a"]
    scored = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), 10.0 + i % 7, 0.9 if i % 3 else 0.1) for i in range(130)], "symbol string, ts timestamp_ntz, close double, score double")
    params = spark.createDataFrame([(0, 10_000.0, 0.001, 0.51)], "param_id int, initial_capital double, transaction_cost double, prediction_threshold double")
    out = bt.backtest(scored, params)
    io.write_trades(bt.trade_log(out), f"{tmp_path}/t")
    io.write_equity(out.select("symbol", "ts", "equity"), f"{tmp_path}/e")
    io.write_metrics(bt.metrics(out), f"{tmp_path}/m")
    assert os.path.isdir(f"{tmp_path}/t/symbol=a") and spark.read.parquet(f"{tmp_path}/e").count() == 30 and spark.read.parquet(f"{tmp_path}/m").count() == 1
    io.write_order_intents(scored.select("symbol", F.lit("SELL").alias("side"), F.lit(1.0).alias("qty"), "ts").limit(2), f"{tmp_path}/o")
    assert spark.read.parquet(f"{tmp_path}/o").columns == ["symbol", "side", "qty"]


def test_stream_of_files_is_the_batch(spark, tmp_path):
    rows = ticks(200)
    files(spark, rows, 4, f"{tmp_path}/in")
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = jobs.drain(jobs.stream_ohlcv(stream), f"{tmp_path}/bars")
    want = from_ticks(spark.createDataFrame(rows, TICKS)).where(F.col("ts") + F.expr("INTERVAL 1 HOUR") <= F.lit(rows[-1][1] - dt.timedelta(minutes=10)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_features_onward_equal_the_whole_series(spark, tmp_path):
    """Four files, one a trigger: a gap over a batch's end, a symbol that comes late, one that stops, one with a single tick."""
    from tidebar.functions.clean import FEATURE_COLS
    from tidebar.operators.bars import fill_gaps
    from tidebar.operators.features import add_features_v2

    at = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    rows = [("a", at(h, m), 100 + (h * 7 + m) % 13 + 0.25 * (h % 5), 1.0, 0) for h in range(260) for m in (1, 40) if not 96 <= h < 113]
    rows += [("b", at(h, 5), 50 + (h * h) % 11, 1.0, 0) for h in range(120, 260, 3)] + [("c", at(h, 9), 10 + h % 4, 1.0, 0) for h in range(60)] + [("d", at(70), 5.0, 1.0, 0)] + [("z", at(300), 1.0, 1.0, 0)]
    rows = [(r[0], r[1], float(r[2]), r[3], i) for i, r in enumerate(sorted(rows, key=lambda r: r[1]))]
    files(spark, rows, 4, f"{tmp_path}/in")
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = jobs.feature_table(stream, f"{tmp_path}/out")
    bars = fill_gaps(from_ticks(spark.createDataFrame(rows, TICKS)).where("symbol <> 'z'"), "1 hour")
    want = add_features_v2(bars)
    key, cols = ["symbol", "ts"], list(FEATURE_COLS)
    a, b = (df.select(*key, *cols).orderBy(*key).toPandas() for df in (got, want))
    assert a[key].equals(b[key]) and abs(a[cols] - b[cols]).max().max() < 1e-9
    batches = sum(1 for b in os.listdir(f"{tmp_path}/out/bars") if b.startswith("batch="))
    assert batches >= 4
    state = {r["symbol"]: r for r in spark.read.schema(jobs.STATE).parquet(f"{tmp_path}/out/state/{(batches - 1) % 2}").collect()}
    assert sorted(state) == ["a", "b", "c", "d"] and len(state["a"]["tail"]) == 20 and len(state["d"]["tail"]) == 1 and state["c"]["ts"] == at(59)


def test_sequences_onward_equal_the_whole_series(spark):
    from tidebar.operators.features import add_features_v2
    from tidebar.operators.sequences import sequence_lookback

    bars = from_ticks(spark.createDataFrame([("a", T0 + dt.timedelta(hours=h), 100.0 + (h * 7) % 13 + 0.25 * (h % 5), 1.0, h) for h in range(150)], TICKS)).cache()
    state, got = spark.createDataFrame([], jobs.STATE), {}
    for end in (90, 130, 150):
        rows = jobs.joined_to_state(bars.where(F.col("ts") < F.lit(T0 + dt.timedelta(hours=end))), state, "1 hour")
        done = jobs.features_onward(rows, 3600).checkpoint()
        got |= {r["ts"]: [[round(x, 3) for x in s] for s in r["seq"]] for r in jobs.sequences_onward(state, done, 100, 3600).collect()}
        state = jobs.next_state(state, done, 100).checkpoint()
    want = {r["ts"]: [[round(x, 3) for x in s] for s in r["seq"]] for r in sequence_lookback(add_features_v2(bars)).collect()}
    assert got == want and len(want) == 50


def test_a_batch_run_again_is_the_same(spark):
    state = spark.createDataFrame([], jobs.STATE)
    bars = from_ticks(spark.createDataFrame(ticks(300), TICKS)).checkpoint()
    first = jobs.features_onward(jobs.joined_to_state(bars.where("ts < '2024-01-01 20:00'"), state, "1 hour"), 3600).checkpoint()
    after = jobs.next_state(state, first, 20).checkpoint()
    again = jobs.joined_to_state(bars, after, "1 hour")  # bars seen before are left out
    assert again.where("is_new").agg(F.min("ts")).first()[0] == T0 + dt.timedelta(hours=20)
    nothing = jobs.features_onward(jobs.joined_to_state(bars.where("false"), after, "1 hour"), 3600).checkpoint()
    none = jobs.next_state(after, nothing, 20)
    assert sorted(map(str, none.collect())) == sorted(map(str, after.collect()))


def test_decisions_of_files_out_of_order(spark, tmp_path):
    """Three files, one a micro-batch, each tick up to six hours late: what the watermark has passed is the batch answer."""
    import random

    from tidebar.operators import decide

    rng, rows = random.Random(4), ticks(240)
    late = sorted(rows, key=lambda r: r[TICKS.split(", ").index("ts timestamp_ntz")] + dt.timedelta(hours=rng.uniform(0, 6)))
    for k in range(3):
        spark.createDataFrame(late[k * 80 : k * 80 + 80], TICKS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    score = (F.col("price") / 100).alias("score")
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").select("*", score)
    got = jobs.drain(jobs.stream_decide(stream, "7 hours"), f"{tmp_path}/out")
    scored = spark.createDataFrame(rows, TICKS).select("*", score)
    end = scored.where(decide.can_act(F.col("score"))).agg(F.max("ts")).first()[0] - dt.timedelta(hours=7)
    want = [tuple(r) for r in decide.cooldown(scored).collect() if r["ts"] <= end]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 4


def test_one_evaluation_a_cycle(spark, tmp_path):
    rows = [(1, "a", T0 + dt.timedelta(seconds=s)) for s in (0, 5, 59, 60, 61, 200)] + [(2, "a", T0), (1, "b", T0)]
    spark.createDataFrame(rows, "account long, symbol string, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema("account long, symbol string, ts timestamp_ntz").parquet(f"{tmp_path}/in/*")
    out = jobs.drain(jobs.dedupe_ticks(stream), f"{tmp_path}/out")
    assert sorted((r["account"], r["symbol"], r["cycle"].minute) for r in out.collect()) == [(1, "a", 0), (1, "a", 1), (1, "a", 3), (1, "b", 0), (2, "a", 0)]


def test_walk_is_step_by_step():
    import random

    import numpy as np

    from tidebar.operators import decide

    rng = random.Random(8)
    for _ in range(200):
        now = np.sort(np.array([rng.randrange(20_000) / 2 for _ in range(rng.randrange(60))], float))
        score = np.array([rng.choice([0.1, 0.5, 0.61, 0.62, 0.63, 0.9]) for _ in now], float)
        held, until = rng.random() < 0.5, rng.choice([float("-inf"), 3000.0])
        want, h, u = [], held, until
        for i, (t, x) in enumerate(zip(now.tolist(), score.tolist(), strict=True)):
            side, h, u = decide.step(h, u, t, x)
            want += [(i, side)] if side else []
        at, sides, after, free = decide.walk(now, score, held, until)
        assert (list(zip(at.tolist(), sides, strict=True)), after, free) == (want, h, u)


@pytest.mark.parametrize("gap", [False, True])
def test_a_stretch_of_several_files_is_one_micro_batch(spark, tmp_path, monkeypatch, gap):
    """Many files a stretch: as many in each, one stretch at once, and the decisions are the batch's."""
    from tidebar.operators import decide
    from tidebar.plans import catalog

    monkeypatch.setattr(catalog, "FILE_ROWS", 300)
    monkeypatch.setattr(catalog, "LEAST_ROWS", 50)
    n = 6000
    rows = spark.range(0, n, 1, 6).select(F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 30_000_000 + F.lit(864_000_000_000 if gap else 0) * (F.col("id") >= n // 2).cast("long")).cast("timestamp_ntz").alias("ts"), F.lit("s").alias("event_type"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    stream = catalog._scored_ticks(catalog._in_turn(spark, str(tmp_path), f"{tmp_path}/s", late="30 minutes"))
    files = [len(list(p.glob("*.parquet"))) for p in sorted((tmp_path / "s" / "in").iterdir())]
    assert len(set(files)) == 1 and files[0] > 1 and len(files) == (2 if gap else 4)
    got = jobs.drain(jobs.stream_decide(stream, "40 minutes"), f"{tmp_path}/out")
    scored = catalog._scored_ticks(catalog._events(spark, str(tmp_path)))
    end = scored.where(decide.can_act(F.col("score"))).agg(F.max("ts")).first()[0] - dt.timedelta(minutes=40)
    want = [tuple(r) for r in decide.cooldown(scored).collect() if r["ts"] <= end]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 4
