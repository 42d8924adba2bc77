"""Structured Streaming jobs: bars with a watermark, and decisions with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidebar.functions.clean import FEATURE_COLS, ensure_columns, null_to_zero, scrub, series
from tidebar.operators.bars import fill_gaps, from_ticks
from tidebar.operators.decide import can_act, walk
from tidebar.operators.features import HALO, v2_finite
from tidebar.operators.indicators import macd_of_parts, macd_parts
from tidebar.operators.sequences import sequence_lookback
from tidebar.sources.bars import OHLCV

DELAY = "10 minutes"


def stream_ohlcv(ticks: DataFrame, every: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Bars of a stream of ticks, each once it is closed by the watermark. Watermarks need a zoned time, so the session's zone is put on and taken off again."""
    zoned = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return from_ticks(zoned, every).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: Ticks in one row of a symbol's state.
TOGETHER = 50_000


class _InTurn(StatefulProcessor):
    """A symbol's decisions: ticks wait until the watermark has passed them, and then act in the order of their time. They wait as arrays, many in a row of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us binary, seq binary, score binary")
        self.position = handle.getValueState("position", "held boolean, until double, timer bigint")

    def _ask(self, us: int, held: bool, until: float, timer: int) -> None:
        """One timer a symbol, at the first tick that waits."""
        due = -(-us // 1000)
        if timer < 0 or due < timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.position.update((held, until, timer))

    def _state(self) -> tuple[bool, float, int]:
        return tuple(self.position.get()) if self.position.exists() else (False, float("-inf"), -1)

    def _wait(self, *ticks: np.ndarray) -> None:
        self.waiting.appendList([tuple(c[at : at + TOGETHER].tobytes() for c in ticks) for at in range(0, len(ticks[0]), TOGETHER)])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        parts = [[p["us"].astype("int64").to_numpy(), p["seq"].astype("int64").to_numpy(), p["score"].astype("float64").to_numpy()] for p in rows if len(p)]
        if parts:
            ticks = [np.concatenate(c) for c in zip(*parts, strict=True)]
            self._wait(*ticks)
            self._ask(int(ticks[0].min()), *self._state())
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        held, until, _ = self._state()
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())  # no more than the watermark's delay and one micro-batch bring
        us, seq, score = (np.frombuffer(b"".join(bytes(r[k]) for r in rows), t) for k, t in enumerate((np.int64, np.int64, np.float64)))
        order = np.lexsort((score, seq, us))
        us, seq, score = us[order], seq[order], score[order]
        n = int(np.searchsorted(us, upto, "right"))
        at, sides, held, until = walk(us[:n] / 1e6, score[:n], held, until)
        self.waiting.clear()
        self.position.update((held, until, -1))
        if n < len(us):
            self._wait(us[n:], seq[n:], score[n:])
            self._ask(int(us[n]), held, until, -1)
        yield pd.DataFrame({"symbol": pd.Series([key[0]] * len(at), dtype=object), "us": us[at], "seq": seq[at], "side": pd.Series(sides, dtype=object)})


def stream_decide(ticks: DataFrame, delay: str = DELAY) -> DataFrame:
    """Decisions with cooldown from a stream of scored ticks: the batch answer (``decide.cooldown``) for all ticks that the watermark has passed.

    Ticks may come in any order within ``delay``, over any micro-batches: they wait in keyed state and act in the order of time and
    seq once the watermark, ``delay`` behind the latest tick that may act, has passed them. Later ones are left out, as is a tick
    without a time. A symbol's state is the ticks that wait, whether it is held, and until when it pauses. Keyed timers need the
    RocksDB state store: it is set on the session.
    """
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    acting = ticks.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "seq", "score").where(can_act(F.col("score")) & F.col("ts").isNotNull())
    rows = acting.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    done = rows.groupBy("symbol").transformWithStateInPandas(_InTurn(), "symbol string, us long, seq long, side string", "append", "EventTime")
    return done.select("symbol", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "seq", "side")


def dedupe_ticks(ticks: DataFrame, cycle: str = "60 seconds", delay: str = DELAY) -> DataFrame:
    """One evaluation of each account and symbol in a cycle."""
    marked = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cycle", F.window("ts", cycle)["start"])
    return marked.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["account", "symbol", "cycle"])


#: What is carried of each symbol from one micro-batch to the next: its last bar, its last rows, and its averages after them.
STATE = "symbol string, ts timestamp_ntz, tail array<struct<ts:timestamp_ntz,open:double,high:double,low:double,close:double,volume:double>>, ema_fast double, ema_slow double, ema_signal double"
AVERAGES = ["ema_fast", "ema_slow", "ema_signal"]


def joined_to_state(bars: DataFrame, state: DataFrame, every: str, policy: str = "ffill") -> DataFrame:
    """New bars of each symbol behind the rows that its state holds, gaps filled on from its last bar: with ``is_new`` and the state's averages (``was_``).

    Bars that are no later than their symbol's last one were seen before and are left out; symbols without new bars have no rows.
    """
    last = state.select("symbol", F.col("ts").alias("_last"), *(F.col(c).alias(f"was_{c}") for c in AVERAGES))
    fresh = bars.join(last.select("symbol", "_last"), "symbol", "left").where("_last IS NULL OR ts > _last").select("symbol", "ts", *OHLCV)
    known = state.join(fresh.select("symbol").distinct(), "symbol", "left_semi").select("symbol", F.explode("tail").alias("x")).select("symbol", "x.*")
    rows = fill_gaps(known.unionByName(fresh), every, policy).join(last, "symbol", "left")
    return rows.withColumn("is_new", F.col("_last").isNull() | (F.col("ts") > F.col("_last")))


def features_onward(rows: DataFrame, bar: int) -> DataFrame:
    """The second feature set of the new rows of ``joined_to_state``, with the averages after each; nothing before a symbol's state is read."""
    base = null_to_zero(ensure_columns(rows, "zero"))
    new = v2_finite(base, series()).where("is_new")
    out = macd_parts(new, bar=bar, before={c: f"was_{c}" for c in AVERAGES}).withColumn("macd", macd_of_parts())
    return scrub(out, FEATURE_COLS[5:]).select("symbol", "ts", *FEATURE_COLS, *AVERAGES)


def sequences_onward(state: DataFrame, done: DataFrame, lookback: int, bar: int) -> DataFrame:
    """The matrix of each row that ``features_onward`` gave, from the ``lookback`` bars before it; ``state`` (before that batch) must hold as many.

    What lies before the state's rows is out of every window's reach, so the rows behind them are a whole series for these.
    """
    held = state.join(done.select("symbol").distinct(), "symbol", "left_semi").select("symbol", F.explode("tail").alias("x")).select("symbol", "x.*")
    rows = held.unionByName(done.select("symbol", "ts", *OHLCV))
    whole = v2_finite(rows, series()).withColumn("macd", F.lit(0.0))  # computed anew from each window's first bar
    return sequence_lookback(whole, lookback, bar=bar).join(done.select("symbol", "ts"), ["symbol", "ts"])


def next_state(state: DataFrame, done: DataFrame, keep: int) -> DataFrame:
    """The state after the rows that ``features_onward`` gave; a symbol without new rows keeps the one it has."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    rows = F.struct("ts", *OHLCV)
    recent = done.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).groupBy("symbol").agg(F.max("ts").alias("ts"), F.collect_list(rows).alias("_new"), *(F.max_by(c, "ts").alias(c) for c in AVERAGES))
    both = recent.join(state.select("symbol", F.col("tail").alias("_old")), "symbol", "left")
    tail = F.array_sort(F.concat(F.coalesce("_old", F.array().cast(STATE.split("tail ")[1].split(", ema")[0])), "_new"))
    moved = both.select("symbol", "ts", F.slice(tail, F.greatest(F.size(tail) - keep + 1, F.lit(1)), keep).alias("tail"), *AVERAGES)
    return moved.unionByName(state.join(recent.select("symbol"), "symbol", "left_anti"))


def feature_table(ticks: DataFrame, path: str, every: str = "1 hour", delay: str = DELAY, lookback: int | None = None, cycle: str | None = None) -> DataFrame | StreamingQuery:
    """The second feature set over the bars of a stream, as ``foreachBatch`` keeps it up under ``path``.

    Row windows don't run on streams. So each micro-batch features its own closed bars behind one row of state a symbol: the
    last rows that a window reaches, and the averages after them. What it writes equals the features of the whole series, bins of
    gaps between two batches included; earlier bars are not read again. The state after a batch is written beside that of the
    batch before, so a batch that is run again finds what it found. With ``lookback`` it also writes, under ``sequences``, the
    matrix of each new bar from that many bars before it.

    Runs over what there is now and returns the features; with ``cycle`` ("60 seconds") it is started at that pace and returned.
    """
    spark, bar = ticks.sparkSession, int(pd.Timedelta(every).total_seconds())
    keep = max(HALO, lookback or 0)

    def run(new: DataFrame, batch: int) -> None:
        state = spark.read.schema(STATE).parquet(f"{path}/state/{(batch - 1) % 2}") if batch else spark.createDataFrame([], STATE)
        new.write.mode("overwrite").parquet(f"{path}/bars/batch={batch}")
        rows = joined_to_state(spark.read.schema(new.schema).parquet(f"{path}/bars/batch={batch}"), state, every)
        features_onward(rows, bar).write.mode("overwrite").parquet(f"{path}/features/batch={batch}")
        done = spark.read.parquet(f"{path}/features/batch={batch}")
        if lookback:
            sequences_onward(state, done, lookback, bar).write.mode("overwrite").parquet(f"{path}/sequences/batch={batch}")
        next_state(state, done, keep).write.mode("overwrite").parquet(f"{path}/state/{batch % 2}")

    writer = stream_ohlcv(ticks, every, delay).writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/log")
    if cycle:
        return writer.trigger(processingTime=cycle).start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/features/*").drop(*AVERAGES)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that is there now, into Parquet under ``path``, and read the result."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
