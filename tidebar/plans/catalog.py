"""All registered queries of the time-series engine. Each takes (spark, sf_dir) and reads the whole tables that it names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.functions import clean, scan, windows
from tidebar.functions.ewm import HOUR, Ewm, ewm, reseed, span
from tidebar.operators import backtest as bt
from tidebar.operators import bars as bar_ops
from tidebar.operators import decide, features, indicators, sequences
from tidebar.sources import bars as io
from tidebar.sources.bars import OHLCV, ticks
from tidebar.streaming import jobs

from .oracle import ORACLE_SQL

FLAGSHIP = "features_v2"
EVERY = "1 hour"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def _events(spark: SparkSession, d: str) -> DataFrame:
    return ticks(spark.read.parquet(f"{d}/events.parquet"))


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return bar_ops.from_ticks(_events(spark, d), EVERY)


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return bar_ops.fill_gaps(_bars(spark, d), EVERY, "ffill")


def _v2(spark: SparkSession, d: str) -> DataFrame:
    return features.add_features_v2(_filled(spark, d))


def _universe(df: DataFrame) -> DataFrame:
    """The symbols of a table with their priority by name: as many rows as there are symbols."""
    names = df.select("symbol").distinct()
    return names.select("symbol", F.row_number().over(Window.orderBy("symbol")).alias("priority"))


# Bars


@query
def bars_resample(spark, d):
    return rounded(_bars(spark, d), *OHLCV)


@query
def bars_resample_days(spark, d):
    return rounded(bar_ops.resample(_bars(spark, d), "1 day"), *OHLCV)


@query
def bars_gapfill_zero(spark, d):
    return rounded(bar_ops.fill_gaps(_bars(spark, d), EVERY, "zero"), *OHLCV)


@query
def bars_gapfill_ffill(spark, d):
    return rounded(_filled(spark, d), *OHLCV)


@query
def bars_recent(spark, d):
    bars = _bars(spark, d)
    end = bars.agg(F.max("ts").alias("_end"))  # one row
    return rounded(clean.recent(bars.crossJoin(F.broadcast(end)), F.col("_end"), 6).drop("_end"), *OHLCV)


@query
def bars_tail(spark, d):
    return rounded(bar_ops.tail(_bars(spark, d), 32), *OHLCV)


@query
def bars_limit(spark, d):
    return rounded(bar_ops.limit_per_symbol(_bars(spark, d), 500), *OHLCV)


@query
def bars_latest(spark, d):
    return rounded(bar_ops.latest(_bars(spark, d), "close", "volume"), "close", "volume")


@query
def bars_min_rows(spark, d):
    """Of the series of events that are cut after 40, 80, ... bars by their names, those of 101 bars or more."""
    bars = _bars(spark, d)
    short = bars.join(_universe(bars), "symbol").withColumn("_n", F.row_number().over(clean.series())).where(F.col("_n") <= 40 * F.col("priority"))
    return rounded(clean.min_rows(short.drop("_n", "priority"), 101), *OHLCV)


@query
def bars_universe(spark, d):
    bars = _bars(spark, d)
    return rounded(clean.universe(bars, _universe(bars).where("priority <= 3")), *OHLCV)


@query
def orders_daily(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("ts", F.col("o_orderdate").cast("timestamp_ntz"))
    return rounded(bar_ops.from_ticks(ticks(o, "o_orderpriority", "o_totalprice", "o_orderkey"), "1 day"), *OHLCV)


# Cleaning: raw columns are made from the events so that text, nulls and infinities occur


def _dirty(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.pmod("event_id", F.lit(11))
    text = F.when(k == 0, "abc").when(k == 1, "").when(k == 2, "1e3").when(k == 3, None).when(k == 4, "NaN").otherwise(F.col("value").cast("string"))
    return e.select(F.col("event_type").alias("symbol"), "ts", "event_id", text.alias("open"), F.when(k == 5, F.lit(float("inf"))).when(k == 6, None).otherwise(F.col("value")).alias("high"), "value")


@query
def clean_numeric(spark, d):
    return rounded(clean.to_numeric(_dirty(spark, d), ["open"]), "open").select("symbol", "ts", "event_id", "open")


@query
def clean_null_to_zero(spark, d):
    return rounded(clean.null_to_zero(_dirty(spark, d), ["open"]), "open").select("symbol", "ts", "event_id", "open")


@query
def clean_scrub(spark, d):
    return rounded(clean.scrub(_dirty(spark, d), ["high"]), "high").select("symbol", "ts", "event_id", "high")


@query
def clean_fill_chain(spark, d):
    gappy = bar_ops.fill_gaps(_bars(spark, d), EVERY, "none")
    n = F.row_number().over(clean.series())
    gappy = gappy.withColumn("close", F.when(n > 5, F.col("close")))
    out = clean.bfill_leading(clean.ffill(gappy, ["close", "volume"]), ["close", "volume"])
    return rounded(out.select("symbol", "ts", "close", "volume"), "close", "volume")


@query
def clean_missing_cols(spark, d):
    bars = _bars(spark, d).drop("volume")
    out = clean.project_features(clean.ensure_columns(bars, "zero"))
    return rounded(out, *clean.FEATURE_COLS)


@query
def clean_missing_defaults(spark, d):
    return features.add_features_v1(_bars(spark, d).drop("high"))


# Window primitives


@query
def pct_change(spark, d):
    return _filled(spark, d).select("symbol", "ts", r6(windows.pct_change("close")).alias("returns"))


@query
def pct_change_zero(spark, d):
    zero = bar_ops.fill_gaps(_bars(spark, d), EVERY, "zero")
    return zero.withColumn("raw", windows.raw_change("close")).select("symbol", "ts", r6("raw").alias("raw"), r6(windows.diff("close")).alias("diff"), r6(windows.shift("close", 2)).alias("shift2"))


@query
def rolling_mean(spark, d):
    return _filled(spark, d).select("symbol", "ts", r6(windows.rolling_mean("close", 14)).alias("mean_14"))


@query
def rolling_std(spark, d):
    zero = bar_ops.fill_gaps(_bars(spark, d), EVERY, "zero").withColumn("raw", windows.raw_change("close"))
    return zero.select("symbol", "ts", r6(windows.rolling_std("raw", 14)).alias("std_14"))


@query
def running_chunked(spark, d):
    """Greatest, summed, last and previous values chunk by chunk."""
    gappy = bar_ops.fill_gaps(_bars(spark, d), EVERY, "none")
    specs = {"peak": ("max", F.col("close")), "total": ("sum", F.col("volume")), "held": ("last", F.col("close")), "before": ("prev", F.col("close")), "is_last": ("end", F.lit(True))}
    return rounded(scan.running(gappy, ["symbol"], specs, HOUR, 100).select("symbol", "ts", *specs), "peak", "total", "held", "before")


@query
def expanding_max(spark, d):
    return _filled(spark, d).select("symbol", "ts", r6(windows.expanding_max("close")).alias("peak"))


@query
def ewm_span(spark, d):
    out = ewm(_filled(spark, d), [Ewm("ema_12", "close", span(12)), Ewm("ema_26", "close", span(26))])
    return out.select("symbol", "ts", r6("ema_12").alias("ema_12"), r6("ema_26").alias("ema_26"))


@query
def ewm_adjusted(spark, d):
    return ewm(_filled(spark, d), [Ewm("wilder", "close", 1 / 14, "adjusted", 14)]).select("symbol", "ts", r6("wilder").alias("wilder"))


@query
def ewm_seeded(spark, d):
    return ewm(_filled(spark, d), [Ewm("ema", "close", span(12), "seeded", 12)]).select("symbol", "ts", r6("ema").alias("ema"))


@query
def ewm_lookback(spark, d):
    full = ewm(_filled(spark, d), [Ewm("y", "close", span(12), "adjusted")])
    w = clean.series()
    raw = full.withColumn("y", F.col("y") * (1 - F.pow(F.lit(1 - span(12)), F.row_number().over(w))))
    return raw.select("symbol", "ts", r6(reseed(F.col("y"), F.col("close"), span(12), 50, w)).alias("ema_50"), r6(reseed(F.col("y"), F.col("close"), span(12), 50, w, "adjusted")).alias("adjusted_50"))


# Indicators


def _moves(spark, d):
    return indicators.with_moves(_filled(spark, d))


@query
def rsi_sma(spark, d):
    return _moves(spark, d).select("symbol", "ts", r6(indicators.rsi_sma()).alias("rsi"))


@query
def rsi_wilder(spark, d):
    return indicators.rsi_wilder(_moves(spark, d)).select("symbol", "ts", r6("rsi").alias("rsi"))


@query
def macd_line(spark, d):
    return indicators.macd_line(_filled(spark, d)).select("symbol", "ts", r6("macd").alias("macd"))


@query
def macd_hist(spark, d):
    return indicators.macd_hist(_filled(spark, d)).select("symbol", "ts", r6("macd").alias("macd"))


@query
def true_range(spark, d):
    return _filled(spark, d).select("symbol", "ts", r6(indicators.true_range()).alias("tr"))


@query
def atr_sma(spark, d):
    return _moves(spark, d).select("symbol", "ts", r6(indicators.atr_sma()).alias("atr"))


@query
def atr_wilder(spark, d):
    return indicators.atr_wilder(_moves(spark, d)).select("symbol", "ts", r6("atr").alias("atr"))


@query
def bollinger(spark, d):
    mid, upper, lower = indicators.bollinger()
    return _filled(spark, d).select("symbol", "ts", r6(mid).alias("mid"), r6(upper).alias("upper"), r6(lower).alias("lower"))


@query
def bb_width_ratio(spark, d):
    return _filled(spark, d).select("symbol", "ts", r6(indicators.bb_width_ratio()).alias("bb_width"))


@query
def bb_width_pct(spark, d):
    return _filled(spark, d).select("symbol", "ts", r6(indicators.bb_width_pct()).alias("bb_width"))


@query
def features_v1(spark, d):
    return rounded(features.add_features_v1(_filled(spark, d)), *clean.FEATURE_COLS)


@query
def features_v2(spark, d):
    return rounded(_v2(spark, d), *clean.FEATURE_COLS)


@query
def features_v2_chunked(spark, d):
    return rounded(features.add_features_v2(_filled(spark, d), parallel="chunk"), *clean.FEATURE_COLS)


@query
def features_v1_chunked(spark, d):
    filled = bar_ops.fill_gaps(_bars(spark, d), EVERY, "ffill", parallel="chunk")
    return rounded(features.add_features_v1(filled, parallel="chunk", rows=256), *clean.FEATURE_COLS)


def _five_minutes(spark, d):
    """Bars of five minutes as they are, with gaps."""
    return bar_ops.from_ticks(_events(spark, d), "5 minutes")


@query
def features_v2_gappy(spark, d):
    return rounded(features.add_features_v2(_five_minutes(spark, d), 300, parallel="chunk", rows=512), *clean.FEATURE_COLS)


@query
def features_v1_gappy(spark, d):
    return rounded(features.add_features_v1(_five_minutes(spark, d), 300, parallel="chunk", rows=512), *clean.FEATURE_COLS)


@query
def features_v1_leak_free(spark, d):
    return rounded(features.add_features_v1(_filled(spark, d), leak_free=True), *clean.FEATURE_COLS)


@query
def features_v1_keep_inf(spark, d):
    """Returns over bars whose gaps are zero prices; an infinite one is shown as 999."""
    v1 = features.add_features_v1(bar_ops.fill_gaps(_bars(spark, d), EVERY, "zero"), keep_inf=True)
    return v1.select("symbol", "ts", r6(F.when(F.col("returns") == float("inf"), 999.0).otherwise(F.col("returns"))).alias("returns"))


@query
def clean_empty(spark, d):
    """No rows in, no rows out, with every feature's column."""
    none = _bars(spark, d).where("volume < 0")
    return features.add_features_v1(none).union(features.add_features_v2(none))


@query
def clean_strip_tz(spark, d):
    zoned = _bars(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(clean.strip_tz(zoned), *OHLCV)


# Sequences and scores


def _cells(df: DataFrame) -> DataFrame:
    """A row for each step of each matrix, with all its cells."""
    steps = df.select("symbol", "ts", F.posexplode("seq").alias("step", "x"))
    return steps.select("symbol", "ts", F.col("step").cast("long").alias("step"), *((F.round(F.col("x")[k].cast("double"), 3) + F.lit(0.0)).alias(c) for k, c in enumerate(clean.FEATURE_COLS)))


@query
def seq_tail(spark, d):
    return _cells(sequences.sequence_tail(_v2(spark, d)))


@query
def seq_sliding(spark, d):
    return _cells(sequences.sequence_sliding(_v2(spark, d)))


def _macds(seq: DataFrame) -> DataFrame:
    return seq.select("symbol", "ts", F.size("seq").cast("long").alias("steps"), (F.round(F.element_at("seq", -1)[8].cast("double"), 3) + F.lit(0.0)).alias("last_macd"), (F.round(F.element_at("seq", 1)[8].cast("double"), 3) + F.lit(0.0)).alias("first_macd"))


@query
def seq_lookback(spark, d):
    return _macds(sequences.sequence_lookback(_v2(spark, d)))


@query
def seq_lookback_cells(spark, d):
    return _cells(sequences.sequence_lookback(_v2(spark, d)))


@query
def seq_lookback_chunked(spark, d):
    return _macds(sequences.sequence_lookback(features.add_features_v2(_five_minutes(spark, d), 300), bar=300, parallel="chunk", rows=2048))


@query
def seq_lookback_v1(spark, d):
    seq = sequences.sequence_lookback_v1(features.add_features_v1(_filled(spark, d)))
    last = lambda k: F.round(F.element_at("seq", -1)[k].cast("double"), 3) + F.lit(0.0)
    return seq.select("symbol", "ts", F.size("seq").cast("long").alias("steps"), last(7).alias("rsi"), last(8).alias("macd"), last(9).alias("atr"))


@query
def scaler_fit(spark, d):
    return rounded(sequences.fit_scaler(_v2(spark, d)), "mean", "std")


@query
def scaler_apply(spark, d):
    v2 = _v2(spark, d)
    return rounded(sequences.scale(v2, sequences.fit_scaler(v2)), *clean.FEATURE_COLS)


def _scored(spark, d):
    """Bars with bounded prices and, for each, the score of the bar before it."""
    px = _filled(spark, d).withColumns({c: 100 + F.col(c) / 10 for c in OHLCV[:4]})
    v2 = features.add_features_v2(px).withColumn("_s", sequences.logistic())
    return v2.select("symbol", "ts", "close", F.lag("_s").over(clean.series()).alias("score"))


@query
def score_logistic(spark, d):
    return _v2(spark, d).select("symbol", "ts", r6(sequences.logistic()).alias("score"))


@query
def score_fallback(spark, d):
    return rounded(sequences.neutral_fallback(_scored(spark, d)).select("symbol", "ts", "score", "score_status"), "score")


@query
def score_numpy(spark, d):
    import numpy as np

    seq = sequences.sequence_sliding(_v2(spark, d))
    scorer = sequences.numpy_scorer(lambda: lambda x: 1 / (1 + np.exp(-20 * x[:, -1, 5].astype(float) - (x[:, -1, 7].astype(float) - 50) / 50)))
    return seq.select("symbol", "ts", r6(scorer(F.col("seq"))).alias("score"))


@query
def score_ml(spark, d):
    """A logistic regression of whether the next close is higher, fitted and applied by Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    v2 = _v2(spark, d).withColumn("label", F.coalesce(F.lead("close").over(clean.series()) > F.col("close"), F.lit(False)).cast("double"))
    fitted = LogisticRegression(maxIter=10, regParam=0.01).fit(v2.select("label", array_to_vector(F.array(*clean.FEATURE_COLS)).alias("features")))
    return sequences.ml_score(v2, fitted).select("symbol", "ts", r6("score").alias("score"))


@query
def signal_classify(spark, d):
    return _scored(spark, d).select("symbol", "ts", bt.classify(F.col("score"), F.lit(0.51)).cast("long").alias("signal"))


@query
def signal_hysteresis(spark, d):
    held = F.pmod(F.row_number().over(clean.series()), F.lit(2)) == 0
    return _scored(spark, d).withColumn("held", held).select("symbol", "ts", bt.classify_hysteresis(F.col("score"), F.col("held")).alias("side"))


# Backtest


def _params(spark: SparkSession, n: int = 1) -> DataFrame:
    """n settings; the first is the usual one."""
    i = F.col("id")
    return spark.range(n).select(i.cast("int").alias("param_id"), (10_000.0 + 100 * F.pmod(i, F.lit(3))).alias("initial_capital"), (0.001 + 0.0005 * F.pmod(i, F.lit(4))).alias("transaction_cost"), (0.51 - 0.03 * F.pmod(i, F.lit(5)) + 0.06 * F.floor(F.pmod(i, F.lit(10)) / 5)).alias("prediction_threshold"))


def _tested(spark, d, n=1):
    return bt.backtest(_scored(spark, d), _params(spark, n))


def _tested_chunked(spark, d, n=1):
    return bt.backtest(_scored(spark, d), _params(spark, n), bar=HOUR, size=100)


def ln6(c: str) -> Column:
    return r6(F.log(F.col(c)))


@query
def bt_state(spark, d):
    return _tested(spark, d).select("symbol", "ts", F.col("state").cast("long").alias("state"))


@query
def bt_equity(spark, d):
    return _tested(spark, d).select("symbol", "ts", ln6("equity").alias("ln_equity"))


@query
def bt_state_chunked(spark, d):
    return _tested_chunked(spark, d).select("symbol", "ts", F.col("state").cast("long").alias("state"))


@query
def bt_equity_chunked(spark, d):
    return _tested_chunked(spark, d).select("symbol", "ts", ln6("equity").alias("ln_equity"))


@query
def bt_trades_chunked(spark, d):
    return bt.trade_log(_tested_chunked(spark, d)).select("symbol", "ts", "type", r6("price").alias("price"), ln6("units").alias("ln_units"), ln6("equity").alias("ln_equity"))


@query
def bt_grid_chunked(spark, d):
    return _grid(bt.metrics(_tested_chunked(spark, d, 100), bar=HOUR, size=64))


@query
def bt_drawdown_chunked(spark, d):
    return bt.drawdown(_tested(spark, d), HOUR).select("symbol", "ts", r6("drawdown").alias("drawdown"))


@query
def bt_trades(spark, d):
    return bt.trade_log(_tested(spark, d)).select("symbol", "ts", "type", r6("price").alias("price"), ln6("units").alias("ln_units"), ln6("equity").alias("ln_equity"))


@query
def bt_round_trips(spark, d):
    return bt.round_trips(_tested(spark, d)).select("symbol", "ts", r6("entry_price").alias("entry_price"), r6("exit_price").alias("exit_price"), F.round(F.col("pnl"), 4).alias("pnl"), "is_open")


@query
def bt_drawdown(spark, d):
    return bt.drawdown(_tested(spark, d)).select("symbol", "ts", r6("drawdown").alias("drawdown"))


_METRICS = ("total_return", "sharpe", "max_drawdown", "win_rate")


@query
def bt_metrics(spark, d):
    m = bt.metrics(_tested(spark, d))
    return rounded(m, *_METRICS).select("symbol", F.round("final_capital", 3).alias("final_capital"), *_METRICS, "n_trades", "wins", "losses", F.round("avg_win", 3).alias("avg_win"), F.round("avg_loss", 3).alias("avg_loss"))


@query
def bt_metrics_fmt(spark, d):
    return bt.format_metrics(bt.metrics(_tested(spark, d))).drop("param_id")


def _grid(m: DataFrame) -> DataFrame:
    return m.select(F.col("param_id").cast("long").alias("param_id"), "symbol", ln6("final_capital").alias("ln_final"), r6("max_drawdown").alias("max_drawdown"), "n_trades")


@query
def bt_grid(spark, d):
    return _grid(bt.metrics(_tested(spark, d, 100)))


def _replayed(spark, d, reward="portfolio_return"):
    px = _filled(spark, d).withColumns({c: 100 + F.col(c) / 10 for c in OHLCV[:4]})
    n = F.row_number().over(clean.series())
    actions = px.withColumn("_n", n).select("symbol", "ts", F.pmod(F.col("_n") * 7 + F.floor(F.col("_n") / 5), F.lit(3)).cast("int").alias("action"))
    return bt.replay_actions(px, actions, reward=reward)


@query
def replay_equity(spark, d):
    return _replayed(spark, d).select("symbol", "ts", ln6("portfolio_value").alias("ln_value"))


@query
def replay_rewards(spark, d):
    return _replayed(spark, d).select("symbol", "ts", r6("reward").alias("reward"), "terminated")


@query
def replay_info(spark, d):
    return _replayed(spark, d, "pnl").select("symbol", "ts", F.round("current_capital", 4).alias("current_capital"), r6("current_position").alias("current_position"), r6("current_price").alias("current_price"), F.round("reward", 4).alias("reward"))


# Live rules: accounts and positions from the orders


CAP, AMOUNT = 1_500_000.0, 200_000.0


def _positions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.groupBy(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("symbol")).agg(F.count("*").cast("double").alias("qty"), F.round(F.sum("o_totalprice"), 2).alias("market_value"))


@query
def portfolio_value(spark, d):
    return decide.portfolio_value(_positions(spark, d)).select("account", F.round("total", 2).alias("total"))


@query
def largest_position(spark, d):
    p = _positions(spark, d)
    return decide.largest_position(p, _universe(p))


@query
def cap_liquidate(spark, d):
    p = _positions(spark, d)
    return decide.over_cap_liquidate(p, _universe(p), CAP)


@query
def order_size(spark, d):
    return _bars(spark, d).select(clean.normalise_symbol(F.concat("symbol", F.lit("/USD"))).alias("symbol"), "ts", r6(decide.size_order(F.col("close"))).alias("qty"))


@query
def headroom_budget(spark, d):
    p = _positions(spark, d)
    totals = decide.portfolio_value(p)
    candidates = p.select("account", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("cycle"), "symbol", "qty").where("pmod(qty, cycle) = 0").drop("qty")
    return decide.headroom_budget(candidates, totals, _universe(p), CAP, AMOUNT).select("account", "cycle", "symbol", "accepted")


def _scored_ticks(t: DataFrame) -> DataFrame:
    return t.withColumn("score", F.pmod(F.col("price") * 7, F.lit(100.0)) / 100)


@query
def decide_cooldown(spark, d):
    return decide.cooldown(_scored_ticks(_events(spark, d)))


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return ticks(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*"))


def _folder(spark: SparkSession) -> str:
    """A new folder where driver and executors can both write: under ``spark.checkpoint.dir``; where that is unset (tests), a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


# Sources and sinks: what is written is read again


@query
def io_bars(spark, d):
    """Bars as three formats and as a stream of files, each read with its types."""
    path = _folder(spark)
    bars = _bars(spark, d)
    for fmt in ("parquet", "csv", "json"):
        bars.write.format(fmt).save(f"{path}/{fmt}")
    read = [io.read_bars(spark, f"{path}/{fmt}", fmt).withColumn("via", F.lit(fmt)) for fmt in ("parquet", "csv", "json")]
    streamed = jobs.drain(io.stream_bars(spark, f"{path}/parquet"), f"{path}/drained").withColumn("via", F.lit("stream"))
    return rounded(read[0].union(read[1]).union(read[2]).union(streamed), *OHLCV)


@query
def io_positions(spark, d):
    """Holdings of which some quantities are 0."""
    path = _folder(spark)
    _positions(spark, d).withColumn("qty", F.col("qty") - 1).write.parquet(path)
    return io.read_positions(spark, path)


@query
def io_trades(spark, d):
    path = _folder(spark)
    io.write_trades(bt.trade_log(_tested(spark, d)), f"{path}/trades")
    t = spark.read.parquet(f"{path}/trades")
    return t.select("symbol", "ts", "type", r6("price").alias("price"), ln6("units").alias("ln_units"), ln6("equity").alias("ln_equity"))


@query
def io_order_intents(spark, d):
    path = _folder(spark)
    p = _positions(spark, d)
    io.write_order_intents(decide.over_cap_liquidate(p, _universe(p), CAP), path)
    return spark.read.parquet(path).groupBy("symbol", "side").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query
def stream_dedupe(spark, d):
    """One tick of each account and symbol an hour; which one is left open, so its cycle is what is compared."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    marked = raw.select(F.pmod("user_id", F.lit(5)).alias("account"), F.col("event_type").alias("symbol"), "ts")
    out = jobs.drain(jobs.dedupe_ticks(marked, "60 minutes", "40 days"), _folder(spark))
    return out.select("account", "symbol", F.col("cycle").cast("timestamp_ntz").alias("cycle"))


#: Events that one file of a stream is made for, and the least that it gets where a stretch of time has several.
FILE_ROWS, LEAST_ROWS = 500_000, 1000


def _in_turn(spark, d, path: str, parts: int = 4, late: str | None = None) -> DataFrame:
    """The ticks as a stream of files, one stretch of time a micro-batch: the events are cut into stretches and written one after another.

    All stretches with rows have as many files, as a micro-batch takes that many: a file that came after the others of its stretch
    would be late. With ``late`` a tick goes by the time at which it comes: up to that much after its own, by a hash of its id.
    """
    events = spark.read.parquet(f"{d}/events.parquet")
    comes = F.col("ts") if late is None else F.col("ts") + F.expr(f"INTERVAL {late}") * (F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000)
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    cuts = [ends["a"] + (ends["b"] - ends["a"]) * k / parts for k in range(1, parts)] if ends["a"] is not None else []
    inside = [((comes >= F.lit(low)) if low else F.lit(True)) & ((comes < F.lit(high)) if high else F.lit(True)) for low, high in zip([None, *cuts], [*cuts, None], strict=True)]
    rows = [r for r in events.agg(*(F.count_if(c).alias(str(k)) for k, c in enumerate(inside))).first()]
    files = max(1, min(max(rows) // FILE_ROWS, min((n for n in rows if n), default=0) // LEAST_ROWS))
    for k, (c, n) in enumerate(zip(inside, rows, strict=True)):
        if n or not any(rows):
            events.where(c).repartition(files).write.parquet(f"{path}/in/{k}")
    return ticks(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in/*"))


@query
def stream_features(spark, d):
    """The second feature set kept up over several micro-batches, each from its own bars and one row of state a symbol."""
    path = _folder(spark)
    return rounded(jobs.feature_table(_in_turn(spark, d, path), path, EVERY), *clean.FEATURE_COLS)


@query
def stream_bars(spark, d):
    return rounded(jobs.drain(jobs.stream_ohlcv(_stream(spark, d), EVERY), _folder(spark)), *OHLCV)


@query
def stream_decide(spark, d):
    """Cooldown over a stream whose files overlap in time: each tick stands up to half an hour late."""
    path = _folder(spark)
    return jobs.drain(jobs.stream_decide(_scored_ticks(_in_turn(spark, d, path, late="30 minutes")), "40 minutes"), path)
