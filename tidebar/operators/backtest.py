"""Backtests, action replay and performance without a loop over bars.

The position after a bar is the last actionable signal before or at it, so it comes from a window; each exit multiplies the
capital by (1-c)^2 x exit / entry, so capital is the exponential of a running sum.

What a stretch of bars does is a function of the position before it (flat or long) to the position, gain and entry after it.
Such functions compose, so a long series is cut into chunks: each is summed up from both positions at once, one row a chunk is
folded along the series, and each chunk then runs from what came before it. Capital, cost and threshold are apart: positions
and gains depend on the threshold alone, the cost enters by the number of exits, the capital as a factor. So a grid runs one
ledger for each different threshold and is widened to its settings after that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.ewm import HOUR, chunk_of
from tidebar.functions.scan import running

#: Bars before the first that counts, and bar lengths of a chunk.
WARMUP, CHUNK = 100, 4096


def classify(score: Column, thr: Column) -> Column:
    """1 above the threshold, -1 under 1 - threshold, both strictly, else 0; missing and NaN scores give 0."""
    ok = score.isNotNull() & ~F.isnan(score)
    return F.when(ok & (score > thr), 1).when(ok & (score < 1 - thr), -1).otherwise(0)


def classify_hysteresis(score: Column, held: Column, sell_below: float = 0.61, buy_above: float = 0.63) -> Column:
    ok = score.isNotNull() & ~F.isnan(score)
    return F.when(ok & held & (score < sell_below), "SELL").when(ok & ~held & (score > buy_above), "BUY")


def _run(rows: DataFrame, w: WindowSpec, start: Column, tag: str = "") -> DataFrame:
    """Positions and gains inside the window's partitions from the position ``start``: state, prev, entry (missing where it lies before
    the partition), the last entry so far, and at exits the logarithmic gain (missing where its entry lies before)."""
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = lambda name: F.col(f"{name}{tag}")
    since = F.col("_tsum") - F.coalesce("_tset", F.lit(0))  # toggles after the last plain signal
    out = rows.withColumn(f"state{tag}", F.pmod(F.coalesce(F.col("_held"), start) + since, F.lit(2)).cast("int"))
    out = out.withColumn(f"prev{tag}", F.coalesce(F.lag(c("state")).over(w), start))
    enters, exits = (c("state") == 1) & (c("prev") == 0), (c("state") == 0) & (c("prev") == 1)
    out = out.withColumns({f"_in{tag}": F.last(F.when(enters, F.col("close")), ignorenulls=True).over(upto), f"_exit{tag}": exits.cast("long")})
    out = out.withColumn(f"entry{tag}", F.lag(c("_in")).over(w))
    return out.withColumn(f"_gain{tag}", F.when(exits, F.log(F.col("close") / c("entry"))))


def _signals(rows: DataFrame, w: WindowSpec, buy: Column, sell: Column) -> DataFrame:
    """The last plain signal and the toggles so far: both signals at once, which a threshold under a half allows, turn the position around."""
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = F.coalesce(F.col("close") > 0, F.lit(False))
    out = rows.withColumns({"_b": F.coalesce(buy & live, F.lit(False)), "_s": F.coalesce(sell & live, F.lit(False))})
    out = out.withColumns({"_set": F.when(F.col("_b") & ~F.col("_s"), 1).when(F.col("_s") & ~F.col("_b"), 0), "_tog": (F.col("_b") & F.col("_s")).cast("int")})
    out = out.withColumns({"_held": F.last("_set", ignorenulls=True).over(upto), "_tsum": F.sum("_tog").over(upto)})
    return out.withColumn("_tset", F.last(F.when(F.col("_set").isNotNull(), F.col("_tsum")), ignorenulls=True).over(upto))


def _carries(marked: DataFrame, keys: Sequence[str], w: WindowSpec) -> DataFrame:
    """For each chunk what came before it: the position ``_start``, the last entry ``_e0``, gains ``_g0`` and exits ``_x0``, the bar before ``_was0``, and whether it is the last."""
    both = _run(_run(marked, w, F.lit(0), "0"), w, F.lit(1), "1")
    pick = lambda tag: F.struct(F.max_by(f"state{tag}", "ts").alias("state"), F.sum(f"_gain{tag}").alias("gain"), F.sum(f"_exit{tag}").alias("exits"), F.max(F.when((F.col(f"_exit{tag}") == 1) & F.col(f"entry{tag}").isNull(), F.col("close"))).alias("closes"), F.max_by(f"_in{tag}", "ts").alias("entry"))
    chunks = both.groupBy(*keys, "_part").agg(pick("0").alias("_flat"), pick("1").alias("_long"))
    over = Window.partitionBy(*keys).orderBy("_part")
    upto, before = over.rowsBetween(Window.unboundedPreceding, Window.currentRow), over.rowsBetween(Window.unboundedPreceding, -1)
    same, turns = F.when(F.col("_flat.state") == F.col("_long.state"), F.col("_flat.state")), (F.col("_flat.state") > F.col("_long.state")).cast("int")
    out = chunks.withColumns({"_cset": same, "_ctog": F.sum(turns).over(upto)})
    out = out.withColumns({"_h": F.last("_cset", ignorenulls=True).over(before), "_t": F.lag("_ctog", 1, 0).over(over), "_ts": F.last(F.when(F.col("_cset").isNotNull(), F.col("_ctog")), ignorenulls=True).over(before)})
    out = out.withColumn("_start", F.pmod(F.coalesce("_h", F.lit(0)) + F.col("_t") - F.coalesce("_ts", F.lit(0)), F.lit(2)).cast("int"))
    out = out.withColumn("_own", F.when(F.col("_start") == 1, F.col("_long")).otherwise(F.col("_flat")))
    out = out.withColumn("_e0", F.last("_own.entry", ignorenulls=True).over(before))
    gain = F.coalesce("_own.gain", F.lit(0.0)) + F.coalesce(F.log(F.col("_own.closes") / F.col("_e0")), F.lit(0.0))
    return out.select(*keys, "_part", "_start", "_e0", F.coalesce(F.sum(gain).over(before), F.lit(0.0)).alias("_g0"), F.coalesce(F.sum("_own.exits").over(before), F.lit(0)).alias("_x0"), F.lead("_part").over(over).isNull().alias("_end"))


def positions(rows: DataFrame, keys: Sequence[str], buy: Column, sell: Column, bar: int | None = None, size: int = CHUNK) -> DataFrame:
    """rows (with ``ts`` and ``close``) plus ``state, prev, entry, gains, exits, is_last``: what doesn't depend on capital or cost.

    A buy acts only when flat and a sell only when long; bars with a close of 0 or less, or none, have no signal. ``gains`` is the
    sum of the logarithms of exit by entry, and ``exits`` their number, before the bar's own trade. With ``bar`` (seconds) a
    series runs in chunks of ``size`` bar lengths; keys must not be missing then.
    """
    own = [*keys, "_part"]
    cut = rows.withColumn("_part", chunk_of(bar, size) if bar else F.lit(0).cast("long"))
    w = Window.partitionBy(*own).orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = _signals(cut, w, buy, sell)
    if bar:
        carries = _carries(marked, keys, w)
        marked = marked.join(carries, own)  # by the partitioning that the windows have, so nothing is dealt out again
    else:
        marked = marked.withColumns({"_start": F.lit(0), "_e0": F.lit(None).cast("double"), "_g0": F.lit(0.0), "_x0": F.lit(0).cast("long"), "_end": F.lit(True)})
    out = _run(marked, w, F.col("_start"))
    out = out.withColumn("entry", F.coalesce("entry", "_e0")).withColumn("_gain", F.coalesce(F.when(F.col("_exit") == 1, F.log(F.col("close") / F.col("entry"))), F.lit(0.0)))
    out = out.withColumns({"gains": F.col("_g0") + F.sum("_gain").over(upto) - F.col("_gain"), "exits": F.col("_x0") + F.sum("_exit").over(upto) - F.col("_exit"), "is_last": F.col("_end") & F.lead(F.lit(True)).over(w).isNull()})
    return out.drop(*(c for c in out.columns if c.startswith("_") and c not in rows.columns))


def priced(pos: DataFrame, capital: Column, cost: Column) -> DataFrame:
    """``positions`` with ``cap_before, units, equity_pre, equity_post``: before the bar's own trade, and after it."""
    keep = 1 - cost
    enters, exits = (F.col("state") == 1) & (F.col("prev") == 0), (F.col("state") == 0) & (F.col("prev") == 1)
    out = pos.withColumn("cap_before", capital.cast("double") * F.exp(F.col("gains") + 2 * F.col("exits") * F.log(keep)))
    out = out.withColumn("equity_pre", F.when(F.col("prev") == 1, F.col("cap_before") * keep * F.col("close") / F.col("entry")).otherwise(F.col("cap_before")))
    return out.withColumns({
        "units": F.when(enters, F.col("cap_before") * keep / F.col("close")).when(F.col("prev") == 1, F.col("cap_before") * keep / F.col("entry")).otherwise(0.0),
        "equity_post": F.when(enters, F.col("cap_before") * keep).when(exits, F.col("equity_pre") * keep).otherwise(F.col("equity_pre")),
    })


def ledger(rows: DataFrame, keys: Sequence[str], buy: Column, sell: Column, capital: Column, cost: Column, bar: int | None = None) -> DataFrame:
    """``positions`` of the rows, priced."""
    return priced(positions(rows, keys, buy, sell, bar), capital, cost)


def backtest(scored: DataFrame, params: DataFrame, warmup: int = WARMUP, bar: int | None = None, size: int = CHUNK) -> DataFrame:
    """Per parameter set, symbol and bar from number ``warmup`` on: the ledger and ``equity`` (the last bar's is after its trade).

    ``scored``: symbol, ts, close, score (of the bars before). ``params``: param_id, initial_capital, transaction_cost,
    prediction_threshold; how it is joined is left to Spark, which sends a short list to all tasks. There is one ledger for
    each symbol and different threshold, widened to all sets after it. With ``bar`` (seconds) long series run in chunks of
    ``size`` bar lengths. Series of ``warmup`` bars or fewer give no row.
    """
    numbered = running(scored, ["symbol"], {"_n": ("sum", F.lit(1))}, bar)
    none = F.coalesce("prediction_threshold", F.lit(float("inf")))  # without a threshold nothing is ever traded
    by = params.select(none.alias("_thr")).distinct()
    bars = numbered.where(F.col("_n") > warmup).drop("_n").crossJoin(by)
    score, thr = F.col("score"), F.col("_thr")
    ok = score.isNotNull() & ~F.isnan(score)
    pos = positions(bars, ["_thr", "symbol"], ok & (score > thr), ok & (score < 1 - thr), bar, size)
    wide = pos.join(params, F.col("_thr") == none).drop("_thr")
    out = priced(wide, F.col("initial_capital"), F.col("transaction_cost"))
    return out.withColumn("equity", F.when(F.col("is_last"), F.col("equity_post")).otherwise(F.col("equity_pre")))


def trade_log(bt: DataFrame) -> DataFrame:
    """A row for each trade, with the equity before it."""
    kind = F.when(F.col("state") == 1, "BUY").otherwise("SELL")
    return bt.where("state <> prev").select("param_id", "symbol", "ts", kind.alias("type"), F.col("close").alias("price"), "units", F.col("equity_pre").alias("equity"))


def round_trips(bt: DataFrame) -> DataFrame:
    """A row for each closed trade, and one for a position open at the end; its entry fee is not in the result."""
    closed = F.col("state") < F.col("prev")
    open_ = F.col("is_last") & (F.col("state") == 1)
    entry = F.when(F.col("prev") == 1, F.col("entry")).otherwise(F.col("close"))
    pnl = (F.col("close") - entry) * F.col("units") - F.col("units") * F.col("close") * F.col("transaction_cost")
    return bt.where(closed | open_).select("param_id", "symbol", "ts", entry.alias("entry_price"), F.col("close").alias("exit_price"), "units", pnl.alias("pnl"), open_.alias("is_open"))


def drawdown(bt: DataFrame, bar: int | None = None) -> DataFrame:
    out = running(bt.select("param_id", "symbol", "ts", "equity"), ["param_id", "symbol"], {"peak": ("max", F.col("equity"))}, bar)
    return out.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


def metrics(bt: DataFrame, bars_per_year: float = 252 * 24 * 60, bar: int = HOUR, size: int = CHUNK) -> DataFrame:
    """One row for each parameter set and symbol. ``sharpe`` is missing without returns or without variation; no trade gives 0 rates.

    No window over a series: each chunk of ``size`` bar lengths gives its greatest and least equity, its deepest fall, the number, mean
    and squares of its returns, and its ends; chunks are merged in order, with the return from one to the next.
    """
    at = ["param_id", "symbol"]
    entry = F.when(F.col("prev") == 1, F.col("entry")).otherwise(F.col("close"))
    trip = (F.col("state") < F.col("prev")) | (F.col("is_last") & (F.col("state") == 1))
    pnl = F.when(trip, (F.col("close") - entry) * F.col("units") - F.col("units") * F.col("close") * F.col("transaction_cost"))
    rows = bt.select(*at, "ts", "equity", "initial_capital", chunk_of(bar, size).alias("part"), ((F.col("state") == 1) & (F.col("prev") == 0)).alias("_buy"), pnl.alias("_pnl"))
    win, loss = F.when(F.col("_pnl") > 0, F.col("_pnl")), F.when(F.col("_pnl") <= 0, F.col("_pnl"))
    chunks = rows.groupBy(*at, "part").agg(
        F.first("initial_capital").alias("initial_capital"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "equity"))), lambda x: x["equity"]).alias("eq"),
        F.count_if("_buy").alias("n_trades"), F.count(win).alias("wins"), F.count(loss).alias("losses"), F.sum(win).alias("_win"), F.sum(loss).alias("_loss"))
    deepest = F.aggregate("eq", F.struct(F.lit(float("-inf")).alias("p"), F.lit(0.0).alias("d")), lambda a, x: F.struct(F.greatest(a["p"], x).alias("p"), F.least(a["d"], x / F.greatest(a["p"], x) - 1).alias("d")))["d"]
    over = Window.partitionBy(*at).orderBy("part")
    chunks = chunks.withColumns({"_d": deepest, "_top": F.array_max("eq"), "_low": F.array_min("eq"), "_was": F.lag(F.element_at("eq", -1)).over(over)})
    peak = F.max("_top").over(over.rowsBetween(Window.unboundedPreceding, -1))
    whole = F.when(F.col("_was").isNull(), F.col("eq")).otherwise(F.concat(F.array("_was"), "eq"))
    changes = F.filter(F.zip_with(F.slice(whole, 2, F.size(whole)), F.slice(whole, 1, F.size(whole) - 1), lambda y, x: F.try_divide(y, x) - 1), lambda r: r.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    chunks = chunks.withColumns({"_r": changes, "_dd": F.least("_d", F.col("_low") / peak - 1)})
    chunks = chunks.withColumns({"_n": F.size("_r"), "_m": F.try_divide(total(F.col("_r")), F.size("_r"))})
    chunks = chunks.withColumn("_q", F.aggregate("_r", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))))
    g = chunks.groupBy(*at).agg(
        F.first("initial_capital").alias("initial_capital"), F.max_by(F.element_at("eq", -1), "part").alias("final_capital"), F.min("_dd").alias("max_drawdown"), F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_m")).alias("_sum"),
        F.sum("_q").alias("_in"), F.sum(F.col("_n") * F.col("_m") * F.col("_m")).alias("_between"), *(F.sum(c).alias(c) for c in ("n_trades", "wins", "losses", "_win", "_loss")))
    mean = F.try_divide("_sum", "_n")
    squares = F.greatest(F.col("_in") + F.col("_between") - F.col("_n") * mean * mean, F.lit(0.0))
    g = g.withColumns({"_m": mean, "_s": F.sqrt(F.try_divide(squares, F.nullif(F.col("_n") - 1, F.lit(0)))), "avg_win": F.coalesce(F.try_divide("_win", "wins"), F.lit(0.0)), "avg_loss": F.coalesce(F.try_divide("_loss", "losses"), F.lit(0.0))})
    return g.select("param_id", "symbol", "initial_capital", "final_capital", ((F.col("final_capital") - F.col("initial_capital")) / F.col("initial_capital")).alias("total_return"),
                    (F.try_divide("_m", F.nullif("_s", F.lit(0.0))) * F.sqrt(F.lit(float(bars_per_year)))).alias("sharpe"), "max_drawdown", "n_trades", "wins", "losses",
                    F.coalesce(F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")), F.lit(0.0)).alias("win_rate"), "avg_win", "avg_loss")


def format_metrics(m: DataFrame) -> DataFrame:
    """Percentages and money as text, a missing Sharpe ratio as N/A."""
    pct = lambda c: F.format_string("%.2f%%", 100 * F.col(c))
    return m.select("param_id", "symbol", pct("total_return").alias("total_return"), F.when(F.col("sharpe").isNull(), "N/A").otherwise(F.format_string("%.2f", "sharpe")).alias("sharpe"),
                    pct("max_drawdown").alias("max_drawdown"), pct("win_rate").alias("win_rate"), F.format_string("$%.2f", "avg_win").alias("avg_win"), F.format_string("$%.2f", "avg_loss").alias("avg_loss"))


BUY, HOLD, SELL = 0, 1, 2


def replay_actions(bars: DataFrame, actions: DataFrame, capital: float = 10_000.0, cost: float = 0.001, start: int = 32, reward: str = "portfolio_return") -> DataFrame:
    """Positions, value and reward from a log of actions (symbol, ts, action); a bar without action holds. Bars count from ``start`` on.

    ``portfolio_value`` is after the bar's trade. Rewards are against the bar before, the first against the capital:
    ``portfolio_return`` relative, ``pnl`` absolute, any other name 0.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.select("symbol", "ts", "close", F.row_number().over(w).alias("_n")).where(F.col("_n") > start).drop("_n").join(actions.select("symbol", "ts", "action"), ["symbol", "ts"], "left")
    out = ledger(rows, ["symbol"], F.col("action") == BUY, F.col("action") == SELL, F.lit(capital), F.lit(cost)).withColumnRenamed("equity_post", "portfolio_value")
    before = F.lag("portfolio_value", 1, capital).over(w)
    change = {"portfolio_return": F.try_divide(F.col("portfolio_value") - before, before), "pnl": F.col("portfolio_value") - before}.get(reward, F.lit(0.0))
    held = F.when(F.col("state") == 1, F.col("units")).otherwise(0.0)
    return out.select("symbol", "ts", "action", F.when(F.col("state") == 1, 0.0).otherwise(F.col("portfolio_value")).alias("current_capital"), held.alias("current_position"), "portfolio_value", F.col("close").alias("current_price"), change.alias("reward"), F.col("is_last").alias("terminated"))
