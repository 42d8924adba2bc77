"""Fixed-length feature sequences, scaling, and scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.clean import FEATURE_COLS, finite, series
from tidebar.functions.ewm import HOUR, Ewm, ewm, span
from tidebar.functions.scan import running
from tidebar.functions.windows import rolling_mean, sigmoid

from .bars import tail, with_halo
from .features import CHUNK
from .indicators import with_moves

LENGTH, LOOKBACK = 32, 100


def _step(cols: Sequence[str]) -> Column:
    return F.array(*(F.col(c).cast("float") for c in cols))


def sequence_tail(features: DataFrame, n: int = LENGTH, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """One matrix a symbol from its last n bars: ``symbol, ts`` (of the last bar), ``seq``; shorter series have none."""
    last = tail(features, n).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", _step(cols).alias("x")))).alias("rows")).where(F.size("rows") == n)
    return last.select("symbol", F.element_at("rows", -1)["ts"].alias("ts"), F.col("rows.x").alias("seq"))


def sequence_sliding(features: DataFrame, n: int = LENGTH, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """One matrix for each bar, ending with it; the first n-1 bars have none."""
    frame = series().rowsBetween(1 - n, Window.currentRow)
    return features.select("symbol", "ts", F.collect_list(_step(cols)).over(frame).alias("seq")).where(F.size("seq") == n)


def sequence_lookback(features: DataFrame, lookback: int = LOOKBACK, n: int = LENGTH, bar: int = HOUR, fast: int = 12, slow: int = 26, signal: int = 9, parallel: str | None = None, rows: int = CHUNK) -> DataFrame:
    """One matrix for each bar from the second feature set as computed over the ``lookback`` bars before it, the bar itself left out.

    Only the histogram remembers further back than the n steps allow. Started anew at each window's first bar s it is, with
    the unseeded scans Y and Z (of Y fast - Y slow) and d = t - s + 1: E(t) = Y(t) + q^d (x(s) - Y(s-1)), and for the
    signal Z(t) - p^d Z(s-1) plus a geometric sum for each start term. So no window is recomputed. ``parallel='chunk'`` cuts series into chunks
    of ``rows`` bar lengths, each with the bars before it that its first windows reach.
    """
    scans = ewm(features, [Ewm("yf", "close", span(fast), "adjusted"), Ewm("ys", "close", span(slow), "adjusted")], bar)
    unseed = lambda c, a: F.col(c) * (1 - F.pow(F.lit(1 - a), F.col("_n")))  # noqa: E731  back from normalised weights
    scans = running(scans, ["symbol"], {"_n": ("sum", F.lit(1))}, bar if parallel else None).withColumns({"yf": unseed("yf", span(fast)), "ys": unseed("ys", span(slow))}).withColumn("ym", F.col("yf") - F.col("ys"))
    scans = ewm(scans, [Ewm("z", "ym", span(signal), "adjusted")], bar).withColumn("z", unseed("z", span(signal)))
    w = series("symbol", "part") if parallel == "chunk" else series()
    if parallel == "chunk":
        scans = with_halo(scans, bar, rows, lookback + 1)
    elif parallel:
        raise ValueError("parallel is chunk or None")
    steps = F.struct(*(c for c in FEATURE_COLS), "yf", "ys", "ym", "z")
    lag0 = lambda c: F.coalesce(F.lag(c, lookback + 1).over(w), F.lit(0.0))
    start = F.lag("close", lookback).over(w)
    own = ~F.col("is_halo") if parallel else F.lit(True)
    rows = scans.select("symbol", "ts", "_n", own.alias("own"), F.collect_list(steps).over(w.rowsBetween(-n, -1)).alias("steps"), (start - lag0("yf")).alias("af"), (start - lag0("ys")).alias("as_"), lag0("z").alias("z0")).where((F.col("_n") > lookback) & F.col("own"))
    qf, qs, p = 1 - span(fast), 1 - span(slow), 1 - span(signal)

    def histogram(x: Column, k: Column) -> Column:
        d = (k + (lookback - n + 1)).cast("double")
        term = lambda q: F.pow(F.lit(q), d)
        line = x["ym"] + term(qf) * F.col("af") - term(qs) * F.col("as_")
        geometric = lambda q: q * (term(p) - term(q)) / (p - q)
        sig = x["z"] - term(p) * F.col("z0") + (1 - p) * (F.col("af") * geometric(qf) - F.col("as_") * geometric(qs))
        return line - sig

    seq = F.transform("steps", lambda x, k: F.array(*((histogram(x, k) if c == "macd" else x[c]).cast("float") for c in FEATURE_COLS)))
    return rows.select("symbol", "ts", seq.alias("seq"))


def sequence_lookback_v1(features: DataFrame, lookback: int = LOOKBACK, n: int = LENGTH, bar: int = HOUR, fast: int = 12, slow: int = 26, wilder: int = 14) -> DataFrame:
    """The same for the first feature set; ``features`` is that set over whole series, without missing prices.

    With s the window's first bar: Wilder sums of gains and losses are U(t) - q^(t-s) U(s), as the first bar has no change; the
    true range's first term is replaced by high less low; the line's averages start from the mean at m = s + length - 1:
    Y(t) + q^(t-m) (mean(m) - Y(m)). An RSI without any movement is 50.
    """
    if lookback - n < slow:
        raise ValueError("the first step must stand after the slow average's start")
    w, q = series(), 1 - 1 / wilder
    rows = with_moves(features).withColumns({"gain": F.coalesce("gain", F.lit(0.0)), "loss": F.coalesce("loss", F.lit(0.0)), "_n": F.row_number().over(w), "hl": F.col("high") - F.col("low"), "mf": rolling_mean("close", fast), "ms": rolling_mean("close", slow)})
    specs = [Ewm("yf", "close", span(fast), "adjusted"), Ewm("ys", "close", span(slow), "adjusted"), *(Ewm(f"u{c[0]}", c, 1 / wilder, "adjusted") for c in ("gain", "loss", "tr"))]
    rows = ewm(rows, specs, bar)
    rows = rows.withColumns({e.name: F.col(e.name) * (1 - F.pow(F.lit(1 - e.alpha), F.col("_n"))) for e in specs})
    lag = lambda c, k: F.lag(c, k).over(w)
    at = {f"{u}0": lag(u, lookback) for u in ("ug", "ul", "ut", "hl")} | {f"{y}0": lag(m, lookback - k + 1) - lag(y, lookback - k + 1) for y, m, k in (("yf", "mf", fast), ("ys", "ms", slow))}
    steps = F.collect_list(F.struct(*FEATURE_COLS, "yf", "ys", "ug", "ul", "ut")).over(w.rowsBetween(-n, -1))
    rows = rows.withColumns({**at, "steps": steps}).where(F.col("_n") > lookback)

    def value(c: str, x: Column, k: Column) -> Column:
        after = (k + (lookback - n)).cast("double")  # bars between s and the step
        fade = F.pow(F.lit(q), after)
        if c == "rsi":
            up, down = x["ug"] - fade * F.col("ug0"), x["ul"] - fade * F.col("ul0")
            return F.when(up + down > 1e-12, 100 * up / (up + down)).otherwise(50.0)
        if c == "atr":
            return (x["ut"] - fade * F.col("ut0") + fade * F.col("hl0") / wilder) / (1 - fade * q)
        if c == "macd":
            start = lambda y, m: x[y] + F.pow(F.lit(1 - span(m)), after - (m - 1)) * F.col(f"{y}0")
            return start("yf", fast) - start("ys", slow)
        return x[c]

    seq = F.transform("steps", lambda x, k: F.array(*(value(c, x, k).cast("float") for c in FEATURE_COLS)))
    return rows.select("symbol", "ts", seq.alias("seq"))


def fit_scaler(features: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """``feature, mean, std`` over all rows; population std, 1 where it is 0 or missing. One aggregation, one row a feature."""
    one = features.agg(*(x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.coalesce(F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(1.0)).alias("std")) for c in cols))
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def scale(features: DataFrame, stats: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """(x - mean) / std; a feature without stats stays. ``stats`` has one row a feature, so it is sent to all tasks."""
    wide = stats.groupBy().agg(*(F.max(F.when(F.col("feature") == c, F.struct("mean", "std"))).alias(f"_{c}") for c in cols))
    scaled = {c: F.when(F.col(f"_{c}").isNotNull(), (F.col(c) - F.col(f"_{c}.mean")) / F.col(f"_{c}.std")).otherwise(F.col(c)) for c in cols}
    return features.crossJoin(F.broadcast(wide)).withColumns(scaled).drop(*(f"_{c}" for c in cols))


def logistic(a: float = 20.0, b: float = 1.0, c: float = 10.0) -> Column:
    """A scorer without Python: over returns, RSI and MACD of one row."""
    return sigmoid(a * F.col("returns") + b * (F.col("rsi") - 50) / 50 + c * F.coalesce(F.try_divide("macd", "close"), F.lit(0.0)))


def numpy_scorer(load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Callable[[Column], Column]:
    """A scorer from a function over (rows, steps, features); ``load`` runs once in each Python worker."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = load()
        for batch in batches:
            ok = batch.notna()
            out = pd.Series(np.nan, index=batch.index)
            if ok.any():
                out[ok] = f(np.stack([np.stack(x) for x in batch[ok]]))
            yield out

    return run


def ml_score(features: DataFrame, model: Transformer, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """``score`` from a Spark ML classifier over the features of one row: the probability of label 1."""
    vector = array_to_vector(F.array(*(F.col(c).cast("double") for c in cols)))
    scored = model.transform(features.withColumn("features", vector))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def neutral_fallback(df: DataFrame, col: str = "score") -> DataFrame:
    """Missing and NaN scores become 0.5; ``score_status`` keeps the reason."""
    known = finite(F.col(col)).isNotNull()
    return df.withColumns({col: F.when(known, F.col(col)).otherwise(0.5), "score_status": F.when(known, F.lit("ok")).otherwise("no_score")})
