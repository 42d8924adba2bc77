"""Technical indicators: columns over a window, and frames where an exponential average is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.clean import series
from tidebar.functions.ewm import HOUR, Ewm, ewm, span
from tidebar.functions.windows import clip_high, clip_low, diff, rolling_mean, rolling_std


def true_range(w: WindowSpec | None = None) -> Column:
    """Greatest of high less low and both less the close before; the first row has high less low."""
    before = F.lag("close").over(w or series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_moves(df: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    """``gain`` and ``loss`` of the close, missing on the first row, and ``tr``."""
    d = df.withColumn("_d", diff("close", w)).withColumn("tr", true_range(w))
    return d.withColumn("gain", clip_low(F.col("_d"))).withColumn("loss", -clip_high(F.col("_d"))).drop("_d")


def rsi_sma(n: int = 14, w: WindowSpec | None = None) -> Column:
    """Over ``gain`` and ``loss``: plain averages; 50 without losses or before n changes."""
    rs = F.try_divide(rolling_mean("gain", n, w), F.nullif(rolling_mean("loss", n, w), F.lit(0.0)))
    return F.coalesce(100 - 100 / (1 + rs), F.lit(50.0))


def atr_sma(n: int = 14, w: WindowSpec | None = None) -> Column:
    return F.coalesce(rolling_mean("tr", n, w), F.lit(0.0))


def bollinger(n: int = 20, k: float = 2.0, w: WindowSpec | None = None, ddof: int = 1) -> tuple[Column, Column, Column]:
    """Middle, upper and lower band of the close."""
    mid, std = rolling_mean("close", n, w), rolling_std("close", n, w, ddof)
    return mid, mid + k * std, mid - k * std


def bb_width_ratio(n: int = 20, k: float = 2.0, w: WindowSpec | None = None) -> Column:
    """Width over the middle; 0 where it is missing or the middle is 0."""
    return F.coalesce(F.try_divide(2 * k * rolling_std("close", n, w), rolling_mean("close", n, w)), F.lit(0.0))


def bb_width_pct(n: int = 20, k: float = 2.0, w: WindowSpec | None = None, ddof: int = 0) -> Column:
    """Width in percent of the middle; missing before n rows."""
    return 100 * F.try_divide(2 * k * rolling_std("close", n, w, ddof), rolling_mean("close", n, w))


def rsi_wilder(df: DataFrame, n: int = 14, bar: int = HOUR, name: str = "rsi") -> DataFrame:
    """Wilder averages of gain and loss with normalised weights; missing before n changes or without any movement."""
    zeros = df.withColumns({"_g": F.coalesce("gain", F.lit(0.0)), "_l": F.coalesce("loss", F.lit(0.0))})
    out = ewm(zeros, [Ewm("_ag", "_g", 1 / n, "adjusted", n, 1), Ewm("_al", "_l", 1 / n, "adjusted", n, 1)], bar)
    return out.withColumn(name, F.try_divide(100 * F.col("_ag"), F.col("_ag") + F.col("_al"))).drop("_g", "_l", "_ag", "_al")


def atr_wilder(df: DataFrame, n: int = 14, bar: int = HOUR, name: str = "atr") -> DataFrame:
    return ewm(df, [Ewm(name, "tr", 1 / n, "adjusted", n)], bar)


def macd_line(df: DataFrame, fast: int = 12, slow: int = 26, bar: int = HOUR, name: str = "macd") -> DataFrame:
    """Difference of two averages that start from plain means; missing before ``slow`` rows."""
    out = ewm(df, [Ewm("_f", "close", span(fast), "seeded", fast), Ewm("_s", "close", span(slow), "seeded", slow)], bar)
    return out.withColumn(name, F.col("_f") - F.col("_s")).drop("_f", "_s")


def macd_parts(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, bar: int = HOUR, before: dict[str, str] | None = None) -> DataFrame:
    """``ema_fast``, ``ema_slow`` of the close and ``ema_signal`` of their difference, from the first value or from the averages in the columns ``before``."""
    of = (before or {}).get
    lines = ewm(df, [Ewm("ema_fast", "close", span(fast), before=of("ema_fast", "")), Ewm("ema_slow", "close", span(slow), before=of("ema_slow", ""))], bar).withColumn("_m", F.col("ema_fast") - F.col("ema_slow"))
    return ewm(lines, [Ewm("ema_signal", "_m", span(signal), before=of("ema_signal", ""))], bar).drop("_m")


def macd_of_parts() -> Column:
    return F.col("ema_fast") - F.col("ema_slow") - F.col("ema_signal")


def macd_hist(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, bar: int = HOUR, name: str = "macd") -> DataFrame:
    """Line less its own average, all averages starting from the first value."""
    return macd_parts(df, fast, slow, signal, bar).withColumn(name, macd_of_parts()).drop("ema_fast", "ema_slow", "ema_signal")


def v1_averages(df: DataFrame, bar: int = HOUR) -> DataFrame:
    """``rsi``, ``macd`` and ``atr`` of the first feature set from one scan instead of three."""
    zeros = df.withColumns({"_g": F.coalesce("gain", F.lit(0.0)), "_l": F.coalesce("loss", F.lit(0.0))})
    specs = [Ewm("_ag", "_g", 1 / 14, "adjusted", 14, 1), Ewm("_al", "_l", 1 / 14, "adjusted", 14, 1), Ewm("_f", "close", span(12), "seeded", 12), Ewm("_s", "close", span(26), "seeded", 26), Ewm("atr", "tr", 1 / 14, "adjusted", 14)]
    out = ewm(zeros, specs, bar)
    return out.withColumns({"rsi": F.try_divide(100 * F.col("_ag"), F.col("_ag") + F.col("_al")), "macd": F.col("_f") - F.col("_s")}).drop("_g", "_l", "_ag", "_al", "_f", "_s")
