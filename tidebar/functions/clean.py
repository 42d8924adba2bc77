"""Cleaning of columns and rows. No function here returns NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.sources.bars import OHLCV

from .scan import running

KEYS = ("symbol", "ts")
# The feature columns in their order, and what a feature is where it can't be computed.
FEATURE_COLS = ("open", "high", "low", "close", "volume", "returns", "vol_14", "rsi", "macd", "atr", "bb_width")
FEATURE_DEFAULTS = {"returns": 0.0, "vol_14": 0.0, "rsi": 50.0, "macd": 0.0, "atr": 0.0, "bb_width": 0.0}

INF = float("inf")


def number(c: Column) -> Column:
    """The value as a double; what can't be read as one, and NaN, is missing."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(c: Column) -> Column:
    """Missing, NaN and infinite values as missing."""
    return F.when(~F.isnan(c) & (F.abs(c) != INF), c)


def null_to_zero(df: DataFrame, cols: Sequence[str] = OHLCV) -> DataFrame:
    return df.withColumns({c: F.coalesce(number(F.col(c)), F.lit(0.0)) for c in cols})


def to_numeric(df: DataFrame, cols: Sequence[str] = OHLCV) -> DataFrame:
    return df.withColumns({c: number(F.col(c)) for c in cols})


def scrub(df: DataFrame, cols: Sequence[str], default: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(default)) for c in cols})


def ensure_columns(df: DataFrame, policy: str = "zero") -> DataFrame:
    """``zero``: an absent OHLCV column becomes 0. ``defaults``: if any is absent, every feature becomes its default (OHLCV 0)."""
    absent = [c for c in OHLCV if c not in df.columns]
    if policy == "zero":
        return df.withColumns({c: F.lit(0.0) for c in absent}) if absent else df
    if policy != "defaults":
        raise ValueError("policy is zero or defaults")
    return df.select(*KEYS, *(F.lit(FEATURE_DEFAULTS.get(c, 0.0)).alias(c) for c in FEATURE_COLS)) if absent else df


def strip_tz(df: DataFrame, col: str = "ts") -> DataFrame:
    """Without zone, by the session's wall clock."""
    return df.withColumn(col, F.col(col).cast("timestamp_ntz"))


def series(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("ts")


def ffill(df: DataFrame, cols: Sequence[str], bar: int | None = None) -> DataFrame:
    """With ``bar`` chunk by chunk."""
    return running(df, ["symbol"], {c: ("last", F.col(c)) for c in cols}, bar)


def bfill_leading(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """After ``ffill`` only leading gaps remain; they take the series' first value, from one aggregate row a symbol."""
    first = df.groupBy("symbol").agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"first_{c}") for c in cols))
    return df.join(first, "symbol").withColumns({c: F.coalesce(c, f"first_{c}") for c in cols}).drop(*(f"first_{c}" for c in cols))


def fill_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in FEATURE_DEFAULTS.items() if c in df.columns})


def project_features(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys and the features in their order; an absent one is its default."""
    return df.select(*keys, *(F.col(c) if c in df.columns else F.lit(FEATURE_DEFAULTS.get(c, 0.0)).alias(c) for c in FEATURE_COLS))


def recent(df: DataFrame, end: Column, hours: int = 6) -> DataFrame:
    """Rows of the closed range of ``hours`` up to ``end``, which is always an argument."""
    return df.where(F.col("ts").between(end - F.expr(f"INTERVAL {hours} HOURS"), end))


def min_rows(df: DataFrame, n: int) -> DataFrame:
    """Only series of n rows or more."""
    long_ones = df.groupBy("symbol").count().where(F.col("count") >= n).select("symbol")
    return df.join(long_ones, "symbol", "left_semi")


def universe(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the universe's symbols, with their priority; ``names`` is a short list of ``symbol, priority``."""
    return df.join(names, "symbol")


def normalise_symbol(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit(""))
