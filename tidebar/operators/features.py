"""The two feature sets. They share names but not definitions: see the indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.clean import FEATURE_COLS, FEATURE_DEFAULTS, bfill_leading, ensure_columns, ffill, fill_defaults, null_to_zero, project_features, scrub, series, to_numeric
from tidebar.functions.ewm import HOUR
from tidebar.functions.windows import pct_change_inf, raw_change, rolling_std
from tidebar.sources.bars import OHLCV

from . import indicators as ind
from .bars import with_halo

#: Rows that the finite-memory features look back, and bars of a chunk where series are cut.
HALO, CHUNK = 20, 4096


def _cut(base: DataFrame, bar: int, parallel: str | None, rows: int) -> tuple[DataFrame, WindowSpec]:
    """Rows and the window of the finite-memory features: by series, or by chunks with a halo."""
    if parallel == "chunk":
        return with_halo(base, bar, rows, HALO), series("symbol", "part")
    if parallel:
        raise ValueError("parallel is chunk or None")
    return base, series()


def _own(rows: DataFrame, parallel: str | None) -> DataFrame:
    return rows.where("NOT is_halo").drop("part", "is_halo") if parallel else rows


def add_features_v1(df: DataFrame, bar: int = HOUR, leak_free: bool = False, keep_inf: bool = False, parallel: str | None = None, rows: int = CHUNK) -> DataFrame:
    """Wilder RSI and ATR, MACD line, band width in percent; gaps filled forward, then backward (``leak_free``: by defaults).

    ``bar`` is the usual bar length in seconds; it only deals out the work.
    If an OHLCV column is absent every feature is its default. ``keep_inf`` keeps infinite returns where a price leaves 0.
    Exponential averages read missing prices as the last one before (0 at the start of a series). ``parallel='chunk'`` cuts
    series into chunks of ``rows`` bars, fills included; gaps do no harm.
    """
    if any(c not in df.columns for c in OHLCV):
        return ensure_columns(df, "defaults")
    base, w = _cut(to_numeric(df), bar, parallel, rows)
    base = base.withColumn("_raw", raw_change("close", w))
    base = base.withColumn("returns", pct_change_inf("close", w) if keep_inf else F.coalesce("_raw", F.lit(0.0)))
    base = _own(ind.with_moves(base, w).withColumn("vol_14", rolling_std("_raw", 14, w)).withColumn("bb_width", ind.bb_width_pct(w=w)), parallel)
    by_chunk = bar if parallel else None
    safe = ffill(base.withColumn("_close", F.col("close")), ["close"], by_chunk).withColumn("close", F.coalesce("close", F.lit(0.0))).withColumn("tr", F.coalesce("tr", F.lit(0.0)))
    out = ind.v1_averages(safe, bar).withColumn("close", F.col("_close"))
    filled = ffill(out, FEATURE_COLS, by_chunk)
    return project_features(fill_defaults(filled if leak_free else bfill_leading(filled, FEATURE_COLS)))


def add_features_v2(df: DataFrame, bar: int = HOUR, parallel: str | None = None, rows: int = CHUNK) -> DataFrame:
    """Plain-average RSI and ATR, MACD histogram, band width as a ratio; never filled from other rows.

    ``parallel='chunk'`` cuts long series into chunks with a halo, so that one series runs on many tasks.
    """
    base, w = _cut(null_to_zero(ensure_columns(df, "zero")), bar, parallel, rows)
    out = scrub(ind.macd_hist(_own(v2_finite(base, w), parallel), bar=bar), FEATURE_COLS[5:])
    return project_features(out)


def v2_finite(base: DataFrame, w: WindowSpec) -> DataFrame:
    """The second set's features that look back ``HALO`` rows at most: all but the histogram."""
    full = ind.with_moves(base.withColumn("_raw", raw_change("close", w)), w)
    return full.withColumns({"returns": F.coalesce("_raw", F.lit(0.0)), "vol_14": rolling_std("_raw", 14, w), "rsi": ind.rsi_sma(14, w), "atr": ind.atr_sma(14, w), "bb_width": ind.bb_width_ratio(20, 2.0, w)})


def defaults() -> dict[str, float]:
    return dict(FEATURE_DEFAULTS)
