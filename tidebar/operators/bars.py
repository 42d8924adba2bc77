"""Bars from ticks or shorter bars, gap filling, and rows picked by their place in a series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.clean import ffill, series
from tidebar.functions.ewm import chunk_of
from tidebar.sources.bars import OHLCV


def resample(df: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Longer bars from bars: first open, greatest high, least low, last close, summed volume; bins are closed and labelled left."""
    g = df.groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("ts"), *OHLCV)


def from_ticks(ticks: DataFrame, every: str = "1 hour") -> DataFrame:
    """Bars from single prices; equal times go by ``seq``."""
    order = F.struct("ts", "seq")
    g = ticks.groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("ts"), *OHLCV)


#: Bins that one row of the spine becomes.
STRETCH = 4096


def fill_gaps(bars: DataFrame, every: str = "5 minutes", policy: str = "ffill", parallel: str | None = None) -> DataFrame:
    """Every bin between a series' first and last bar. Empty bins: ``zero`` has all columns 0, ``ffill`` the last close and no volume, ``none`` missing values.

    Bins are made in stretches that are dealt out; ``parallel='chunk'`` fills forward chunk by chunk too.
    """
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    stretches = ends.select("symbol", "b", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {every} * {STRETCH}"))).alias("a")).repartition("symbol", "a")
    upto = F.least("b", F.col("a") + F.expr(f"INTERVAL {every} * {STRETCH - 1}"))
    spine = stretches.select("symbol", F.explode(F.sequence("a", upto, F.expr(f"INTERVAL {every}"))).alias("ts"))
    wide = spine.join(bars, ["symbol", "ts"], "left")
    if policy == "none":
        return wide
    if policy == "zero":
        return wide.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in OHLCV})
    if policy != "ffill":
        raise ValueError("policy is zero, ffill or none")
    bar = int(pd.Timedelta(every).total_seconds()) if parallel == "chunk" else None
    held = ffill(wide.withColumn("_c", F.col("close")), ["_c"], bar)
    return held.withColumns({**{c: F.coalesce(c, "_c") for c in OHLCV[:4]}, "volume": F.coalesce("volume", F.lit(0.0))}).drop("_c")


def limit_per_symbol(df: DataFrame, n: int = 500) -> DataFrame:
    """The earliest n rows of each series."""
    return df.withColumn("_n", F.row_number().over(series())).where(F.col("_n") <= n).drop("_n")


def tail(df: DataFrame, n: int = 32) -> DataFrame:
    """The last n rows of each series."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, *cols: str) -> DataFrame:
    """The last value of columns of each series, and its time."""
    return df.groupBy("symbol").agg(F.max("ts").alias("ts"), *(F.max_by(c, "ts").alias(c) for c in cols))


def with_halo(df: DataFrame, bar: int, rows: int, halo: int) -> DataFrame:
    """Rows dealt to ``part`` (stretches of ``rows`` bar lengths of time), each part with the ``halo`` rows of its series before it, marked in ``is_halo``.

    Windows of up to ``halo`` rows back then run by (symbol, part) instead of by symbol. The halo goes by rows, not by time: it may
    come from several parts back where there are gaps, so bars of any length give the same windows.
    """
    own = df.withColumn("part", chunk_of(bar, rows))
    rest = [c for c in df.columns if c not in ("symbol", "ts")]
    from_end = Window.partitionBy("symbol", "part").orderBy(F.desc("ts"))
    ends = own.withColumn("_k", F.row_number().over(from_end)).where(F.col("_k") <= halo).groupBy("symbol", "part").agg(F.collect_list(F.struct("ts", *rest)).alias("_rows"))
    near = F.flatten(F.collect_list("_rows").over(Window.partitionBy("symbol").orderBy("part").rowsBetween(-halo, -1)))  # each part has a row at least
    near = ends.select("symbol", "part", F.array_sort(near).alias("_near"))
    last = F.slice("_near", F.greatest(F.size("_near") - halo + 1, F.lit(1)), halo)
    before = near.select("symbol", "part", F.explode(last).alias("_x")).select("symbol", "_x.*", "part", F.lit(True).alias("is_halo"))
    return own.withColumn("is_halo", F.lit(False)).unionByName(before)
