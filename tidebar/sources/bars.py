"""Readers and writers of bars, positions, trades and order intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLCV = ("open", "high", "low", "close", "volume")
BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in OHLCV)])
POSITIONS = T.StructType([T.StructField("account", T.LongType()), T.StructField("symbol", T.StringType()), T.StructField("qty", T.DoubleType()), T.StructField("market_value", T.DoubleType())])


def _finite(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Typed minute bars of all series; NaN becomes null at this boundary."""
    raw = spark.read.format(fmt).schema(BARS).options(**options).load(path)
    return raw.select("symbol", "ts", *(_finite(c).alias(c) for c in OHLCV))


def stream_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """The same rows as a stream of files."""
    raw = spark.readStream.format(fmt).schema(BARS).options(**options).load(path)
    return raw.select("symbol", "ts", *(_finite(c).alias(c) for c in OHLCV))


def ticks(events: DataFrame, symbol: str = "event_type", price: str = "value", order: str = "event_id") -> DataFrame:
    """Single prices as rows ``symbol, ts, price, volume, seq``; ``seq`` settles equal times."""
    return events.select(F.col(symbol).alias("symbol"), "ts", F.col(price).alias("price"), F.lit(1.0).alias("volume"), F.col(order).alias("seq")).where(F.col("symbol").isNotNull() & F.col("ts").isNotNull())


def read_positions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Holdings with a quantity above zero."""
    return spark.read.format(fmt).schema(POSITIONS).load(path).where("qty > 0")


def write_series(df: DataFrame, path: str, mode: str = "error") -> None:
    """Trades, equity points or metrics, one folder for each symbol."""
    df.write.mode(mode).partitionBy("symbol").parquet(path)


write_trades = write_equity = write_metrics = write_series


def write_order_intents(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select("symbol", "side", "qty").write.mode(mode).parquet(path)
