"""Exponentially weighted averages as a two-level scan.

A series is dealt out by time (``CHUNK`` bar lengths at once), and what lies in one such stretch is cut into chunks of at most
``CHUNK`` rows by count: bars of any length, and with gaps, give the same averages, and ``bar`` only says how the work is dealt
out. Inside a chunk the average is a running sum. A chunk's carry is the sum of the ends of the chunks before it, each faded by
the rows since; it looks back only as far as a double can see (``FADE``), so its frame is bounded, and works on one row for each
chunk. Values must not be missing (fill them first) and (symbol, ts) must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 256
HOUR = 3600
#: Weights under this one vanish beside any others in a double.
FADE = 1e-40


@dataclass(frozen=True)
class Ewm:
    """One average: ``name`` of the new column, source ``col``, decay ``alpha``, and how it starts.

    ``first``: from the first value, or from the average ``before`` it where that column has one. ``adjusted``: weights normalised to 1, missing before ``n`` values, and the first
    ``skip`` rows don't count. ``seeded``: the mean of the first n values is the n-th row's average, missing before it.
    """

    name: str
    col: str
    alpha: float
    start: str = "first"
    n: int = 1
    skip: int = 0
    before: str = ""


def span(n: int) -> float:
    return 2.0 / (n + 1)


def chunk_of(bar: int, rows: int = CHUNK) -> Column:
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000 * bar * rows)).cast("long")


def ewm(df: DataFrame, specs: Sequence[Ewm], bar: int = HOUR, rows: int = CHUNK) -> DataFrame:
    """df with a column for each spec; ``bar`` is the usual bar length in seconds."""
    if any((1 - s.alpha) ** -rows > 1e280 for s in specs):
        raise ValueError("shorter chunks are needed for so large an alpha")
    at = ["symbol", "_chunk", "_sub"]
    w = Window.partitionBy(*at).orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_chunk", chunk_of(bar, rows)).withColumn("_j", (F.row_number().over(Window.partitionBy("symbol", "_chunk").orderBy("ts")) - 1).cast("int"))
    out = out.withColumns({"_sub": F.floor(F.col("_j") / rows).cast("int"), "_j": F.col("_j") % rows})
    power = lambda s, e: F.pow(F.lit(1 - s.alpha), e)
    out = out.withColumns({f"_{s.name}": power(s, F.col("_j")) * F.sum(F.col(s.col) * F.lit(s.alpha) * power(s, -F.col("_j"))).over(upto) for s in specs})
    first = lambda s: F.coalesce(F.col(s.before), F.col(s.col)) if s.before else F.col(s.col)
    ends = out.groupBy(*at).agg(F.count("*").cast("int").alias("n"), *(F.max_by(f"_{s.name}", "ts").alias(f"e_{s.name}") for s in specs), *(F.min_by(first(s), "ts").alias(f"x_{s.name}") for s in specs))
    by_chunk = Window.partitionBy("symbol").orderBy("_chunk", "_sub")
    ends = ends.withColumn("after", F.sum(F.col("n").cast("long")).over(by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_at", F.col("after") - F.col("n"))
    seen = max(math.ceil(math.log(FADE) / math.log(max(1 - s.alpha, 1e-9))) for s in specs)
    near = Window.partitionBy("symbol").orderBy("_at").rangeBetween(-seen - rows, -1)
    ends = ends.withColumns({"near": F.collect_list(F.struct("after", *(f"e_{s.name}" for s in specs))).over(near), **{f"x_{s.name}": F.first(f"x_{s.name}").over(by_chunk) for s in specs if s.start == "first"}})

    def carry(s: Ewm) -> Column:
        faded = F.aggregate("near", F.lit(0.0), lambda acc, x: acc + x[f"e_{s.name}"] * power(s, F.col("_at") - x["after"]))
        return faded + F.col(f"x_{s.name}") * power(s, F.col("_at")) if s.start == "first" else faded

    carries = ends.select(*at, "_at", *(carry(s).alias(f"c_{s.name}") for s in specs))
    out = out.join(carries, at)
    out = out.withColumn("_i", F.col("_at") + F.col("_j"))
    values = {}
    for s in specs:
        y = F.col(f"_{s.name}") + F.col(f"c_{s.name}") * power(s, F.col("_j") + 1)
        if s.start == "adjusted":
            n = F.col("_i") + 1 - s.skip
            y = F.when(n >= s.n, y / (1 - power(s, n)))
        values[s.name] = y
    out = out.withColumns(values)
    seeded = [s for s in specs if s.start == "seeded"]
    if seeded:
        at = lambda s: F.col("_i") == s.n - 1
        seeds = out.where(F.col("_i") < max(s.n for s in seeded)).groupBy("symbol").agg(*(x for s in seeded for x in (F.avg(F.when(F.col("_i") < s.n, F.col(s.col))).alias(f"m_{s.name}"), F.max(F.when(at(s), F.col(s.name))).alias(f"y_{s.name}"))))
        out = out.join(seeds, "symbol")
        out = out.withColumns({s.name: F.when(F.col("_i") >= s.n - 1, F.col(s.name) + power(s, F.col("_i") - (s.n - 1)) * (F.col(f"m_{s.name}") - F.col(f"y_{s.name}"))) for s in seeded})
        out = out.drop(*(f"{p}_{s.name}" for s in seeded for p in "my"))
    return out.drop("_chunk", "_sub", "_j", "_i", "_at", *(f"_{s.name}" for s in specs), *(f"c_{s.name}" for s in specs))


def reseed(full: Column, x: Column, alpha: float, lookback: int, w: Window, start: str = "first") -> Column:
    """The average as if it had begun ``lookback`` rows ago (that row included), from the unseeded scan ``full``.

    With fewer rows it begins at the series' first one. ``first`` starts from that row's value; ``adjusted`` normalises.
    """
    q = 1 - alpha
    d = F.least(F.row_number().over(w), F.lit(lookback))
    before = F.coalesce(F.lag(full, lookback).over(w), F.lit(0.0))
    raw = full - F.pow(F.lit(q), d) * before
    if start == "adjusted":
        return raw / (1 - F.pow(F.lit(q), d))
    first = F.coalesce(F.lag(x, lookback - 1).over(w), F.first(x).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return raw + F.pow(F.lit(q), d) * first
