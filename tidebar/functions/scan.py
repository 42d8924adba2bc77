"""Running values of a series, by one window a series or chunk by chunk.

With ``bar`` a series is cut into chunks as for averages: each chunk runs by itself, one row a chunk is carried on to the
chunks after it and joined back. A long series so runs on many tasks, and only its chunks' rows meet in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ewm import CHUNK, chunk_of

#: ``last``: the last value that isn't missing. ``prev``: the value of the row before. ``end``: whether no row follows (the value isn't read).
KINDS = ("sum", "max", "last", "prev", "end")


def _inside(kind: str, c: Column, w: Window) -> Column:
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {"sum": lambda: F.sum(c).over(upto), "max": lambda: F.max(c).over(upto), "last": lambda: F.last(c, ignorenulls=True).over(upto), "prev": lambda: F.lag(c).over(w), "end": lambda: F.lead(F.lit(True)).over(w).isNull()}[kind]()


def running(df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, Column]], bar: int | None = None, rows: int = CHUNK) -> DataFrame:
    """df with a column for each spec, name to (kind, value), in the order of ``ts``. Missing values add nothing to a sum."""
    if any(kind not in KINDS for kind, _ in specs.values()):
        raise ValueError(f"kinds are {', '.join(KINDS)}")
    value = {n: F.coalesce(c, F.lit(0)) if kind == "sum" else c for n, (kind, c) in specs.items()}
    if bar is None:
        w = Window.partitionBy(*keys).orderBy("ts")
        return df.withColumns({n: _inside(kind, value[n], w) for n, (kind, _) in specs.items()})
    at = [*keys, "_part"]
    own = df.withColumn("_part", chunk_of(bar, rows)).withColumns({f"_v_{n}": c for n, c in value.items()})
    w, over = Window.partitionBy(*at).orderBy("ts"), Window.partitionBy(*keys).orderBy("_part")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    end = {
        "sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("ts"))), "prev": lambda c: F.max_by(F.struct(c.alias("x")), "ts"), "end": lambda c: F.lit(True),
    }
    carry = {
        "sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before), "last": lambda c: F.last(c, ignorenulls=True).over(before), "prev": lambda c: F.lag(c).over(over), "end": lambda c: F.lead(F.lit(True)).over(over).isNull(),
    }
    ends = own.groupBy(*at).agg(*(end[kind](F.col(f"_v_{n}")).alias(f"_c_{n}") for n, (kind, _) in specs.items()))
    carries = ends.select(*at, *(carry[kind](F.col(f"_c_{n}")).alias(f"_c_{n}") for n, (kind, _) in specs.items()))
    first = F.row_number().over(w) == 1
    local = own.withColumns({**{f"_l_{n}": _inside(kind, F.col(f"_v_{n}"), w) for n, (kind, _) in specs.items()}, "_first": first}).join(carries, at)

    def both(kind: str, n: str) -> Column:
        x, c = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        return {"sum": lambda: x + F.coalesce(c, F.lit(0)), "max": lambda: F.greatest(x, c), "last": lambda: F.coalesce(x, c), "prev": lambda: F.when(F.col("_first"), c["x"]).otherwise(x), "end": lambda: x & c}[kind]()

    return local.withColumns({n: both(kind, n) for n, (kind, _) in specs.items()}).drop("_part", "_first", *(f"_{p}_{n}" for p in "vcl" for n in specs))
