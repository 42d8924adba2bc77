"""Live decision rules: exposure caps, order sizes, headroom, cooldown."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rules' amounts, thresholds and pauses (seconds).
ORDER_AMOUNT, MAX_PORTFOLIO, MAX_TRADE = 50.0, 200.0, 100.0
SELL_BELOW, BUY_ABOVE, PAUSE_SELL, PAUSE_BUY = 0.61, 0.63, 3600, 600


def portfolio_value(positions: DataFrame) -> DataFrame:
    """Total market value of each account."""
    return positions.groupBy("account").agg(F.sum("market_value").alias("total"))


def largest_position(positions: DataFrame, universe: DataFrame) -> DataFrame:
    """The position of greatest market value of each account; ties go to the smaller priority number."""
    rows = positions.join(universe, "symbol")  # Spark sends the universe to all tasks if it is short
    best = rows.groupBy("account").agg(F.max_by(F.struct("symbol", "qty", "market_value"), F.struct("market_value", -F.col("priority"))).alias("p"))
    return best.select("account", "p.*")


def over_cap(positions: DataFrame, cap: float = MAX_PORTFOLIO) -> DataFrame:
    """Accounts at or over the cap: no buys in this cycle."""
    return portfolio_value(positions).where(F.col("total") >= cap)


def over_cap_liquidate(positions: DataFrame, universe: DataFrame, cap: float = MAX_PORTFOLIO) -> DataFrame:
    """A SELL intent for the largest position of each account at or over the cap."""
    return largest_position(positions, universe).join(over_cap(positions, cap), "account").select("account", "symbol", F.lit("SELL").alias("side"), "qty")


def size_order(price: Column, amount: float = ORDER_AMOUNT, most: float = MAX_TRADE) -> Column:
    """Quantity for the amount; missing (rejected) if the price is not above 0 or the notional is over the limit."""
    qty = F.try_divide(F.lit(amount), price)
    return F.when((price > 0) & (qty * price <= most), qty)


def headroom_budget(candidates: DataFrame, totals: DataFrame, universe: DataFrame, cap: float = MAX_PORTFOLIO, amount: float = ORDER_AMOUNT) -> DataFrame:
    """Buy candidates (account, cycle, symbol) in the universe's order, marked ``accepted`` while the account has room for the amount."""
    rows = candidates.join(universe, "symbol").join(totals, "account", "left")
    rank = F.row_number().over(Window.partitionBy("account", "cycle").orderBy("priority"))
    room = F.floor((F.lit(cap) - F.coalesce("total", F.lit(0.0))) / F.lit(amount))
    return rows.withColumn("accepted", (rank <= room) & (F.coalesce("total", F.lit(0.0)) < cap))


def step(held: bool, until: float, now: float, score: float | None) -> tuple[str | None, bool, float]:
    """One tick of a symbol: the side taken if any, and the state after it. Sell goes first; a pause ends exactly at ``until``."""
    if now < until or score is None or score != score:
        return None, held, until
    if held and score < SELL_BELOW:
        return "SELL", False, now + PAUSE_SELL
    if not held and score > BUY_ABOVE:
        return "BUY", True, now + PAUSE_BUY
    return None, held, until


def walk(now: np.ndarray, score: np.ndarray, held: bool, until: float) -> tuple[np.ndarray, list[str], bool, float]:
    """As ``step`` for one tick after another in the order of time: which ticks act, their sides, and the state after all. Work grows with the acts."""
    may = np.flatnonzero(score > BUY_ABOVE), np.flatnonzero(score < SELL_BELOW)
    at, sides = [], []
    while True:
        own = may[held]
        k = np.searchsorted(own, np.searchsorted(now, until, "left"))
        if k == len(own):
            return np.array(at, np.int64), sides, held, until
        at.append(int(own[k]))
        sides.append(("BUY", "SELL")[held])
        until = float(now[at[-1]]) + (PAUSE_BUY, PAUSE_SELL)[held]
        held = not held


def can_act(score: Column) -> Column:
    """Whether a tick of this score may be acted on in some state; other ticks leave every state as it is."""
    return ~F.isnan(score) & ((score < SELL_BELOW) | (score > BUY_ABOVE))


def _exits(now: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a stretch of ticks in order that may act: for each tick and for flat and held (columns), where a symbol that is free from that
    tick on acts next (n: nowhere), from which tick on it is free again after that, and when it is free after its last act (minus infinity: it never acts)."""
    n = len(now)
    act, free, until = np.full((n + 1, 2), n), np.full((n + 1, 2), n), np.full((n + 1, 2), -np.inf)
    pause = (PAUSE_BUY, PAUSE_SELL)
    may = np.stack([score > BUY_ABOVE, score < SELL_BELOW], axis=1)
    again = np.stack([np.searchsorted(now, now + p, "left") for p in pause], axis=1)
    for held in (0, 1):
        at = np.where(may[:, held], np.arange(n), n)
        act[:n, held] = np.minimum.accumulate(at[::-1])[::-1]
    for held in (0, 1):
        j = act[:n, held]
        free[:n, held] = np.where(j < n, again[np.minimum(j, n - 1), held], n) if n else n
    for i in range(n - 1, -1, -1):
        for held in (0, 1):
            j = act[i, held]
            if j < n:
                k = free[i, held]
                later = until[k, 1 - held] if k < n else -np.inf
                until[i, held] = later if later > -np.inf else now[j] + pause[held]
    return act, free, until


def _ends(now: np.ndarray, score: np.ndarray) -> list[tuple[int, float, bool, float]]:
    """What a stretch does to a state: for flat and held, by the tick from which the symbol is free, the state behind it. Rows (held, last time
    of a run of ticks, held after it, free from then on): different starts soon take the same way, so runs are few."""
    act, free, until = _exits(now, score)
    n, out = len(now), []
    turns = np.zeros((n + 1, 2), np.int64)  # whether the number of acts from a tick on is odd
    for i in range(n - 1, -1, -1):
        for held in (0, 1):
            if act[i, held] < n:
                turns[i, held] = 1 ^ turns[free[i, held], 1 - held]
    for held in (0, 1):
        same = (until[1:n, held] == until[: n - 1, held]) & (turns[1:n, held] == turns[: n - 1, held])
        for i in np.append(np.flatnonzero(~same), n - 1).tolist() if n else ():
            out.append((held, float(now[i]), bool(held ^ turns[i, held]), float(until[i, held])))
    return out


def cooldown(ticks: DataFrame, stretch: str = "6 hours") -> DataFrame:
    """Decisions of each symbol's ticks (symbol, ts, seq, score): ``symbol, ts, seq, side``; a tick without a time takes no side.

    Each tick acts on the state that earlier ones left. A symbol's ticks are cut into stretches of time (one hour at least, the
    longest pause): each is run from every start at once, as starts soon fall into the same way; the few different ends are
    chained along the symbol, and each stretch then runs from the state before it. So one busy symbol uses many tasks.
    """
    length = pd.Timedelta(stretch).total_seconds()
    if length < PAUSE_SELL:
        raise ValueError("a stretch is no shorter than the longest pause")
    second = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)
    rows = ticks.select("symbol", "ts", "seq", "score", F.floor(second / length).cast("long").alias("part")).where(can_act(F.col("score")) & F.col("ts").isNotNull())
    seconds = lambda ts: ts.astype("datetime64[us]").astype("int64").to_numpy() / 1e6
    ordered = lambda g: g.sort_values(["ts", "seq"])  # noqa: E731  a stretch of one symbol

    def sum_up(group: pd.DataFrame) -> pd.DataFrame:
        g = ordered(group)
        out = pd.DataFrame(_ends(seconds(g["ts"]), g["score"].to_numpy()), columns=["held", "upto", "then", "until"])
        return out.assign(symbol=g["symbol"].iloc[0], part=g["part"].iloc[0])

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        """The state before each stretch: as many rows at once as a symbol has stretches, with a few ends each."""
        held, until, starts = False, float("-inf"), []
        for part, ends in group.sort_values(["part", "held", "upto"]).groupby("part", sort=True):
            starts.append((group["symbol"].iloc[0], part, held, until))
            own = ends[(ends["held"] == int(held)) & (ends["upto"] >= until)]
            if len(own) and own["until"].iloc[0] > float("-inf"):
                held, until = bool(own["then"].iloc[0]), float(own["until"].iloc[0])
        return pd.DataFrame(starts, columns=["symbol", "part", "held", "until"])

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        g = ordered(group)
        now, score = seconds(g["ts"]), g["score"].to_numpy()
        act, free, _ = _exits(now, score)
        sides, held = np.full(len(g), None, object), int(g["held"].iloc[0])
        i = int(np.searchsorted(now, g["until"].iloc[0], "left"))
        while i < len(g) and act[i, held] < len(g):
            sides[act[i, held]] = ("BUY", "SELL")[held]
            i, held = int(free[i, held]), 1 - held
        out = g[["symbol", "ts", "seq"]].assign(side=sides)
        return out[out["side"].notna()]

    ends = rows.groupBy("symbol", "part").applyInPandas(sum_up, "symbol string, part long, held int, upto double, then boolean, until double")
    starts = ends.groupBy("symbol").applyInPandas(chain, "symbol string, part long, held boolean, until double")
    return rows.join(starts, ["symbol", "part"]).groupBy("symbol", "part").applyInPandas(walk, "symbol string, ts timestamp_ntz, seq long, side string")
