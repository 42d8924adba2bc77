"""SQL that says what each query returns, by other algorithms where there are: recursion for averages and backtests."""

from __future__ import annotations

_BARS = """
ticks AS (SELECT event_type AS symbol, ts AS t, value AS price, event_id AS seq FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
bars AS (SELECT symbol, time_bucket(INTERVAL '1 hour', t) AS ts, first(price ORDER BY t, seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY t, seq) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)"""
_GAPS = (
    _BARS
    + """,
spine AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM bars GROUP BY symbol),
g0 AS (SELECT s.symbol, s.ts, b.open, b.high, b.low, b.close, b.volume FROM spine s LEFT JOIN bars b USING (symbol, ts)),
gz AS (SELECT symbol, ts, coalesce(open, 0.0::DOUBLE) AS open, coalesce(high, 0.0::DOUBLE) AS high, coalesce(low, 0.0::DOUBLE) AS low, coalesce(close, 0.0::DOUBLE) AS close, coalesce(volume, 0.0::DOUBLE) AS volume FROM g0),
g1 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM g0),
g AS (SELECT symbol, ts, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, coalesce(close, c) AS close, coalesce(volume, 0.0::DOUBLE) AS volume FROM g1)"""
)
_PX = "px AS (SELECT symbol, ts, 100 + open / 10 AS open, 100 + high / 10 AS high, 100 + low / 10 AS low, 100 + close / 10 AS close, volume FROM g)"


def _i(source: str) -> str:
    """Numbered rows with the moves from the row before."""
    return f"""
i0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM {source}),
i AS (SELECT *, CASE WHEN n = 1 THEN 0.0 WHEN pc = 0 AND close = 0 THEN 0.0 WHEN pc = 0 THEN NULL ELSE close / pc - 1 END AS raw,
  CASE WHEN n > 1 THEN greatest(close - pc, 0) END AS gain, CASE WHEN n > 1 THEN -least(close - pc, 0) END AS loss, CASE WHEN n = 1 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM i0)"""


def _mean(c: str, n: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) {w} = {n} THEN avg({c}) {w} END"


def _std(c: str, n: int, f: str = "stddev_samp") -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) {w} = {n} THEN {f}({c}) {w} END"


# Every recursive average at once: plain starts (e*), normalised ones (w*: sum and weight), and plain means as starts (s*).
_REC = f"""
m12 AS (SELECT *, {_mean("close", 12)} AS sma12, {_mean("close", 26)} AS sma26 FROM i),
rec AS (
 SELECT symbol, ts, n, close AS e12, close AS e26, 0.0::DOUBLE AS sig, close AS wc, 1.0::DOUBLE AS wn, 0.0::DOUBLE AS wg, 0.0::DOUBLE AS wl, 0.0::DOUBLE AS wd, tr AS wt, NULL::DOUBLE AS s12, NULL::DOUBLE AS s26 FROM m12 WHERE n = 1
 UNION ALL
 SELECT x.symbol, x.ts, x.n, x.e12, x.e26, r.sig * 0.8 + 0.2 * (x.e12 - x.e26), x.wc, x.wn, x.wg, x.wl, x.wd, x.wt, x.s12, x.s26 FROM (
  SELECT i.symbol, i.ts, i.n, r.e12 * (11.0 / 13) + i.close * (2.0 / 13) AS e12, r.e26 * (25.0 / 27) + i.close * (2.0 / 27) AS e26,
   r.wc * (13.0 / 14) + i.close AS wc, r.wn * (13.0 / 14) + 1 AS wn, r.wg * (13.0 / 14) + i.gain AS wg, r.wl * (13.0 / 14) + i.loss AS wl, r.wd * (13.0 / 14) + 1 AS wd, r.wt * (13.0 / 14) + i.tr AS wt,
   CASE WHEN i.n = 12 THEN i.sma12 WHEN i.n > 12 THEN r.s12 * (11.0 / 13) + i.close * (2.0 / 13) END AS s12,
   CASE WHEN i.n = 26 THEN i.sma26 WHEN i.n > 26 THEN r.s26 * (25.0 / 27) + i.close * (2.0 / 27) END AS s26
  FROM rec r JOIN m12 i ON i.symbol = r.symbol AND i.n = r.n + 1) x JOIN rec r ON r.symbol = x.symbol
)"""

_V2_COLS = f"""symbol, ts, n, open, high, low, close, volume, coalesce(raw, 0.0) AS returns, coalesce({_std("raw", 14)}, 0.0) AS vol_14,
 coalesce(100 - 100 / (1 + ({_mean("gain", 14)}) / nullif({_mean("loss", 14)}, 0)), 50.0) AS rsi, coalesce({_mean("tr", 14)}, 0.0) AS atr,
 coalesce(4 * ({_std("close", 20)}) / nullif({_mean("close", 20)}, 0), 0.0) AS bb_width"""


def _v2(source: str) -> str:
    return f"{_i(source)}, {_REC}, f0 AS (SELECT {_V2_COLS} FROM i), v2 AS (SELECT f0.*, r.e12 - r.e26 - r.sig AS macd FROM f0 JOIN rec r USING (symbol, n))".replace("JOIN rec r USING (symbol, n)", "JOIN (SELECT symbol, n, e12, e26, sig FROM rec) r USING (symbol, n)")


_SCORE = "1 / (1 + exp(-(20.0 * returns + 1.0 * (rsi - 50) / 50 + 10.0 * coalesce(macd / nullif(close, 0), 0.0))))"
_SCORED = f"{_GAPS}, {_PX}, {_v2('px')}, scored AS (SELECT symbol, ts, n, close, lag({_SCORE}) OVER (PARTITION BY symbol ORDER BY ts) AS score FROM v2)"

FEATURES = ("open", "high", "low", "close", "volume", "returns", "vol_14", "rsi", "macd", "atr", "bb_width")
OHLCV = FEATURES[:5]


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c.split('.')[-1]}" for c in cols)


def _x(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE AS {name}"


def _sql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes} {body}"


_DIRTY = """d0 AS (SELECT event_type AS symbol, ts, event_id, event_id % 11 AS k, value FROM events),
d AS (SELECT symbol, ts, event_id, CASE k WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN '1e3' WHEN 3 THEN NULL WHEN 4 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS open,
 CASE WHEN k = 5 THEN 'inf'::DOUBLE WHEN k = 6 THEN NULL ELSE value END AS high FROM d0),
dn AS (SELECT symbol, ts, event_id, CASE WHEN isnan(TRY_CAST(open AS DOUBLE)) THEN NULL ELSE TRY_CAST(open AS DOUBLE) END AS open, high FROM d)"""


def _bt(p_cap: str = "10000.0", p_cost: str = "0.001", p_thr: str = "0.51", params: str = "(SELECT 0 AS param_id) p") -> str:
    """A backtest bar by bar: capital and units carried from one to the next."""
    return f"""{_SCORED},
par AS MATERIALIZED (SELECT param_id, {p_cap}::DOUBLE AS cap0, {p_cost}::DOUBLE AS c, {p_thr}::DOUBLE AS thr FROM {params}),
b AS MATERIALIZED (SELECT par.*, s.symbol, s.ts, s.n, s.close, max(s.n) OVER (PARTITION BY s.symbol, par.param_id) AS last_n, coalesce(s.score > par.thr AND s.close > 0, false) AS buy, coalesce(s.score < 1 - par.thr AND s.close > 0, false) AS sell FROM scored s CROSS JOIN par WHERE s.n > 100),
run AS (
 SELECT param_id, symbol, n, ts, close, CASE WHEN buy THEN 0.0 ELSE cap0 END AS cap, CASE WHEN buy THEN cap0 * (1 - c) / close ELSE 0.0 END AS units, CASE WHEN buy THEN close END AS entry, cap0 AS pre, CASE WHEN buy THEN 'BUY' END AS side, CASE WHEN buy THEN cap0 * (1 - c) / close END AS moved, NULL::DOUBLE AS pnl FROM b WHERE n = 101
 UNION ALL
 SELECT b.param_id, b.symbol, b.n, b.ts, b.close,
  CASE WHEN r.units = 0 AND b.buy THEN 0.0 WHEN r.units > 0 AND b.sell THEN r.units * b.close * (1 - b.c) ELSE r.cap END,
  CASE WHEN r.units = 0 AND b.buy THEN r.cap * (1 - b.c) / b.close WHEN r.units > 0 AND b.sell THEN 0.0 ELSE r.units END,
  CASE WHEN r.units = 0 AND b.buy THEN b.close WHEN r.units > 0 AND b.sell THEN NULL ELSE r.entry END,
  r.cap + r.units * b.close, CASE WHEN r.units = 0 AND b.buy THEN 'BUY' WHEN r.units > 0 AND b.sell THEN 'SELL' END,
  CASE WHEN r.units = 0 AND b.buy THEN r.cap * (1 - b.c) / b.close WHEN r.units > 0 AND b.sell THEN r.units END,
  CASE WHEN r.units > 0 AND b.sell THEN (b.close - r.entry) * r.units - r.units * b.close * b.c END
 FROM run r JOIN b ON b.param_id = r.param_id AND b.symbol = r.symbol AND b.n = r.n + 1),
e AS (SELECT run.*, b.cap0, b.c, run.n = b.last_n AS is_last, CASE WHEN run.n = b.last_n THEN run.cap + run.units * run.close ELSE run.pre END AS equity FROM run JOIN b USING (param_id, symbol, n)),
trips AS (SELECT param_id, symbol, ts, pnl FROM e WHERE pnl IS NOT NULL UNION ALL SELECT param_id, symbol, ts, (close - entry) * units - units * close * c FROM e WHERE is_last AND units > 0),
dd AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER (PARTITION BY param_id, symbol ORDER BY n ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e WINDOW w AS (PARTITION BY param_id, symbol ORDER BY n)),
t AS (SELECT param_id, symbol, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses, avg(pnl) FILTER (pnl > 0) AS avg_win, avg(pnl) FILTER (pnl <= 0) AS avg_loss FROM trips GROUP BY ALL),
m0 AS (SELECT param_id, symbol, first(cap0) AS cap0, arg_max(equity, n) AS final_capital, avg(ret) AS m, stddev_samp(ret) AS s, min(dd) AS max_drawdown, count(*) FILTER (side = 'BUY') AS n_trades FROM dd GROUP BY ALL),
m AS (SELECT m0.param_id, m0.symbol, final_capital, final_capital / cap0 - 1 AS total_return, m / nullif(s, 0) * sqrt(252 * 24 * 60) AS sharpe, max_drawdown, n_trades, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses,
 coalesce(wins / nullif(wins + losses, 0), 0.0) AS win_rate, coalesce(avg_win, 0.0) AS avg_win, coalesce(avg_loss, 0.0) AS avg_loss FROM m0 LEFT JOIN t USING (param_id, symbol))"""


_REPLAY = f"""{_GAPS}, {_PX},
a AS MATERIALIZED (SELECT symbol, ts, close, n, (n * 7 + n // 5) % 3 AS action, max(n) OVER (PARTITION BY symbol) AS last_n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM px)),
run AS (
 SELECT symbol, ts, close, n, last_n, CASE WHEN action = 0 THEN 0.0 ELSE 10000.0::DOUBLE END AS cap, CASE WHEN action = 0 THEN 10000.0::DOUBLE * 0.999 / close ELSE 0.0 END AS units, 10000.0::DOUBLE AS before FROM a WHERE n = 33
 UNION ALL
 SELECT a.symbol, a.ts, a.close, a.n, a.last_n, CASE WHEN a.action = 0 AND r.units = 0 THEN 0.0 WHEN a.action = 2 AND r.units > 0 THEN r.units * a.close * 0.999 ELSE r.cap END,
  CASE WHEN a.action = 0 AND r.units = 0 THEN r.cap * 0.999 / a.close WHEN a.action = 2 AND r.units > 0 THEN 0.0 ELSE r.units END, r.cap + r.units * r.close FROM run r JOIN a ON a.symbol = r.symbol AND a.n = r.n + 1),
v AS (SELECT *, cap + units * close AS value FROM run)"""

_POS = """pos AS (SELECT o_custkey AS account, o_orderpriority AS symbol, CAST(count(*) AS DOUBLE) AS qty, round(sum(o_totalprice), 2) AS market_value FROM orders GROUP BY 1, 2),
tot AS (SELECT account, sum(market_value) AS total FROM pos GROUP BY 1),
uni AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS priority FROM (SELECT DISTINCT symbol FROM pos)),
big AS (SELECT account, symbol, qty, market_value FROM (SELECT pos.*, row_number() OVER (PARTITION BY account ORDER BY market_value DESC, priority) AS k FROM pos JOIN uni USING (symbol)) WHERE k = 1)"""

_COOL = """tk AS MATERIALIZED (SELECT event_type AS symbol, ts, event_id AS seq, (value * 7) % 100 / 100 AS score, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
run AS (
 SELECT symbol, ts, seq, n, score > 0.63 AS held, CASE WHEN score > 0.63 THEN now + 600 ELSE -1e18 END AS until, CASE WHEN score > 0.63 THEN 'BUY' END AS side FROM tk WHERE n = 1
 UNION ALL
 SELECT k.symbol, k.ts, k.seq, k.n, CASE WHEN k.now < r.until THEN r.held WHEN r.held AND k.score < 0.61 THEN false WHEN NOT r.held AND k.score > 0.63 THEN true ELSE r.held END,
  CASE WHEN k.now < r.until THEN r.until WHEN r.held AND k.score < 0.61 THEN k.now + 3600 WHEN NOT r.held AND k.score > 0.63 THEN k.now + 600 ELSE r.until END,
  CASE WHEN k.now < r.until THEN NULL WHEN r.held AND k.score < 0.61 THEN 'SELL' WHEN NOT r.held AND k.score > 0.63 THEN 'BUY' END
 FROM run r JOIN tk k ON k.symbol = r.symbol AND k.n = r.n + 1)"""

_CELLS = ", ".join(f"round(CAST(CAST(x.{c} AS FLOAT) AS DOUBLE), 3) + 0.0::DOUBLE AS {c}" for c in FEATURES)
_MATRIX = f"SELECT e.symbol, e.ts, x.n - e.n + 31 AS step, {_CELLS} FROM (SELECT symbol, ts, n, max(n) OVER (PARTITION BY symbol) AS last_n FROM v2) e JOIN v2 x ON x.symbol = e.symbol AND x.n BETWEEN e.n - 31 AND e.n WHERE e.n >= 32"

_V1 = f"""{_GAPS}, {_i("g")}, {_REC},
f AS (SELECT i.symbol, i.ts, i.n, i.open, i.high, i.low, i.close, i.volume, coalesce(i.raw, 0.0) AS returns, {_std("raw", 14).replace("symbol", "i.symbol").replace("BY ts", "BY i.ts")} AS vol_14,
 CASE WHEN i.n >= 15 THEN 100 * r.wg / nullif(r.wg + r.wl, 0) END AS rsi, r.s12 - r.s26 AS macd, CASE WHEN i.n >= 14 THEN r.wt / r.wn END AS atr,
 100 * 4 * ({_std("close", 20, "stddev_pop").replace("symbol", "i.symbol").replace("BY ts", "BY i.ts")}) / nullif({_mean("close", 20).replace("symbol", "i.symbol").replace("BY ts", "BY i.ts")}, 0) AS bb_width
 FROM i JOIN (SELECT symbol, n, wg, wl, s12, s26, wt, wn FROM rec) r USING (symbol, n))"""


def _filled(c: str, default: str) -> str:
    w = "PARTITION BY symbol ORDER BY ts ROWS"
    return f"round(coalesce(last_value({c} IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER ({w} BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), {default}::DOUBLE), 6) + 0.0::DOUBLE AS {c}"


_I, _IZ = f"{_GAPS}, {_i('g')}", f"{_GAPS}, {_i('gz')}"
_R = f"{_I}, {_REC}"
_F2 = f"{_GAPS}, {_v2('g')}"
_B = _bt()

_LOOK = f"""{_I},
m AS (SELECT b.symbol, b.n AS i, b.ts, x.n AS t, sum(u.close * (pow(11.0 / 13, x.n - u.n) * CASE WHEN u.n = b.n - 100 THEN 1 ELSE 2.0 / 13 END - pow(25.0 / 27, x.n - u.n) * CASE WHEN u.n = b.n - 100 THEN 1 ELSE 2.0 / 27 END)) AS m
 FROM i b JOIN i x ON x.symbol = b.symbol AND x.n BETWEEN b.n - 100 AND b.n - 1 JOIN i u ON u.symbol = b.symbol AND u.n BETWEEN b.n - 100 AND x.n WHERE b.n > 100 GROUP BY ALL),
h AS (SELECT a.symbol, a.ts, a.i, a.t, any_value(a.m) - sum(v.m * pow(0.8, a.t - v.t) * CASE WHEN v.t = a.i - 100 THEN 1 ELSE 0.2 END) AS macd
 FROM m a JOIN m v ON v.symbol = a.symbol AND v.i = a.i AND v.t <= a.t WHERE a.t IN (a.i - 1, a.i - 32) GROUP BY ALL)"""

ORACLE_SQL = {
    "bars_resample": _sql(_BARS, f"SELECT symbol, ts, {_r(*OHLCV)} FROM bars"),
    "bars_resample_days": _sql(_BARS, "SELECT symbol, time_bucket(INTERVAL '1 day', b.ts) AS ts, round(first(open ORDER BY b.ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY b.ts), 6) AS close, round(sum(volume), 6) AS volume FROM bars b GROUP BY 1, 2"),
    "bars_gapfill_zero": _sql(_GAPS, f"SELECT symbol, ts, {_r(*OHLCV)} FROM gz"),
    "bars_gapfill_ffill": _sql(_GAPS, f"SELECT symbol, ts, {_r(*OHLCV)} FROM g"),
    "bars_recent": _sql(_BARS, f"SELECT symbol, ts, {_r(*OHLCV)} FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL '6 hours'"),
    "bars_tail": _sql(_BARS, f"SELECT symbol, ts, {_r(*OHLCV)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 32"),
    "bars_limit": _sql(_BARS, f"SELECT symbol, ts, {_r(*OHLCV)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars) WHERE k <= 500"),
    "bars_latest": _sql(_BARS, "SELECT symbol, max(b.ts) AS ts, round(arg_max(close, b.ts), 6) AS close, round(arg_max(volume, b.ts), 6) AS volume FROM bars b GROUP BY 1"),
    "bars_min_rows": _sql(_BARS, f"SELECT symbol, ts, {_r(*OHLCV)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, dense_rank() OVER (ORDER BY symbol) AS p FROM bars) WHERE k <= 40 * p AND p > 2 AND symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 101)"),
    "bars_universe": _sql(_BARS, f"SELECT b.symbol, ts, {_r(*OHLCV)}, CAST(priority AS INTEGER) AS priority FROM bars b JOIN (SELECT symbol, row_number() OVER (ORDER BY symbol) AS priority FROM (SELECT DISTINCT symbol FROM bars)) u ON b.symbol = u.symbol WHERE priority <= 3"),
    "orders_daily": "SELECT o_orderpriority AS symbol, time_bucket(INTERVAL '1 day', o.o_orderdate) AS ts, round(first(o_totalprice ORDER BY o_orderdate, o_orderkey), 6) AS open, round(max(o_totalprice), 6) AS high, round(min(o_totalprice), 6) AS low, round(last(o_totalprice ORDER BY o_orderdate, o_orderkey), 6) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders o WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2",
    "clean_numeric": _sql(_DIRTY, "SELECT symbol, ts, event_id, round(open, 6) + 0.0::DOUBLE AS open FROM dn"),
    "clean_null_to_zero": _sql(_DIRTY, "SELECT symbol, ts, event_id, round(coalesce(open, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS open FROM dn"),
    "clean_scrub": _sql(_DIRTY, "SELECT symbol, ts, event_id, CASE WHEN high IS NULL OR isinf(high) THEN 0.0::DOUBLE ELSE round(high, 6) + 0.0::DOUBLE END AS high FROM d"),
    "clean_fill_chain": _sql(_GAPS, "SELECT symbol, ts, round(coalesce(last_value(c IGNORE NULLS) OVER w, first_value(c IGNORE NULLS) OVER a), 6) + 0.0::DOUBLE AS close, round(coalesce(last_value(volume IGNORE NULLS) OVER w, first_value(volume IGNORE NULLS) OVER a), 6) + 0.0::DOUBLE AS volume FROM (SELECT symbol, ts, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) > 5 THEN close END AS c, volume FROM g0) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "clean_missing_cols": _sql(_BARS, f"SELECT symbol, ts, {_r('open', 'high', 'low', 'close')}, {', '.join(f'{50.0 if c == 'rsi' else 0.0}::DOUBLE AS {c}' for c in FEATURES[4:])} FROM bars"),
    "clean_missing_defaults": _sql(_BARS, f"SELECT symbol, ts, {', '.join(f'{50.0 if c == 'rsi' else 0.0}::DOUBLE AS {c}' for c in FEATURES)} FROM bars"),
    "pct_change": _sql(_I, f"SELECT symbol, ts, {_x('coalesce(raw, 0.0)', 'returns')} FROM i"),
    "pct_change_zero": _sql(_IZ, f"SELECT symbol, ts, {_x('raw', 'raw')}, {_x('close - pc', 'diff')}, {_x('lag(close, 2) OVER (PARTITION BY symbol ORDER BY ts)', 'shift2')} FROM i"),
    "rolling_mean": _sql(_I, f"SELECT a.symbol, a.ts, CASE WHEN count(*) = 14 THEN round(avg(b.close), 6) + 0.0::DOUBLE END AS mean_14 FROM i a JOIN i b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 13 AND a.n GROUP BY 1, 2"),
    "rolling_std": _sql(_IZ, f"SELECT a.symbol, a.ts, CASE WHEN count(b.raw) = 14 THEN round(stddev_samp(b.raw), 6) + 0.0::DOUBLE END AS std_14 FROM i a JOIN i b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 13 AND a.n GROUP BY 1, 2"),
    "expanding_max": _sql(_I, f"SELECT symbol, ts, {_x('max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)', 'peak')} FROM i"),
    "ewm_span": _sql(_R, f"SELECT symbol, ts, {_x('e12', 'ema_12')}, {_x('e26', 'ema_26')} FROM rec"),
    "ewm_adjusted": _sql(_R, f"SELECT symbol, ts, {_x('CASE WHEN n >= 14 THEN wc / wn END', 'wilder')} FROM rec"),
    "ewm_seeded": _sql(_R, f"SELECT symbol, ts, {_x('s12', 'ema')} FROM rec"),
    "ewm_lookback": _sql(_I, "SELECT a.symbol, a.ts, round(sum(b.close * pow(11.0 / 13, a.n - b.n) * CASE WHEN b.n = greatest(1, a.n - 49) THEN 1 ELSE 2.0 / 13 END), 6) + 0.0::DOUBLE AS ema_50, round(sum(b.close * pow(11.0 / 13, a.n - b.n)) / sum(pow(11.0 / 13, a.n - b.n)), 6) + 0.0::DOUBLE AS adjusted_50 FROM i a JOIN i b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 49 AND a.n GROUP BY 1, 2"),
    "rsi_sma": _sql(_F2, f"SELECT symbol, ts, {_r('rsi')} FROM v2"),
    "rsi_wilder": _sql(_R, f"SELECT symbol, ts, {_x('CASE WHEN n >= 15 THEN 100 * wg / nullif(wg + wl, 0) END', 'rsi')} FROM rec"),
    "macd_line": _sql(_R, f"SELECT symbol, ts, {_x('s12 - s26', 'macd')} FROM rec"),
    "macd_hist": _sql(_R, f"SELECT symbol, ts, {_x('e12 - e26 - sig', 'macd')} FROM rec"),
    "true_range": _sql(_I, f"SELECT symbol, ts, {_r('tr')} FROM i"),
    "atr_sma": _sql(_F2, f"SELECT symbol, ts, {_r('atr')} FROM v2"),
    "atr_wilder": _sql(_R, f"SELECT symbol, ts, {_x('CASE WHEN n >= 14 THEN wt / wn END', 'atr')} FROM rec"),
    "bollinger": _sql(_I, f"SELECT symbol, ts, {_x(_mean('close', 20), 'mid')}, {_x(f'({_mean("close", 20)}) + 2 * ({_std("close", 20)})', 'upper')}, {_x(f'({_mean("close", 20)}) - 2 * ({_std("close", 20)})', 'lower')} FROM i"),
    "bb_width_ratio": _sql(_F2, f"SELECT symbol, ts, {_r('bb_width')} FROM v2"),
    "bb_width_pct": _sql(_I, f"SELECT symbol, ts, {_x(f'100 * 4 * ({_std("close", 20, "stddev_pop")}) / nullif({_mean("close", 20)}, 0)', 'bb_width')} FROM i"),
    "features_v1": _sql(_V1, f"SELECT symbol, ts, {_r('open', 'high', 'low', 'close', 'volume', 'returns')}, {_filled('vol_14', '0.0')}, {_filled('rsi', '50.0')}, {_filled('macd', '0.0')}, {_filled('atr', '0.0')}, {_filled('bb_width', '0.0')} FROM f"),
    "features_v2": _sql(_F2, f"SELECT symbol, ts, {_r(*FEATURES)} FROM v2"),
    "features_v2_chunked": _sql(_F2, f"SELECT symbol, ts, {_r(*FEATURES)} FROM v2"),
    "seq_tail": _sql(_F2, f"{_MATRIX} AND e.n = e.last_n"),
    "seq_sliding": _sql(_F2, _MATRIX),
    "seq_lookback": _sql(_LOOK, "SELECT symbol, ts, CAST(32 AS BIGINT) AS steps, round(CAST(CAST(max(macd) FILTER (t = i - 1) AS FLOAT) AS DOUBLE), 3) + 0.0::DOUBLE AS last_macd, round(CAST(CAST(max(macd) FILTER (t = i - 32) AS FLOAT) AS DOUBLE), 3) + 0.0::DOUBLE AS first_macd FROM h GROUP BY 1, 2"),
    "scaler_fit": _sql(_F2, " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) + 0.0::DOUBLE AS mean, round(coalesce(nullif(stddev_pop({c}), 0), 1), 6) + 0.0::DOUBLE AS std FROM v2" for c in FEATURES)),
    "scaler_apply": _sql(_F2, f"SELECT symbol, ts, {', '.join(_x(f'({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)', c) for c in FEATURES)} FROM v2"),
    "score_logistic": _sql(_F2, f"SELECT symbol, ts, {_x(_SCORE, 'score')} FROM v2"),
    "score_fallback": _sql(_SCORED, f"SELECT symbol, ts, {_x('coalesce(score, 0.5)', 'score')}, CASE WHEN score IS NULL THEN 'no_score' ELSE 'ok' END AS score_status FROM scored"),
    "signal_classify": _sql(_SCORED, "SELECT symbol, ts, CAST(CASE WHEN score > 0.51 THEN 1 WHEN score < 1 - 0.51 THEN -1 ELSE 0 END AS BIGINT) AS signal FROM scored"),
    "signal_hysteresis": _sql(_SCORED, "SELECT symbol, ts, CASE WHEN n % 2 = 0 AND score < 0.61 THEN 'SELL' WHEN n % 2 = 1 AND score > 0.63 THEN 'BUY' END AS side FROM scored"),
    "bt_state": _sql(_B, "SELECT symbol, ts, CAST(units > 0 AS BIGINT) AS state FROM e"),
    "bt_equity": _sql(_B, f"SELECT symbol, ts, {_x('ln(equity)', 'ln_equity')} FROM e"),
    "bt_trades": _sql(_B, f"SELECT symbol, ts, side AS type, {_x('close', 'price')}, {_x('ln(moved)', 'ln_units')}, {_x('ln(pre)', 'ln_equity')} FROM e WHERE side IS NOT NULL"),
    "bt_round_trips": _sql(_B, f"SELECT symbol, ts, {_x('entry_price', 'entry_price')}, {_x('exit_price', 'exit_price')}, {_x('pnl', 'pnl', 4)}, is_open FROM (SELECT symbol, ts, CASE WHEN pnl IS NULL THEN entry ELSE lag(entry) OVER (PARTITION BY symbol ORDER BY n) END AS entry_price, close AS exit_price, coalesce(pnl, (close - entry) * units - units * close * c) AS pnl, is_last AND units > 0 AS is_open, pnl IS NOT NULL OR (is_last AND units > 0) AS is_trip FROM e) WHERE is_trip"),
    "bt_drawdown": _sql(_B, f"SELECT symbol, ts, {_x('dd', 'drawdown')} FROM dd"),
    "bt_metrics": _sql(_B, f"SELECT symbol, {_x('final_capital', 'final_capital', 3)}, {_r('total_return', 'sharpe', 'max_drawdown', 'win_rate')}, n_trades, wins, losses, {_x('avg_win', 'avg_win', 3)}, {_x('avg_loss', 'avg_loss', 3)} FROM m"),
    "bt_metrics_fmt": _sql(_B, "SELECT symbol, printf('%.2f%%', 100 * total_return) AS total_return, CASE WHEN sharpe IS NULL THEN 'N/A' ELSE printf('%.2f', sharpe) END AS sharpe, printf('%.2f%%', 100 * max_drawdown) AS max_drawdown, printf('%.2f%%', 100 * win_rate) AS win_rate, printf('$%.2f', avg_win) AS avg_win, printf('$%.2f', avg_loss) AS avg_loss FROM m"),
    "bt_grid": _sql(_bt("(10000.0 + 100 * (param_id % 3))", "(0.001 + 0.0005 * (param_id % 4))", "(0.51 - 0.03 * (param_id % 5) + 0.06 * ((param_id % 10) // 5))", "(SELECT unnest(range(100)) AS param_id) p"), f"SELECT CAST(param_id AS BIGINT) AS param_id, symbol, {_x('ln(final_capital)', 'ln_final')}, {_r('max_drawdown')}, n_trades FROM m"),
    "replay_equity": _sql(_REPLAY, f"SELECT symbol, ts, {_x('ln(value)', 'ln_value')} FROM v"),
    "replay_rewards": _sql(_REPLAY, f"SELECT symbol, ts, {_x('value / coalesce(lag(value) OVER (PARTITION BY symbol ORDER BY n), 10000.0) - 1', 'reward')}, n = last_n AS terminated FROM v"),
    "replay_info": _sql(_REPLAY, f"SELECT symbol, ts, {_x('cap', 'current_capital', 4)}, {_x('units', 'current_position')}, {_x('close', 'current_price')}, {_x('value - coalesce(lag(value) OVER (PARTITION BY symbol ORDER BY n), 10000.0)', 'reward', 4)} FROM v"),
    "portfolio_value": _sql(_POS, "SELECT account, round(total, 2) AS total FROM tot"),
    "largest_position": _sql(_POS, "SELECT * FROM big"),
    "cap_liquidate": _sql(_POS, "SELECT account, symbol, 'SELL' AS side, qty FROM big JOIN tot USING (account) WHERE total >= 1500000.0"),
    "order_size": _sql(_BARS, f"SELECT symbol || 'USD' AS symbol, ts, {_x('CASE WHEN close > 0 AND 50.0 / close * close <= 100 THEN 50.0 / close END', 'qty')} FROM bars"),
    "headroom_budget": _sql(_POS, "SELECT account, cycle, symbol, row_number() OVER (PARTITION BY account, cycle ORDER BY priority) <= floor((1500000.0 - total) / 200000.0) AND total < 1500000.0 AS accepted FROM pos JOIN uni USING (symbol) JOIN tot USING (account) CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS cycle) WHERE qty % cycle = 0"),
    "decide_cooldown": _sql(_COOL, "SELECT symbol, ts, seq, side FROM run WHERE side IS NOT NULL"),
    "stream_bars": _sql(_BARS, f"SELECT symbol, ts, {_r(*OHLCV)} FROM bars WHERE ts + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"),
    "stream_decide": _sql(_COOL, "SELECT symbol, ts, seq, side FROM run WHERE side IS NOT NULL AND ts <= (SELECT max(ts) FROM tk WHERE score < 0.61 OR score > 0.63) - INTERVAL '40 minutes'"),
}
_OF = "PARTITION BY symbol ORDER BY ts"
_AGO = "WHERE ts + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"
# Queries that reach the rows of another in a different way, and those of what was written and read again.
ORACLE_SQL |= {name: ORACLE_SQL[of] for name, of in (("features_v1_chunked", "features_v1"), ("bt_drawdown_chunked", "bt_drawdown"), ("bt_state_chunked", "bt_state"), ("bt_equity_chunked", "bt_equity"), ("bt_trades_chunked", "bt_trades"), ("bt_grid_chunked", "bt_grid"), ("clean_strip_tz", "bars_resample"), ("io_trades", "bt_trades"))}
ORACLE_SQL |= {
    "running_chunked": _sql(_GAPS, f"SELECT symbol, ts, {_x(f'max(close) OVER ({_OF} ROWS UNBOUNDED PRECEDING)', 'peak')}, {_x(f'coalesce(sum(volume) OVER ({_OF} ROWS UNBOUNDED PRECEDING), 0.0)', 'total')}, {_x(f'last_value(close IGNORE NULLS) OVER ({_OF} ROWS UNBOUNDED PRECEDING)', 'held')}, {_x(f'lag(close) OVER ({_OF})', 'before')}, lead(ts) OVER ({_OF}) IS NULL AS is_last FROM g0"),
    "clean_empty": _sql(_BARS, f"SELECT symbol, ts, {', '.join(f'0.0::DOUBLE AS {c}' for c in FEATURES)} FROM bars WHERE volume < 0"),
    "score_numpy": _sql(_F2, f"SELECT symbol, ts, {_x('1 / (1 + exp(-20 * CAST(CAST(returns AS FLOAT) AS DOUBLE) - (CAST(CAST(rsi AS FLOAT) AS DOUBLE) - 50) / 50))', 'score')} FROM v2 WHERE n >= 32"),
    "io_bars": _sql(_BARS, f"SELECT symbol, ts, {_r(*OHLCV)}, unnest(['parquet', 'csv', 'json', 'stream']) AS via FROM bars"),
    "io_positions": _sql(_POS, "SELECT account, symbol, qty - 1 AS qty, market_value FROM pos WHERE qty > 1"),
    "io_order_intents": _sql(_POS, "SELECT symbol, 'SELL' AS side, count(*) AS n, sum(qty) AS qty FROM big JOIN tot USING (account) WHERE total >= 1500000.0 GROUP BY 1"),
    "stream_dedupe": "SELECT DISTINCT user_id % 5 AS account, event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS cycle FROM events",
    "stream_features": _sql(f"{_BARS.replace('bars AS (', 'bars0 AS (')}, bars AS (SELECT * FROM bars0 {_AGO}){_GAPS.removeprefix(_BARS)}, {_v2('g')}", f"SELECT symbol, ts, {_r(*FEATURES)} FROM v2"),
}
_FIVE = _BARS.replace("INTERVAL '1 hour'", "INTERVAL '5 minutes'")
_V1_FIVE = _V1.replace(_GAPS, _FIVE).replace("OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM g)", "OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars)")
_LOOK_ALL = _LOOK[len(_I) :].replace("WHERE a.t IN (a.i - 1, a.i - 32)", "WHERE a.t BETWEEN a.i - 32 AND a.i - 1")
_LOOK_FIVE = f"{_FIVE}, {_i('bars')}{_LOOK[len(_I):]}"
_S = "b.n - 100"


def _wilder(c: str) -> str:
    return f"sum({c} * pow(13.0 / 14, b.n - 1 - u.n))"


def _start(n: int) -> str:
    """An average that begins with the mean of the first n rows of the window, at its last row."""
    return f"sum(u.close * CASE WHEN u.n < {_S} + {n} THEN pow({n - 1}.0 / {n + 1}, {99 - n + 1}) / {n} ELSE 2.0 / {n + 1} * pow({n - 1}.0 / {n + 1}, b.n - 1 - u.n) END)"


_LOOK_V1 = f"""{_I},
l AS (SELECT b.symbol, b.ts, {_wilder("u.gain")} FILTER (u.n > {_S}) AS up, {_wilder("u.loss")} FILTER (u.n > {_S}) AS down, {_wilder(f"CASE WHEN u.n = {_S} THEN u.high - u.low ELSE u.tr END")} / {_wilder("1")} AS atr, {_start(12)} - {_start(26)} AS macd
 FROM i b JOIN i u ON u.symbol = b.symbol AND u.n BETWEEN {_S} AND b.n - 1 WHERE b.n > 100 GROUP BY b.symbol, b.ts, b.n)"""


def _f3(expression: str, name: str) -> str:
    return f"round(CAST(CAST({expression} AS FLOAT) AS DOUBLE), 3) + 0.0::DOUBLE AS {name}"


ORACLE_SQL |= {
    "features_v2_gappy": _sql(f"{_FIVE}, {_v2('bars')}", f"SELECT symbol, ts, {_r(*FEATURES)} FROM v2"),
    "features_v1_gappy": ORACLE_SQL["features_v1"].replace(_V1, _V1_FIVE),
    "features_v1_leak_free": _sql(_V1, f"SELECT symbol, ts, {_r(*FEATURES[:6])}, {', '.join(_x(f'coalesce(last_value({c} IGNORE NULLS) OVER ({_OF} ROWS UNBOUNDED PRECEDING), {50.0 if c == "rsi" else 0.0}::DOUBLE)', c) for c in FEATURES[6:])} FROM f"),
    "features_v1_keep_inf": _sql(_IZ, f"SELECT symbol, ts, {_x('CASE WHEN n > 1 AND pc = 0 AND close <> 0 THEN 999.0::DOUBLE ELSE coalesce(raw, 0.0) END', 'returns')} FROM i"),
    "seq_lookback_cells": _sql(_F2 + _LOOK_ALL, f"SELECT x.symbol, x.at AS ts, x.t - x.i + 32 AS step, {_CELLS} FROM (SELECT h.symbol, h.ts AS at, h.t, h.i, h.macd, {', '.join(f'v2.{c}' for c in FEATURES if c != 'macd')} FROM h JOIN v2 ON v2.symbol = h.symbol AND v2.n = h.t) x"),
    "seq_lookback_chunked": ORACLE_SQL["seq_lookback"].replace(_LOOK, _LOOK_FIVE),
    "seq_lookback_v1": _sql(_LOOK_V1, f"SELECT symbol, ts, CAST(32 AS BIGINT) AS steps, {_f3('CASE WHEN up + down > 1e-12 THEN 100 * up / (up + down) ELSE 50.0 END', 'rsi')}, {_f3('macd', 'macd')}, {_f3('atr', 'atr')} FROM l"),
}
