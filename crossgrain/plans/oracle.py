"""DuckDB SQL that says what the queries compute."""

from __future__ import annotations

from ..sources.panel import bars_sql

SCALE = "15.8745"


def roll(how: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} >= {n} THEN {how}({x}) OVER w{n} END"


def windows(*sizes: int) -> str:
    frames = [f"w{n} AS (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes]
    return "WINDOW " + ", ".join(["w AS (PARTITION BY code ORDER BY date)", *frames])


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER w" if n >= 0 else f"lead({x}, {-n}) OVER w"


def base(period: str = "week") -> str:
    """CTEs up to ``f``: bars with all base factors and labels."""
    return f"""
b0 AS ({bars_sql(period)}),
b AS (SELECT * FROM b0 WHERE close > 0),
r1 AS (SELECT *, close / {lag('close')} - 1 AS ret_1d FROM b {windows()}),
r AS (SELECT *, {', '.join(f"{roll('sum', 'ret_1d', n)} AS ret_{n}d" for n in (5, 10, 20))} FROM r1 {windows(5, 10, 20)}),
t AS (SELECT *,
  {', '.join(f"{roll('stddev_samp', 'ret_1d', n)} * {SCALE} AS vol_{n}d" for n in (5, 10, 20))},
  {', '.join(f"{roll('avg', 'close', n)} AS ma_{n}" for n in (5, 10, 20, 60))},
  {', '.join(f"{roll('avg', 'volume', n)} AS vol_ma{n}" for n in (5, 20))}, {', '.join(f"{roll('avg', 'turnover', n)} AS turn_ma{n}" for n in (5, 20))},
  {', '.join(f"{roll('max', 'high', n)} AS high_{n}d, {roll('min', 'low', n)} AS low_{n}d" for n in (20, 60))},
  greatest(abs(high - low), abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr,
  CASE WHEN {lag('close')} IS NOT NULL THEN greatest(close - {lag('close')}, 0.0) END AS gain,
  CASE WHEN {lag('close')} IS NOT NULL THEN greatest({lag('close')} - close, 0.0) END AS loss,
  {roll('stddev_samp', 'close', 20)} AS sd20, volume / {lag('volume', 5)} - 1 AS vol_change_5d,
  CAST(ret_1d > CASE WHEN CAST(code AS VARCHAR) LIKE '30%' OR CAST(code AS VARCHAR) LIKE '68%' THEN 0.195 ELSE 0.095 END AS INTEGER) AS limit_up,
  CAST(ret_1d < -CASE WHEN CAST(code AS VARCHAR) LIKE '30%' OR CAST(code AS VARCHAR) LIKE '68%' THEN 0.195 ELSE 0.095 END AS INTEGER) AS limit_down,
  CAST(volume = 0 AS INTEGER) AS is_suspended FROM r {windows(5, 10, 20, 60)}),
u AS (SELECT *, {roll('avg', 'tr', 14)} AS atr_14, (close - ma_5) / ma_5 AS ma5_dist, (close - ma_20) / ma_20 AS ma20_dist,
  CAST(ma_5 > ma_20 AND {lag('ma_5')} <= {lag('ma_20')} AS INTEGER) AS ma5_ma20_cross, CAST(ma_5 < ma_20 AND {lag('ma_5')} >= {lag('ma_20')} AS INTEGER) AS ma5_ma20_dead,
  volume / vol_ma5 AS vol_ratio, volume / vol_ma20 AS vol_ratio_20, turnover / turn_ma5 AS turn_ratio,
  100 - 100 / (1 + {roll('avg', 'gain', 14)} / ({roll('avg', 'loss', 14)} + 1e-10)) AS rsi_14,
  ma_20 AS bb_mid, ma_20 + 2 * sd20 AS bb_upper, ma_20 - 2 * sd20 AS bb_lower, 4 * sd20 / ma_20 AS bb_width, (close - ma_20 + 2 * sd20) / (4 * sd20 + 1e-10) AS bb_pos,
  {roll('sum', 'limit_up', 5)} AS limit_up_5d,
  {', '.join(f"(close - low_{n}d) / (high_{n}d - low_{n}d + 1e-10) AS price_pos_{n}" for n in (20, 60))} FROM t {windows(5, 14)}),
s1 AS (SELECT *, atr_14 / close AS atr_ratio, CASE WHEN ({lag('ret_1d > 0')}) IS NULL OR ({lag('ret_1d > 0')}) <> (ret_1d > 0) THEN 1 ELSE 0 END AS cu,
  CASE WHEN ({lag('ret_1d < 0')}) IS NULL OR ({lag('ret_1d < 0')}) <> (ret_1d < 0) THEN 1 ELSE 0 END AS cd FROM u {windows()}),
s2 AS (SELECT *, sum(cu) OVER w AS gu, sum(cd) OVER w AS gd FROM s1 {windows()}),
f AS (SELECT * EXCLUDE (cu, cd, gu, gd, tr, gain, loss, sd20),
  CASE WHEN ret_1d IS NOT NULL THEN CAST(sum(CAST(ret_1d > 0 AS INTEGER)) OVER (PARTITION BY code, gu ORDER BY date) AS BIGINT) END AS up_streak,
  CASE WHEN ret_1d IS NOT NULL THEN CAST(sum(CAST(ret_1d < 0 AS INTEGER)) OVER (PARTITION BY code, gd ORDER BY date) AS BIGINT) END AS down_streak,
  {', '.join(f"{lag(f'ret_{n}d', -n)} AS fwd_{n}d" for n in (1, 5, 10, 20))} FROM s2 {windows()})"""


def rank(x: str, *by: str, down: bool = False) -> str:
    by = ", ".join(by)
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} {'DESC' if down else 'ASC'} NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


def corr(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def series(names: dict[str, str], horizons: list[str], method: str = "spearman", where: str = "TRUE", extra: str = "", source: str = "f") -> str:
    """CTEs ``p`` (pairs) and ``ic``. names: name to SQL over the source."""
    parts = " UNION ALL ".join(
        f"SELECT date, code{extra}, '{n}' AS name, '{h}' AS horizon, CAST({e} AS DOUBLE) AS x, CAST({h} AS DOUBLE) AS y FROM {source} WHERE {where}" for n, e in names.items() for h in horizons
    )
    key = "name, horizon, date"
    x, y = ("rx", "ry") if method == "spearman" else ("x", "y")
    return f"""p0 AS ({parts}),
p AS (SELECT * FROM p0 WHERE isfinite(x) AND isfinite(y)),
pr AS (SELECT *, {rank('x', key)} AS rx, {rank('y', key)} AS ry FROM p),
ic AS (SELECT {key}{extra}, {corr(x, y)} AS ic, count(*) AS n FROM pr GROUP BY {key}{extra} HAVING {corr(x, y)} IS NOT NULL)"""


def q(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0 AS {name}"
