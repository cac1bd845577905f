"""The registered queries over the generic panel, each with the SQL that checks it.

Doubles are rounded to six places on both sides, counts are longs, and every order has a tie-break.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import average_rank, rounded, zscore
from ..operators import factors, gates, ic, live, portfolio, study, tensor, text
from ..sources import panel as bars
from ..sources import tables
from ..sources.session import with_package_path
from ..sources.tables import table
from . import dsl
from . import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, Callable[[], str]] = {}

NAMES = {"pull": "-ret_5d * vol_ratio_20", "dist": "ma5_dist", "calm": "-vol_10d"}
LABELS = ["fwd_1d", "fwd_5d", "fwd_10d", "fwd_20d"]
MIN_DAYS = 100


def query(sql: Callable[[], str] | None = None, round_to: int | None = 6):
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with_package_path(spark)
            out = f(spark, sf_dir)
            return rounded(out, round_to) if round_to is not None else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@cache
def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLE.items()}


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with all base factors, labels and the named candidates."""
    df = factors.labels(factors.base(bars.panel(spark, sf_dir)))
    return df.withColumns({n: F.expr(e) for n, e in NAMES.items()})


def series(spark, sf_dir, names=tuple(NAMES), labels=("fwd_5d",), *by, method="spearman") -> DataFrame:
    return ic.ic_series(featured(spark, sf_dir), list(names), list(labels), *by, method=method)


def with_f(rest: str, *more: str) -> str:
    return "WITH " + ",\n".join([o.base(), *more]) + "\n" + rest


def with_ic(rest: str, *more: str, labels=("fwd_5d",), names=None, **kw) -> str:
    return with_f(rest, o.series(names or NAMES, list(labels), **kw), *more)


# --- panel and factors


@query(lambda: f"WITH b AS ({bars.bars_sql()}) SELECT date, code, {', '.join(o.q(c, c, 8) for c in ('open', 'high', 'low', 'close', 'volume', 'amount', 'turnover'))} FROM b", 8)
def panel_bars(spark, sf_dir):
    return bars.panel(spark, sf_dir).select("date", "code", "open", "high", "low", "close", "volume", "amount", "turnover")


def _factor_columns() -> tuple[list[str], list[str]]:
    doubles = [f"ret_{n}d" for n in (1, 5, 10, 20)] + [f"vol_{n}d" for n in (5, 10, 20)] + [f"ma_{n}" for n in (5, 10, 20, 60)]
    doubles += ["vol_ma5", "vol_ma20", "atr_14", "atr_ratio", "ma5_dist", "ma20_dist", "vol_ratio", "vol_ratio_20", "vol_change_5d", "turn_ma5", "turn_ma20", "turn_ratio"]
    doubles += ["high_20d", "low_20d", "high_60d", "low_60d", "price_pos_20", "price_pos_60", "rsi_14", "bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pos"]
    whole = ["ma5_ma20_cross", "ma5_ma20_dead", "limit_up", "limit_down", "is_suspended", "up_streak", "down_streak", "limit_up_5d"]
    return doubles, whole


def _select_factors() -> str:
    doubles, whole = _factor_columns()
    return ", ".join([o.q(c, c) for c in doubles] + [f"CAST({c} AS BIGINT) AS {c}" for c in whole])


@query(lambda: with_f(f"SELECT date, code, {_select_factors()} FROM f"))
def factors_base(spark, sf_dir):
    doubles, whole = _factor_columns()
    df = factors.base(bars.panel(spark, sf_dir))
    return df.select("date", "code", *doubles, *[F.col(c).cast("long").alias(c) for c in whole])


def _ewm(x: str, span: int, name: str) -> str:
    a = 2 / (span + 1)
    return f"CASE WHEN count({x}) OVER w >= {span} THEN sum({x} * pow({1 - a!r}, -i)) OVER w / sum(CASE WHEN {x} IS NOT NULL THEN pow({1 - a!r}, -i) END) OVER w END AS {name}"


@query(lambda: f"""WITH b AS ({bars.bars_sql()}), n AS (SELECT date, code, close, CAST(row_number() OVER w AS DOUBLE) AS i FROM b WINDOW w AS (PARTITION BY code ORDER BY date)),
e AS (SELECT *, {_ewm('close', 12, 'e12')}, {_ewm('close', 26, 'e26')} FROM n WINDOW w AS (PARTITION BY code ORDER BY date)),
d AS (SELECT *, e12 - e26 AS macd_dif FROM e), g AS (SELECT *, {_ewm('macd_dif', 9, 'macd_dea')} FROM d WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT date, code, {o.q('macd_dif', 'macd_dif')}, {o.q('macd_dea', 'macd_dea')}, {o.q('2 * (macd_dif - macd_dea)', 'macd_hist')} FROM g""")
def factors_macd(spark, sf_dir):
    return factors.macd(bars.panel(spark, sf_dir)).select("date", "code", "macd_dif", "macd_dea", "macd_hist")


def _extended_sql() -> str:
    r = o.roll
    clip = lambda x, lo, hi: f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"
    co = lambda n: f"(({r('avg', 'xy', n)}) - ({r('avg', 'r', n)}) * ({r('avg', 'v', n)})) / (({r('stddev_samp', 'r', n)}) * ({r('stddev_samp', 'v', n)}) + 1e-12)"
    return f"""WITH b AS ({bars.bars_sql()}),
c AS (SELECT *, close / {o.lag('close')} - 1 AS r0, volume / {o.lag('volume')} - 1 AS v0 FROM b {o.windows()}),
d AS (SELECT *, {clip('r0', '-1.0', '1.0')} AS r, {clip('v0', '-1.0', '1.0')} AS v FROM c),
e AS (SELECT *, {clip('abs(r) / (amount + 1e-9) * 1e10', '0.0', '1e6')} AS i, r * v AS xy, pow(r, 2) AS r2, pow(r, 3) AS r3, pow(r, 4) AS r4 FROM d),
g AS (SELECT *, {r('avg', 'i', 20)} AS mi, {co(5)} AS vol_corr_5, {co(20)} AS vol_corr_20, {r('avg', 'r', 20)} AS m1, {r('avg', 'r2', 20)} AS m2, {r('avg', 'r3', 20)} AS m3, {r('avg', 'r4', 20)} AS m4,
  {r('stddev_samp', 'r', 20)} AS sd FROM e {o.windows(5, 20)})
SELECT date, code, {o.q('ln(1 + mi)', 'illiq_20')}, {o.q('vol_corr_5', 'vol_corr_5')}, {o.q('vol_corr_20', 'vol_corr_20')},
  {o.q('(m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / (pow(sd, 3) + 1e-12)', 'skew_20')}, {o.q('(m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * pow(m1, 4)) / (pow(sd, 4) + 1e-12) - 3', 'kurt_20')} FROM g"""


@query(_extended_sql)
def factors_extended(spark, sf_dir):
    return factors.extended(bars.panel(spark, sf_dir)).select("date", "code", "illiq_20", "vol_corr_5", "vol_corr_20", "skew_20", "kurt_20")


@query(lambda: with_f(f"SELECT date, code, {', '.join(o.q(h, h) for h in LABELS)} FROM f"))
def labels_forward(spark, sf_dir):
    return featured(spark, sf_dir).select("date", "code", *LABELS)


@query(lambda: f"""WITH b AS ({bars.bars_sql()}), n AS (SELECT date, code, open, high, low, close, {o.lag('date', -1)} AS d1, {o.lag('open', -1)} AS o1, {o.lag('close', -1)} AS c1 FROM b {o.windows()}),
g AS (SELECT *, o1 / close - 1 AS gap, c1 / o1 - 1 AS intraday, c1 / close - 1 AS fullday FROM n WHERE d1 - date <= 10 AND abs(o1 / close - 1) <= 0.5)
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS rows, {o.q('avg(gap)', 'gap')}, {o.q('avg(intraday)', 'intraday')}, {o.q('avg(fullday)', 'fullday')}, {o.q('avg(gap) / nullif(avg(fullday), 0)', 'gap_share', 4)},
  {o.q('avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END)', 'gap_up')} FROM g GROUP BY 1""", None)
def overnight_decomposition(spark, sf_dir):
    return rounded(study.overnight_by_year(factors.overnight(bars.panel(spark, sf_dir))).withColumn("gap_share", F.round("gap_share", 4)))


# --- cross-section


@query(lambda: with_f(f"""SELECT date, code, {o.q(o.rank('ma5_dist', 'date'), 'rank')}, {o.q('(ma5_dist - avg(ma5_dist) OVER d) / (stddev_samp(ma5_dist) OVER d + 1e-12)', 'z', 4)},
  count(ma5_dist) OVER d AS names FROM f WINDOW d AS (PARTITION BY date)"""), None)
def cross_section(spark, sf_dir):
    w = Window.partitionBy("date")
    df = featured(spark, sf_dir).select("date", "code", "ma5_dist")
    df = df.select("date", "code", average_rank("ma5_dist").alias("rank"), F.round(zscore("ma5_dist"), 4).alias("z"), F.count("ma5_dist").over(w).alias("names"))
    return rounded(df)


@query(lambda: with_f(f"SELECT date, code, {o.q('turn_ratio', 'turn_ratio')} FROM (SELECT *, {o.rank('turn_ratio', 'date', down=True)} AS k FROM f) WHERE k <= 5"))
def top_ranked(spark, sf_dir):
    return study.top_n(featured(spark, sf_dir), "turn_ratio", 5).select("date", "code", "turn_ratio")


@query(lambda: with_f(f"""SELECT CAST(least(floor(r / n * 5), 4) AS INTEGER) AS bucket, {o.q('avg(y)', 'mean')}, count(*) AS rows FROM
  (SELECT fwd_5d AS y, {o.rank('x', 'date')} AS r, count(x) OVER (PARTITION BY date) AS n FROM (SELECT date, fwd_5d, ma5_dist AS x FROM f WHERE isfinite(ma5_dist) AND isfinite(fwd_5d))) GROUP BY 1"""))
def quintile_means(spark, sf_dir):
    return ic.bucket_means(featured(spark, sf_dir), "ma5_dist", "fwd_5d")


@query(lambda: with_f(f"""SELECT CAST(len(list_filter(list_distinct(e[2:10]), lambda v: v < x)) AS INTEGER) AS bucket, {o.q('avg(y)', 'mean')}, count(*) AS rows
  FROM p, (SELECT quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS e FROM p) GROUP BY 1""", "p AS (SELECT turn_ratio AS x, fwd_5d AS y FROM f WHERE isfinite(turn_ratio) AND isfinite(fwd_5d))"))
def decile_means(spark, sf_dir):
    return study.deciles(featured(spark, sf_dir), "turn_ratio", "fwd_5d")


@query(lambda: with_f(f"SELECT CAST(limit_up AS DOUBLE) AS value, {o.q('avg(fwd_5d)', 'mean')}, count(*) AS rows FROM f WHERE limit_up IS NOT NULL AND isfinite(fwd_5d) GROUP BY 1"))
def discrete_factor(spark, sf_dir):
    return study.by_value(featured(spark, sf_dir), "limit_up", "fwd_5d")


# --- information coefficients


@query(lambda: with_ic(f"""SELECT name, horizon, {o.q('avg(ic)', 'ic_mean')}, {o.q('avg(ic) / nullif(stddev_samp(ic), 0)', 'icir')}, {o.q('avg(CASE WHEN ic > 1e-9 THEN 1.0 ELSE 0.0 END) * 100', 'ic_pos_pct')},
  count(*) AS days FROM ic GROUP BY ALL HAVING count(*) >= {MIN_DAYS}""", labels=LABELS))
def ic_summary(spark, sf_dir):
    return ic.ic_summary(series(spark, sf_dir, labels=LABELS), min_days=MIN_DAYS)


@query(lambda: with_ic(f"SELECT name, horizon, date, {o.q('ic', 'ic')}, n FROM ic"))
def ic_daily(spark, sf_dir):
    return series(spark, sf_dir)


@query(lambda: with_ic(f"SELECT name, {o.q('avg(ic)', 'ic_mean')}, count(*) AS days FROM ic GROUP BY ALL", method="pearson"))
def ic_pearson(spark, sf_dir):
    return ic.ic_summary(series(spark, sf_dir, method="pearson"), min_days=1).select("name", "ic_mean", "days")


def _newey_west_sql() -> str:
    ks = range(1, ic.LAGS + 1)
    lags = ", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in ks)
    var = " + ".join(["sum(d * d) / count(*)", *[f"{2 * (1 - k / (ic.LAGS + 1))!r} * coalesce(sum(d * d{k}), 0) / count(*)" for k in ks]])
    return with_ic(
        f"SELECT name, {o.q('m', 'mean')}, days, {o.q('CASE WHEN days >= 30 AND v > 0 THEN m / sqrt(v / days) ELSE 0 END', 't_nw', 5)} FROM (SELECT name, avg(ic) AS m, count(*) AS days, {var} AS v FROM l GROUP BY name)",
        "dm AS (SELECT *, ic - avg(ic) OVER (PARTITION BY name) AS d FROM ic)", f"l AS (SELECT *, {lags} FROM dm WINDOW w AS (PARTITION BY name ORDER BY date))",
    )


@query(_newey_west_sql, None)
def ic_newey_west(spark, sf_dir):
    out = ic.newey_west(series(spark, sf_dir)).select("name", "mean", "days", F.round("t_nw", 5).alias("t_nw"))
    return rounded(out)


@query(lambda: with_ic(f"SELECT name, CAST((year(date) - 1990) * 2 + CAST(month(date) > 6 AS INTEGER) AS INTEGER) AS seg, {o.q('avg(ic)', 'ic_mean')}, count(*) AS days FROM ic GROUP BY ALL"))
def ic_half_years(spark, sf_dir):
    return ic.half_years(series(spark, sf_dir)).select("name", F.col("seg").cast("int").alias("seg"), "ic_mean", "days")


@query(lambda: with_ic(f"""SELECT name, {o.q('avg(ok)', 'right_share')}, {o.q('min(CASE WHEN k <= 2 THEN ok END)', 'recent_right')}, count(*) AS segments FROM
  (SELECT name, CASE WHEN sign(m) = sign(mean) THEN 1.0 ELSE 0.0 END AS ok, row_number() OVER (PARTITION BY name ORDER BY seg DESC) AS k FROM sg JOIN (SELECT name, avg(ic) AS mean FROM ic GROUP BY name) USING (name)) GROUP BY name""",
  "sg AS (SELECT name, (year(date) - 1990) * 2 + CAST(month(date) > 6 AS INTEGER) AS seg, avg(ic) AS m FROM ic GROUP BY ALL)"))
def ic_segment_check(spark, sf_dir):
    return ic.segment_check(series(spark, sf_dir)).drop("horizon")


@query(lambda: with_ic(f"""SELECT name, CAST(y AS INTEGER) AS year, {o.q('m', 'ic_mean')}, {o.q('r', 'icir')}, days, CAST(coalesce(abs(r) >= 2 AND sign(m) <> sign(mean), FALSE) AS INTEGER) AS conflict FROM
  (SELECT name, year(date) AS y, avg(ic) AS m, avg(ic) / nullif(stddev_samp(ic), 0) AS r, count(*) AS days FROM ic GROUP BY ALL) JOIN (SELECT name, avg(ic) AS mean FROM ic GROUP BY name) USING (name)"""))
def ic_years(spark, sf_dir):
    return ic.yearly(series(spark, sf_dir)).drop("horizon")


@query(lambda: with_ic(f"""SELECT name, {o.q('near', 'near')}, {o.q('far', 'far')}, {o.q('(near - far) / nullif(near, 0)', 'decay')} FROM (SELECT name, max(CASE WHEN horizon = 'fwd_5d' THEN abs(m) END) AS near,
  max(CASE WHEN horizon = 'fwd_10d' THEN abs(m) END) AS far FROM (SELECT name, horizon, avg(ic) AS m FROM ic GROUP BY ALL) GROUP BY name)""", labels=LABELS))
def ic_decay(spark, sf_dir):
    return ic.decay(ic.ic_summary(series(spark, sf_dir, labels=LABELS), min_days=1))


DAYS_SQL = """dw AS (SELECT date, sum(CAST(floor(close * 10000 + 0.5) AS BIGINT)) * 100 // nullif(count(close), 0) AS u, coalesce(CAST(sum(limit_up) AS BIGINT), 0) AS limit_ups FROM f GROUP BY date),
dx AS (SELECT *, u / 1e6 AS index_close FROM dw),
dy AS (SELECT *, CASE WHEN count(u) OVER w = 20 THEN (sum(u) OVER w // 20) / 1e6 END AS index_ma20 FROM dx WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def days(df: DataFrame) -> DataFrame:
    return bars.index_series(df).join(portfolio.breadth(df).select("date", "limit_ups"), "date")


def _regime_sql() -> str:
    return with_f(
        f"SELECT name, regime, {o.q('avg(ic)', 'ic_mean')}, count(*) AS days FROM ic GROUP BY ALL",
        DAYS_SQL,
        """g AS (SELECT f.*, CASE WHEN index_close >= index_ma20 THEN 'bull' WHEN index_close < index_ma20 AND limit_ups < (SELECT median(limit_ups) FROM f JOIN dy USING (date)) THEN 'bear' ELSE 'range' END AS regime FROM f JOIN dy USING (date))""",
        o.series(NAMES, ["fwd_5d"], extra=", regime", source="g"),
    )


@query(_regime_sql)
def ic_regimes(spark, sf_dir):
    df = featured(spark, sf_dir)
    s = ic.ic_series(ic.regimes(df, days(df)), list(NAMES), ["fwd_5d"], "regime")
    return ic.ic_summary(s, "regime", min_days=1).select("name", "regime", "ic_mean", "days")


@query(lambda: with_ic(f"SELECT name, CAST((i - 60) / 15 AS INTEGER) AS k, {o.q('r', 'icir')} FROM (SELECT name, row_number() OVER (PARTITION BY name ORDER BY date) AS i, avg(ic) OVER v / nullif(stddev_pop(ic) OVER v, 0) AS r FROM ic WINDOW v AS (PARTITION BY name ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE i >= 60 AND (i - 60) % 15 = 0"))
def ic_rolling(spark, sf_dir):
    return ic.rolling_icir(series(spark, sf_dir), 60, 15).select("name", "k", "icir")


@query(lambda: with_ic(f"""SELECT name, {o.q('slope', 'slope')}, {o.q('first', 'first')}, windows, {o.q('CASE WHEN windows >= 4 THEN CASE WHEN slope >= 0 THEN 12.0 ELSE least(greatest(abs(first / (2 * slope)) * 3, 1.0), 24.0) END END', 'half_life', 3)} FROM
  (SELECT name, regr_slope(v, CAST(k AS DOUBLE)) AS slope, arg_min(v, k) AS first, count(*) AS windows FROM (SELECT name, (i - 60) / 15 AS k, abs(r) AS v FROM (SELECT name, row_number() OVER (PARTITION BY name ORDER BY date) AS i,
  avg(ic) OVER v / nullif(stddev_pop(ic) OVER v, 0) AS r FROM ic WINDOW v AS (PARTITION BY name ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE i >= 60 AND (i - 60) % 15 = 0) GROUP BY name)"""), None)
def ic_half_life(spark, sf_dir):
    out = ic.half_life(series(spark, sf_dir), 60, 15).drop("horizon").withColumn("half_life", F.round("half_life", 3))
    return rounded(out)


# --- gates and dedup


@query(lambda: with_f(f"""SELECT name, {o.q('median(n)', 'median_names')}, {o.q('sum(n) / sum(c)', 'coverage')} FROM
  (SELECT name, date, count(x) AS n, count(*) AS c FROM ({' UNION ALL '.join(f"SELECT date, '{n}' AS name, {e} AS x FROM f" for n, e in NAMES.items())}) GROUP BY ALL) GROUP BY name"""))
def gate_coverage(spark, sf_dir):
    return gates.coverage(featured(spark, sf_dir), list(NAMES))


@query(lambda: with_ic(f"SELECT name, {o.q('avg(ic)', 'ic_mean')}, {o.q('avg(ic) / nullif(stddev_samp(ic), 0)', 'icir')}, count(*) AS days FROM ic GROUP BY name", where="is_suspended = 0 AND limit_up = 0 AND limit_down = 0"))
def gate_tradable_domain(spark, sf_dir):
    s = ic.ic_series(ic.tradable(featured(spark, sf_dir)), list(NAMES), ["fwd_5d"])
    return ic.ic_summary(s, min_days=1).select("name", "ic_mean", "icir", "days")


@query()
def gate_funnel(spark, sf_dir):
    """The whole funnel on the panel's first and last years, with limits for small panels."""
    df = featured(spark, sf_dir).persist()
    limits = ic.Limits(min_days=50, min_t=2.0, min_rows=1000, min_names=5)
    cut = df.agg(F.percentile(F.unix_date("date"), F.lit(0.7)).cast("int").alias("d")).first()["d"]
    day = F.unix_date("date")
    design, holdout = df.where(day <= cut - 40), df.where(day > cut + 40)  # 40 days of neither between them
    rows = [(r["name"], r["gate"], r.get("t_nw"), r.get("icir")) for r in gates.funnel(design, holdout, list(NAMES), limits=limits)]
    df.unpersist()
    return spark.createDataFrame(rows, "name string, gate string, t_nw double, icir double")


@query(lambda: with_f(f"""SELECT {o.q('avg(t)', 'top_mean')}, {o.q('sum(s) / sum(c)', 'mean')}, {o.q('avg(t) / nullif(sum(s) / sum(c), 0)', 'exposure')} FROM (SELECT date, avg(CASE WHEN r >= 0.9 * n THEN turn_ratio END) AS t, sum(turn_ratio) AS s, count(*) AS c FROM
  (SELECT date, turn_ratio, {o.rank('x', 'date')} AS r, count(x) OVER (PARTITION BY date) AS n FROM (SELECT date, turn_ratio, ma5_dist AS x FROM f WHERE ma5_dist IS NOT NULL AND turn_ratio IS NOT NULL)) GROUP BY date)"""))
def turnover_exposure(spark, sf_dir):
    return ic.turnover_exposure(featured(spark, sf_dir), "ma5_dist")


@query(lambda: with_f(f"""SELECT {o.q('avg(a)', 'pearson')}, {o.q('avg(b)', 'spearman')}, count(*) AS days FROM (SELECT date, {o.corr('x', 'y')} AS a, {o.corr('rx', 'ry')} AS b FROM
  (SELECT date, x, y, {o.rank('x', 'date')} AS rx, {o.rank('y', 'date')} AS ry FROM (SELECT date, ma5_dist AS x, ma20_dist AS y FROM f WHERE ma5_dist IS NOT NULL AND ma20_dist IS NOT NULL)) GROUP BY date) WHERE b IS NOT NULL"""))
def dedup_correlation(spark, sf_dir):
    return ic.factor_correlation(featured(spark, sf_dir), "ma5_dist", "ma20_dist")


@query(lambda: with_f(f"""SELECT {o.q('sum(p * ln(p / (pa * pb))) / nullif((-sum(p * ln(pa)) - sum(p * ln(pb))) / 2, 0)', 'nmi')} FROM (SELECT c / sum(c) OVER () AS p, sum(c) OVER (PARTITION BY a) / sum(c) OVER () AS pa, sum(c) OVER (PARTITION BY b) / sum(c) OVER () AS pb FROM
  (SELECT least(floor(rx / n * 20), 19) AS a, least(floor(ry / n * 20), 19) AS b, count(*) AS c FROM (SELECT {o.rank('x', 'date')} AS rx, {o.rank('y', 'date')} AS ry, count(x) OVER (PARTITION BY date) AS n FROM
  (SELECT date, ma5_dist AS x, ma20_dist AS y FROM f WHERE ma5_dist IS NOT NULL AND ma20_dist IS NOT NULL)) GROUP BY ALL))"""))
def dedup_mutual_information(spark, sf_dir):
    return ic.mutual_information(featured(spark, sf_dir), "ma5_dist", "ma20_dist")


@query(lambda: with_f(f"SELECT date, code, {o.q('(y - avg(y) OVER ()) - s * (x - avg(x) OVER ())', 'residual', 4)} FROM k, (SELECT covar_pop(x, y) / (var_pop(x) + 1e-8) AS s FROM k)",
  f"k AS (SELECT date, code, {o.rank('ma5_dist', 'date')} AS y, {o.rank('ma20_dist', 'date')} AS x FROM f WHERE ma5_dist IS NOT NULL AND ma20_dist IS NOT NULL)"), None)
def orthogonal_residual(spark, sf_dir):
    return rounded(ic.orthogonalised(featured(spark, sf_dir), "ma5_dist", ["ma20_dist"])[0].select("date", "code", "residual"), 4)


# --- studies


@query(lambda: with_f(f"""SELECT name, "end", {o.q('avg(r)', 'gross')}, count(r) AS days, {o.q('avg(r) / nullif(stddev_pop(r), 0) * sqrt(252)', 'sharpe', 5)}, {o.q('avg(r) - 0.0045', 'net')} FROM
  (SELECT name, date, unnest(['top', 'low']) AS "end", unnest([avg(CASE WHEN t <= 5 THEN y END), avg(CASE WHEN l <= 5 THEN y END)]) AS r FROM (SELECT *, {o.rank('x', 'name, date', down=True)} AS t, {o.rank('x', 'name, date')} AS l, count(x) OVER (PARTITION BY name, date) AS c FROM p) WHERE c >= 5 GROUP BY name, date) GROUP BY ALL HAVING count(r) >= 50""",
  o.series(NAMES, ["fwd_5d"])), None)
def grid_ends(spark, sf_dir):
    return rounded(study.ends(featured(spark, sf_dir), list(NAMES), min_names=5).withColumn("sharpe", F.round("sharpe", 5)))


@query(lambda: with_f(f"""SELECT CAST(year AS INTEGER) AS year, {o.q('avg(CASE WHEN r >= hi THEN y END)', 'top')}, {o.q('avg(CASE WHEN r <= lo THEN y END)', 'bottom')}, count(*) AS rows FROM p2 JOIN (SELECT year, quantile_cont(r, 0.2) AS lo, quantile_cont(r, 0.8) AS hi FROM p2 GROUP BY year) USING (year) GROUP BY year""",
  "p1 AS (SELECT date, ma5_dist AS x, fwd_5d AS y FROM f WHERE isfinite(ma5_dist) AND isfinite(fwd_5d))", f"p2 AS (SELECT year(date) AS year, y, ({o.rank('x', 'date')}) / count(x) OVER (PARTITION BY date) AS r FROM p1)"))
def yearly_groups(spark, sf_dir):
    return study.yearly_groups(featured(spark, sf_dir), "ma5_dist", "fwd_5d").withColumn("year", F.col("year").cast("int"))


EVENTS_SQL = f"""ev AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS code, round(o_totalprice - 150000, 2) AS net FROM orders),
en AS (SELECT date, code, sum(net) AS net FROM ev GROUP BY ALL)"""


def events(spark, sf_dir) -> DataFrame:
    """Event rows (date, code, net): orders laid on the panel's codes."""
    codes = table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("m")).first()["m"]
    e = table(spark, sf_dir, "orders").select(
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"), (F.col("o_custkey") % codes).alias("code"), F.round(F.col("o_totalprice") - 150000, 2).alias("net")
    )
    return e


@query(lambda: with_f(f"SELECT CAST(sign(net) AS INTEGER) AS sign, count(*) AS rows, {o.q('avg(fwd_5d)', 'event_mean')}, {o.q('(SELECT avg(fwd_5d) FROM f)', 'market_mean')} FROM f JOIN en USING (date, code) GROUP BY 1", EVENTS_SQL))
def event_study(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("date", "code").agg(F.sum("net").alias("net"))
    return study.event_study(featured(spark, sf_dir), e, "fwd_5d")


@query(lambda: with_f(f"""SELECT date, code, CAST(net IS NOT NULL AS INTEGER) AS event, coalesce(CAST(net > 0 AS INTEGER), 0) AS event_up, {o.q('coalesce(net, 0)', 'net', 2)},
  {o.q('CASE WHEN net IS NOT NULL THEN (net - avg(net) OVER d) / (stddev_samp(net) OVER d + 1e-12) ELSE 0 END', 'net_z', 5)} FROM f LEFT JOIN en USING (date, code) WINDOW d AS (PARTITION BY date)""", EVENTS_SQL), None)
def event_factor(spark, sf_dir):
    out = study.event_factor(featured(spark, sf_dir).select("date", "code"), events(spark, sf_dir))
    return rounded(out.select("date", "code", "event", "event_up", F.round("net", 2).alias("net"), F.round("net_z", 5).alias("net_z")))


@query(lambda: with_f(f"""SELECT CAST(close <= 1500 AS INTEGER) AS affordable, {o.q('avg(y)', 'mean')}, count(*) AS rows FROM (SELECT close, y, {o.rank('x', 'date, close <= 1500', down=True)} AS r FROM p) WHERE r <= 5 GROUP BY 1""",
  "p AS (SELECT date, close, ma5_dist AS x, fwd_5d AS y FROM f WHERE isfinite(ma5_dist) AND isfinite(fwd_5d))"))
def affordability_split(spark, sf_dir):
    return study.affordability(featured(spark, sf_dir), "ma5_dist", "fwd_5d", 1500.0)


# --- scores, market, portfolio


@query(lambda: with_f("""SELECT date, count(CASE WHEN ret_1d > 0 THEN 1 END) AS ups, count(*) AS names, count(*) - count(CASE WHEN ret_1d > 0 THEN 1 END) AS downs, 2 * count(CASE WHEN ret_1d > 0 THEN 1 END) - count(*) AS spread,
  round(count(CASE WHEN ret_1d > 0 THEN 1 END) / count(*), 6) + 0.0 AS up_share, CAST(coalesce(sum(limit_up), 0) AS BIGINT) AS limit_ups, CAST(coalesce(sum(limit_down), 0) AS BIGINT) AS limit_downs FROM f GROUP BY date"""))
def market_breadth(spark, sf_dir):
    return portfolio.breadth(featured(spark, sf_dir))


@query(lambda: with_f(f"SELECT date, {o.q('index_close', 'index_close')}, {o.q('index_ma20', 'index_ma20')}, limit_ups, CAST(coalesce(CAST(index_close > index_ma20 AS INTEGER), 0) + CAST(limit_ups > 20 AS INTEGER) >= 2 AS INTEGER) AS open FROM dy", DAYS_SQL))
def market_gate(spark, sf_dir):
    return portfolio.market_gate(days(featured(spark, sf_dir)), 20)


SCORE = tuple(p for p in portfolio.BASE_SCORE if p[0] != "s6")


def _score_sql() -> str:
    return " + ".join(f"coalesce({o.rank(n, 'date')}, 0) * {w}" for n, _, w in SCORE)


def _parts_sql() -> str:
    return ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e, _ in SCORE)


@query(lambda: with_f(f"SELECT date, code, {o.q(_score_sql(), 'score')} FROM (SELECT date, code, {_parts_sql()} FROM f)"))
def composite_score(spark, sf_dir):
    return portfolio.composite(featured(spark, sf_dir), SCORE).select("date", "code", "score")


@query(lambda: with_f(f"SELECT date, code, {o.q('0.001 + 0.002 * coalesce(least(abs(ret_1d) / 0.05, 1), 0.5)', 'slip')}, {o.q('greatest(5.0, amount * 0.00025)', 'commission', 4)} FROM f WHERE is_suspended = 0 AND limit_up = 0 AND limit_down = 0 AND price_pos_20 > 0.1 AND price_pos_20 < 0.85 AND close > ma_20"), None)
def candidate_costs(spark, sf_dir):
    df = portfolio.candidates(featured(spark, sf_dir))
    return rounded(df.select("date", "code", portfolio.slippage(F.col("ret_1d")).alias("slip"), F.round(portfolio.commission(F.col("amount")), 4).alias("commission")))


def _hold_sql() -> str:
    slip = "(0.001 + 0.002 * coalesce(least(abs(ret_1d) / 0.05, 1), 0.5))"
    return with_f(
        f"SELECT date, code, {o.q('score', 'score')}, {o.q('buy', 'buy')}, sell_date, {o.q('sell', 'sell')}, {o.q('sell / buy - 1', 'ret')} FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, code) AS k FROM h WHERE is_suspended = 0 AND limit_up = 0 AND limit_down = 0 AND price_pos_20 > 0.1 AND price_pos_20 < 0.85 AND close > ma_20) WHERE k <= 3 AND sell IS NOT NULL",
        f"sc AS (SELECT *, round({_score_sql()}, 9) AS score FROM (SELECT *, {_parts_sql()} FROM f))",
        f"h AS (SELECT *, close * (1 + {slip}) AS buy, lead(close * (1 - {slip}), 5) OVER w AS sell, lead(date, 5) OVER w AS sell_date FROM sc {o.windows()})",
    )


@query(_hold_sql)
def hold_n_trades(spark, sf_dir):
    df = portfolio.composite(featured(spark, sf_dir), SCORE).withColumn("score", F.round("score", 9))
    return portfolio.hold_n(df, 5)


def simulated(spark, sf_dir) -> DataFrame:
    df = factors.macd(featured(spark, sf_dir))
    day = portfolio.market_gate(days(df), 20).select("date", F.col("open").alias("market_open"))
    df = df.withColumn("buyable", F.coalesce(F.expr(portfolio.BUYABLE), F.lit(False)))
    parts = bars.parts(table(spark, sf_dir, "lineitem"))
    sides = df.select("date", "code", "buyable", *[e.alias(n) for n, e in portfolio.score_parts().items()])
    scored = portfolio.ranked(sides.repartition(parts, "date"))
    rules = portfolio.Rules(capital=2e6, position=5e5, min_cash=1e5)
    return portfolio.simulate(df, portfolio.grid(rules, gate=[True, False], hold=[0, 5], top=[3, 5]), day, scored)


@query()
def portfolio_trades(spark, sf_dir):
    return simulated(spark, sf_dir)


@query()
def portfolio_metrics(spark, sf_dir):
    return portfolio.metrics(simulated(spark, sf_dir), 2e6)


# --- live


TRADES_SQL = """tr AS (SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS code, event_type || '|' || CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS factors, (value - 50) / 1000 AS ret FROM events)"""


def trades(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    side = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    return e.select(F.to_date("ts").alias("date"), F.col("user_id").cast("string").alias("code"), F.concat_ws("|", "event_type", side).alias("factors"), ((F.col("value") - 50) / 1000).alias("ret"))


@query(lambda: f"WITH {TRADES_SQL} SELECT factor, count(*) AS n, {o.q('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)', 'hit_rate')}, {o.q('avg(ret)', 'mean_ret')} FROM (SELECT unnest(string_split(factors, '|')) AS factor, ret FROM tr) WHERE factor <> '' AND ret IS NOT NULL GROUP BY factor HAVING count(*) >= 2")
def factor_attribution(spark, sf_dir):
    return live.by_factor(trades(spark, sf_dir))


@query(lambda: f"""WITH {TRADES_SQL}, x AS (SELECT string_split(factors, '|')[1] AS factor, count(*) AS n, sum((ret * ret - (ret - 0.005) * (ret - 0.005)) / (2 * 0.02 * 0.02)) AS l, avg(ret) AS m FROM tr WHERE ret IS NOT NULL GROUP BY 1)
SELECT factor, n, {o.q('l', 'ln_lr', 4)}, {o.q('m', 'mean_ret')}, CASE WHEN l >= ln(19) THEN 'confirmed' WHEN l <= -ln(19) THEN 'rejected' ELSE 'open' END AS state FROM x""", None)
def sequential_test(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("factor", F.get(F.split("factors", r"\|"), 0))
    return rounded(live.sprt(t, 0.005, 0.02, "factor").withColumn("ln_lr", F.round("ln_lr", 4)))


#: (factor, expected_pct, brief, degraded)
EXPECTED = [("odd", 0.2, False, False), ("even", 3.0, True, False), ("click", -0.5, False, False), ("view", 1.0, False, True)]


@query(lambda: f"""WITH {TRADES_SQL}, e(factor, mu, least) AS (VALUES {', '.join(f"('{f}', {0.0 if d else m}, {5 if b else 10})" for f, m, b, d in EXPECTED)}),
x AS (SELECT unnest(string_split(factors, '|')) AS factor, CASE WHEN abs(ret) < 0.049 THEN ret * 100 END AS r FROM tr),
g AS (SELECT factor, count(r) AS n, count(*) - count(r) AS bad_rows, count(*) AS shared, avg(r) AS m, greatest(stddev_pop(r), 0.01) AS sd FROM x GROUP BY factor),
y AS (SELECT g.*, CASE WHEN n >= least THEN (m - mu) / greatest(abs(mu), 2) * 100 END AS d, CASE WHEN n >= least THEN n * (2 * m * mu - mu * mu) / (2 * sd * sd) END AS l FROM g JOIN e USING (factor))
SELECT factor, n, bad_rows, shared, {o.q('m', 'realized_pct')}, {o.q('d', 'deviation_pct')}, {o.q('l', 'ln_lr')}, CASE WHEN l >= ln(19) AND abs(d) <= 50 THEN 'confirmed' WHEN l <= -ln(19) AND abs(d) > 50 THEN 'rejected' ELSE 'open' END AS state FROM y""")
def live_evaluation(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("ret", F.when(F.abs("ret") < 0.049, F.col("ret").cast("string")).otherwise("n/a"))
    return live.live_evaluation(t, spark.createDataFrame(EXPECTED, "factor string, expected_pct double, brief boolean, degraded boolean"))


@query(lambda: with_f(f"""SELECT date, code, {', '.join(o.q(f'r{n}', f'ret_{n}') for n in (1, 3, 5, 10))} FROM (SELECT date, code, turn_ratio, {', '.join(f"{o.lag('close', -n)} / close - 1 AS r{n}" for n in (1, 3, 5, 10))}, {o.rank('turn_ratio', 'date', down=True)} AS k FROM f {o.windows()}) WHERE k <= 3"""))
def picks_follow_up(spark, sf_dir):
    df = featured(spark, sf_dir)
    return live.follow_up(study.top_n(df, "turn_ratio", 3).select("date", "code"), df)


@query(lambda: with_f(f"""SELECT date, code, CAST(k AS INTEGER) AS "rank", {o.q('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC NULLS LAST, code) AS k FROM (SELECT date, code, {_score_sql()} AS score FROM (SELECT date, code, {_parts_sql()} FROM f))) WHERE k <= 5"""))
def daily_picks(spark, sf_dir):
    return live.picks(featured(spark, sf_dir), list(SCORE)).select("date", "code", "rank", "score")


@query(lambda: with_f("SELECT date, code, CASE WHEN close / ma_5 - 1 <= -0.04 THEN 'stop' WHEN close / ma_5 - 1 >= 0.06 THEN 'take' WHEN date_diff('day', date, DATE '2001-01-01') >= 5 THEN 'time' ELSE 'hold' END AS action FROM f"))
def position_monitor(spark, sf_dir):
    held = F.datediff(F.lit("2001-01-01").cast("date"), "date")
    return featured(spark, sf_dir).select("date", "code", live.monitor(F.col("close"), F.col("ma_5"), held).alias("action"))


@query(lambda: """WITH l AS (SELECT event_type AS gate, value > 20 AS passed, user_id % 13 = 0 AS open, CASE WHEN value > 5 THEN value END AS metric FROM events)
SELECT gate, n AS rows, passed, open, missing, CASE WHEN n < 20 THEN 'few' WHEN passed = n THEN 'always passes' WHEN missing = n THEN 'never measures' WHEN open > 0.1 * n THEN 'open' ELSE 'none' END AS alarm FROM
(SELECT gate, count(*) AS n, CAST(sum(CAST(passed AS INTEGER)) AS BIGINT) AS passed, CAST(sum(CAST(open AS INTEGER)) AS BIGINT) AS open, count(*) - count(metric) AS missing FROM l GROUP BY gate)""")
def gate_audit(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("gate"), (F.col("value") > 20).alias("passed"), (F.col("user_id") % 13 == 0).alias("open"), F.when(F.col("value") > 5, F.col("value")).alias("metric"))
    return live.gate_audit(log)


@query(lambda: "SELECT date, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, kind) AS k FROM (SELECT CAST(ts AS DATE) AS date, event_type AS kind, count(*) AS n FROM events GROUP BY ALL)) WHERE k <= 3")
def run_summary(spark, sf_dir):
    return live.run_summary(table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("kind")))


@query(lambda: with_f(f"SELECT count(DISTINCT date) AS dates, min(date) AS first, max(date) AS last, count(*) AS rows, {o.q('least(count(close) / count(*), count(ret_5d) / count(*), count(ma_20) / count(*)) * 100', 'key_pct')}, CAST(least(count(close) / count(*), count(ret_5d) / count(*), count(ma_20) / count(*)) >= 0.95 AS INTEGER) AS ok FROM f"))
def data_health(spark, sf_dir):
    return live.data_health(featured(spark, sf_dir), ["close", "ret_5d", "ma_20"])


# --- relational operators


@query(lambda: f"""WITH b AS ({bars.bars_sql()}), c AS (SELECT s_suppkey AS code, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)
SELECT r_name, n_name, count(*) AS rows, {o.q('sum(volume)', 'volume')}, {o.q('avg(close)', 'close', 5)} FROM b LEFT JOIN c USING (code) GROUP BY ALL""", None)
def symbol_lookup(spark, sf_dir):
    names = (
        table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("s_suppkey").alias("code"), "n_name", "r_name")
    )
    out = bars.panel(spark, sf_dir).join(names, "code", "left").groupBy("r_name", "n_name").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"), F.round(F.avg("close"), 5).alias("close"))
    return rounded(out)


@query(lambda: f"""WITH b AS ({bars.bars_sql()}), m AS (SELECT date, code, close, volume, 0 AS s FROM b UNION ALL SELECT date, code, close + 1, volume, 1 FROM b WHERE code % 3 = 0)
SELECT date, code, {o.q('close', 'close')}, {o.q('volume', 'volume')} FROM (SELECT *, row_number() OVER (PARTITION BY date, code ORDER BY s DESC) AS k FROM m) WHERE k = 1""")
def keep_last(spark, sf_dir):
    main = bars.panel(spark, sf_dir)
    delta = main.where(F.col("code") % 3 == 0).withColumn("close", F.col("close") + 1)
    both = main.withColumn("source_ord", F.lit(0)).unionByName(delta.withColumn("source_ord", F.lit(1)))
    return tables.keep_last(both, ["date", "code"]).select("date", "code", "close", "volume")


@query(lambda: "SELECT user_id, event_type, CAST(ts AS DATE) AS date, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def keep_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return tables.keep_first(e, ["user_id", "event_type"], "o").select("user_id", "event_type", F.to_date("ts").alias("date"), "event_id")


@query(lambda: "SELECT o_orderpriority AS label, count(*) AS n, count(seg) AS seg, count(price) AS price FROM (SELECT o_orderpriority, o_totalprice AS price, NULL AS seg FROM orders UNION ALL SELECT c_mktsegment, NULL, c_mktsegment FROM customer) GROUP BY 1")
def diagonal_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("price"))
    b = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("label").agg(F.count("*").alias("n"), F.count("seg").alias("seg"), F.count("price").alias("price"))


@query(lambda: "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 45 AND l_shipdate IS NOT NULL)")
def resume_missing(spark, sf_dir):
    calendar = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return tables.not_done(calendar, table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.to_date("l_shipdate").alias("date")))


@query(lambda: f"SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, {o.q('median(value)', 'median')}, {o.q('quantile_cont(value, 0.2)', 'low')} FROM events GROUP BY 1")
def json_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", text.json_field(F.col("props"), "k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.median("value").alias("median"), F.percentile("value", F.lit(0.2)).alias("low"))


GOOD, BAD = ["the ", "der ", "le "], ["license", "stupid", "trash", "worthless"]


@query(lambda: f"""WITH s AS (SELECT lang, source, len(regexp_extract_all(text, '{'|'.join(GOOD)}')) AS g, len(regexp_extract_all(text, '{'|'.join(BAD)}')) AS b FROM documents)
SELECT lang, source, CAST(sum(g + b) AS BIGINT) AS hits, CAST(sum(g) AS BIGINT) AS good, CAST(sum(b) AS BIGINT) AS bad, {o.q('sum(sign(g - b)) / greatest(sum(g + b), 1)', 'sentiment')} FROM s GROUP BY ALL""")
def text_sentiment(spark, sf_dir):
    return text.daily_sentiment(table(spark, sf_dir, "documents"), "text", ["lang", "source"], GOOD, BAD)


def _presence_sql() -> str:
    g, b = (" + ".join(f"CAST(contains(text, '{w}') AS INTEGER)" for w in words) for words in (GOOD, BAD))
    return f"SELECT doc_id, {o.q(f'coalesce((({g}) - ({b})) / nullif(({g}) + ({b}), 0), 0)', 'sentiment')} FROM documents"


@query(_presence_sql)
def text_presence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.presence_sentiment(F.col("text"), GOOD, BAD).alias("sentiment"))


@query(lambda: "SELECT page_id, CAST(len(c) AS INTEGER) AS cells, array_to_string(list_transform(c, lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), '|') AS items FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li\\b[^>]*>(.*?)</li>', 1) AS c FROM pages)")
def html_cells(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", text.html_cells(F.col("html")).alias("c"))
    return p.select("page_id", F.size("c").alias("cells"), F.array_join("c", "|").alias("items"))


# --- expressions and tensors


EXPRESSIONS = {
    "e_reversal": "-col('ret_5d') * col('turn_ma5')",
    "e_smooth": "col('ret_5d').rolling_mean(5, min_samples=3).over('code')",
    "e_zscore": dsl.form("zscore", "close", 20),
    "e_rank": "(col('close') / col('close').shift(5).over('code') - 1).rank().over('date')",
}


@query(lambda: with_f(f"SELECT date, code, {o.q('-ret_5d * turn_ma5', 'e_reversal')}, {o.q('CASE WHEN count(ret_5d) OVER w5 >= 3 THEN avg(ret_5d) OVER w5 END', 'e_smooth')}, {o.q('(close - ma_20) / (sd + 1e-9)', 'e_zscore')}, {o.q(o.rank('m', 'date'), 'e_rank')} FROM g WINDOW w5 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
  f"g AS (SELECT *, {o.roll('stddev_samp', 'close', 20)} AS sd, close / {o.lag('close', 5)} - 1 AS m FROM f {o.windows(20)})"))
def dsl_expressions(spark, sf_dir):
    df = featured(spark, sf_dir)
    for name, e in EXPRESSIONS.items():
        df = dsl.compile_expression(e, df.columns).add_to(df, name)
    return df.select("date", "code", *EXPRESSIONS)


@query()
def beam_search(spark, sf_dir):
    df = featured(spark, sf_dir).select("date", "code", "close", "turn_ratio", "fwd_5d").persist()  # lies by code, in order of date
    best = dsl.beam_search(df, ["close", "turn_ratio"], "fwd_5d", width=5, params=(5,), min_days=50, parts=bars.parts(table(spark, sf_dir, "lineitem")))
    df.unpersist()
    return spark.createDataFrame([(k, r["expr"], r["icir"]) for k, r in enumerate(best, 1)], "place int, expr string, icir double")


def _tensor_sql() -> str:
    return with_f(
        f"SELECT date, code, {o.q('y', 'y')}, {o.q('a / 60', 'mean')}, CAST(30 AS INTEGER) AS size FROM (SELECT date, code, y, n, rows, sum(z1 + z2) OVER w30 AS a, count(*) OVER w30 AS c FROM g {o.windows(30)}) WHERE c = 30 AND y IS NOT NULL AND rows >= 35 AND (n - 30) % 5 = 0",
        "g AS (SELECT date, code, fwd_5d AS y, row_number() OVER (PARTITION BY code ORDER BY date) AS n, count(*) OVER (PARTITION BY code) AS rows, coalesce((ret_1d - avg(ret_1d) OVER c) / (stddev_samp(ret_1d) OVER c + 1e-9), 0) AS z1, coalesce((vol_ratio - avg(vol_ratio) OVER c) / (stddev_samp(vol_ratio) OVER c + 1e-9), 0) AS z2 FROM f WINDOW c AS (PARTITION BY code))",
    )


@query(_tensor_sql)
def window_tensor(spark, sf_dir):
    t = tensor.windows(featured(spark, sf_dir), ["ret_1d", "vol_ratio"], "fwd_5d")
    return t.select("date", "code", "y", (F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, v: a + v) / 60).alias("mean"), F.size("x").alias("size"))


@query(lambda: with_ic(f"SELECT name, horizon, {o.q('avg(ic)', 'ic_mean')}, count(*) AS days FROM ic WHERE n > 5 GROUP BY ALL HAVING count(*) >= 30", names={"dist": "ma5_dist"}))
def prediction_ic(spark, sf_dir):
    return tensor.prediction_ic(featured(spark, sf_dir), "dist", "fwd_5d").select("name", "horizon", "ic_mean", "days")
