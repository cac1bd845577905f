"""Information coefficients: rank correlations of candidates and labels by date, and what is derived from the series.

All candidates and horizons go through one pass: the panel is unpivoted to (date, name, horizon, x, y), ranked within
(date, name, horizon) over complete pairs, and correlated by moments. Cost grows with candidates, not with passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import average_rank, bucket, finite, pearson, ratio

LAGS = 10


@dataclass(frozen=True)
class Limits:
    """Thresholds of the tests. The defaults are for panels of thousands of codes; small panels need their own."""

    min_days: int = 100
    min_t: float = 3.0
    min_rows: int = 10_000
    min_names: int = 500
    min_coverage: float = 0.6
    max_gap: float = 0.3
    min_segments: float = 0.6
    min_monotone: float = 0.3
    max_decay: float = 0.5


def pairs(df: DataFrame, names: list[str], horizons: list[str], *keep: str) -> DataFrame:
    """(date, code, name, horizon, x, y, *keep): complete finite pairs only."""
    entries = [F.struct(F.lit(n).alias("name"), F.lit(h).alias("horizon"), finite(n).alias("x"), finite(h).alias("y")) for n in names for h in horizons]
    out = df.select("date", "code", *keep, F.explode(F.array(*entries)).alias("p")).select("date", "code", *keep, "p.*")
    return out.where("x IS NOT NULL AND y IS NOT NULL")


def ic_series(df: DataFrame, names: list[str], horizons: list[str], *by: str, method: str = "spearman", parts: int | None = None) -> DataFrame:
    """(name, horizon, date, *by, ic, n): the correlation by date; dates on which a side is constant are left out.

    parts: over how many partitions the dates are dealt, if rows are to be shuffled before they are unpivoted, as wide rows by date alone.
    """
    if parts is not None:
        return _by_number(df.select("date", "code", *by, *names, *horizons).repartition(parts, "date"), names, horizons, *by, method=method)
    return _series(pairs(df, names, horizons, *by), ("name", "horizon", "date"), *by, method=method)


def _series(p: DataFrame, key: tuple, *by: str, method: str) -> DataFrame:
    if method == "spearman":
        p = p.withColumns({"rx": average_rank("x", *key), "ry": average_rank("y", *key)})
        x, y = "rx", "ry"
    else:
        x, y = "x", "y"
    return p.groupBy(*key, *by).agg(pearson(x, y).alias("ic"), F.count("*").alias("n")).where("ic IS NOT NULL")


def _by_number(df: DataFrame, names: list[str], horizons: list[str], *by: str, method: str) -> DataFrame:
    """The same with numbers in place of names and horizons until the rows are correlations."""
    every = [(n, h) for n in names for h in horizons]
    entries = [F.struct(F.lit(k).alias("_k"), finite(n).alias("x"), finite(h).alias("y")) for k, (n, h) in enumerate(every)]
    p = df.select("date", *by, F.explode(F.array(*entries)).alias("p")).select("date", *by, "p.*").where("x IS NOT NULL AND y IS NOT NULL")
    out = _series(p, ("_k", "date"), *by, method=method)
    named = [F.element_at(F.array(*[F.lit(e[i]) for e in every]), F.col("_k") + 1).alias(c) for i, c in enumerate(("name", "horizon"))]
    return out.select(*named, "date", *by, "ic", "n")


def ic_summary(series: DataFrame, *by: str, min_days: int = 100) -> DataFrame:
    """Mean, mean / sample deviation, share above zero (%) and number of dates, for series of enough dates."""
    out = series.groupBy("name", "horizon", *by).agg(
        F.avg("ic").alias("ic_mean"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("icir"),
        (F.avg(F.when(F.col("ic") > 1e-9, 1.0).otherwise(0.0)) * 100).alias("ic_pos_pct"), F.count("*").alias("days"),
    )
    return out.where(F.col("days") >= min_days)


def newey_west(series: DataFrame, *by: str, lags: int = LAGS, min_days: int = 30) -> DataFrame:
    """t of the mean with autocovariances up to lags, weighted by 1 - k / (lags + 1); 0 for short or degenerate series."""
    key = ["name", "horizon", *by]
    w = Window.partitionBy(*key).orderBy("date")
    df = series.withColumn("_d", F.col("ic") - F.avg("ic").over(Window.partitionBy(*key)))
    df = df.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    agg = df.groupBy(*key).agg(
        F.avg("ic").alias("mean"), F.count("*").alias("days"), F.sum(F.col("_d") * F.col("_d")).alias("_g0"),
        *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_g{k}") for k in range(1, lags + 1)],
    )
    var = F.col("_g0") / F.col("days")
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.col(f"_g{k}") / F.col("days")
    agg = agg.withColumn("_var", var)
    t = F.when((F.col("days") >= min_days) & (F.col("_var") > 0), F.col("mean") / F.sqrt(F.col("_var") / F.col("days"))).otherwise(0.0)
    return agg.select(*key, "mean", "days", t.alias("t_nw"))


def half_years(series: DataFrame, origin: int = 1990) -> DataFrame:
    """Mean by half year; seg counts half years from the origin's start."""
    seg = (F.year("date") - origin) * 2 + (F.month("date") > 6).cast("int")
    return series.withColumn("seg", seg).groupBy("name", "horizon", "seg").agg(F.avg("ic").alias("ic_mean"), F.count("*").alias("days"))


def segment_check(series: DataFrame) -> DataFrame:
    """Share of half years whose mean has the sign of the whole, and whether the last two have it."""
    seg = half_years(series)
    whole = series.groupBy("name", "horizon").agg(F.avg("ic").alias("mean"))
    last = F.row_number().over(Window.partitionBy("name", "horizon").orderBy(F.col("seg").desc()))
    ok = (F.signum("ic_mean") == F.signum("mean")).cast("double")
    return (
        seg.join(F.broadcast(whole), ["name", "horizon"])  # a row per candidate and horizon
        .withColumns({"ok": ok, "last": last})
        .groupBy("name", "horizon")
        .agg(F.avg("ok").alias("right_share"), F.min(F.when(F.col("last") <= 2, F.col("ok"))).alias("recent_right"), F.count("*").alias("segments"))
    )


def yearly(series: DataFrame) -> DataFrame:
    """Mean, mean / deviation and dates by year; conflict where a clear year has the other sign."""
    whole = series.groupBy("name", "horizon").agg(F.avg("ic").alias("mean"))
    out = series.withColumn("year", F.year("date")).groupBy("name", "horizon", "year").agg(
        F.avg("ic").alias("ic_mean"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.count("*").alias("days")
    )
    out = out.join(F.broadcast(whole), ["name", "horizon"])
    clear = (F.abs("icir") >= 2) & (F.signum("ic_mean") != F.signum("mean"))
    return out.withColumn("conflict", F.coalesce(clear, F.lit(False)).cast("int")).drop("mean")


def decay(summary: DataFrame, near: str = "fwd_5d", far: str = "fwd_10d") -> DataFrame:
    """(|IC near| - |IC far|) / |IC near| by name."""
    pick = lambda h: F.max(F.when(F.col("horizon") == h, F.abs("ic_mean")))
    out = summary.groupBy("name").agg(pick(near).alias("near"), pick(far).alias("far"))
    return out.withColumn("decay", ratio(F.col("near") - F.col("far"), "near"))


def bucket_means(df: DataFrame, name: str, label: str, n: int = 5) -> DataFrame:
    """(bucket, mean, rows): pooled label means by within-date rank buckets."""
    p = pairs(df, [name], [label]).withColumn("r", average_rank("x"))
    p = p.withColumn("bucket", bucket(F.col("r"), F.count("x").over(Window.partitionBy("date")), n))
    return p.groupBy("bucket").agg(F.avg("y").alias("mean"), F.count("*").alias("rows"))


def monotonicity(df: DataFrame, name: str, label: str) -> DataFrame:
    """Correlation of bucket number and bucket mean over quintiles, with the rows behind it."""
    b = bucket_means(df, name, label)
    return b.agg(pearson(F.col("bucket").cast("double"), "mean").alias("monotone"), F.sum("rows").alias("rows"))


def regimes(df: DataFrame, day: DataFrame) -> DataFrame:
    """Adds regime: bull (index at or above its mean), bear (below, limit-ups under the row median), else range.

    day: (date, index_close, index_ma20, limit_ups), a row per date; its size is bounded by the calendar.
    """
    out = df.join(F.broadcast(day), "date", "left")
    median = out.agg(F.median("limit_ups").alias("_median"))
    out = out.crossJoin(F.broadcast(median))  # one row
    regime = (
        F.when(F.col("index_close") >= F.col("index_ma20"), "bull")
        .when((F.col("index_close") < F.col("index_ma20")) & (F.col("limit_ups") < F.col("_median")), "bear")
        .otherwise("range")
    )
    return out.withColumn("regime", regime).drop("_median")


def rolling_icir(series: DataFrame, window: int = 252, step: int = 63) -> DataFrame:
    """ICIR (population deviation) over windows of the series, at every step; k numbers them."""
    w = Window.partitionBy("name", "horizon").orderBy("date")
    inside = w.rowsBetween(-(window - 1), 0)
    df = series.withColumns({"_n": F.row_number().over(w), "icir": ratio(F.avg("ic").over(inside), F.stddev_pop("ic").over(inside))})
    df = df.where((F.col("_n") >= window) & ((F.col("_n") - window) % step == 0))
    return df.select("name", "horizon", "date", ((F.col("_n") - window) / step).cast("int").alias("k"), "icir")


def half_life(series: DataFrame, window: int = 252, step: int = 63) -> DataFrame:
    """Months until the rolling |ICIR| halves on its trend: 12 if it doesn't fall, else in [1, 24]; null for few windows."""
    r = rolling_icir(series, window, step).withColumn("v", F.abs("icir"))
    out = r.groupBy("name", "horizon").agg(
        F.regr_slope("v", F.col("k").cast("double")).alias("slope"), F.min_by("v", "k").alias("first"), F.count("*").alias("windows")
    )
    months = F.when(F.col("slope") >= 0, 12.0).otherwise(F.least(F.greatest(F.abs(ratio("first", 2 * F.col("slope"))) * 3, F.lit(1.0)), F.lit(24.0)))
    return out.withColumn("half_life", F.when(F.col("windows") >= 4, months))


def sampled_dates(df: DataFrame, share: float, seed: int) -> DataFrame:
    """The rows of a deterministic share of dates."""
    return df.where(F.pmod(F.xxhash64(F.col("date").cast("string"), F.lit(seed)), F.lit(10_000)) < int(share * 10_000))


def tradable(df: DataFrame) -> DataFrame:
    return df.where("is_suspended = 0 AND limit_up = 0 AND limit_down = 0")


def turnover_exposure(df: DataFrame, name: str) -> DataFrame:
    """Mean over dates of mean turn_ratio in the top tenth by name, over the whole mean."""
    p = df.select("date", finite(name).alias("x"), "turn_ratio").where("x IS NOT NULL AND turn_ratio IS NOT NULL")
    p = p.withColumns({"r": average_rank("x"), "n": F.count("x").over(Window.partitionBy("date"))})
    day = p.groupBy("date").agg(F.avg(F.when(F.col("r") >= 0.9 * F.col("n"), F.col("turn_ratio"))).alias("top"), F.sum("turn_ratio").alias("s"), F.count("*").alias("c"))
    return day.agg(F.avg("top").alias("top_mean"), ratio(F.sum("s"), F.sum("c")).alias("mean")).withColumn("exposure", ratio("top_mean", "mean"))


def factor_correlation(df: DataFrame, a: str, b: str, min_days: int = 30) -> DataFrame:
    """Mean over dates of Pearson and Spearman correlations of two factors."""
    p = df.select("date", finite(a).alias("x"), finite(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    p = p.withColumns({"rx": average_rank("x"), "ry": average_rank("y")})
    day = p.groupBy("date").agg(pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman")).where("spearman IS NOT NULL")
    return day.agg(F.avg("pearson").alias("pearson"), F.avg("spearman").alias("spearman"), F.count("*").alias("days")).where(F.col("days") >= min_days)


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 20) -> DataFrame:
    """Normalised mutual information (by the mean entropy) of pooled rank bins of two factors."""
    p = df.select("date", finite(a).alias("x"), finite(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    p = p.withColumns({"rx": average_rank("x"), "ry": average_rank("y"), "n": F.count("x").over(Window.partitionBy("date"))})
    c = p.select(bucket(F.col("rx"), F.col("n"), bins).alias("a"), bucket(F.col("ry"), F.col("n"), bins).alias("b")).groupBy("a", "b").agg(F.count("*").alias("c"))
    total, by_a, by_b = (F.sum("c").over(Window.partitionBy(*k)) for k in ((F.lit(1),), ("a",), ("b",)))
    c = c.withColumns({"p": F.col("c") / total, "pa": by_a / total, "pb": by_b / total})
    s = c.agg(
        F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"),
        (-F.sum(F.col("p") * F.ln("pa"))).alias("ha"), (-F.sum(F.col("p") * F.ln("pb"))).alias("hb"),
    )
    return s.select(ratio("mi", (F.col("ha") + F.col("hb")) / 2).alias("nmi"))


def orthogonalised(df: DataFrame, name: str, others: list[str]) -> tuple[DataFrame, float]:
    """(df with residual: the rank of name without what the ranks of others explain by ridge regression, rss / tss).

    One aggregation gives the normal equations, at most (k + 2)^2 sums; the solution is a column expression.
    """
    import numpy as np

    cols = [name, *others]
    p = df.where(" AND ".join(f"{c} IS NOT NULL" for c in cols))
    p = p.withColumns({f"_r{k}": average_rank(finite(c)) for k, c in enumerate(cols)})
    names = [f"_r{k}" for k in range(len(cols))]
    sums = p.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in names], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a in names for b in names]).first()
    if not sums["n"]:
        return p.withColumn("residual", F.lit(None).cast("double")).drop(*names), float("nan")
    c = np.array([[sums[f"c{a}{b}"] for b in names] for a in names])
    xx, xy = c[1:, 1:], c[1:, 0]
    alpha = 1e-8 if np.linalg.cond(xx) < 1e4 else 1e-3
    beta = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    residual = F.col("_r0") - sums["m_r0"]
    for k, b in enumerate(beta, 1):
        residual = residual - float(b) * (F.col(f"_r{k}") - sums[f"m_r{k}"])
    rss = c[0, 0] - 2 * beta @ xy + beta @ xx @ beta
    return p.withColumn("residual", residual).drop(*names), float(rss / c[0, 0]) if c[0, 0] else float("nan")


def false_discovery(summary: DataFrame) -> DataFrame:
    """Benjamini-Hochberg: t = icir x sqrt(days), two-sided normal p, q = p x candidates / rank, made monotone."""
    t = F.abs(F.col("icir") * F.sqrt("days"))
    # the normal tail by a rational approximation (7.1.26 of Abramowitz and Stegun; error under 1.5e-7)
    z = t / math.sqrt(2)
    u = 1 / (1 + 0.3275911 * z)
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    out = summary.withColumns({"t": F.col("icir") * F.sqrt("days"), "p": poly * F.exp(-z * z)})
    order = Window.orderBy(F.col("p"), "name", "horizon")  # one row per candidate
    out = out.withColumns({"_rank": F.row_number().over(order), "_all": F.count("*").over(Window.partitionBy(F.lit(1)))})
    out = out.withColumn("_q", F.col("p") * F.col("_all") / F.col("_rank"))
    down = Window.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("q", F.least(F.min("_q").over(down), F.lit(1.0))).drop("_rank", "_all", "_q")
