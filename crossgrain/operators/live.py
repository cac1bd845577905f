"""Live checks: sequential tests, attribution, follow-up of picks, position monitoring, weights, health, audits."""

from __future__ import annotations

import math
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import average_rank, ratio

LINE = math.log(0.95 / 0.05)


def sprt(trades: DataFrame, mean: float = 0.005, sigma: float = 0.02, *by: str) -> DataFrame:
    """Sequential probability ratio of returns under the expected mean against none, on the full sample: state by group."""
    r = F.col("ret")
    step = (r * r - (r - mean) * (r - mean)) / (2 * sigma * sigma)
    out = trades.where("ret IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.sum(step).alias("ln_lr"), F.avg("ret").alias("mean_ret"))
    state = F.when(F.col("ln_lr") >= LINE, "confirmed").when(F.col("ln_lr") <= -LINE, "rejected").otherwise("open")
    return out.withColumn("state", state)


def sprt_path(trades: DataFrame, mean: float = 0.005, sigma: float = 0.02, by: str = "factor", order: str = "date") -> DataFrame:
    """The running ratio after each trade."""
    r = F.col("ret")
    w = Window.partitionBy(by).orderBy(order, "code").rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("ln_lr", F.sum((r * r - (r - mean) * (r - mean)) / (2 * sigma * sigma)).over(w))


def by_factor(trades: DataFrame, least: int = 2) -> DataFrame:
    """(factor, n, hit_rate, mean_ret): trades count for each of their factors, which are joined by bars."""
    t = trades.withColumn("factor", F.explode(F.split("factors", r"\|"))).where("factor <> '' AND ret IS NOT NULL")
    out = t.groupBy("factor").agg(F.count("*").alias("n"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg("ret").alias("mean_ret"))
    return out.where(F.col("n") >= least)


def follow_up(picks: DataFrame, panel: DataFrame, horizons=(1, 3, 5, 10)) -> DataFrame:
    """picks (date, code, ...) with ret_n: the return from the pick's close to that n rows later."""
    w = Window.partitionBy("code").orderBy("date")
    ahead = panel.select("date", "code", *[(ratio(F.lead("close", n).over(w), "close") - 1).alias(f"ret_{n}") for n in horizons])
    return picks.join(ahead, ["date", "code"], "left")


def alerts(followed: DataFrame, up: float = 0.04, down: float = -0.03) -> DataFrame:
    return followed.withColumn("alert", F.when(F.col("ret_1") >= up, "up").when(F.col("ret_1") <= down, "down").otherwise("none"))


def monitor(price: Column, cost: Column, days: Column, stop: float = -0.04, take: float = 0.06, most: int = 5) -> Column:
    """What to do with a position, by its gain and the calendar days that it is held."""
    gain = ratio(price, cost) - 1
    return F.when(gain <= stop, "stop").when(gain >= take, "take").when(days >= most, "time").otherwise("hold")


def picks(df: DataFrame, weights: list[tuple[str, str, float]], n: int = 5, sentiment: str | None = None) -> DataFrame:
    """The top n by score of each date, with the two parts that contributed most: (rank - (N + 1) / 2) / N x weight."""
    df = df.withColumns({f"_{k}": average_rank(F.expr(e).cast("double")) for k, e, _ in weights})
    count = F.count("*").over(Window.partitionBy("date"))
    score, parts = F.lit(0.0), []
    for k, _, w in weights:
        score = score + F.coalesce(F.col(f"_{k}"), F.lit(0.0)) * w
        part = F.coalesce((F.col(f"_{k}") - (count + 1) / 2) / count * w, F.lit(0.0))
        parts.append(F.struct((-F.abs(part)).alias("v"), F.lit(k).alias("k")))
    score = score + 10 * F.coalesce(F.col(sentiment), F.lit(0.0)) if sentiment else score
    # rounded, so that equal sums tie whatever the order of their terms
    df = df.withColumns({"score": F.round(score, 9), "top_factors": F.array_join(F.transform(F.slice(F.sort_array(F.array(*parts)), 1, 2), lambda x: x["k"]), "|")})
    order = Window.partitionBy("date").orderBy(F.col("score").desc_nulls_last(), "code")
    df = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return df.drop(*[f"_{k}" for k, _, _ in weights])


def fresh(panel: DataFrame, calendar: DataFrame, most_lag: int = 1) -> int:
    """Dates of the calendar after the panel's last; an error if there are more than most_lag."""
    last = panel.agg(F.max("date").alias("d")).first()["d"]
    lag = calendar.where(F.col("date") > F.lit(last)).select("date").distinct().count() if last else calendar.count()
    if lag > most_lag:
        raise ValueError(f"the panel is {lag} dates behind")
    return lag


def upsert_log(log: DataFrame, new: DataFrame, key: str = "date") -> DataFrame:
    """log with the rows of new whose key it lacks: repeated runs add nothing."""
    return log.unionByName(new.join(log.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def weights(pool: list[dict]) -> dict[str, float]:
    """Weights by |ICIR| over its median x 0.05, at most 0.10 (0.04 if short-lived or of unknown life), at least 0.02.

    The tradable-domain figure counts where there is one. A pool of more than 0.5 in all is scaled to 0.5, and what falls under its floor
    (0.02, short-lived 0.015) goes.
    """
    if not pool:
        return {}
    strength = [abs(next((v for v in (p.get("icir_tradable"), p.get("icir")) if v is not None), 0.0)) for p in pool]
    unit = 0.05 / max(median(strength), 1e-6)
    bounds = [(0.0, 0.04) if p.get("short_lived") or p.get("half_life_unknown") else (0.02, 0.10) for p in pool]
    raw = [max(low, min(unit * v, high)) for v, (low, high) in zip(strength, bounds, strict=True)]
    scale = 0.5 / sum(raw) if sum(raw) > 0.5 else None
    if scale is None:
        return {p["name"]: round(w, 4) for p, w in zip(pool, raw, strict=True)}
    return {p["name"]: round(w * scale, 4) for p, w in zip(pool, raw, strict=True) if w * scale >= (0.015 if p.get("short_lived") else 0.02)}


def threshold(n: int) -> float:
    """The gain a candidate needs in percent, growing with the number of trials."""
    return 0.5 + 0.05 * math.log(max(n, 1))


def portfolio_decision(gain_train: float, gain_valid: float, trades_valid: int, trials: int) -> str:
    """Enabled if the gain in training reaches the threshold and validation doesn't contradict it."""
    if gain_train < threshold(trials):
        return "rejected: training"
    least = -2.0 if trades_valid < 20 else 0.0
    return "enabled" if gain_valid >= least else "rejected: validation"


def pool_health(pool: list[dict], deviation_pct: float | None = None) -> float:
    """0 to 100: ten enabled factors and a mean half-life of 12 months count 30 each, a mean |ICIR| of 0.3 20, and the last live
    deviation 20 within 50 % (or unknown), else 10. An empty pool has 100.

    pool: dicts with enabled, icir, icir_tradable and half_life (None where unknown; none known counts nothing).
    """
    if not pool:
        return 100.0
    lives = [p["half_life"] for p in pool if p.get("half_life") is not None]
    icir = [abs(next((v for v in (p.get("icir_tradable"), p.get("icir")) if v is not None), 0.0)) for p in pool]
    reached = ((sum(bool(p.get("enabled")) for p in pool) / 10, 30), (sum(lives) / len(lives) / 12 if lives else 0.0, 30), (sum(icir) / len(icir) / 0.3, 20))
    return round(sum(min(share, 1.0) * points for share, points in reached) + (20 if abs(deviation_pct or 0.0) <= 50 else 10), 1)


def live_evaluation(trades: DataFrame, factors: DataFrame) -> DataFrame:
    """(factor, n, bad_rows, shared, realized_pct, deviation_pct, ln_lr, state): live trades against what was expected of their factors.

    trades: factors (names joined by bars) and ret, a fraction, as a number or text; what is no number counts in bad_rows. factors: factor,
    expected_pct, brief (5 trades suffice, else 10) and degraded (0 is expected). The deviation is in percent of the expectation, or of
    2 points where that is less. Confirmed and rejected need both the sequential test and a deviation within, or beyond, 50 %.
    """
    t = trades.select(F.array_distinct(F.transform(F.split(F.coalesce("factors", F.lit("")), r"\|"), lambda x: F.trim(x))).alias("f"), (F.col("ret").try_cast("double") * 100).alias("r"))
    t = t.withColumn("f", F.filter("f", lambda x: x != "")).select(F.explode("f").alias("factor"), (F.size("f") > 1).cast("int").alias("s"), "r")
    g = t.groupBy("factor").agg(
        F.count("r").alias("n"), F.count(F.when(F.col("r").isNull(), 1)).alias("bad_rows"), F.sum("s").cast("long").alias("shared"),
        F.avg("r").alias("realized_pct"), F.when(F.count("r") > 1, F.greatest(F.stddev_pop("r"), F.lit(0.01))).otherwise(0.02).alias("_sd"),
    ).join(factors, "factor")
    g = g.withColumn("_mu", F.when(F.col("degraded"), 0.0).otherwise(F.coalesce("expected_pct", F.lit(0.0))))
    enough = F.col("n") >= F.when(F.col("brief"), 5).otherwise(10)
    g = g.withColumns({
        "ln_lr": F.when(enough, F.col("n") * (2 * F.col("realized_pct") * F.col("_mu") - F.col("_mu") * F.col("_mu")) / (2 * F.col("_sd") * F.col("_sd"))),
        "deviation_pct": F.when(enough, (F.col("realized_pct") - F.col("_mu")) / F.greatest(F.abs("_mu"), F.lit(2.0)) * 100),
    })
    near = F.abs("deviation_pct") <= 50
    state = F.when((F.col("ln_lr") >= LINE) & near, "confirmed").when((F.col("ln_lr") <= -LINE) & ~near, "rejected").otherwise("open")
    return g.select("factor", "n", "bad_rows", "shared", "realized_pct", "deviation_pct", "ln_lr", state.alias("state"))


def gate_audit(log: DataFrame, least: int = 20) -> DataFrame:
    """(gate, rows, passed, open, missing, alarm): gates that always pass, never measure, or pass open too often."""
    out = log.groupBy("gate").agg(
        F.count("*").alias("rows"), F.sum(F.col("passed").cast("long")).alias("passed"),
        F.sum(F.col("open").cast("long")).alias("open"), F.count(F.when(F.col("metric").isNull(), 1)).alias("missing"),
    )
    alarm = (
        F.when(F.col("rows") < least, "few").when(F.col("passed") == F.col("rows"), "always passes")
        .when(F.col("missing") == F.col("rows"), "never measures").when(F.col("open") > 0.1 * F.col("rows"), "open").otherwise("none")
    )
    return out.withColumn("alarm", alarm)


def run_summary(events: DataFrame, top: int = 3) -> DataFrame:
    """(date, kind, n): the most frequent kinds of each date."""
    c = events.groupBy("date", "kind").agg(F.count("*").alias("n"))
    w = Window.partitionBy("date").orderBy(F.col("n").desc(), "kind")
    return c.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def data_health(df: DataFrame, keys: list[str], least: float = 95.0) -> DataFrame:
    """(dates, first, last, rows, key_pct, ok): the span of a panel and the least share of values in its key columns."""
    out = df.agg(
        F.countDistinct("date").alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("rows"),
        F.least(*[F.count(k) / F.count("*") * 100 for k in keys], F.lit(100.0)).alias("key_pct"),
    )
    return out.withColumn("ok", (F.col("key_pct") >= least).cast("int"))


class Ledger:
    """Open positions as plain data: at most a few, in whole lots, with a limit of money for each."""

    def __init__(self, positions: list[dict] | None = None, most: int = 4, money: float = 5_000.0, lot: int = 100):
        self.positions, self.most, self.money, self.lot = list(positions or []), most, money, lot

    def add(self, code: str, price: float, shares: int, date: str, factors: str = "") -> None:
        if len(self.positions) >= self.most or any(p["code"] == code for p in self.positions):
            raise ValueError("no room for the position")
        if shares <= 0 or shares % self.lot or shares * price > self.money:
            raise ValueError("shares must be whole lots within the limit")
        self.positions.append({"code": code, "cost": price, "shares": shares, "date": date, "factor": factors})

    def sell(self, code: str, price: float, date: str) -> dict:
        p = next((p for p in self.positions if p["code"] == code), None)
        if p is None:
            raise ValueError("no such position")
        self.positions.remove(p)
        return {"date": date, "code": code, "cost": p["cost"], "price": price, "shares": p["shares"], "pnl_pct": price / p["cost"] - 1, "factor": p["factor"]}
