"""Scoring, fills, market gates and portfolio simulation.

A simulation depends on its own path, so it runs date by date; different configurations run side by side, one group each.
What each group gets is the scored candidates and the rows of codes that may be held, already filtered and ranked by Spark.
"""

from __future__ import annotations

import itertools
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import average_rank, ratio

#: Base score: expressions on factor columns and their weights (fixed values).
BASE_SCORE = (
    ("s1", "-ret_5d * turn_ma5", 0.25),
    ("s2", "-ma5_dist * turn_ma5", 0.20),
    ("s3", "-vol_10d - vol_change_5d", 0.15),
    ("s4", "limit_up_5d", 0.15),
    ("s5", "-turn_ratio", 0.15),
    ("s6", "macd_dif", 0.10),
)


#: Rows that may be bought.
BUYABLE = "is_suspended = 0 AND limit_up = 0 AND limit_down = 0 AND price_pos_20 > 0.1 AND price_pos_20 < 0.85 AND close > ma_20"


@dataclass(frozen=True)
class Rules:
    """One configuration of the simulator; percentages are fractions, prices are in panel units."""

    capital: float = 20_000.0
    slots: int = 4
    position: float = 5_000.0
    lot: int = 100
    stop: float = -0.04
    take: float = 0.06
    time_stop: int = 5
    time_gain: float = 0.05
    min_cash: float = 2_000.0
    protect: float = 0.03
    top: int = 3
    commission: float = 0.00025
    commission_min: float = 5.0
    stamp: float = 0.0005
    hold: int = 0  # exit after so many dates alone; 0: by the rules
    gate: bool = True
    strict_slots: bool = True  # False: the limit of slots is looked at once a date


def score_parts(parts=BASE_SCORE) -> dict[str, Column]:
    """The columns that ranked() needs."""
    return {f"_{name}": F.expr(e).cast("double") for name, e, _ in parts}


def ranked(df: DataFrame, parts=BASE_SCORE) -> DataFrame:
    """Adds score in place of score_parts(): the weighted sum of their average ranks within the date; null parts count as 0."""
    df = df.withColumn("score", F.lit(0.0))
    for name, _, weight in parts:  # one at a time, so that rows are sorted with the parts still to come alone
        df = df.withColumn("score", F.col("score") + F.coalesce(average_rank(f"_{name}"), F.lit(0.0)) * weight).drop(f"_{name}")
    return df


def composite(df: DataFrame, parts=BASE_SCORE) -> DataFrame:
    """Adds score: the weighted sum of average ranks of the parts within the date; null parts count as 0."""
    return ranked(df.withColumns(score_parts(parts)), parts)


def candidates(df: DataFrame, trend: bool = True) -> DataFrame:
    """Rows that may be bought: tradable, and in an upward middle position."""
    df = df.where("is_suspended = 0 AND limit_up = 0 AND limit_down = 0")
    return df.where("price_pos_20 > 0.1 AND price_pos_20 < 0.85 AND close > ma_20") if trend else df


def slippage(ret: Column) -> Column:
    return 0.001 + 0.002 * F.coalesce(F.least(F.abs(ret) / 0.05, F.lit(1.0)), F.lit(0.5))


def commission(amount: Column, rules: Rules = Rules()) -> Column:
    return F.greatest(F.lit(rules.commission_min), amount * rules.commission)


def breadth(df: DataFrame) -> DataFrame:
    """(date, ups, downs, names, spread, up_share, limit_ups, limit_downs); flat and null returns count as down."""
    out = df.groupBy("date").agg(
        F.count(F.when(F.col("ret_1d") > 0, 1)).alias("ups"), F.count("*").alias("names"),
        F.coalesce(F.sum("limit_up"), F.lit(0)).cast("long").alias("limit_ups"), F.coalesce(F.sum("limit_down"), F.lit(0)).cast("long").alias("limit_downs"),
    )
    return out.withColumns({"downs": F.col("names") - F.col("ups"), "spread": 2 * F.col("ups") - F.col("names"), "up_share": F.col("ups") / F.col("names")})


def market_gate(day: DataFrame, limit_ups: int = 60) -> DataFrame:
    """Adds open: at least two of an index above its mean, many limit-ups, and net inflow (where there is a column)."""
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    inflow = yes(F.col("inflow") > 0) if "inflow" in day.columns else F.lit(0)
    return day.withColumn("open", (yes(F.col("index_close") > F.col("index_ma20")) + yes(F.col("limit_ups") > limit_ups) + inflow >= 2).cast("int"))


def hold_n(df: DataFrame, n: int, top: int = 3) -> DataFrame:
    """Trades without limits of capital: the top by score of each date, sold n rows of the code later, with slippage."""
    w = Window.partitionBy("code").orderBy("date")
    buy = F.col("close") * (1 + slippage(F.col("ret_1d")))
    sell = F.lead(F.col("close") * (1 - slippage(F.col("ret_1d"))), n).over(w)
    df = df.withColumns({"buy": buy, "sell": sell, "sell_date": F.lead("date", n).over(w)})
    df = candidates(df)
    first = Window.partitionBy("date").orderBy(F.col("score").desc_nulls_last(), "code")
    df = df.withColumn("_n", F.row_number().over(first)).where((F.col("_n") <= top) & F.col("sell").isNotNull())
    return df.select("date", "code", "score", "buy", "sell_date", "sell", (ratio("sell", "buy") - 1).alias("ret"))


TRADE = "config long, code string, buy_date date, buy_price double, sell_date date, sell_price double, shares long, pnl double, pnl_pct double, fee double, px_ret_pct double, net_ret_pct double, notional double, reason string, held_days long"


class Book:
    """Holdings and cash of one configuration."""

    def __init__(self, rules: Rules):
        self.r, self.cash, self.held, self.trades = rules, rules.capital, {}, []

    @staticmethod
    def slip(ret) -> float:
        return 0.001 + 0.002 * (0.5 if ret is None or ret != ret else min(abs(ret) / 0.05, 1.0))

    def exit_reason(self, h: dict, row, age: int) -> tuple[str | None, float]:
        r, gain = self.r, row.close / h["price"] - 1
        if r.hold:
            return ("hold" if age >= r.hold else None), 1.0
        below = lambda mean: mean == mean and mean is not None and row.close < mean
        if gain <= r.stop:
            return "stop", 1.0
        if gain >= r.take:
            return "take", 1.0
        if h["peak"] >= h["price"] * (1 + r.protect) and gain < 0.01:
            return "protect", 1.0
        if below(row.ma_60):
            return "ma60", 1.0
        if below(row.ma_20):
            return ("ma20", 1.0) if h["half"] else ("ma20 half", 0.5)
        if age >= r.time_stop and gain < r.time_gain:
            return "time", 1.0
        return None, 1.0

    def sell(self, code, day, row, shares: int, age: int, reason: str) -> None:
        h, r = self.held[code], self.r
        price = row.close * (1 - self.slip(row.ret_1d))
        amount = shares * price
        paid = max(r.commission_min, amount * r.commission) + amount * r.stamp
        fee = paid + h["fee"] * shares / h["bought"]
        ret, notional = price / h["price"] - 1, shares * h["price"]
        self.note(code, h, day, price, shares, notional * ret - fee, ret, fee, row.close / h["close"] - 1, notional, reason, age)
        self.cash += amount - paid
        h["shares"] -= shares

    def note(self, code, h, day, price, shares, pnl, ret, fee, px, notional, reason, age) -> None:
        net = ret - fee / notional if notional else 0.0
        self.trades.append((code, h["date"], h["price"], day, price, shares, pnl, 100 * ret, fee, 100 * px, 100 * net, notional, reason, age))

    def exits(self, day, rows: dict, number: int) -> None:
        for code in list(self.held):
            h, row = self.held[code], rows.get(code)
            age = number - h["number"]
            if age < 1 or row is None or (row.ret_1d == row.ret_1d and row.ret_1d is not None and row.ret_1d <= -0.095):
                continue
            h["peak"] = max(h["peak"], row.close)
            reason, part = self.exit_reason(h, row, age)
            if reason is None:
                continue
            shares = int(h["shares"] * part)
            self.sell(code, day, row, shares if shares >= self.r.lot else h["shares"], age, reason)
            h["half"] |= part == 0.5
            if h["shares"] < self.r.lot:
                del self.held[code]

    def buys(self, day, ranked: list, number: int) -> None:
        r = self.r
        if len(self.held) >= r.slots or self.cash < r.min_cash:
            return
        for row in [x for x in ranked if str(x.code) not in self.held][: r.top]:
            if r.strict_slots and len(self.held) >= r.slots:
                break
            shares = int(r.position / row.close / r.lot) * r.lot
            price = row.close * (1 + self.slip(row.ret_1d))
            cost = shares * price
            fee = max(r.commission_min, cost * r.commission)
            if shares < r.lot or cost + fee > self.cash:
                continue
            self.cash -= cost + fee
            self.held[str(row.code)] = {"date": day, "number": number, "price": price, "close": row.close, "shares": shares, "bought": shares, "fee": fee, "peak": price, "half": False}

    def close(self, day, rows: dict, number: int) -> None:
        """Sells what is left on the last date; codes without a row that day go at cost."""
        for code, h in list(self.held.items()):
            if (row := rows.get(code)) is not None:
                self.sell(code, day, row, h["shares"], number - h["number"], "end")
            else:
                fee, notional = h["fee"] * h["shares"] / h["bought"], h["shares"] * h["price"]
                self.note(code, h, day, h["price"], h["shares"], -fee, 0.0, fee, 0.0, notional, "end without data", number - h["number"])
                self.cash += notional
        self.held.clear()


def replay(rows: pd.DataFrame, rules: Rules, days: list[tuple] | None = None) -> list[tuple]:
    """Trades of one configuration. rows: date, code, close, ret_1d, ma_20, ma_60, score, buyable, market_open.

    days: (date, market_open) of all dates in order, where rows don't have them all.
    """
    book, day, by_code, number = Book(rules), None, {}, -1
    rows = rows.sort_values(["date", "score", "code"], ascending=[True, False, True])
    by_day = {day: list(x.itertuples(index=False)) for day, x in rows.groupby("date", sort=True)}
    if days is None:
        days = [(day, items[0].market_open) for day, items in by_day.items()]
    for number, (day, market_open) in enumerate(days):
        items = by_day.pop(day, [])
        by_code = {str(r.code): r for r in items}
        book.exits(day, by_code, number)
        if rules.gate and not market_open:
            continue
        book.buys(day, [r for r in items if r.buyable and r.score == r.score], number)
    if day is not None:
        book.close(day, by_code, number)
    return book.trades


def reachable(rules: Rules) -> int:
    """How many of a date's buyable rows, by score, a configuration may look at: its top, behind all that it may hold before it buys."""
    return max(0, rules.top + max(0, rules.slots - 1))


def simulate(df: DataFrame, configs: list[Rules], days: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """Trades of all configurations, numbered by their place in the list.

    df: a panel with close, ret_1d, ma_20, ma_60, score, market_open and the candidates' columns (or buyable in place of those).
    days: (date, market_open) of all its dates, if it has no market_open. scored: (date, code, buyable, score), if it has no score. A configuration buys among the first rows of a date that are buyable, and
    then looks at those codes alone, so its task reads these codes' rows and the dates: at most dates x reachable() codes, however many
    the panel has. Its path demands one task; configurations spread over the cluster.
    """
    spark: SparkSession = df.sparkSession
    if "buyable" not in df.columns:
        df = df.withColumn("buyable", F.coalesce(F.expr(BUYABLE), F.lit(False)))
    df = df.withColumn("code", F.col("code").cast("string")).where("date IS NOT NULL")
    scored = df if scored is None else scored.withColumn("code", F.col("code").cast("string")).where("date IS NOT NULL")
    if days is None:
        days = df.groupBy("date").agg(F.max("market_open").alias("market_open"))
    most = max((reachable(c) for c in configs), default=0)
    first = Window.partitionBy("date").orderBy(F.col("score").desc(), F.col("code").asc_nulls_last())
    picked = scored.where("buyable AND score IS NOT NULL AND NOT isnan(score)").select("date", "code", "score")
    picked = picked.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    picked = picked.groupBy("code", "date").agg(F.max("score").alias("score")).groupBy(F.col("code").alias("_code"))
    picked = picked.agg(F.map_from_entries(F.collect_list(F.struct("date", "score"))).alias("_scores"))
    rows = df.select("date", "code", "close", "ret_1d", "ma_20", "ma_60", "buyable")
    rows = rows.join(F.broadcast(picked), F.col("code").eqNullSafe(F.col("_code")))  # at most dates x most scores in all
    rows = rows.withColumn("score", F.try_element_at("_scores", "date").cast("double")).withColumn("buyable", F.col("buyable") & F.col("score").isNotNull())
    rows = rows.drop("_code", "_scores").withColumn("market_open", F.lit(None).cast("boolean"))
    every = rows.withColumn("_day", F.lit(False)).unionByName(days.select("date", F.col("market_open").cast("boolean"), F.lit(True).alias("_day")), allowMissingColumns=True)
    table = spark.createDataFrame([(k, *asdict(c).values()) for k, c in enumerate(configs)], ["config", *[f.name for f in fields(Rules)]])
    known = {k: c for k, c in enumerate(configs)}

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in TRADE.split(", ")]
        of_days = x["_day"].astype(bool)
        dates = x[of_days].sort_values("date")
        trades = replay(x[~of_days].drop(columns="_day"), known[key[0]], list(zip(dates["date"], dates["market_open"].astype(bool), strict=True)))
        return pd.DataFrame([(key[0], *t) for t in trades], columns=names)

    every = every.crossJoin(F.broadcast(table.select("config")))  # a row per configuration
    return every.groupBy("config").applyInPandas(run, TRADE)


def grid(base: Rules = Rules(), **axes) -> list[Rules]:
    """All combinations of the axes' values on a base configuration."""
    return [Rules(**(asdict(base) | dict(zip(axes, v, strict=True)))) for v in itertools.product(*axes.values())]


def metrics(trades: DataFrame, capital: float = 20_000.0, *by: str) -> DataFrame:
    """Total %, trades, win rate %, profit / loss ratio (99 without losses), drawdown %, fees and mean days, by group."""
    by = by or ("config",)
    w = Window.partitionBy(*by).orderBy("sell_date", "code", "buy_date", "shares")
    run = trades.withColumn("_cum", F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("_peak", F.greatest(F.max("_cum").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    win, loss = F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.avg(F.when(F.col("pnl") <= 0, -F.col("pnl")))
    return run.groupBy(*by).agg(
        (F.sum("pnl") / capital * 100).alias("total_pct"), F.count("*").alias("trades"),
        (F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)) * 100).alias("win_pct"),
        F.coalesce(F.try_divide(win, loss), F.lit(99.0)).alias("profit_loss"),
        (F.min(F.col("_cum") - F.col("_peak")) / capital * 100).alias("drawdown_pct"),
        F.sum("fee").alias("fees"), F.avg("held_days").alias("held_days"), F.avg("net_ret_pct").alias("net_ret_pct"),
    )


def attribution(trades: DataFrame) -> DataFrame:
    """(reason, trades, mean, wins): trades by exit reason."""
    return trades.groupBy("reason").agg(F.count("*").alias("trades"), F.avg("pnl_pct").alias("mean"), F.count(F.when(F.col("pnl") > 0, 1)).alias("wins"))


def segments(trades: DataFrame, months: int = 6) -> DataFrame:
    """Results by out-of-sample stretch of so many months of the sale."""
    at = F.floor((F.year("sell_date") * 12 + F.month("sell_date") - 1) / months).cast("long")
    return trades.withColumn("segment", at).groupBy("config", "segment").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("trades"))


def priced(df: DataFrame, raw: str = "raw_close", least: float = 0.95) -> DataFrame:
    """df, if enough rows have an unadjusted price; an error otherwise."""
    share = df.agg((F.count(raw) / F.count("*")).alias("s")).first()["s"]
    if share is None or share < least:
        raise ValueError(f"only {share} of the rows have {raw}")
    return df
