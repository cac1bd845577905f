"""Studies: top-N ends against costs, discrete factors, deciles, events, overnight returns, affordability."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import average_rank, finite, ratio, zscore

COST = 0.0045


def top_n(df: DataFrame, name: str, n: int, ascending: bool = False) -> DataFrame:
    """Rows whose average rank within the date is at most n."""
    return df.withColumn("_rank", average_rank(finite(name), ascending=ascending)).where(F.col("_rank") <= n).drop("_rank")


def ends(df: DataFrame, names: list[str], label: str = "fwd_5d", n: int = 5, min_names: int = 20, min_days: int = 50) -> DataFrame:
    """(name, end, gross, net, days, sharpe): mean label of both ends' n names by date, before and after costs."""
    parts = F.array(*[F.struct(F.lit(x).alias("name"), finite(x).alias("x")) for x in names])
    p = df.select("date", F.explode(parts).alias("p"), finite(label).alias("y")).select("date", "p.*", "y").where("x IS NOT NULL AND y IS NOT NULL")
    key = ("name", "date")
    p = p.withColumns({"top": average_rank("x", *key, ascending=False), "low": average_rank("x", *key), "c": F.count("x").over(Window.partitionBy(*key))})
    p = p.where(F.col("c") >= min_names)
    day = p.groupBy(*key).agg(F.avg(F.when(F.col("top") <= n, F.col("y"))).alias("top"), F.avg(F.when(F.col("low") <= n, F.col("y"))).alias("low"))
    long = day.select(*key, F.explode(F.array(F.struct(F.lit("top").alias("end"), F.col("top").alias("r")), F.struct(F.lit("low").alias("end"), F.col("low").alias("r")))).alias("e")).select(*key, "e.*")
    out = long.groupBy("name", "end").agg(F.avg("r").alias("gross"), F.count("r").alias("days"), (ratio(F.avg("r"), F.stddev_pop("r")) * math.sqrt(252)).alias("sharpe"))
    return out.where(F.col("days") >= min_days).withColumn("net", F.col("gross") - COST)


def by_value(df: DataFrame, name: str, label: str, most: int = 20) -> DataFrame:
    """For a factor of fewer than most values: mean label by value; no rows otherwise."""
    p = df.select(F.col(name).cast("double").alias("value"), finite(label).alias("y")).where("value IS NOT NULL AND y IS NOT NULL")
    out = p.groupBy("value").agg(F.avg("y").alias("mean"), F.count("*").alias("rows"))
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).where(F.col("_n") < most).drop("_n")


def deciles(df: DataFrame, name: str, label: str, n: int = 10) -> DataFrame:
    """Mean label between pooled quantile edges; equal edges fall together. Edges are n + 1 figures."""
    p = df.select(finite(name).alias("x"), finite(label).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    edges = p.agg(F.percentile("x", F.array(*[F.lit(k / n) for k in range(n + 1)])).alias("e"))
    p = p.crossJoin(F.broadcast(edges))  # one row
    inner = F.array_distinct(F.slice("e", 2, n - 1))
    b = F.size(F.filter(inner, lambda e: e < F.col("x")))
    return p.withColumn("bucket", b).groupBy("bucket").agg(F.avg("y").alias("mean"), F.count("*").alias("rows"))


def event_study(panel: DataFrame, events: DataFrame, label: str) -> DataFrame:
    """(sign, rows, event_mean, market_mean): label means of rows with events, by the sign of their net amount."""
    market = panel.agg(F.avg(finite(label)).alias("market_mean"))
    hit = panel.join(events, ["date", "code"]).withColumn("sign", F.signum("net").cast("int"))
    return hit.groupBy("sign").agg(F.count("*").alias("rows"), F.avg(finite(label)).alias("event_mean")).crossJoin(F.broadcast(market))


def event_factor(panel: DataFrame, events: DataFrame) -> DataFrame:
    """panel with event, net, event_up and net_z (within the date; 0 off events)."""
    net = events.groupBy("date", "code").agg(F.sum("net").alias("net"))
    out = panel.join(net, ["date", "code"], "left").withColumn("event", F.col("net").isNotNull().cast("int"))
    out = out.withColumn("event_up", F.coalesce((F.col("net") > 0).cast("int"), F.lit(0)))
    return out.withColumn("net_z", F.when(F.col("event") == 1, zscore("net")).otherwise(0.0)).fillna({"net": 0.0})


def yearly_groups(df: DataFrame, name: str, label: str, share: float = 0.2) -> DataFrame:
    """(year, top, bottom, rows): label means above and below the year's quantiles of the within-date rank."""
    p = df.select("date", finite(name).alias("x"), finite(label).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    p = p.withColumns({"r": average_rank("x") / F.count("x").over(Window.partitionBy("date")), "year": F.year("date")})
    q = p.groupBy("year").agg(F.percentile("r", F.lit(share)).alias("lo"), F.percentile("r", F.lit(1 - share)).alias("hi"))
    p = p.join(F.broadcast(q), "year")  # a row per year
    return p.groupBy("year").agg(F.avg(F.when(F.col("r") >= F.col("hi"), F.col("y"))).alias("top"), F.avg(F.when(F.col("r") <= F.col("lo"), F.col("y"))).alias("bottom"), F.count("*").alias("rows"))


def overnight_by_year(df: DataFrame) -> DataFrame:
    """(year, rows, gap, intraday, fullday, gap_share, gap_up): means of the parts of a return."""
    return df.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("rows"), F.avg("gap").alias("gap"), F.avg("intraday").alias("intraday"), F.avg("fullday").alias("fullday"),
        ratio(F.avg("gap"), F.avg("fullday")).alias("gap_share"), F.avg(F.when(F.col("gap") > 0, 1.0).otherwise(0.0)).alias("gap_up"),
    )


def affordability(df: DataFrame, name: str, label: str, price: float, n: int = 5) -> DataFrame:
    """(affordable, mean, rows): the top n by name within the date and price class."""
    p = df.select("date", "close", finite(name).alias("x"), finite(label).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    p = p.withColumn("affordable", (F.col("close") <= price).cast("int"))
    p = p.withColumn("r", average_rank("x", "date", "affordable", ascending=False)).where(F.col("r") <= n)
    return p.groupBy("affordable").agg(F.avg("y").alias("mean"), F.count("*").alias("rows"))
