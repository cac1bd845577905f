"""Indicators on a panel of bars, by code in order of date.

Every rolling factor uses a frame over one window specification, so Spark sorts the panel once, after one shuffle by code.
Columns of one stage are made in one projection; a stage refers only to earlier ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import clip, finite, frame, lag, ratio, roll, runs

SCALE = 15.8745  # yearly factor of daily deviations, as a fixed figure
LABELS = (1, 5, 10, 20)


def returns(df: DataFrame) -> DataFrame:
    """ret_1d and its sums over 5, 10 and 20 rows (sums, not compounded)."""
    df = df.withColumn("ret_1d", finite(ratio("close", lag("close")) - 1))
    return df.withColumns({f"ret_{n}d": roll(F.sum, "ret_1d", n) for n in (5, 10, 20)})


def trends(df: DataFrame) -> DataFrame:
    """Volatility, means of price, volume and turnover, true range, extremes, limits and flags."""
    before = lag("close")
    true_range = F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    limit = F.when(F.col("code").cast("string").rlike("^(30|68)"), 0.195).otherwise(0.095)
    df = df.withColumns(
        {f"vol_{n}d": roll(F.stddev_samp, "ret_1d", n) * SCALE for n in (5, 10, 20)}
        | {f"ma_{n}": roll(F.avg, "close", n) for n in (5, 10, 20, 60)}
        | {f"vol_ma{n}": roll(F.avg, "volume", n) for n in (5, 20)}
        | {f"turn_ma{n}": roll(F.avg, "turnover", n) for n in (5, 20)}
        | {f"high_{n}d": roll(F.max, "high", n) for n in (20, 60)}
        | {f"low_{n}d": roll(F.min, "low", n) for n in (20, 60)}
        | {
            "_tr": true_range,
            "_gain": F.greatest(F.col("close") - before, F.lit(0.0)) + (before - before),
            "_loss": F.greatest(before - F.col("close"), F.lit(0.0)) + (before - before),
            "_sd20": roll(F.stddev_samp, "close", 20),
            "vol_change_5d": finite(ratio("volume", lag("volume", 5)) - 1),
            "limit_up": (F.col("ret_1d") > limit).cast("int"),
            "limit_down": (F.col("ret_1d") < -limit).cast("int"),
            "is_suspended": (F.col("volume") == 0).cast("int"),
        }
    )
    above = F.col("ma_5") > F.col("ma_20")
    under = F.col("ma_5") < F.col("ma_20")
    width = 2 * F.col("_sd20")
    df = df.withColumns(
        {
            "atr_14": roll(F.avg, "_tr", 14),
            "ma5_dist": ratio(F.col("close") - F.col("ma_5"), "ma_5"),
            "ma20_dist": ratio(F.col("close") - F.col("ma_20"), "ma_20"),
            "ma5_ma20_cross": (above & (lag("ma_5") <= lag("ma_20"))).cast("int"),
            "ma5_ma20_dead": (under & (lag("ma_5") >= lag("ma_20"))).cast("int"),
            "vol_ratio": ratio("volume", "vol_ma5"),
            "vol_ratio_20": ratio("volume", "vol_ma20"),
            "turn_ratio": ratio("turnover", "turn_ma5"),
            "rsi_14": 100 - 100 / (1 + roll(F.avg, "_gain", 14) / (roll(F.avg, "_loss", 14) + 1e-10)),
            "bb_mid": F.col("ma_20"),
            "bb_upper": F.col("ma_20") + width,
            "bb_lower": F.col("ma_20") - width,
            "bb_width": ratio(2 * width, "ma_20"),
            "bb_pos": (F.col("close") - F.col("ma_20") + width) / (2 * width + 1e-10),
            "limit_up_5d": roll(F.sum, "limit_up", 5),
        }
        | {f"price_pos_{n}": (F.col("close") - F.col(f"low_{n}d")) / (F.col(f"high_{n}d") - F.col(f"low_{n}d") + 1e-10) for n in (20, 60)}
    )
    return df.withColumn("atr_ratio", ratio("atr_14", "close")).drop("_tr", "_gain", "_loss", "_sd20")


def streaks(df: DataFrame) -> DataFrame:
    """up_streak and down_streak: rows in a row with a positive or negative return; null on a code's first row."""
    df = df.withColumns({"_up": F.col("ret_1d") > 0, "_down": F.col("ret_1d") < 0})
    return runs(runs(df, "_up", "up_streak"), "_down", "down_streak").drop("_up", "_down")


def ewm(x: str, span: int):
    """Exponential mean with weights that sum to one from the first row on, null with fewer than span values.

    Weights below 1e-16 of the newest are left out, so the frame is bounded and nothing overflows on long series.
    """
    keep = 1 - 2 / (span + 1)
    wide = math.ceil(math.log(1e-16) / math.log(keep))
    values = F.collect_list(F.col(x)).over(frame(wide))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc * keep + v)
    n = F.size(values)
    return F.when(n >= span, total * (1 - keep) / (1 - F.pow(F.lit(keep), n)))


def macd(df: DataFrame) -> DataFrame:
    """macd_dif (12, 26), macd_dea (9) and macd_hist."""
    df = df.withColumn("macd_dif", ewm("close", 12) - ewm("close", 26))
    df = df.withColumn("macd_dea", ewm("macd_dif", 9))
    return df.withColumn("macd_hist", 2 * (F.col("macd_dif") - F.col("macd_dea")))


def extended(df: DataFrame) -> DataFrame:
    """illiq_20, vol_corr_5, vol_corr_20, skew_20 and kurt_20, by moments with sample deviations in the denominators."""
    df = df.withColumns(
        {"_r": clip(finite(ratio("close", lag("close")) - 1), -1.0, 1.0), "_v": clip(finite(ratio("volume", lag("volume")) - 1), -1.0, 1.0)}
    )
    df = df.withColumns(
        {
            "_i": clip(F.abs("_r") / (F.col("amount") + 1e-9) * 1e10, 0.0, 1e6),
            "_xy": F.col("_r") * F.col("_v"), "_r2": F.pow("_r", F.lit(2)), "_r3": F.pow("_r", F.lit(3)), "_r4": F.pow("_r", F.lit(4)),
        }
    )

    def co(n: int):
        c = roll(F.avg, "_xy", n) - roll(F.avg, "_r", n) * roll(F.avg, "_v", n)
        return c / (roll(F.stddev_samp, "_r", n) * roll(F.stddev_samp, "_v", n) + 1e-12)

    m1, m2, m3, m4 = (roll(F.avg, c, 20) for c in ("_r", "_r2", "_r3", "_r4"))
    sd = roll(F.stddev_samp, "_r", 20)
    return df.withColumns(
        {
            "illiq_20": F.log1p(roll(F.avg, "_i", 20)), "vol_corr_5": co(5), "vol_corr_20": co(20),
            "skew_20": (m3 - 3 * m1 * m2 + 2 * F.pow(m1, F.lit(3))) / (F.pow(sd, F.lit(3)) + 1e-12),
            "kurt_20": (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, F.lit(4))) / (F.pow(sd, F.lit(4)) + 1e-12) - 3,
        }
    ).drop("_r", "_v", "_i", "_xy", "_r2", "_r3", "_r4")


def labels(df: DataFrame) -> DataFrame:
    """fwd_n: the sum of the next n returns, that is ret_n n rows ahead. Filter dates only after this."""
    return df.withColumns({f"fwd_{n}d": lag(f"ret_{n}d", -n) for n in LABELS})


def clean(df: DataFrame) -> DataFrame:
    """Rows whose close is finite and above zero."""
    return df.where(finite("close") > 0)


def base(df: DataFrame) -> DataFrame:
    """All factors without exponential means."""
    return streaks(trends(returns(clean(df))))


def overnight(df: DataFrame, most_days: int = 10, most_gap: float = 0.5) -> DataFrame:
    """gap, intraday, fullday and range of adjacent bars: the next one at most most_days later, gap at most most_gap."""
    nxt = lag("date", -1)
    df = df.withColumns(
        {
            "_days": F.datediff(nxt, "date"), "gap": ratio(lag("open", -1), "close") - 1, "intraday": ratio(lag("close", -1), lag("open", -1)) - 1,
            "fullday": ratio(lag("close", -1), "close") - 1, "range": ratio("high", "low") - 1,
        }
    )
    return df.where((F.col("_days") <= most_days) & (F.abs("gap") <= most_gap)).drop("_days")
