"""Windows of features as arrays, for models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import by_code, finite


def windows(df: DataFrame, features: list[str], label: str, size: int = 30, stride: int = 5, least: int = 35, cutoff: str | None = None) -> DataFrame:
    """(date, code, x, y): arrays size x features of z-scores, each feature scaled by its code's mean and deviation.

    The scales are those up to cutoff (a date), else of all rows. Nulls become 0; rows without a finite label and codes with
    fewer than least rows are left out; every stride-th window of a code stays.
    """
    part = Window.partitionBy("code")
    seen = F.col("date") <= F.lit(cutoff) if cutoff else F.lit(True)
    scaled = {}
    for f in features:
        known = F.when(seen, finite(f))
        z = (finite(f) - F.avg(known).over(part)) / (F.stddev_samp(known).over(part) + 1e-9)
        scaled[f"_z_{f}"] = F.coalesce(finite(z), F.lit(0.0))
    df = df.withColumns(scaled | {"_rows": F.count("*").over(part), "_n": F.row_number().over(by_code()), "y": finite(label)})
    row = F.array(*[F.col(c) for c in scaled])
    df = df.withColumn("x", F.collect_list(row).over(by_code().rowsBetween(-(size - 1), 0)))
    ok = (F.size("x") == size) & F.col("y").isNotNull() & (F.col("_rows") >= least) & ((F.col("_n") - size) % stride == 0)
    return df.where(ok).select("date", "code", "x", "y")


def prediction_ic(df: DataFrame, prediction: str, label: str, least: int = 5, min_days: int = 30) -> DataFrame:
    """Daily rank correlation of predictions over dates with more than least names: mean and dates."""
    from . import ic

    s = ic.ic_series(df, [prediction], [label]).where(F.col("n") > least)
    return ic.ic_summary(s, min_days=min_days)
