"""Null discipline, rolling frames and cross-sectional functions.

NaN and infinities become null at the boundary; divisions by zero give null; correlations never divide by a zero
spread; ranks leave nulls out. Order is always in a window, never in the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATE, CODE = "date", "code"


def by_code():
    return Window.partitionBy(CODE).orderBy(DATE)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: str | Column) -> Column:
    """x as a double, null where it is NaN or infinite."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(col(a), col(b))


def clip(x: str | Column, low: float, high: float) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def frame(n: int):
    return by_code().rowsBetween(-(n - 1), 0)


def roll(how, x: str | Column, n: int, least: int | None = None) -> Column:
    """An aggregate over the last n observed rows of a code; null with fewer than least (n) values."""
    x, w = col(x), frame(n)
    least = n if least is None else least
    return F.when(F.count(x).over(w) >= least, how(x).over(w))


def lag(x: str | Column, n: int = 1) -> Column:
    """The value n rows ago; of future rows if n is negative (labels only)."""
    return F.lag(col(x), n).over(by_code()) if n >= 0 else F.lead(col(x), -n).over(by_code())


def average_rank(x: str | Column, *by: str, ascending: bool = True) -> Column:
    """Rank from 1 with ties averaged, nulls left out, within by (the date)."""
    x, by = col(x), by or (DATE,)
    order = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    w = Window.partitionBy(*by).orderBy(order)
    first, ties = F.rank().over(w), F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow))  # one sort for both
    return F.when(x.isNotNull(), first + (ties - 1) / 2)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation by moments; null where either side is constant. Rows must be complete pairs."""
    x, y = col(x), col(y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.try_divide(F.covar_pop(x, y), spread))


def zscore(x: str | Column, *by: str, epsilon: float = 1e-12) -> Column:
    x, w = col(x), Window.partitionBy(*(by or (DATE,)))
    return (x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + F.lit(epsilon))


def bucket(rank: Column, count: Column, n: int) -> Column:
    """The n-quantile bucket of a rank: trunc(rank / count * n), at most n - 1."""
    return F.least(F.floor(rank / count * n), F.lit(n - 1)).cast("int")


def runs(df: DataFrame, flag: str, out: str) -> DataFrame:
    """Adds the number of flagged rows in a row up to each one of a code; 0 off the flag, null where it is null."""
    change = F.when(lag(flag).isNull() | (lag(flag) != F.col(flag)), 1).otherwise(0)
    df = df.withColumn("_change", change)
    df = df.withColumn("_run", F.sum("_change").over(by_code().rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(CODE, "_run").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col(flag).isNotNull(), F.sum(F.col(flag).cast("int")).over(inside)).cast("long")).drop("_change", "_run")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, -0 as 0: sums depend on the order of their terms in the last digits."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
