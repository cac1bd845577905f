"""Bars: a panel keyed by (date, code) from trade rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: Bytes of a source's files for each partition of its rows; sorts of that much stay in memory.
PART_BYTES = 8 << 20
VALID = "l_quantity > 0 AND l_shipdate IS NOT NULL"
TRADE_COLUMNS = ("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def parts(lines: DataFrame) -> int:
    """How many partitions rows made of these are dealt over: the session's number, or more for large sources."""
    size = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)


def bars(lines: DataFrame, period: str = "week") -> DataFrame:
    """(date, code, open, high, low, close, volume, amount, turnover) by supplier and period.

    Price is extended price over quantity; open and close are the first and last by (l_shipdate, l_orderkey,
    l_linenumber, l_partkey), which is unique with the supplier. Turnover stands in for a traded share:
    volume / 1000. One shuffle, by (code, date), with partial aggregation.
    """
    return bars_of_valid(lines.where(VALID), period)


def bars_of_valid(lines: DataFrame, period: str) -> DataFrame:
    """bars() of rows that are VALID."""
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return (
        lines.select(F.col("l_suppkey").alias("code"), F.to_date(F.date_trunc(period, "l_shipdate")).alias("date"), price.alias("p"), at.alias("at"), "l_quantity", "l_extendedprice")
        .groupBy("code", "date")
        .agg(
            F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"),
            F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"),
        )
        .withColumn("turnover", F.col("volume") / 1000)
    )


#: Bits of whole numbers that share a long in packed rows: line numbers, quantities, days.
LINE_BITS, QUANTITY_BITS, DAY_BITS = 4, 10, 20
#: Types of the columns that are packed.
WHOLE, STAMPS = {"tinyint", "smallint", "int", "bigint"}, {"date", "timestamp", "timestamp_ntz"}


def dealt(lines: DataFrame, n: int) -> DataFrame:
    """Trades dealt by code over n partitions, the same rows after as before. On the way most are three longs: order and line, part and
    quantity, price in hundredths and day. Rows that those cannot hold exactly travel as they are."""
    kinds = dict(lines.dtypes)
    if not (all(kinds[c] in WHOLE for c in ("l_orderkey", "l_linenumber", "l_partkey")) and kinds["l_quantity"] == kinds["l_extendedprice"] == "double" and kinds["l_shipdate"] in STAMPS):
        return lines.repartition(n, "l_suppkey")
    others = [c for c in TRADE_COLUMNS if c != "l_suppkey"]
    under = lambda c, bits: (F.col(c) >= 0) & (F.col(c) < F.lit(1 << bits))
    price, some = F.col("l_extendedprice"), F.col("l_quantity").between(1, (1 << QUANTITY_BITS) - 1)
    # each column is made once: expressions that repeat one another would make a method too long to be compiled
    made = lines.select(
        "*", F.when((price > 0) & (price < 1e9), F.floor(price * 100 + 0.5)).alias("_cents"), F.to_date("l_shipdate").alias("_date"),
        F.when(some, F.col("l_quantity").cast("long")).alias("_whole"),
    ).withColumn("_day", F.unix_date("_date"))
    fits = (
        under("l_linenumber", LINE_BITS) & under("l_orderkey", 62 - LINE_BITS) & under("l_partkey", 62 - QUANTITY_BITS) & (F.col("l_quantity") == F.col("_whole"))
        & (F.col("_cents") / F.lit(100.0) == price) & (F.col("_date").cast(kinds["l_shipdate"]) == F.col("l_shipdate")) & under("_day", DAY_BITS)
    )
    made, fits = made.withColumn("_fits", F.coalesce(fits, F.lit(False))), F.col("_fits")
    sent = made.select(
        "l_suppkey", F.when(~fits, F.struct(*others)).alias("_row"),
        F.when(fits, F.shiftleft(F.col("l_orderkey").cast("long"), LINE_BITS) + F.col("l_linenumber")).alias("_a"),
        F.when(fits, F.shiftleft(F.col("l_partkey").cast("long"), QUANTITY_BITS) + F.col("_whole")).alias("_b"),
        F.when(fits, F.shiftleft("_cents", DAY_BITS) + F.col("_day")).alias("_c"),
    ).repartition(n, "l_suppkey")
    low = lambda c, bits: F.col(c).bitwiseAND(F.lit((1 << bits) - 1))
    found = {
        "l_orderkey": F.shiftright("_a", LINE_BITS), "l_linenumber": low("_a", LINE_BITS), "l_partkey": F.shiftright("_b", QUANTITY_BITS),
        "l_quantity": low("_b", QUANTITY_BITS), "l_extendedprice": F.shiftright("_c", DAY_BITS) / F.lit(100.0), "l_shipdate": F.date_from_unix_date(low("_c", DAY_BITS).cast("int")),
    }
    return sent.select("l_suppkey", *[F.when(F.col("_row").isNull(), found[c].cast(kinds[c])).otherwise(F.col(f"_row.{c}")).alias(c) for c in others])


def panel(spark: SparkSession, sf_dir: str, period: str = "week") -> DataFrame:
    """Bars of lineitem, dealt by code: the trades' own columns are shuffled once, and windows by code need no other shuffle."""
    lines = table(spark, sf_dir, "lineitem").select(*TRADE_COLUMNS)
    # a filter of what is unpacked would be moved ahead of the shuffle and repeat all of the packing
    return bars_of_valid(dealt(lines.where(VALID), parts(lines)), period)


def bars_sql(period: str = "week") -> str:
    """The same for DuckDB."""
    at = "ROW(l_shipdate, l_orderkey, l_linenumber, l_partkey)"
    return f"""SELECT l_suppkey AS code, CAST(date_trunc('{period}', l_shipdate) AS DATE) AS date,
  arg_min(l_extendedprice / l_quantity, {at}) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, {at}) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount, sum(l_quantity) / 1000 AS turnover
  FROM lineitem WHERE l_quantity > 0 AND l_shipdate IS NOT NULL GROUP BY 1, 2"""


def index_series(panel: DataFrame) -> DataFrame:
    """A day-level index: the mean close by date, and its mean over 20 rows. Bounded by the number of dates.

    Closes count in whole units of 1e-4 and means in whole millionths, so that nothing depends on the order of the rows.
    """
    from pyspark.sql import Window

    w = Window.orderBy("date").rowsBetween(-19, 0)
    units = F.floor(F.col("close") * 10000 + 0.5)
    day = panel.groupBy("date").agg(F.sum(units).alias("_s"), F.count("close").alias("_n"))
    day = day.select("date", F.expr("_s * 100 div _n").alias("_u"))
    mean = F.call_function("div", F.sum("_u").over(w), F.lit(20)) / 1e6
    return day.select("date", (F.col("_u") / 1e6).alias("index_close"), F.when(F.count("_u").over(w) == 20, mean).alias("index_ma20"))
