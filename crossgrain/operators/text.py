"""Text and nested values: keyword sentiment, JSON fields, rows and cells of HTML tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_counts(text: Column, good: list[str], bad: list[str]) -> tuple[Column, Column]:
    """Occurrences of any good and of any bad keyword."""
    count = lambda words: F.regexp_count(text, F.lit("|".join(words))).cast("long")
    return count(good), count(bad)


def daily_sentiment(df: DataFrame, text: str, by: list[str], good: list[str], bad: list[str]) -> DataFrame:
    """(*by, hits, good, bad, sentiment): the sum of the texts' signs over their keyword hits, at least one."""
    g, b = keyword_counts(F.col(text), good, bad)
    df = df.withColumns({"_g": g, "_b": b}).withColumn("_s", F.signum(F.col("_g") - F.col("_b")))
    out = df.groupBy(*by).agg(F.sum("_g").alias("good"), F.sum("_b").alias("bad"), F.sum("_s").alias("_s"))
    out = out.withColumn("hits", F.col("good") + F.col("bad"))
    return out.select(*by, "hits", "good", "bad", (F.col("_s") / F.greatest(F.col("hits"), F.lit(1))).alias("sentiment"))


def presence_sentiment(text: Column, good: list[str], bad: list[str]) -> Column:
    """(good - bad) / (good + bad) over the keywords that occur at all; 0 without any."""
    hits = lambda words: sum((text.contains(w).cast("int") for w in words), F.lit(0))
    g, b = hits(good), hits(bad)
    return F.coalesce(F.try_divide((g - b).cast("double"), g + b), F.lit(0.0))


def html_cells(html: Column, tag: str = "li") -> Column:
    """The texts of all elements of a tag, without inner tags."""
    raw = F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(raw, lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))


def json_field(x: Column, name: str, kind: str = "bigint") -> Column:
    """A field of a JSON object; null where the text is malformed."""
    return F.get_json_object(x, f"$.{name}").try_cast(kind)


def quote_fields(x: Column) -> Column:
    """Fields of a record with tildes between them."""
    return F.split(x, "~")
