"""Readers and writers: Parquet (one or several paths), CSV and JSON lines with schemas, upserts, JSON documents."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The column that numbers appended batches, and more than there can be of them.
BATCH, MOST_BATCHES = "_batch", 1 << 40
WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as longs and floats as doubles, so that files of different widths can be joined up."""
    return df.select(*[F.col(c).cast(WIDER.get(kind, kind)).alias(c) for c, kind in df.dtypes])


def ordered(df: DataFrame, source: int = 0) -> DataFrame:
    """df with source_ord in place of BATCH: grows by source, then by the batch that a row was appended with (none: the first)."""
    batch = F.coalesce(F.col(BATCH).cast("long"), F.lit(0)) if BATCH in df.columns else F.lit(0)
    return df.withColumn("source_ord", F.lit(source * MOST_BATCHES) + batch).drop(BATCH)


def scan(spark: SparkSession, *paths: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One or more Parquet tables, widened, with missing columns as nulls; source_ord tells tables and appended batches apart, in
    their order (main first)."""
    parts = [ordered(widened(spark.read.option("mergeSchema", True).parquet(p)), k) for k, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*columns, "source_ord") if columns else out


def keep_last(df: DataFrame, keys: list[str], order: str = "source_ord") -> DataFrame:
    """One row per key: that of the last source. Aggregation combines before it shuffles, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: str = "source_ord") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def conforming(batch: DataFrame, columns: list[str]) -> DataFrame:
    """The contract for a new batch: every old column must be there; others are dropped; the order is the old one."""
    missing = [c for c in columns if c not in batch.columns]
    if missing:
        raise ValueError(f"the batch lacks {missing}")
    return batch.select(*columns)


def append_delta(batch: DataFrame, path: str, keys: list[str]) -> int:
    """Appends a batch as new files under the next batch number, which it returns; readers settle repeated keys with keep_last over
    scan(). Of a key's rows in one batch the last one stays. One writer at a time."""
    spark = batch.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    last = 0
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        stored = spark.read.option("mergeSchema", True).parquet(path)
        last = (stored.agg(F.max(BATCH)).first()[0] if BATCH in stored.columns else None) or 0
    own = keep_last(batch.withColumn("source_ord", F.monotonically_increasing_id()), keys).drop("source_ord")
    own.withColumn(BATCH, F.lit(last + 1).cast("long")).write.mode("append").option("compression", "zstd").parquet(path)
    return last + 1


def not_done(calendar: DataFrame, stored: DataFrame, key: str = "date") -> DataFrame:
    """What a resumed job still has to do: the calendar's keys that are not stored."""
    return calendar.join(stored.select(key).distinct(), key, "left_anti")


def replace_parquet(df: DataFrame, path: str) -> None:
    """Writes a table beside the old one and swaps them; the old one stays as .bak."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    new, old, bak = (jvm.org.apache.hadoop.fs.Path(path + s) for s in (".new", "", ".bak"))
    fs = old.getFileSystem(conf)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path + ".new")
    if fs.exists(old):
        fs.delete(bak, True)
        fs.rename(old, bak)
    fs.rename(new, old)


def compact(spark: SparkSession, parts: str, path: str, keys: list[str], files: int = 1) -> None:
    """Merges appended batches into one table with one row per key, that of the last batch."""
    keep_last(ordered(spark.read.option("mergeSchema", True).parquet(parts)), keys).drop("source_ord").repartition(files).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and given types (codes as strings keep their zeros)."""
    return spark.read.csv(path, schema=schema, header=True)


def read_events(spark: SparkSession, path: str, schema: str, stage: str | None = None, run_id: str | None = None, limit: int | None = None) -> DataFrame:
    """JSON lines; malformed ones are skipped. Optionally one stage or run, and the last rows by ts."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    df = df.where(F.col("stage") == stage) if stage else df
    df = df.where(F.col("run_id") == run_id) if run_id else df
    return df.orderBy(F.col("ts").desc()).limit(limit) if limit else df


def write_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def save_json(path: str | Path, doc: dict, backups: int = 3) -> dict:
    """A small driver-side document: written aside, synced and swapped in; version grows. The last few versions stay beside it,
    as name.v1.bak and so on."""
    path = Path(path)
    had = int(load_json(path).get("version", 0)) if path.exists() else 0
    doc = {**doc, "version": had + 1}
    if had:
        path.with_suffix(f".v{had}.bak").write_bytes(path.read_bytes())
        path.with_suffix(f".v{had - backups}.bak").unlink(missing_ok=True)
    new = path.with_suffix(".tmp")
    with new.open("w") as f:
        json.dump(doc, f, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(new, path)
    return doc


def load_json(path: str | Path, schema_version: int | None = None) -> dict:
    doc = json.loads(Path(path).read_text())
    if schema_version is not None and doc.get("schema_version") != schema_version:
        raise ValueError(f"schema_version {doc.get('schema_version')} is not {schema_version}")
    return doc


def latest_rows(df: DataFrame, by: str, n: int, *order) -> DataFrame:
    """The first n rows of each group, by an order with a tie-break."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
