"""Stored tables: Parquet, CSV and JSON, whole, by column or split by a value."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from subpanel.session import work_dir


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet",
               schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    return df if columns is None else df.select(*columns)


#: Rows of a file whose rows are so small when packed that a read by bytes would give millions of them to one task.
ROWS_PER_FILE = 100_000


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "snappy",
                rows_per_file: int = 0) -> None:
    """Full refresh of a Parquet table, packed with Snappy if nothing else is said; 0 rows per file is no limit."""
    df.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", rows_per_file).partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, path: str, table: str, key: str | Sequence[str], buckets: int,
                   partition_by: Sequence[str] = (), spread: bool = False, point_reads: bool = False) -> DataFrame:
    """Full refresh of a Parquet table whose files are split by a hash of the key columns; returns the table.

    Joins, windows and groupings on the key between tables with the same number of buckets need no
    shuffle. `spread` shuffles the rows by the key first; without it they must already be so
    partitioned, or every task writes a file per bucket. `point_reads` adds Bloom filters on the key, so
    that a lookup of one id opens one bucket and skips the row groups without it. Only later stages read these files,
    so they are packed with zstd, a third smaller than Snappy.
    """
    key = [key] if isinstance(key, str) else list(key)
    if spread:
        df = df.repartition(buckets, *key)
    blooms = {"parquet.bloom.filter.adaptive.enabled": "true",
              **{f"parquet.bloom.filter.enabled#{k}": "true" for k in key}} if point_reads else {}
    (df.write.mode("overwrite").options(**blooms).option("path", path).option("compression", "zstd").partitionBy(*partition_by)
     .bucketBy(buckets, *key).sortBy(*key).saveAsTable(table))
    return df.sparkSession.table(table)


def kept(df: DataFrame, name: str, compression: str = "snappy", rows_per_file: int = 0) -> DataFrame:
    """Store a frame in the shared folder and read it back: cuts lineage, and every later reader sees the same rows."""
    path = f"{work_dir(df.sparkSession)}/kept/{name}-{uuid.uuid4().hex[:16]}"
    write_table(df, path, (), compression, rows_per_file)
    return read_table(df.sparkSession, path, schema=df.schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by(df: DataFrame, column: str, path: str, fmt: str = "csv") -> None:
    """One output folder per value of the column, in a single write."""
    writer = df.write.mode("overwrite").partitionBy(column)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
