"""CSV extracts: one file (or folder of part files) per source and month, the month in its name."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subpanel.functions.columns import half_even, month_from_name
from subpanel.schemas import INVENTORY_SOURCES, SOURCE_COLUMNS
from subpanel.session import setting
from subpanel.sources.tables import ROWS_PER_FILE


# Texts that stand for a missing value in the extracts.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


#: Files that a task writes side by side; rows of further months are sorted.
OPEN_MONTHS = 32


def _entry(path: Column) -> Column:
    """A monthly file, or the folder that holds its part files."""
    return F.when(_name(path).startswith("part-"), F.regexp_extract(path, "^(.*)/[^/]+$", 1)).otherwise(path)


def _name(entry: Column) -> Column:
    return F.substring_index(entry, "/", -1)


def _listing(spark: SparkSession, root: str, source: str) -> DataFrame | None:
    """Files of one source, None when its folder is absent. Reads the listing, not the contents."""
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", "{*.csv,part-*.csv.gz}").load(f"{root}/{source}"))
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    entry = _entry(F.col("path"))
    return files.filter(_name(entry).startswith(f"{source}_")).select(
        F.lit(source).alias("source"), "path", entry.alias("entry"), _name(entry).alias("name"),
        F.coalesce(month_from_name(_name(entry)), F.lit("unknown")).alias("month"),
        half_even(F.col("length") / (1024 * 1024), 2).alias("size_mb"), F.col("modificationTime").alias("modified"))


def list_source_files(spark: SparkSession, root: str, sources: Sequence[str] = tuple(INVENTORY_SOURCES)) -> DataFrame:
    """Files below root/<source>: name, month, size in MB, time of change and number of files per source.

    Absent folders give no rows.
    """
    found = [df for source in sources if (df := _listing(spark, root, source)) is not None]
    if not found:
        return spark.createDataFrame([], "source string, path string, name string, month string, size_mb double, "
                                         "modified timestamp, file_count bigint")
    out = reduce(DataFrame.unionByName, found).drop("entry")
    return out.join(out.groupBy("source").agg(F.count(F.lit(1)).alias("file_count")), "source")


def table_inventory(spark: SparkSession, root: str, tables: Sequence[str]) -> DataFrame:
    """Stored tables below root: files, rows, size and last change, from file metadata; an empty table gives no row.

    No data column is read: rows are counted from the footers, files are grouped before tables.
    """
    parts = [spark.read.parquet(f"{root}/{t}.parquet").select(
        F.lit(t).alias("table_name"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified")) for t in tables]
    by_file = (reduce(DataFrame.unionByName, parts).groupBy("table_name", "path", "size", "modified")
               .agg(F.count(F.lit(1)).alias("n")))
    return by_file.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("n").alias("row_count"),
        half_even(F.sum("size") / (1024 * 1024), 2).alias("size_mb"), F.max("modified").alias("modified"))


def source_counts(spark: SparkSession, root: str, sources: Sequence[str] = tuple(INVENTORY_SOURCES)) -> DataFrame:
    """Every known source with its number of files, 0 for an absent or empty folder."""
    known = spark.createDataFrame([(s,) for s in sources], "source string")
    found = list_source_files(spark, root, sources).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return known.join(found, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("file_count"),
                                                      F.col("n").isNotNull().alias("has_files"))


def _text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _entries(spark: SparkSession, root: str, source: str, months: Sequence[str] | None) -> list[str]:
    """Paths of the source's monthly files or folders, in name order."""
    listed = _listing(spark, root, source)
    rows = [] if listed is None else listed.select("entry", "name").distinct().orderBy("name").collect()
    return [r["entry"] for r in rows if months is None or any(m in r["name"] for m in months)]


def months_found(spark: SparkSession, root: str, source: str) -> list[str]:
    """Months in the names of the source's files or folders."""
    listed = _listing(spark, root, source)
    rows = [] if listed is None else listed.select(month_from_name("name").alias("month")).distinct().collect()
    return sorted(r["month"] for r in rows if r["month"])


def with_data_month(df: DataFrame) -> DataFrame:
    """Tag rows with the month in the name of the file or folder they come from.

    This is worked out for every row, so the name is cut out by plain text functions.
    """
    path = F.col("_metadata.file_path")
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    name = F.when(_name(path).startswith("part-"), folder).otherwise(_name(path))
    return df.select("*", month_from_name(name).alias("data_month"))


def _header(spark: SparkSession, path: str, on_error: str) -> tuple[str, ...]:
    try:
        return tuple(spark.read.option("header", True).csv(path).columns)
    except PySparkException as e:
        if on_error == "fail":
            raise
        warnings.warn(f"skipped {path}: {e.getCondition() or e}", stacklevel=2)
        return ()


def read_source(spark: SparkSession, root: str, source: str, months: Sequence[str] | None = None,
                files: Sequence[str] | None = None, on_error: str = "fail",
                ignore_corrupt: bool = False) -> DataFrame:
    """All rows of one source as text columns plus `data_month`.

    All months found are read unless `months` names some. An explicit file list replaces the listing and its month filter. Files are grouped by header,
    each group is one scan, and groups are united by name with nulls for absent columns. With
    on_error="skip" files that cannot be opened are reported and left out; with "fail" they raise.
    A file that breaks off while it is read (a cut archive, say) raises unless `ignore_corrupt`,
    which silently keeps what came before. A source without files gives no rows and the declared
    columns.
    """
    paths = list(files) if files else _entries(spark, root, source, months)
    by_header: dict[tuple[str, ...], list[str]] = {}
    # One file or folder per month: a few small reads of a first line each, side by side.
    with ThreadPoolExecutor(8) as pool:
        headers = list(pool.map(lambda p: _header(spark, p, on_error), paths))
    for path, header in zip(paths, headers):
        if header:
            by_header.setdefault(header, []).append(path)
    out = None
    for header, group in by_header.items():
        # The header of every file is checked against the group's, so part files of one folder that
        # differ raise an error instead of shifting columns.
        part = (spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
                .option("ignoreCorruptFiles", ignore_corrupt).option("ignoreMissingFiles", ignore_corrupt)
                .schema(_text_schema(header)).csv(group))
        part = with_data_month(part)
        part = part.withColumns({c: F.when(~F.col(c).isin(MISSING), F.col(c)) for c in header})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], _text_schema([*SOURCE_COLUMNS.get(source, ["isdn"]), "data_month"]))
    return out


def read_extracts(spark: SparkSession, root: str, months: Sequence[str] | None = None,
                  files: dict[str, Sequence[str]] | None = None, on_error: str = "fail") -> dict[str, DataFrame]:
    """The six extracts; a source without files is left out, so that its columns stay absent."""
    out = {}
    for source in SOURCE_COLUMNS:
        paths = (files or {}).get(source)
        found = paths or _entries(spark, root, source, months)
        if found or source == "N10":
            out[source] = read_source(spark, root, source, months, found, on_error)
    return out


def write_extract(df: DataFrame, root: str, source: str) -> None:
    """One folder of part files per month, in a single write, named so that `read_source` finds them.

    A task keeps the files of its months open side by side, so it need not sort its rows by month. Part files are packed
    with gzip, as texts are many times larger; such a file is read by one task, so it holds few rows.
    """
    folder = f"{source}_month"
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", OPEN_MONTHS):
        (df.filter(F.col("data_month").isNotNull()).withColumnRenamed("data_month", folder)
         .write.mode("overwrite").option("header", True).option("compression", "gzip")
         .option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(folder).csv(f"{root}/{source}"))
