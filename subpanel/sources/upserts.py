"""Stored tables that take deliveries by rewriting only what a delivery touches.

A table lies in folders, by a column of its own such as the month, or by a hash of its keys. A delivery names
the folders it touches; only these are read, merged and replaced, and the files of all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subpanel.session import shuffling_into
from subpanel.sources import merge

_PART = "_part"


@dataclass(frozen=True)
class FolderTable:
    """keys: the unique key. parts: folders by key hash, or files by key hash in each folder of column `by`.

    Give as many parts as make a folder (or file) of some 200 MB; the number must not change afterwards.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    parts: int
    by: str | None = None

    @property
    def folder(self) -> str:
        return self.by or _PART

    def _slot(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.parts))

    def _placed(self, df: DataFrame) -> DataFrame:
        return df if self.by else df.withColumn(_PART, self._slot())

    def _stored(self) -> DataFrame:
        schema = self.schema if self.by else T.StructType([*self.schema.fields, T.StructField(_PART, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def _write(self, df: DataFrame, mode: str) -> None:
        with shuffling_into(self.spark, self.parts):
            (df.repartition(F.col(self.folder), self._slot()).write.mode(mode).option("compression", "snappy")
             .option("partitionOverwriteMode", "dynamic").partitionBy(self.folder).parquet(self.path))
        self.spark.catalog.refreshByPath(self.path)

    def create(self, df: DataFrame) -> None:
        """Write the whole table to a new path."""
        self._write(self._placed(df.select(*self.schema.names)), "errorifexists")

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def touched(self, new: DataFrame) -> list:
        """Folders that hold or will hold keys of the delivery: at most `parts`, or the months delivered."""
        return [r[0] for r in self._placed(new).select(self.folder).distinct().collect()]

    def upsert(self, new: DataFrame, update_columns: Sequence[str], now: datetime | str | None = None) -> list:
        """`merge.upsert` over the touched folders, which are replaced when all tasks are done; returns them.

        Keys must be unique in `new`. The folders' old files are read until the commit, so a lost executor costs
        a recomputation only, and a delivery that was broken off can be given again.
        """
        folders = self.touched(new)
        if folders:
            base = self._stored().filter(F.col(self.folder).isin(folders)).select(*self.schema.names)
            merged = merge.upsert(base, new, list(self.keys), list(update_columns), now)
            self._write(self._placed(merged), "overwrite")
        return folders

    def insert(self, new: DataFrame) -> list:
        """Add rows with absent keys as further files; no stored file is rewritten. Returns the touched folders."""
        folders = self.touched(new)
        if folders:
            known = self._stored().filter(F.col(self.folder).isin(folders)).select(*self.keys)
            fresh = new.join(known, list(self.keys), "left_anti").select(*self.schema.names)
            self._write(self._placed(fresh), "append")
        return folders
