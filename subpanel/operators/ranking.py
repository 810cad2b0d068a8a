"""Ranks inside groups that may be as large as the table.

There are three services, so a plain window over the service would sort a third of all rows in one
task. Here the rows are range-partitioned by group, score and id and sorted within each partition, so
that partitions follow one another in rank order. The place of a row in its partition plus the sizes
of the partitions before it is its rank: a prefix sum over a few numbers a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subpanel.sources import tables

_PLACE_BITS = 33  # of monotonically_increasing_id that count the rows of a partition


def in_rank_order(df: DataFrame, group: str, score: str, id_column: str, parts: int) -> DataFrame:
    """The rows with `_part` and `_place`: by group, then score and id descending, over `parts` sorted partitions.

    The cut points come from a sample, so the result must be stored before it is read twice.
    """
    order = [F.asc(group), F.desc(score), F.desc(id_column)]
    at = F.monotonically_increasing_id()
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({
        "_part": F.shiftright(at, _PLACE_BITS).cast("int"), "_place": at.bitwiseAND((1 << _PLACE_BITS) - 1)})


def rank_descending(df: DataFrame, group: str, score: str, id_column: str, parts: int | None = None) -> DataFrame:
    """0-based rank inside the group by score, then id, both descending; exact at any group size.

    More partitions (by default those of a shuffle) make smaller tasks. Rows of equal score and id lie in one
    partition. The score must not be null.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tables.kept(in_rank_order(df, group, score, id_column, parts), "ranks")
    # A group is contiguous, so there are fewer than `parts` + groups of these.
    sizes = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    return (rows.join(offsets, [group, "_part"]).withColumn("rank", F.col("_offset") + F.col("_place"))
            .drop("_part", "_place", "_offset"))
