"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subpanel.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs → (node, root): every node that has an edge and the smallest node it reaches.

    Large-star and small-star rounds until the edges form stars (Kiveris et al., 2014). Each round is a
    grouped minimum (partial aggregation tames nodes with many edges) and a join; its edges are stored.
    An empty table and self-loops give no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(down, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            down.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = written(small, "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    star = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
