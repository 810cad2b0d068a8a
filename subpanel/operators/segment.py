"""Clustering of the latest snapshot and business segments by past advance rate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subpanel.functions.columns import case_when, exact_avg, half_even, is_true, pct
from subpanel.operators import kmeans
from subpanel.operators.features import TOPUP_FEATURES
from subpanel.operators.params import ClusterParams

# Default clustering columns: top-up behaviour, financial state, activity and packages. Advance
# history is left out because the segments are ranked by it afterwards.
CLUSTER_FEATURES = TOPUP_FEATURES + [
    "estimated_balance", "balance_is_negative", "balance_is_low", "burn_rate_capped", "burn_rate_high",
    "burn_rate_very_high", "financial_stress_score", "is_active_user", "usage_intensity",
    "has_multiple_packages", "has_high_value_package", "package_per_topup_ratio",
    "num_renewed_packages", "avg_package_cycle"]

# Segment labels.
EXISTING, SIMILAR, MEDIUM, UNLIKELY = "GROUP_1_EXISTING", "GROUP_2_SIMILAR", "GROUP_2_MEDIUM", "GROUP_3_UNLIKELY"


def advance_users(features: DataFrame) -> DataFrame:
    """Subscribers with an advance record in any month."""
    return features.filter(is_true(F.col("has_advance_in_month"))).select("isdn").distinct()


def flag_membership(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Keep all rows and tell whether the id is in the list. `ids` holds each id once."""
    return (df.join(ids.select("isdn", F.lit(True).alias(name)), "isdn", "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(False))))


def never_advanced(df: DataFrame, features: DataFrame) -> DataFrame:
    return df.join(advance_users(features), "isdn", "left_anti")


def clean_matrix(df: DataFrame, columns: Sequence[str], infinite: float = 999.0, prefix: str = "") -> DataFrame:
    """Missing values become 0, infinite ones a large constant. A prefix keeps the original columns."""
    def clean(name: str) -> Column:
        x = F.col(name).cast("double")
        x = F.when(F.isnan(x), None).otherwise(x)
        return F.when(F.abs(x) == float("inf"), F.lit(infinite)).otherwise(F.coalesce(x, F.lit(0.0)))
    return df.withColumns({f"{prefix}{n}": clean(n) for n in columns})


def cluster_matrix(df: DataFrame, columns: Sequence[str] = tuple(CLUSTER_FEATURES)) -> DataFrame:
    return clean_matrix(df, columns).select("isdn", *columns)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0.

    The moments are one row, read as a scalar subquery.
    """
    moments = df.agg(F.struct(*[x for n in columns for x in (
        F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"))]).alias("m")).scalar()
    scaled = {n: F.coalesce(F.try_divide(F.col(n) - moments[f"{n}_mean"], F.nullif(moments[f"{n}_std"], F.lit(0.0))),
                            F.lit(0.0)) for n in columns}
    return df.withColumns(scaled)


def assign_clusters(df: DataFrame, centroids: Sequence[Mapping[str, float]]) -> DataFrame:
    """Nearest centroid by squared distance, the lower number on ties, as one projection."""
    def distance(centre: Mapping[str, float]) -> Column:
        total = F.lit(0.0)
        for name, value in centre.items():
            total = total + (F.col(name) - F.lit(float(value))) * (F.col(name) - F.lit(float(value)))
        return total
    options = F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)])
    return df.withColumn("cluster", F.array_min(options)["cluster"])


# Prefix of the cleaned and scaled copies a model reads.
_SCALED = "_z_"


@dataclass
class SegmentModel:
    """Scaling, centres on the scaled columns, and the costs of all starts."""

    columns: list[str]
    means: list[float]
    deviations: list[float]
    centres: list[list[float]]
    cost: float
    costs: list[float]

    def scaled(self, df: DataFrame) -> DataFrame:
        """The rows with a scaled copy of each column; a constant column becomes 0."""
        out = clean_matrix(df, self.columns, prefix=_SCALED)
        return out.withColumns({f"{_SCALED}{c}": (F.col(f"{_SCALED}{c}") - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
                                for c, m, s in zip(self.columns, self.means, self.deviations)})

    def assign(self, df: DataFrame) -> DataFrame:
        """All columns of the rows and their cluster number."""
        centroids = [dict(zip((_SCALED + c for c in self.columns), centre)) for centre in self.centres]
        return assign_clusters(self.scaled(df), centroids).drop(*[_SCALED + c for c in self.columns])

    def distances(self, df: DataFrame) -> DataFrame:
        """The rows of an assignment with the squared distances from all centres, in order, as `distances`."""
        def distance(centre: Sequence[float]) -> Column:
            total = F.lit(0.0)
            for c, v in zip(self.columns, centre):
                total = total + (F.col(_SCALED + c) - F.lit(v)) * (F.col(_SCALED + c) - F.lit(v))
            return total
        return (self.scaled(df).withColumn("distances", F.array(*[distance(c) for c in self.centres]))
                .drop(*[_SCALED + c for c in self.columns]))

    def centers(self, spark: SparkSession) -> DataFrame:
        """Centres on the standardised scale, one row per cluster and feature."""
        rows = [(i, name, float(v)) for i, centre in enumerate(self.centres) for name, v in zip(self.columns, centre)]
        return spark.createDataFrame(rows, "cluster int, feature string, center double")


def fit_segments(df: DataFrame, columns: Sequence[str] = tuple(CLUSTER_FEATURES),
                 params: ClusterParams = ClusterParams()) -> SegmentModel:
    """K-Means with several starts, the cheapest kept. All starts share each pass over the scaled vectors."""
    params.validate()
    columns = list(columns)
    matrix = clean_matrix(df.select(*columns), columns)
    moments = matrix.agg(*[f(c).alias(f"{tag}:{c}") for c in columns for tag, f in (("m", exact_avg), ("s", F.stddev_pop))]).first()
    model = SegmentModel(columns, [moments[f"m:{c}"] or 0.0 for c in columns], [moments[f"s:{c}"] or 0.0 for c in columns], [], 0.0, [])
    vectors = (model.scaled(df.select(*columns)).select(F.array(*[_SCALED + c for c in columns]).alias("x"))
               .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        found = kmeans.fit(vectors, "x", params.n_clusters, params.n_init, params.max_iter, params.random_state)
    finally:
        vectors.unpersist()
    if found is None:
        raise ValueError("no rows to cluster")
    model.centres, model.cost, model.costs = found.centres.tolist(), found.cost, found.costs
    return model


def save_model(model: SegmentModel, mapping: DataFrame, path: str) -> None:
    """Scaling, centres, costs and the segment of each cluster, as Parquet tables below the path."""
    spark = mapping.sparkSession
    scaling = spark.createDataFrame([(i, c, float(m), float(s)) for i, (c, m, s) in enumerate(zip(model.columns, model.means, model.deviations))],
                                    "position int, feature string, mean double, deviation double")
    costs = spark.createDataFrame([(i, float(c), i == model.costs.index(model.cost)) for i, c in enumerate(model.costs)],
                                  "start int, cost double, kept boolean")
    for name, table in (("scaling", scaling), ("centers", model.centers(spark)), ("costs", costs), ("cluster_mapping", mapping)):
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[SegmentModel, DataFrame]:
    """A stored model and the segment of each cluster; its tables have a row per feature, cluster or start."""
    scaling = spark.read.parquet(f"{path}/scaling").orderBy("position").collect()
    centre = {(r["cluster"], r["feature"]): r["center"] for r in spark.read.parquet(f"{path}/centers").collect()}
    costs = spark.read.parquet(f"{path}/costs").orderBy("start").collect()
    columns = [r["feature"] for r in scaling]
    centres = [[centre[k, c] for c in columns] for k in range(1 + max(k for k, _ in centre))]
    model = SegmentModel(columns, [r["mean"] for r in scaling], [r["deviation"] for r in scaling], centres,
                         next(r["cost"] for r in costs if r["kept"]), [r["cost"] for r in costs])
    return model, spark.read.parquet(f"{path}/cluster_mapping")


def _group_stats(df: DataFrame, key: str) -> DataFrame:
    grouped = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("is_advance_user").cast("long")).alias("advance_users"))
    return grouped.withColumns({
        "advance_rate": half_even(pct("advance_users", "total"), 2),
        "share_pct": pct("total", F.sum("total").over(Window.partitionBy()))})


def cluster_stats(df: DataFrame) -> DataFrame:
    """Size, advance users, advance rate and share of each cluster."""
    return _group_stats(df, "cluster")


def segment_stats(df: DataFrame) -> DataFrame:
    return _group_stats(df, "segment")


def rank_clusters(df: DataFrame) -> DataFrame:
    """Clusters ranked from 0 by advance rate, highest first, with the segment of their newcomers.

    The first rank is similar to advance users, the last unlikely, all between are medium.
    The window runs over one row per cluster.
    """
    rates = df.groupBy("cluster").agg(F.avg(F.col("is_advance_user").cast("double")).alias("rate"))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("rate"), "cluster")) - 1
    ranked = rates.withColumns({"rank": rank, "_k": F.count(F.lit(1)).over(Window.partitionBy())})
    return ranked.select("cluster", "rank", case_when(
        [(F.col("rank") == 0, SIMILAR), (F.col("rank") == F.col("_k") - 1, UNLIKELY)], MEDIUM).alias("newcomer_segment"))


def label_segments(df: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Segment of each subscriber: existing advance users first, the rest by their cluster's rank.

    The mapping has one row per cluster (k is at most 10), so it is broadcast.
    """
    ranks = rank_clusters(df) if ranks is None else ranks
    return (df.join(F.broadcast(ranks.select("cluster", "newcomer_segment")), "cluster", "left")
            .withColumn("segment", F.when(F.col("is_advance_user"), EXISTING)
                        .otherwise(F.coalesce(F.col("newcomer_segment"), F.lit("Unknown"))))
            .drop("newcomer_segment"))


def segmentation_summary(df: DataFrame, inertia: float | None = None, advance_base: DataFrame | None = None) -> DataFrame:
    """One row of totals. The expansion ratio divides by all subscribers who ever advanced, also
    those without a row in the snapshot, when their list is given."""
    count = lambda s: F.count_if(F.col("segment") == s)
    base = F.count_if("is_advance_user") if advance_base is None else advance_base.agg(F.count(F.lit(1))).scalar()
    out = (df.agg(F.count(F.lit(1)).alias("total_subscribers"),
                  count(EXISTING).alias("group_1_existing"), count(SIMILAR).alias("group_2_similar"),
                  count(MEDIUM).alias("group_2_medium"), count(UNLIKELY).alias("group_3_unlikely"),
                  F.count_if("is_advance_user").alias("_advanced"))
           .withColumn("group_2_total", F.col("group_2_similar") + F.col("group_2_medium")))
    base = F.col("_advanced") if advance_base is None else base
    out = out.withColumn("expansion_ratio", F.try_divide(F.col("group_2_total"), base)).drop("_advanced")
    return out if inertia is None else out.withColumn("kmeans_inertia", F.lit(float(inertia)))


def expansion_targets(df: DataFrame, level: str = "all") -> DataFrame:
    """Group-2 list: "high" (similar), "medium" or "all"."""
    wanted = {"high": [SIMILAR], "medium": [MEDIUM], "all": [SIMILAR, MEDIUM]}[level]
    return df.filter(F.col("segment").isin(wanted)).select("isdn", "cluster", "segment")


def cluster_profiles(df: DataFrame, columns: Sequence[str] = tuple(CLUSTER_FEATURES), top: int = 5) -> DataFrame:
    """The features with the largest centres of each cluster, in original units, with overall means.

    A K-Means centre in original units is the mean of its members. The ranked table has
    clusters x features rows.
    """
    df = clean_matrix(df, columns)
    pairs = lambda t: F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in columns])).alias(t)
    centres = df.groupBy("cluster").agg(*[exact_avg(n).alias(n) for n in columns]).select("cluster", pairs("p"))
    means = df.agg(*[exact_avg(n).alias(n) for n in columns]).select(pairs("p"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("center"), "feature"))
    return (centres.select("cluster", F.col("p.feature").alias("feature"), F.col("p.v").alias("center"))
            .join(F.broadcast(means.select(F.col("p.feature").alias("feature"), F.col("p.v").alias("overall_mean"))),
                  "feature", "left")
            .withColumn("rank", rank).filter(F.col("rank") <= top)
            .select("cluster", "rank", "feature", "center", "overall_mean"))


