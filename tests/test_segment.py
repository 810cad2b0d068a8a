import numpy as np
from pyspark.sql import functions as F

from subpanel.operators import kmeans, segment
from subpanel.operators.params import ClusterParams
from tests.conftest import values


def blobs(spark):
    """Three separated groups whose advance rates are 0.8, 0.5 and 0.2."""
    df = spark.range(300).withColumn("g", (F.col("id") % 3).cast("int"))
    return df.select(F.concat(F.lit("s"), "id").alias("isdn"), "g",
                     (F.col("g") * 10 + F.col("id") % 7 * 0.1).alias("x"), (F.col("g") * -5.0 + F.col("id") % 5 * 0.1).alias("y"),
                     (F.floor(F.col("id") / 3) % 10 < F.element_at(F.array(*[F.lit(v) for v in (2, 8, 5)]), F.col("g") + 1)).alias("is_advance_user"))


def test_kmeans_finds_blobs_and_ranks_them(spark):
    df = blobs(spark)
    model = segment.fit_segments(df, ["x", "y"], ClusterParams(n_init=3, max_iter=100))
    assert model.cost == min(model.costs) and len(model.costs) == 3
    found = segment.label_segments(model.assign(df))
    assert found.groupBy("g").agg(F.countDistinct("cluster").alias("n")).filter("n > 1").count() == 0
    got = {(r.g, r.is_advance_user): r.segment for r in found.select("g", "is_advance_user", "segment").distinct().collect()}
    assert got[1, False] == segment.SIMILAR and got[2, False] == segment.MEDIUM and got[0, False] == segment.UNLIKELY
    assert {v for k, v in got.items() if k[1]} == {segment.EXISTING}
    assert set(df.columns) < set(found.columns)
    assert model.centers(spark).count() == 6


def test_cost_does_not_grow_with_more_starts(spark):
    df = blobs(spark)
    few = segment.fit_segments(df, ["x", "y"], ClusterParams(n_init=1, n_clusters=5, max_iter=100))
    many = segment.fit_segments(df, ["x", "y"], ClusterParams(n_init=4, n_clusters=5, max_iter=100))
    assert many.cost <= few.cost


def test_model_round_trip(spark, tmp_path):
    df = blobs(spark)
    model = segment.fit_segments(df, ["x", "y"], ClusterParams(n_init=1, max_iter=100))
    ranks = segment.rank_clusters(model.assign(df))
    segment.save_model(model, ranks, str(tmp_path / "m"))
    again, mapping = segment.load_model(spark, str(tmp_path / "m"))
    assert values(mapping) == values(ranks) and again == model
    assert values(again.assign(df), "isdn", "cluster") == values(model.assign(df), "isdn", "cluster")


def test_starts_share_passes_and_settle(spark):
    """One aggregation an iteration for all starts; a settled start does no more iterations."""
    df = blobs(spark).select(F.array("x", "y").alias("v")).cache()
    found = kmeans.fit(df, "v", 3, 6, 100, 42)
    x = np.array([r.v for r in df.collect()])
    away = ((x[:, None] - found.centres[None]) ** 2).sum(axis=2)
    assert abs(away.min(axis=1).sum() - found.cost) < 1e-9 and found.cost == min(found.costs)
    # A centre is the mean of its rows.
    label = away.argmin(axis=1)
    assert np.allclose(found.centres, [x[label == k].mean(axis=0) for k in range(3)], atol=1e-2)
    assert len(found.iterations) == 6 and max(found.iterations) < 100
    again = kmeans.fit(df.repartition(7), "v", 3, 6, 100, 42)
    assert np.allclose(sorted(again.centres.tolist()), sorted(found.centres.tolist()), atol=1e-9)


def test_kmeans_of_few_rows(spark):
    """Fewer different rows than clusters, and none at all."""
    same = spark.createDataFrame([([1.0, 2.0],)] * 5, "v array<double>")
    found = kmeans.fit(same, "v", 3, 2, 100, 1)
    assert found.cost == 0 and found.centres.tolist() == [[1.0, 2.0]] * 3
    assert kmeans.fit(same.limit(0), "v", 3, 2, 100, 1) is None


def test_distances_agree_with_the_assignment(spark):
    df = blobs(spark)
    model = segment.fit_segments(df, ["x", "y"], ClusterParams(n_init=2, max_iter=100))
    rows = model.distances(model.assign(df)).collect()
    assert all(r.distances[r.cluster] == min(r.distances) for r in rows)
    assert abs(sum(min(r.distances) for r in rows) - model.cost) < 1e-9


def test_clean_matrix(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (2.0,)], "x double")
    assert [r.x for r in segment.clean_matrix(df, ["x"]).collect()] == [0.0, 0.0, 999.0, 999.0, 2.0]


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    assert values(segment.standardize(df, ["x", "k"])) == [(-1.0, 0.0), (1.0, 0.0)]


def test_ties_go_to_the_lower_cluster(spark):
    df = spark.createDataFrame([(0.0,), (-2.0,), (2.0,)], "x double")
    got = {r.x: r.cluster for r in segment.assign_clusters(df, [{"x": 1.0}, {"x": -1.0}]).collect()}
    assert got == {0.0: 0, -2.0: 1, 2.0: 0}


def test_two_clusters_have_no_medium(spark):
    df = spark.createDataFrame([("a", 0, True), ("b", 0, False), ("c", 1, False)], "isdn string, cluster int, is_advance_user boolean")
    assert values(segment.label_segments(df), "isdn", "segment") == [
        ("a", segment.EXISTING), ("b", segment.SIMILAR), ("c", segment.UNLIKELY)]


def test_membership_keeps_rows(spark):
    df = spark.createDataFrame([("a",), ("b",)], "isdn string")
    ids = spark.createDataFrame([("b",), ("z",)], "isdn string")
    assert values(segment.flag_membership(df, ids, "hit")) == [("a", False), ("b", True)]


def test_summary_adds_up(stages):
    r = segment.segmentation_summary(stages.segments(), advance_base=stages.advance_users()).first()
    assert r.total_subscribers == r.group_1_existing + r.group_2_total + r.group_3_unlikely
    assert segment.expansion_targets(stages.segments(), "high").count() + segment.expansion_targets(
        stages.segments(), "medium").count() == r.group_2_total
