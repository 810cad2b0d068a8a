"""The command over CSV files, and results under skew."""

import json

import pandas as pd
from pyspark.sql import functions as F

from subpanel.__main__ import main, parse
from subpanel.operators import master, monthly
from subpanel.operators import segment
from subpanel.sources import files, panel
from tests.conftest import values


def test_command(spark, sf_dir, tmp_path):
    for source, df in panel.extracts(spark, sf_dir).items():
        files.write_extract(df, str(tmp_path / "data"), source)
    params = tmp_path / "params.json"
    params.write_text(json.dumps({"clusters": {"n_init": 1, "max_iter": 100}, "offers": {"mbfg_min_amount": 12000}}))
    out = tmp_path / "out"
    main(["--data", str(tmp_path / "data"), "--out", str(out), "--params", str(params), "--day", "2025-08-31"])
    read = lambda name: spark.read.option("header", True).csv(str(out / "export" / name))
    final = read("recommendations_final_filtered")
    assert final.count() == spark.read.parquet(str(out / "serving/rec_documents")).count() > 0
    assert read("final_by_service").count() == final.count()
    summary = read("clustering_summary").first()
    assert int(summary.group_2_total) == read("expansion_group2_all_targets").count() and float(summary.kmeans_inertia) > 0
    assert read("feature_list").count() == 69
    model, mapping = segment.load_model(spark, str(out / "export/model"))
    # The stored bundle gives the clusters and segments of the run, also on rows of another month.
    segments = spark.read.parquet(str(out / "stages/segments"))
    again = segment.label_segments(model.assign(segments.drop("cluster", "segment")), mapping)
    assert values(again, "isdn", "cluster", "segment") == values(segments, "isdn", "cluster", "segment")
    earlier = spark.read.parquet(str(out / "stages/features")).filter("data_month = '202507'")
    assert model.assign(earlier).filter("cluster IS NOT NULL").count() == earlier.count() > 0
    for phase in ("1", "2", "3a", "3b", "4"):
        assert spark.read.json(str(out / f"export/phase{phase}_summary")).count() == 1
    assert spark.read.parquet(str(out / "serving/service_index")).count() == final.count()


def test_explicit_files_argument():
    args = parse(["--data", "d", "--out", "o", "--N5", "a.csv", "b.csv"])
    assert args.N5 == ["a.csv", "b.csv"] and args.N4 is None


def test_one_subscriber_owning_a_third_of_all_rows(spark):
    n = 6000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("isdn"),
        F.lit("202508").alias("data_month"), (F.col("id") % 97 * 10).cast("string").alias("topup_amount"),
        F.concat(F.lit("c"), F.col("id") % 4).alias("topup_channel")).repartition(8)
    want = pd.DataFrame({"id": range(n)})
    want["isdn"] = ["hot" if i % 3 == 0 else f"s{i % 50}" for i in want.id]
    want["x"], want["c"] = want.id % 97 * 10.0, [f"c{i % 4}" for i in want.id]
    grouped = want.groupby("isdn").agg(n=("x", "count"), total=("x", "sum"), std=("x", "std"), top=("c", lambda c: c.mode()[0]))
    got = monthly.agg_topup(df).toPandas().set_index("isdn")
    assert set(got.index) == set(grouped.index)
    for isdn, r in grouped.iterrows():
        g = got.loc[isdn]
        assert (g.topup_count, g.total_topup_amount, g.most_used_topup_channel) == (r.n, r.total, r.top)
        assert abs(g.std_topup_amount - r["std"]) < 1e-6


def test_hot_key_reaches_the_shuffle_aggregated(spark):
    df = spark.createDataFrame([("a", "1", "1", "c")], "isdn string, data_month string, topup_amount string, topup_channel string")
    text = monthly.agg_topup(df)._jdf.queryExecution().executedPlan().toString()
    # Rows are counted by key and code before they are shuffled; the string reads from the last step to the first.
    assert "ObjectHashAggregate" not in text
    before, after = text.rindex("partial_count"), text.rindex("Exchange hashpartitioning")
    assert after < before  # the plan prints the root first


def test_one_key_owning_a_third_of_every_extract(spark):
    """The master of hot raw rows equals the one worked out by hand."""
    n, third = 3000, 1000
    ids = spark.range(n).select("id", F.when(F.col("id") < third, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("isdn"),
                                F.lit("202508").alias("data_month")).repartition(8)
    n10 = ids.select("isdn", "data_month", F.when(F.col("id") == 7, "POS").otherwise("PRE").alias("subscriber_type"),
                     F.lit("ACTIF").alias("subscriber_status"), F.lit("d").alias("status_detail"),
                     F.when(F.col("id") == 7, "01/02/2024").otherwise("01/01/2024").alias("activation_date"),
                     F.lit("01/01/2034").alias("expire_date"))
    n1 = ids.select("isdn", "data_month", *[(F.col("id") % 10).alias(c) for c in ("arpu_call", "arpu_sms", "arpu_data", "arpu_total")])
    n4 = ids.select("isdn", "data_month", F.lit("100").alias("amount"), F.when(F.col("id") % 2 == 0, "ut").otherwise("hu").alias("source"),
                    F.lit("EasyCredit").alias("advance_service_type"))
    n2 = ids.select("isdn", "data_month", F.lit("P").alias("package_code"), F.lit("3").alias("package_price"),
                    F.lit("30").alias("package_cycle"), F.lit(None).cast("string").alias("package_renewal_datetime"))
    got = {r.isdn: r for r in master.build_master(n10, n1, n4, None, n2, ids).collect()}
    hot = got["hot"]
    assert len(got) == 21
    assert (hot.subscriber_type, hot.arpu_total, hot.advance_count, hot.total_advance_amount) == ("POS", 4.5, third, third / 2 * 10.0)
    assert (hot.avg_repayment_rate, hot.num_packages, hot.total_package_value, hot.n3_record_count) == (1.0, third, 3.0 * third, third)
    assert sum(r.n3_record_count for r in got.values()) == n
