"""Rows of a task stay the same when the tables grow, and settings of the session come back."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from subpanel.operators import monthly
from subpanel.session import parts_for, setting, shuffling_into
from subpanel.sources import files, panel, star

SHUFFLE = "spark.sql.shuffle.partitions"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_rows(spark):
    own = int(spark.conf.get(SHUFFLE))
    assert parts_for(spark, 10) == own
    assert parts_for(spark, 36_000_000) == max(own, 120) and parts_for(spark, 216_000_000) == 720


def test_settings_come_back(spark):
    before = spark.conf.get(SHUFFLE)
    with shuffling_into(spark, 500):
        assert spark.conf.get(SHUFFLE) == "500"
        with shuffling_into(spark, 3):
            assert spark.conf.get(SHUFFLE) == "500"
    with pytest.raises(ValueError), setting(spark, SHUFFLE, 501):
        raise ValueError
    assert spark.conf.get(SHUFFLE) == before


def _tables(spark, tmp_path, n=60):
    """A small star: an order a customer, three lines an order, one line of no part and one of no order."""
    d = str(tmp_path)
    day = F.lit("1996-05-07").cast("timestamp")
    spark.range(n).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name"), F.lit(1).alias("c_nationkey"),
                          F.lit("MACHINERY").alias("c_mktsegment")).coalesce(1).write.parquet(f"{d}/customer.parquet")
    spark.range(n).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit(5.0).alias("o_totalprice"), day.alias("o_orderdate"),
                          F.lit("HIGH").alias("o_orderpriority")).write.parquet(f"{d}/orders.parquet")
    spark.range(3 * n + 1).select(F.floor(F.col("id") / 3).alias("l_orderkey"), F.nullif(F.col("id") % 5, F.lit(4)).alias("l_partkey"),
                                  (F.col("id") % 7).alias("l_suppkey"), F.lit(2.0).alias("l_quantity"), F.lit(9.0).alias("l_extendedprice"),
                                  F.lit(0.05).alias("l_discount"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
                                  day.alias("l_shipdate")).write.parquet(f"{d}/lineitem.parquet")
    spark.range(4).select(F.col("id").alias("p_partkey"), F.lit("B").alias("p_brand"), F.lit(1.0).alias("p_retailprice"),
                          F.lit(3).alias("p_size")).write.parquet(f"{d}/part.parquet")
    spark.range(n).select(F.col("id").alias("event_id"), day.alias("ts"), F.col("id").alias("user_id")).write.parquet(f"{d}/events.parquet")
    return d


def test_subscriber_months_of_one_file_are_dealt_out(spark, tmp_path, monkeypatch):
    """One file of customers gave one task that sorted all rows of all months."""
    monkeypatch.setattr(panel, "MONTHS_PER_PART", 20)
    d = _tables(spark, tmp_path)
    df = monthly.subscriber_months(panel.n10(spark, d))
    assert df.count() == 60 * len(panel.PANEL_MONTHS) and df.select("isdn").distinct().count() == 60
    text = plan(df)
    assert text.index("REPARTITION_BY_NUM") > text.index("Generate explode") and text.count("Exchange hashpartitioning") == 1
    assert panel.n10(spark, d).rdd.getNumPartitions() >= 60 * len(panel.PANEL_MONTHS) // 20


def test_star_is_cut_by_its_rows(spark, tmp_path, monkeypatch):
    """Stored tables lie in as many files as their rows need, and shuffle into as many, whatever the session's setting."""
    d = _tables(spark, tmp_path)
    monkeypatch.setattr(panel, "fact_parts", lambda spark, sf_dir: parts_for(spark, 181, 10))
    before, written = spark.conf.get(SHUFFLE), []
    write = star.tables.write_bucketed

    def spy(df, *args, **kwargs):
        written.append(spark.conf.get(SHUFFLE))
        return write(df, *args, **kwargs)

    monkeypatch.setattr(star, "tables", SimpleNamespace(write_bucketed=spy))
    n2, n1, n4 = panel.n2(spark, d), panel.n1(spark, d), panel.n4(spark, d)
    assert set(written) == {"19"} and spark.conf.get(SHUFFLE) == before
    assert n4.count() == 180 and n2.count() == 180 - 36
    assert n1.count() == 60 and n1.agg(F.sum("arpu_total")).first()[0] == 180 * 100 + 9 * 3 * 1100
    assert {r[0] for r in n4.select("advance_service_type").distinct().collect()} == {"EasyCredit", "ungdata247", "MBFG", "UT_SPLUS"}


def test_months_are_written_without_a_sort(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("string").alias("isdn"), F.concat(F.lit("2025"), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0")).alias("data_month"))
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    files.write_extract(df, str(tmp_path), "N5")
    assert spark.conf.get(name) == before
    back = files.read_source(spark, str(tmp_path), "N5")
    assert back.count() == 1000 and back.select("data_month").distinct().count() == 12


def test_star_is_stored_where_its_joins_leave_the_rows(spark, tmp_path, monkeypatch):
    """Orders and events were shuffled once more by the customer's id, lines moved with the columns of their parts."""
    d = _tables(spark, tmp_path)
    monkeypatch.setattr(panel, "fact_parts", lambda spark, sf_dir: parts_for(spark, 181, 10))
    found, write = {}, star.tables.write_bucketed

    def spy(df, path, table, key, buckets, *args, **kwargs):
        found[path.split("/")[-1]] = df.columns, plan(df.repartition(buckets, *key))
        return write(df, path, table, key, buckets, *args, **kwargs)

    monkeypatch.setattr(star, "tables", SimpleNamespace(write_bucketed=spy))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        assert panel.n4(spark, d).count() == 180 and panel.n3(spark, d).count() == 60
    assert set(found) == {"booked_orders", "booked_lines", "booked_usage"}
    assert not any("REPARTITION_BY_NUM" in text for _, text in found.values())
    assert not {"p_brand", "p_retailprice", "p_size"} & set(found["booked_lines"][0])


def test_a_line_counts_once_per_row_of_its_part(spark, tmp_path):
    d = _tables(spark, tmp_path)
    part = spark.read.parquet(f"{d}/part.parquet")
    part.unionByName(part.where("p_partkey = 1")).write.parquet(f"{d}/twice.parquet")
    twice = SimpleNamespace(orders="orders", lineitem="lineitem", customer="customer", part="twice", events="events")
    table = panel._table
    try:
        panel._table = lambda spark, sf_dir, name: spark.read.parquet(f"{d}/{getattr(twice, name)}.parquet")
        n1, n2, n4 = panel.n1(spark, d), panel.n2(spark, d), panel.n4(spark, d)
        assert n4.count() == 180 + 36 and n2.count() == 180 - 36 + 36 and n1.count() == 60
    finally:
        panel._table = table


def test_files_of_small_packed_rows_hold_few_of_them(spark, tmp_path, monkeypatch):
    """A packed CSV file is read by one task, so its rows are bounded; other packed files are no extracts."""
    monkeypatch.setattr(files, "ROWS_PER_FILE", 100)
    df = spark.range(0, 1000, 1, 1).select(F.col("id").cast("string").alias("isdn"), F.lit("202503").alias("data_month"))
    files.write_extract(df, str(tmp_path), "N5")
    parts = sorted((tmp_path / "N5").rglob("*.csv*"))
    packed = [p for p in parts if not p.name.startswith(".")]
    assert len(packed) == 10 and all(p.name.endswith(".csv.gz") for p in packed)
    (tmp_path / "N5" / "N5_202504.csv.gz").write_bytes(packed[0].read_bytes())
    back = files.read_source(spark, str(tmp_path), "N5")
    assert back.count() == 1000 and [r[0] for r in back.select("data_month").distinct().collect()] == ["202503"]
    assert files.list_source_files(spark, str(tmp_path), ["N5"]).select("name").distinct().count() == 1
