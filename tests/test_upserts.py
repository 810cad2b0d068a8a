"""Deliveries into stored tables, numbers that do not fit, point reads and the inventory of tables."""

import contextlib
import glob
import io
import os

import pytest
from pyspark.sql import functions as F

from subpanel.functions.columns import money0
from subpanel.operators import monthly, quality, serving
from subpanel.sources import files, merge, tables, upserts
from tests.conftest import values


def contents(path: str) -> dict[str, int]:
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.fixture
def base(spark):
    return spark.range(2000).select(F.format_string("s%05d", "id").alias("isdn"), F.lit("LOW").alias("risk"),
                                    (F.col("id") * 1.5).alias("amount"), F.lit("2025-01-01").cast("timestamp").alias("updated_at"))


def folder_table(spark, tmp_path, base, keys=("isdn",), parts=16, by=None):
    table = upserts.FolderTable(spark, str(tmp_path / "table"), base.schema, tuple(keys), parts, by)
    table.create(base)
    return table


def test_upsert_leaves_untouched_folders_alone(spark, tmp_path, base):
    table = folder_table(spark, tmp_path, base)
    new = spark.createDataFrame([("s00007", "HIGH", -1.0), ("new", "HIGH", 5.0)], "isdn string, risk string, amount double")
    want = values(merge.upsert(base, new, ["isdn"], ["amount"], "2025-03-03"))
    before = contents(table.path)
    folders = table.upsert(new, ["amount"], "2025-03-03")
    after = contents(table.path)
    assert values(table.read()) == want and len(want) == 2001
    assert len(folders) <= 2
    rewritten = {os.path.dirname(f) for f in before.keys() ^ after.keys()}
    assert rewritten == {f"{table.path}/_part={n}" for n in folders}
    assert all(after[f] == t for f, t in before.items() if os.path.dirname(f) not in rewritten)


def test_delivery_given_twice_changes_nothing_more(spark, tmp_path, base):
    table = folder_table(spark, tmp_path, base)
    new = base.filter("isdn < 's00100'").withColumn("amount", F.lit(3.0))
    table.upsert(new, ["amount"], "2025-03-03")
    first = values(table.read())
    table.upsert(new, ["amount"], "2025-03-03")
    assert values(table.read()) == first


def test_empty_delivery(spark, tmp_path, base):
    table = folder_table(spark, tmp_path, base)
    before = contents(table.path)
    assert table.upsert(base.limit(0), ["amount"]) == [] and table.insert(base.limit(0)) == [] and contents(table.path) == before


def test_insert_by_month_adds_files_only(spark, tmp_path):
    rows = [(f"s{i}", m, float(i)) for i in range(50) for m in ("202507", "202508")]
    kind = "isdn string, data_month string, x double"
    base = spark.createDataFrame(rows, kind)
    table = folder_table(spark, tmp_path, base, ["isdn", "data_month"], 2, "data_month")
    new = spark.createDataFrame([("s1", "202508", -1.0), ("t1", "202508", 7.0), ("t1", "202509", 8.0)], kind)
    want, before = values(merge.insert_new(base, new, ["isdn", "data_month"])), contents(table.path)
    assert sorted(table.insert(new)) == ["202508", "202509"]
    assert values(table.read()) == want and len(want) == 102
    assert before.items() <= contents(table.path).items()
    table.insert(new)
    assert values(table.read()) == want


def test_wide_amounts_and_further_decimals_survive(spark):
    df = spark.createDataFrame([("1e14",), ("100000000000000",), ("0.00001",), ("x",), (None,), ("nan",)], "v string")
    assert [float(r[0]) for r in df.select(money0("v")).collect()] == [1e14, 1e14, 0.00001, 0.0, 0.0, 0.0]
    topups = spark.createDataFrame([("a", "202508", v, "c") for v in ("1e14", "3e14", "0.00001")],
                                   "isdn string, data_month string, topup_amount string, topup_channel string")
    row = monthly.agg_topup(topups).first()
    assert row.total_topup_amount == pytest.approx(4e14) and row.max_topup_amount == 3e14 and row.std_topup_amount > 1e14


def test_numbers_that_do_not_fit_are_counted(spark):
    raw = spark.createDataFrame([("1",), ("x",), ("1e30",), (None,), ("",), ("NaN",)], "amount string")
    assert values(quality.lost_numbers(raw, "N4", ["amount"])) == [("N4", "amount", 5, 2)]
    rows = spark.createDataFrame([(1e25, 3), (2.0, 4), (None, None), (float("nan"), 5)], "arpu_total double, arpu_call int")
    assert values(serving.rejects(rows, serving.SERVING_MONTHLY, "t")) == [("t", "arpu_call", 3, 0), ("t", "arpu_total", 2, 1)]
    assert values(serving.rejects(rows.limit(0), serving.SERVING_MONTHLY, "t")) == [("t", "arpu_call", 0, 0), ("t", "arpu_total", 0, 0)]


def test_point_read_opens_one_bucket(spark, tmp_path, base):
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        stored = tables.write_bucketed(base, str(tmp_path / "t"), "point_reads_test", "isdn", 8, spread=True, point_reads=True)
        one = stored.filter(F.col("isdn") == "s00042")
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            one.explain("formatted")
        assert "SelectedBucketsCount: 1 out of 8" in text.getvalue()
        assert one.count() == 1
    finally:
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
        spark.sql("DROP TABLE IF EXISTS point_reads_test")


def test_documents_by_a_table_of_keys(stages):
    docs = serving.rec_documents(stages.store().recommendations, "2025-08-31 00:00:00")
    keys = docs.select("key").orderBy("key").limit(3)
    got = serving.read_document(docs, keys, ["bad_debt_risk"])
    assert sorted(r.key for r in got.collect()) == [r.key for r in keys.collect()]
    assert {k for r in got.collect() for k in r.fields} == {"bad_debt_risk"}
    assert values(got.select("key")) == values(serving.read_document(docs, [r.key for r in keys.collect()]).select("key"))


def test_table_inventory(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "b.parquet"))
    rows = files.table_inventory(spark, str(tmp_path), ["a", "b"]).collect()
    assert [(r.table_name, r.file_count, r.row_count) for r in rows] == [("a", 3, 10)]
    assert rows[0].modified is not None and rows[0].size_mb >= 0
