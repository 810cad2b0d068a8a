from datetime import date

from subpanel.operators import master, monthly
from subpanel.schemas import MASTER_COLUMNS
from tests.conftest import values

N5 = "isdn string, data_month string, topup_amount string, topup_channel string"
N4 = "isdn string, data_month string, amount string, source string, advance_service_type string"
N2 = "isdn string, data_month string, package_code string, package_price string, package_cycle string, package_renewal_datetime string"
N1 = "isdn string, data_month string, arpu_call string, arpu_sms string, arpu_data string, arpu_total string"
N10 = ("isdn string, data_month string, subscriber_type string, subscriber_status string, status_detail string, "
       "activation_date string, expire_date string")


def test_topup(spark):
    df = spark.createDataFrame([
        ("a", "202508", "10", "b"), ("a", "202508", "20", "a"), ("a", "202508", "x", None),
        ("b", "202508", "5.5", None), (None, "202508", "7", "a"), ("c", None, "7", "a")], N5)
    rows = {r.isdn: r for r in monthly.agg_topup(df).collect()}
    assert set(rows) == {"a", "b"}
    a, b = rows["a"], rows["b"]
    assert (a.topup_count, a.total_topup_amount, a.avg_topup_amount, a.max_topup_amount) == (3, 30.0, 10.0, 20.0)
    assert abs(a.std_topup_amount - 10.0) < 1e-9
    assert a.most_used_topup_channel == "a"  # the smallest among ties
    assert b.most_used_topup_channel == "Unknown" and b.std_topup_amount == 0.0


def test_advance_units_and_ratio(spark):
    df = spark.createDataFrame([
        ("a", "202508", "250000", "ut", "EasyCredit"), ("a", "202508", "5000", "hu", "MBFG"),
        ("b", "202508", "250000", "ut", "MBFG"), ("c", "202508", "100", "hu", "UT_SPLUS")], N4)
    rows = {r.isdn: r for r in monthly.agg_advance(df).collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert (a.advance_count, a.total_advance_amount, a.avg_advance_amount, a.max_advance_amount) == (2, 25000.0, 12500.0, 25000.0)
    assert (a.avg_repayment_rate, a.outstanding_debt) == (0.2, 20000.0)
    assert b.total_advance_amount == 250000.0
    assert (c.advance_count, c.avg_repayment_rate, c.outstanding_debt, c.has_advance_in_month) == (1, 0.0, 0.0, True)


def test_package(spark):
    df = spark.createDataFrame([
        ("a", "202508", "P1", "100", "30", "2025-08-01"), ("a", "202508", None, "300", "x", None)], N2)
    r = monthly.agg_package(df).first()
    assert (r.num_packages, r.total_package_value, r.avg_package_price, r.max_package_price) == (1, 400.0, 200.0, 300.0)
    assert (r.avg_package_cycle, r.num_active_packages, r.num_renewed_packages) == (15.0, 2, 1)


def _sources(spark):
    n10 = spark.createDataFrame([
        ("a", "202508", "PRE", "ACTIF", "x", "01/01/2020", "01/01/2030"),
        ("a", "202508", "POS", "ACTIF", "x", "1/1/2024", "01/01/2030"),
        ("b", "202508", "PRE", "DEACT", "x", "31/02/2025", None), (None, "202508", "PRE", "ACTIF", "x", None, None)], N10)
    n1 = spark.createDataFrame([("a", "202508", "10", "0", "20", "30"), ("a", "202508", "30", "0", "20", "50")], N1)
    return n10, n1


def test_master_has_one_row_per_key(spark):
    n10, n1 = _sources(spark)
    rows = {r.isdn: r for r in master.build_master(n10, n1).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].subscriber_type == "POS" and rows["a"].activation_date == date(2024, 1, 1)
    assert (rows["a"].arpu_call, rows["a"].arpu_total) == (20.0, 40.0)
    assert rows["b"].arpu_total == 0.0 and rows["b"].activation_date is None


def test_master_keeps_repeats_on_request(spark):
    n10, n1 = _sources(spark)
    assert master.build_master(n10, n1, reduce=False).filter("isdn = 'a'").count() == 4


def test_absent_extract_leaves_columns_out(spark):
    n10, n1 = _sources(spark)
    df = master.build_master(n10, n1)
    assert "topup_count" not in df.columns and "arpu_total" in df.columns


def test_full_master(stages, sf_dir, spark):
    df = stages.master()
    assert df.columns and set(df.columns) == set(MASTER_COLUMNS)
    assert len(MASTER_COLUMNS) == 34
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert df.count() == customers * 7 == df.select("isdn", "data_month").distinct().count()


def test_dedup_months_counts_a_key_once(spark):
    df = spark.createDataFrame([("a", "202508", "PRE", True, 2, 5.0, 7.0)] * 3 + [("b", "202508", "POS", False, 0, 0.0, 0.0)],
                               "isdn string, data_month string, subscriber_type string, has_advance_in_month boolean, "
                               "topup_count long, total_advance_amount double, total_topup_amount double")
    from subpanel.plans.reports import monthly_stats, phase1_summary
    assert values(monthly_stats(df)) == [("202508", 2, 7.0, 5.0)]
    r = phase1_summary(df).first()
    assert (r.total_records, r.unique_subscribers, r.advance_users, r.topup_users, r.total_topup_amount) == (4, 2, 1, 1, 7.0)


def test_snapshot_latest(spark):
    df = spark.createDataFrame([("a", "202507"), ("a", "202508"), ("b", "202507")], "isdn string, data_month string")
    assert values(master.snapshot(df)) == [("a", "202508")]
    assert values(master.snapshot(df, "202507")) == [("a", "202507"), ("b", "202507")]
