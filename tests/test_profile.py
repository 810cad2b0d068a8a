import pytest

from subpanel.operators import profile
from subpanel.schemas import PROFILE_COLUMNS, PROFILE_EXTRA_COLUMNS
from tests.conftest import values

MONTHLY = "isdn string, data_month string, arpu_call double, arpu_sms double, arpu_data double, arpu_total double"


@pytest.mark.parametrize("first, last, want", [
    (100.0, 110.0, profile.FLAT), (100.0, 110.1, profile.UP), (100.0, 90.0, profile.FLAT), (100.0, 89.9, profile.DOWN),
    (0.0, 50.0, profile.FLAT)])
def test_trend(spark, first, last, want):
    df = spark.createDataFrame([("a", "202504", 0.0, 0.0, 0.0, last), ("a", "202503", 0.0, 0.0, 0.0, first)], MONTHLY)
    r = profile.arpu_stats(df).first()
    assert (r.arpu_first, r.arpu_last, r.arpu_trend, r.months_count) == (first, last, want, 2)


def test_first_and_last_skip_missing_months(spark):
    df = spark.createDataFrame([("a", f"20250{m}", None, None, None, x) for m, x in ((3, None), (4, 4.0), (5, 6.0), (6, None))], MONTHLY)
    r = profile.arpu_stats(df).first()
    assert (r.arpu_first, r.arpu_last, r.arpu_avg_6m, r.months_count) == (4.0, 6.0, 5.0, 4)


def test_single_month_has_no_deviation(spark):
    df = spark.createDataFrame([("a", "202503", 1.0, 1.0, 1.0, 3.0)], MONTHLY)
    assert profile.arpu_stats(df).first().arpu_std_6m is None


REC = ("isdn string, subscriber_type string, service_type string, advance_amount double, usage_time_hours int, revenue_per_advance double, "
       "arpu double, arpu_call double, arpu_sms double, arpu_data double, voice_sms_pct double, topup_count_last_1m long, "
       "topup_amount_last_1m double, avg_topup_amount double, classification_reason string, topup_advance_ratio double, "
       "risk_score int, bad_debt_risk string")


def build(spark, monthly=(), arpu=1000.0, data=0.0, n=0, ratio=0.0, level="LOW"):
    rec = spark.createDataFrame([("a", "PRE", "MBFG", 10000.0, 24, 3000.0, arpu, 0.0, 0.0, data, 0.0, n, 0.0, 5.0, "r", ratio, 10, level)], REC)
    return profile.build_profile(rec, spark.createDataFrame(list(monthly), MONTHLY)).first()


@pytest.mark.parametrize("data, arpu, want", [
    (80.0, 100.0, profile.BALANCED), (80.1, 100.0, profile.HEAVY_DATA), (20.0, 100.0, profile.BALANCED),
    (19.9, 100.0, profile.VOICE_SMS), (50.0, 0.0, profile.VOICE_SMS)])
def test_user_type(spark, data, arpu, want):
    assert build(spark, arpu=arpu, data=data).user_type == want


@pytest.mark.parametrize("n, want", [(4, profile.OFTEN), (3, profile.MIDDLE), (2, profile.MIDDLE), (1, profile.RARE), (0, profile.NEVER)])
def test_topup_frequency(spark, n, want):
    assert build(spark, n=n).topup_frequency == want


def test_no_history(spark):
    r = build(spark, arpu=1000.0)
    assert r.arpu_avg_6m is None and r.arpu_trend is None
    assert r.customer_value_score == 25.0  # 20 for ARPU, 0 for ratio, 5 for unknown growth


def test_scores_are_capped(spark):
    r = build(spark, arpu=1e6, n=5, ratio=100.0, monthly=[("a", "202503", 0.0, 0.0, 0.0, 1.0), ("a", "202504", 0.0, 0.0, 0.0, 1e6)])
    assert (r.customer_value_score, r.advance_readiness_score) == (100.0, 100.0)


def test_columns(stages):
    assert stages.profiles().columns == PROFILE_COLUMNS + PROFILE_EXTRA_COLUMNS and len(PROFILE_COLUMNS) == 31


def test_public_codes(spark):
    df = spark.createDataFrame([("EasyCredit",), ("MBFG",), ("ungsanluong",), ("other",), (None,)], "s string")
    assert values(df.select("s", profile.public_service("s"))) == sorted([
        ("EasyCredit", "Fee"), ("MBFG", "Free"), ("ungsanluong", "Quota"), ("other", None), (None, None)], key=repr)


def test_priority_of_missing_scores(spark):
    df = spark.createDataFrame([(None, 50.0)], "customer_value_score double, advance_readiness_score double")
    assert tuple(df.select(profile.priority(), profile.priority(False)).first()) == (0.0, None)


def test_eligibility(spark):
    recs = spark.createDataFrame(
        [("ok", "Fee", 25000.0, 7500.0, 60.0, 90.0, "LOW", "u", "t"), ("low", "Fee", 1.0, 1.0, 59.0, 90.0, "LOW", "u", "t"),
         ("risky", "Fee", 1.0, 1.0, 90.0, 90.0, "MEDIUM", "u", "t")],
        "isdn string, service_type string, advance_amount double, revenue_per_advance double, customer_value_score double, "
        "advance_readiness_score double, bad_debt_risk string, user_type string, arpu_trend string")
    ids = spark.createDataFrame([("ok",), ("low",), ("risky",), ("absent",)], "isdn string")
    rows = {r.isdn: r for r in profile.eligibility(ids, recs).collect()}
    assert rows["ok"].eligible and rows["ok"].advance_amount == 25000.0
    assert not rows["low"].eligible and "59.0/100" in rows["low"].reason and rows["low"].advance_amount is None
    assert "MEDIUM" in rows["risky"].reason
    assert "recommendation" in rows["absent"].reason
