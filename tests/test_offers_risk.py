import pytest
from pyspark.sql import functions as F

from subpanel.operators import offers, risk
from subpanel.operators.params import ClusterParams, OfferParams, RiskParams

OFFER = ("isdn string, arpu double, voice_sms_pct double, topup_count_last_1m long, topup_amount_last_1m double, "
         "topup_count_last_2m long, avg_topup_amount double")


def offer(spark, arpu=1000.0, voice=0.0, n1=0, amount=0.0, n2=0, avg=0.0, params=OfferParams()):
    df = spark.createDataFrame([("a", arpu, voice, n1, amount, n2, avg)], OFFER)
    r = offers.classify_offer(df, params).first()
    return r.service_type, r.advance_amount, r.revenue_per_advance, r.usage_time_hours


@pytest.mark.parametrize("kwargs, want", [
    (dict(voice=70.0), ("MBFG", 10000.0, 3000.0, 24)),                       # exactly 70 is not a voice user
    (dict(voice=70.01, arpu=15625.0), ("ungsanluong", 12000.0, 2400.0, 36)),  # 12,500 rounds to even
    (dict(voice=100.0, arpu=1e9), ("ungsanluong", 50000.0, 10000.0, 60)),
    (dict(n1=1, amount=50000.0, n2=1), ("EasyCredit", 25000.0, 7500.0, -1)),
    (dict(n1=1, amount=49999.0, avg=50000.0, n2=1, arpu=100000.01), ("EasyCredit", 50000.0, 15000.0, -1)),
    (dict(n1=1, amount=50000.0, n2=1, arpu=100000.0), ("EasyCredit", 25000.0, 7500.0, -1)),
    (dict(n1=2, amount=1000.0, n2=2, arpu=8000.0), ("MBFG", 10000.0, 3000.0, 36)),
    (dict(n1=2, amount=1000.0, n2=2, arpu=50000.0), ("MBFG", 50000.0, 15000.0, 60)),
    (dict(n1=2, amount=1000.0, n2=2, arpu=12083.0), ("MBFG", 14000.0, 4200.0, 36)),
    (dict(n1=1, amount=1000.0, n2=1), ("MBFG", 10000.0, 3000.0, 24)),
    (dict(voice=None, n1=2, n2=2, amount=0.0, arpu=0.0), ("MBFG", 10000.0, 3000.0, 36)),  # unknown share, next rule applies
])
def test_rules(spark, kwargs, want):
    assert offer(spark, **kwargs) == want


def test_parameters_change_the_rules(spark):
    assert offer(spark, voice=60.0, params=OfferParams(voice_sms_threshold=50.0))[0] == "ungsanluong"
    with pytest.raises(ValueError, match="mbfg_arpu_multiplier"):
        offer(spark, params=OfferParams(mbfg_arpu_multiplier=3))
    assert RiskParams(base_risk_score=101).problems() and ClusterParams(n_clusters=11).problems()
    assert not (OfferParams().problems() + RiskParams().problems() + ClusterParams().problems())


def test_reference_amount_clamps_before_rounding(spark):
    assert offer(spark, voice=80.0, arpu=12000.0)[1] == 10000.0     # 9,600 is lifted to 10,000
    assert offer(spark, voice=80.0, arpu=75000.0)[1] == 50000.0     # 60,000 is cut to 50,000


RISK = "service_type string, advance_amount double, topup_amount_last_1m double, topup_count_last_1m long, arpu double, avg_topup_amount double"


def score(spark, service="EasyCredit", advance=10000.0, amount=0.0, n=0, arpu=700.0, avg=0.0, params=RiskParams()):
    df = spark.createDataFrame([(service, advance, amount, n, arpu, avg)], RISK)
    return risk.score_risk(df, params).first()


@pytest.mark.parametrize("kwargs, want", [
    (dict(), 50 + 40 + 20),
    (dict(service="MBFG"), 50 + 40 - 20 + 20),
    (dict(arpu=500.0), 110), (dict(arpu=499.0), 120), (dict(arpu=999.0), 110), (dict(arpu=1000.0), 105),
    (dict(amount=10000.0, n=3, arpu=5000.0, avg=100000.0), 50 - 40 - 15 - 15 - 15),
    (dict(amount=9999.0, n=2, arpu=2000.0, avg=20000.0, service="MBFG"), 50 - 10 - 10 - 10 - 10 - 5 - 10),
    (dict(amount=1.0, n=1, avg=9999.0), 50 - 10 - 5 + 5), (dict(amount=1.0, n=1, avg=10000.0), 50 - 10 - 5),
])
def test_score(spark, kwargs, want):
    assert score(spark, **kwargs).risk_score == want


@pytest.mark.parametrize("s, want", [(30, "LOW"), (31, "MEDIUM"), (60, "MEDIUM"), (61, "HIGH")])
def test_level(spark, s, want):
    assert spark.range(1).select(risk.risk_level(F.lit(s))).first()[0] == want


def test_weights_scale_their_block(spark):
    base, half = score(spark), score(spark, params=RiskParams(topup_advance_ratio_weight=20.0))
    assert base.risk_score - half.risk_score == 20


def test_ratio(spark):
    assert score(spark, amount=25000.0, advance=10000.0).topup_advance_ratio == 2.5
    assert score(spark, advance=0.0).topup_advance_ratio == 0.0


def test_every_target_gets_one_offer(stages):
    scored, ids = stages.scored(), stages.target_ids()
    prepaid = stages.snapshot().filter("subscriber_type = 'PRE'").join(ids, "isdn", "left_semi")
    assert scored.count() == prepaid.count() == scored.select("isdn").distinct().count()
    assert scored.filter("advance_amount NOT BETWEEN 10000 AND 50000").count() == 0
    assert scored.filter("bad_debt_risk NOT IN ('LOW', 'MEDIUM', 'HIGH')").count() == 0


def test_arpu_is_attached_only_where_absent(spark):
    recs = spark.createDataFrame([("a", 1.0), ("b", None)], "isdn string, arpu_total double")
    arpu = spark.createDataFrame([("a", 5.0, 9.0), ("a", 4.0, 9.0)], "isdn string, arpu_call double, arpu_total double")
    rows = {r.isdn: r for r in offers.attach_arpu(recs, arpu).collect()}
    assert (rows["a"].arpu_total, rows["a"].arpu_call, rows["a"].arpu_sms) == (1.0, 5.0, 0.0)
    assert (rows["b"].arpu_total, rows["b"].arpu_call) == (0.0, 0.0)
