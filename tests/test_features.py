import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from subpanel.functions.quantiles import exact_quantiles
from subpanel.operators import features as feat
from subpanel.schemas import MASTER_COLUMNS

Q = {name: 1e18 for name in feat.QUANTILES}


def panel(spark, rows):
    """Master rows from (isdn, month, overrides)."""
    defaults = {"subscriber_type": "PRE", "subscriber_status": "ACTIF", "status_detail": "x", "most_used_advance_service": "Unknown",
                "most_used_topup_channel": "Unknown", "has_advance_in_month": False}
    counts = {"advance_count", "topup_count", "num_packages", "num_active_packages", "num_renewed_packages", "n3_record_count"}
    kinds, data = [], []
    for c in MASTER_COLUMNS:
        kind = ("date" if c.endswith("_date") else "boolean" if c == "has_advance_in_month" else "long" if c in counts
                else "string" if c in ("isdn", "data_month") or c in defaults else "double")
        kinds.append(f"{c} {kind}")
    for isdn, month, over in rows:
        row = {"isdn": isdn, "data_month": month, **defaults, **over}
        data.append(tuple(row.get(c, None if c.endswith("_date") else 0 if c in counts else 0.0) for c in MASTER_COLUMNS))
    return spark.createDataFrame(data, ", ".join(kinds))


def by_key(df):
    return {(r.isdn, r.data_month): r for r in df.collect()}


def test_history_stays_inside_a_subscriber(spark):
    rows = [("a", f"20250{3 + i}", {"advance_count": n, "topup_count": n, "total_topup_amount": float(n)}) for i, n in enumerate((1, 2, 3))]
    rows += [("b", f"20250{3 + i}", {"advance_count": n}) for i, n in enumerate((10, 20))]
    got = by_key(feat.build_features(panel(spark, rows), quantiles=Q))
    assert [got["a", f"20250{m}"].advance_count_last_2m for m in (3, 4, 5)] == [0, 1, 3]
    assert [got["a", f"20250{m}"].topup_amount_last_1m for m in (3, 4, 5)] == [0.0, 1.0, 2.0]
    assert [got["b", f"20250{m}"].advance_count_last_2m for m in (3, 4)] == [0, 10]
    assert [got["b", f"20250{m}"].has_advance_history for m in (3, 4)] == [0, 1]


def test_months_since_last_advance(spark):
    rows = [("a", m, {"advance_count": n}) for m, n in (("202511", 0), ("202512", 1), ("202601", 0), ("202602", 0))]
    got = by_key(feat.build_features(panel(spark, rows), quantiles=Q))
    assert [got["a", m].months_since_last_advance for m, in (("202511",), ("202512",), ("202601",), ("202602",))] == [99, 0, 1, 2]


def test_financial_edges(spark):
    rows = [("none", "202508", {}), ("package", "202508", {"total_package_value": 10.0}),
            ("both", "202508", {"total_topup_amount": 10.0, "topup_count": 1, "total_package_value": 16.0, "outstanding_debt": 1.0})]
    got = {k[0]: r for k, r in by_key(feat.build_features(panel(spark, rows), quantiles=Q)).items()}
    assert (got["none"].burn_rate, got["none"].burn_rate_capped, got["none"].burn_rate_high, got["none"].topup_is_stable) == (999.0, 5.0, 1, 1)
    assert got["package"].balance_is_negative == 1 and got["package"].financial_stress_score == 3
    assert got["both"].burn_rate_very_high == 1 and got["both"].financial_stress_score == 3


def test_null_tenure_gives_no_class(spark):
    r = feat.build_features(panel(spark, [("a", "202508", {})]), quantiles=Q).first()
    assert (r.subscriber_tenure_days, r.is_new_subscriber, r.is_mature_subscriber) == (None, 0, 0)


def test_frequency_flags_partition_the_rows(stages):
    flags = [f"topup_freq_{x}" for x in ("none", "low", "medium", "high")]
    assert stages.features().filter(sum(F.col(f) for f in flags) != 1).count() == 0
    assert len(feat.FEATURES) == 45 and len(stages.features().columns) == 79


def test_feature_catalog(stages):
    rows = feat.feature_catalog(stages.features()).collect()
    assert len(rows) == 69 and {"burn_rate", "topup_cv"} <= {r.feature for r in rows}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.just(0.0), st.floats(-1e6, 1e6, allow_subnormal=False)), min_size=1, max_size=60), st.sampled_from([0.0, 0.25, 0.5, 0.75, 0.9, 1.0]))
def test_refined_quantile_equals_the_sorted_one(spark, xs, q):
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double").coalesce(2)
    want = float(np.quantile(np.array(xs), q))
    assert exact_quantiles(df, {"q": ("x", q)}, keep=0, cells=4)["q"] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_quantiles_with_one_value_owning_most_rows(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 1.5).alias("x"),
                                   F.lit(7.0).alias("same"))
    wanted = {"a": ("x", 0.2), "b": ("x", 0.75), "c": ("same", 0.5)}
    assert exact_quantiles(df, wanted, keep=0, cells=16) == exact_quantiles(df, wanted)


def test_quantiles_of_extreme_values(spark):
    xs = [float("-inf"), -1e308, 1.0, 2.0, 3.0, 1e308, float("inf"), float("nan"), 0.0, 5e-324]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k, want in enumerate([-1.7976931348623157e308, -1e308, 0.0, 5e-324, 1.0, 2.0, 3.0, 1e308, 1.7976931348623157e308]):
        assert exact_quantiles(df, {"q": ("x", k / 8)}, keep=0, cells=4)["q"] == want


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, {"q": ("x", 0.5)}) == {"q": None}
