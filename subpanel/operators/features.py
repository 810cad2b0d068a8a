"""The 45 behavioural features of a subscriber-month.

One window ordering per subscriber serves all history features, so the panel is shuffled and sorted
once. A subscriber's partition holds one row per month. Thresholds that depend on the whole table
enter the projection as literals.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subpanel.functions.columns import flag, month_index, safe_ratio, tenure_days
from subpanel.functions.quantiles import exact_quantiles
from subpanel.schemas import NON_FEATURE_COLUMNS, TENURE_REFERENCE_DATE

# name -> (column, quantile)
QUANTILES = {
    "topup_count_q75": ("topup_count", 0.75),
    "total_topup_amount_q75": ("total_topup_amount", 0.75),
    "avg_topup_amount_q75": ("avg_topup_amount", 0.75),
    "total_package_value_q75": ("total_package_value", 0.75),
    "total_package_value_q90": ("total_package_value", 0.90),
}

ADVANCE_FEATURES = ["advance_count_last_1m", "advance_count_last_2m", "advance_count_last_3m",
                    "has_advance_history", "months_since_last_advance", "is_good_payer",
                    "has_outstanding_debt", "is_repeat_advancer"]
TOPUP_FEATURES = ["topup_freq_none", "topup_freq_low", "topup_freq_medium", "topup_freq_high",
                  "is_heavy_topup_user", "topup_amount_high", "avg_topup_high", "topup_cv", "topup_is_stable",
                  "topup_count_last_1m", "topup_count_last_2m", "topup_count_last_3m",
                  "topup_amount_last_1m", "topup_amount_last_2m", "topup_amount_last_3m"]
FINANCIAL_FEATURES = ["estimated_balance", "balance_is_negative", "balance_is_low", "burn_rate",
                      "burn_rate_capped", "burn_rate_high", "burn_rate_very_high", "financial_stress_score",
                      "is_active_user", "usage_intensity", "has_multiple_packages", "has_high_value_package",
                      "package_per_topup_ratio"]
PROFILE_FEATURES = ["is_prepaid", "is_active_status", "subscriber_tenure_days", "is_new_subscriber",
                    "is_mature_subscriber"]
INTERACTION_FEATURES = ["heavy_user_good_payer", "heavy_user_has_debt", "high_topup_high_package",
                        "repeat_advance_good_payer"]
FEATURES = ADVANCE_FEATURES + TOPUP_FEATURES + FINANCIAL_FEATURES + PROFILE_FEATURES + INTERACTION_FEATURES


def global_quantiles(master: DataFrame, **options) -> dict[str, float | None]:
    return exact_quantiles(master, QUANTILES, **options)


def _history():
    return Window.partitionBy("isdn").orderBy(month_index("data_month"))


def rolling_prev(c: Column | str, months: int) -> Column:
    """Sum over the subscriber's previous `months` rows, 0 on the first row."""
    return F.coalesce(F.sum(c).over(_history().rowsBetween(-months, -1)), F.lit(0))


def has_history(c: Column | str) -> Column:
    return flag(F.sum(c).over(_history().rowsBetween(Window.unboundedPreceding, -1)) > 0)


def months_since_last(cond: Column, none: int = 99) -> Column:
    """Months since the condition last held, this row included; `none` when it never did."""
    idx = month_index("data_month")
    last = F.last(F.when(cond, idx), ignorenulls=True).over(
        _history().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.coalesce(idx - last, F.lit(none))


def build_features(master: DataFrame, ref_date: str = TENURE_REFERENCE_DATE,
                   quantiles: Mapping[str, float | None] | None = None) -> DataFrame:
    """Master columns plus 45 features. `master` must hold one row per (isdn, data_month)."""
    q = global_quantiles(master) if quantiles is None else quantiles
    c = F.col

    def above(column: str, name: str) -> Column:
        return flag(c(column) > F.lit(q[name]).cast("double"))

    windowed = {}
    for w in (1, 2, 3):
        windowed[f"advance_count_last_{w}m"] = rolling_prev("advance_count", w)
        windowed[f"topup_count_last_{w}m"] = rolling_prev("topup_count", w)
        windowed[f"topup_amount_last_{w}m"] = rolling_prev("total_topup_amount", w)
    windowed["has_advance_history"] = has_history("advance_count")
    windowed["months_since_last_advance"] = months_since_last(c("advance_count") > 0)

    base = {
        "is_good_payer": flag(c("avg_repayment_rate") >= 0.95),
        "has_outstanding_debt": flag(c("outstanding_debt") > 0),
        "is_repeat_advancer": flag(c("advance_count") > 1),
        "topup_freq_none": flag(c("topup_count") == 0),
        "topup_freq_low": flag((c("topup_count") > 0) & (c("topup_count") <= 2)),
        "topup_freq_medium": flag((c("topup_count") > 2) & (c("topup_count") <= 5)),
        "topup_freq_high": flag(c("topup_count") > 5),
        "is_heavy_topup_user": above("topup_count", "topup_count_q75"),
        "topup_amount_high": above("total_topup_amount", "total_topup_amount_q75"),
        "avg_topup_high": above("avg_topup_amount", "avg_topup_amount_q75"),
        "topup_cv": safe_ratio("std_topup_amount", "avg_topup_amount"),
        "estimated_balance": c("total_topup_amount") - c("total_package_value"),
        "burn_rate": safe_ratio("total_package_value", "total_topup_amount", 999),
        "is_active_user": flag(c("n3_record_count") > 0),
        "usage_intensity": c("n3_record_count"),
        "has_multiple_packages": flag(c("num_packages") > 1),
        "has_high_value_package": above("total_package_value", "total_package_value_q75"),
        "package_per_topup_ratio": safe_ratio("num_packages", "topup_count"),
        "is_prepaid": flag(c("subscriber_type") == "PRE"),
        "is_active_status": flag(c("subscriber_status") == "ACTIF"),
        "subscriber_tenure_days": tenure_days("activation_date", ref_date),
    }
    derived = {
        "topup_is_stable": flag(c("topup_cv") < 0.5),
        "balance_is_negative": flag(c("estimated_balance") < 0),
        "balance_is_low": flag(c("estimated_balance") < 50000),
        "burn_rate_capped": F.least(c("burn_rate"), F.lit(5.0)),
        "burn_rate_high": flag(c("burn_rate") > 1.0),
        "burn_rate_very_high": flag(c("burn_rate") > 1.5),
        "is_new_subscriber": flag(c("subscriber_tenure_days") < 90),
        "is_mature_subscriber": flag(c("subscriber_tenure_days") > 365),
        "heavy_user_good_payer": c("is_heavy_topup_user") * c("is_good_payer"),
        "heavy_user_has_debt": c("is_heavy_topup_user") * c("has_outstanding_debt"),
        "high_topup_high_package": c("topup_amount_high") * c("has_high_value_package"),
        "repeat_advance_good_payer": c("is_repeat_advancer") * c("is_good_payer"),
    }
    stress = (c("balance_is_negative") + c("burn_rate_high") + c("has_outstanding_debt") + c("topup_freq_none")
              + above("total_package_value", "total_package_value_q90"))
    return (master.withColumns(windowed).withColumns(base).withColumns(derived)
            .withColumn("financial_stress_score", stress)
            .select(*master.columns, *FEATURES))


def feature_catalog(features: DataFrame) -> DataFrame:
    """Names of all feature columns, in table order."""
    names = [n for n in features.columns if n not in NON_FEATURE_COLUMNS]
    return features.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names, 1)],
                                                 "position int, feature string")
