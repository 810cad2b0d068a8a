"""Service and amount offered to a subscriber.

Each output column is one `when` chain over the same four rule conditions, in rule order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subpanel.functions.columns import clamp, half_even, is_true, safe_ratio, usage_hours
from subpanel.operators.master import first_per, latest_subscribers
from subpanel.operators.params import OfferParams
from subpanel.schemas import ARPU_COLUMNS, LATEST_MONTH, RECOMMENDATION_COLUMNS


def ensure_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add absent columns with a constant."""
    return df.withColumns({n: F.lit(v) for n, v in defaults.items() if n not in df.columns})


def targets_only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the listed subscribers. The list grows with the base, so Spark chooses the join by size."""
    return df.join(ids.select("isdn"), "isdn", "left_semi")


def prepaid_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("subscriber_type") == "PRE") if "subscriber_type" in df.columns else df


def attach_arpu(df: DataFrame, arpu: DataFrame | None = None) -> DataFrame:
    """Left-join the ARPU measures the rows do not carry yet; missing values are 0."""
    absent = [c for c in ARPU_COLUMNS if c not in df.columns]
    if arpu is not None and absent:
        present = [c for c in absent if c in arpu.columns]
        one = first_per(arpu.select("isdn", *present), "isdn", [F.desc(c) for c in present])
        df = df.join(one, "isdn", "left")
    df = ensure_columns(df, {c: 0.0 for c in ARPU_COLUMNS})
    return df.fillna(0, subset=ARPU_COLUMNS)


def voice_share() -> Column:
    """Share of call and message revenue in percent."""
    return F.when(is_true(F.col("arpu") > 0), safe_ratio(F.col("arpu_call") + F.col("arpu_sms"), "arpu") * 100).otherwise(0.0)


# Reason texts of the rules.
REASONS = {
    "ungsanluong": "voice_sms_pct > 70%",
    "EasyCredit": "topup >= 50k/month, consistent 2 months",
    "MBFG": "topup >= 2 times/month, amount < 50k",
    "fallback": "fallback - default to MBFG 10k",
}
# The offer of subscribers no rule covers.
FALLBACK_AMOUNT, FALLBACK_REVENUE, FALLBACK_HOURS, UNLIMITED = 10000.0, 3000.0, 24, -1


def classify_offer(df: DataFrame, params: OfferParams = OfferParams()) -> DataFrame:
    """Add service_type, advance_amount, revenue_per_advance, usage_time_hours and the reason."""
    p = params.validate()
    arpu = F.col("arpu")
    voice = is_true(F.col("voice_sms_pct") > p.voice_sms_threshold)
    credit = (is_true(F.col("topup_count_last_1m") >= p.easycredit_min_topup_count_1m)
              & (is_true(F.col("topup_amount_last_1m") >= p.easycredit_min_topup_amount)
                 | is_true(F.col("avg_topup_amount") >= p.easycredit_min_topup_amount))
              & is_true(F.col("topup_count_last_2m") >= p.easycredit_min_topup_count_2m))
    free = is_true(F.col("topup_count_last_1m") >= p.mbfg_min_topup_count_1m)

    def by_rule(on_voice, on_credit, on_free, otherwise):
        return F.when(voice, on_voice).when(credit, on_credit).when(free, on_free).otherwise(otherwise)

    amount = by_rule(
        half_even(clamp(arpu * p.ungsanluong_arpu_multiplier, float(p.ungsanluong_min_amount),
                        float(p.ungsanluong_max_amount)), -3),
        F.when(is_true(arpu > p.easycredit_vip_arpu_threshold), float(p.easycredit_vip_amount))
        .otherwise(float(p.easycredit_default_amount)),
        clamp(half_even(arpu * p.mbfg_arpu_multiplier, -3), float(p.mbfg_min_amount), float(p.mbfg_max_amount)),
        F.lit(FALLBACK_AMOUNT))
    a = F.col("advance_amount")
    return (df.withColumns({
        "service_type": by_rule(F.lit("ungsanluong"), F.lit("EasyCredit"), F.lit("MBFG"), F.lit("MBFG")),
        "advance_amount": amount,
        "classification_reason": by_rule(*[F.lit(REASONS[k]) for k in ("ungsanluong", "EasyCredit", "MBFG", "fallback")])})
        .withColumns({
            "revenue_per_advance": by_rule(a * p.ungsanluong_revenue_rate, a * p.easycredit_revenue_rate,
                                           a * p.mbfg_revenue_rate, F.lit(FALLBACK_REVENUE)),
            "usage_time_hours": by_rule(usage_hours(a), F.lit(UNLIMITED), usage_hours(a), F.lit(FALLBACK_HOURS))}))


def recommend(features: DataFrame, targets: DataFrame, params: OfferParams = OfferParams(),
              month: str = LATEST_MONTH, arpu: DataFrame | None = None) -> DataFrame:
    """Offers for the prepaid target subscribers of one month, one row each, 15 columns."""
    rows = prepaid_only(latest_subscribers(targets_only(features, targets), month))
    rows = attach_arpu(rows, arpu).withColumn("arpu", F.col("arpu_total"))
    needed = ["topup_count_last_1m", "topup_amount_last_1m", "topup_count_last_2m", "avg_topup_amount"]
    rows = ensure_columns(rows, {c: 0 for c in needed}).fillna(0, subset=needed)
    rows = ensure_columns(rows, {"subscriber_type": "PRE"})
    return classify_offer(rows.withColumn("voice_sms_pct", voice_share()), params).select(*RECOMMENDATION_COLUMNS)


def rule_based_targets(features: DataFrame, advanced: DataFrame, month: str = LATEST_MONTH) -> DataFrame:
    """Ids of the month's subscribers that never advanced: a target list that needs no clustering."""
    return (features.filter(F.col("data_month") == month).select("isdn").distinct()
            .join(advanced, "isdn", "left_anti"))

