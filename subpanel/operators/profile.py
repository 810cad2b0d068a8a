"""Customer-360 profile: ARPU history statistics, behaviour classes and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subpanel.functions.columns import case_when, clamp, exact_avg, half_even, is_true, map_lookup, safe_ratio
from subpanel.operators.offers import targets_only
from subpanel.schemas import ARPU_COLUMNS, KEYS, PROFILE_COLUMNS, PROFILE_EXTRA_COLUMNS, PUBLIC_SERVICE

# Labels of trend, user type and top-up frequency, and the points they give.
UP, DOWN, FLAT = "Tăng trưởng", "Giảm", "Ổn định"
HEAVY_DATA, VOICE_SMS, BALANCED = "Heavy Data User", "Voice/SMS User", "Balanced User"
OFTEN, MIDDLE, RARE, NEVER = "Thường xuyên", "Trung bình", "Hiếm", "Không nạp"
RISK_POINTS = {"LOW": 50.0, "MEDIUM": 30.0, "HIGH": 0.0}
FREQUENCY_POINTS = {OFTEN: 20.0, MIDDLE: 10.0, RARE: 5.0, NEVER: 0.0}


def monthly_arpu(master: DataFrame, recs: DataFrame) -> DataFrame:
    """Mean ARPU per recommended subscriber and month."""
    rows = targets_only(master.select(*KEYS, *ARPU_COLUMNS), recs)
    return rows.groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in ARPU_COLUMNS])


def arpu_stats(monthly: DataFrame) -> DataFrame:
    """Per subscriber: mean, sample deviation, range, first and last known month, growth and trend."""
    total = F.col("arpu_total")
    known = F.when(total.isNotNull(), F.col("data_month"))
    first, last = F.col("arpu_first"), F.col("arpu_last")
    growth = F.when(is_true(first > 0), F.try_divide(last - first, first) * 100).otherwise(0.0)
    return (monthly.groupBy("isdn")
            .agg(exact_avg("arpu_total").alias("arpu_avg_6m"),
                 F.stddev_samp("arpu_total").alias("arpu_std_6m"),
                 F.min("arpu_total").alias("arpu_min_6m"),
                 F.max("arpu_total").alias("arpu_max_6m"),
                 F.min_by("arpu_total", known).alias("arpu_first"),
                 F.max_by("arpu_total", known).alias("arpu_last"),
                 exact_avg("arpu_call").alias("arpu_call_avg"),
                 exact_avg("arpu_sms").alias("arpu_sms_avg"),
                 exact_avg("arpu_data").alias("arpu_data_avg"),
                 F.count("data_month").alias("months_count"))
            .withColumn("arpu_growth_rate", growth)
            .withColumn("arpu_trend", case_when([(F.col("arpu_growth_rate") > 10, UP),
                                                 (F.col("arpu_growth_rate") < -10, DOWN)], FLAT)))


def topup_range(master: DataFrame, recs: DataFrame) -> DataFrame:
    """Smallest and largest monthly top-up total of the recommended subscribers."""
    return (targets_only(master.select("isdn", "total_topup_amount"), recs).groupBy("isdn")
            .agg(F.min("total_topup_amount").alias("topup_min_amount"),
                 F.max("total_topup_amount").alias("topup_max_amount")))


def _share(part: str) -> Column:
    return F.when(is_true(F.col("arpu") > 0), safe_ratio(part, "arpu") * 100).otherwise(0.0)


def user_type() -> Column:
    share = F.col("revenue_data_pct")
    return case_when([(is_true(share > 80), HEAVY_DATA), (is_true(share < 20), VOICE_SMS)], BALANCED)


def topup_frequency() -> Column:
    n = F.coalesce(F.col("topup_count_last_1m"), F.lit(0))
    return case_when([(n >= 4, OFTEN), (n >= 2, MIDDLE), (n >= 1, RARE)], NEVER)


def value_score() -> Column:
    """ARPU up to 40 points, top-up ratio up to 30, growth up to 30."""
    ratio = F.coalesce(F.col("topup_advance_ratio"), F.lit(0.0))
    growth = F.coalesce(F.col("arpu_growth_rate"), F.lit(0.0))
    arpu = F.coalesce(F.col("arpu_avg_6m"), F.col("arpu"))
    return half_even(clamp(arpu / 50, 0.0, 40.0) + clamp(ratio * 10, 0.0, 30.0) + clamp((growth + 10) / 2, 0.0, 30.0))


def readiness_score() -> Column:
    """Risk level up to 50 points, top-up ratio up to 30, top-up frequency up to 20."""
    ratio = F.coalesce(F.col("topup_advance_ratio"), F.lit(0.0))
    return half_even(map_lookup("bad_debt_risk", RISK_POINTS, 0.0) + clamp(ratio * 7.5, 0.0, 30.0)
                     + map_lookup("topup_frequency", FREQUENCY_POINTS, 0.0))


def build_profile(recs: DataFrame, monthly: DataFrame, topups: DataFrame | None = None,
                  segments: DataFrame | None = None) -> DataFrame:
    """One profile per recommendation.

    The 31 profile columns, then those the sinks also expect. `topups` gives the range of monthly
    totals and `segments` the cluster; both are optional and leave nulls.
    """
    df = recs.join(arpu_stats(monthly).drop("arpu_call_avg", "arpu_sms_avg", "arpu_data_avg"), "isdn", "left")
    if topups is not None:
        df = df.join(topups, "isdn", "left")
    else:
        df = df.withColumns({c: F.lit(None).cast("double") for c in ("topup_min_amount", "topup_max_amount")})
    if segments is not None:
        df = df.join(segments.select("isdn", F.col("cluster").alias("cluster_group")), "isdn", "left")
    else:
        df = df.withColumn("cluster_group", F.lit(None).cast("int"))
    df = (df.withColumns({"revenue_call_pct": _share("arpu_call"), "revenue_sms_pct": _share("arpu_sms"),
                          "revenue_data_pct": _share("arpu_data"), "topup_frequency": topup_frequency()})
          .withColumns({"user_type": user_type(), "customer_value_score": value_score(),
                        "advance_readiness_score": readiness_score(),
                        "arpu_first_month": F.col("arpu_first"), "arpu_last_month": F.col("arpu_last"),
                        "topup_frequency_class": F.col("topup_frequency"),
                        "topup_avg_amount": F.col("avg_topup_amount")}))
    return df.select(*PROFILE_COLUMNS, *PROFILE_EXTRA_COLUMNS)


def public_service(c: Column | str) -> Column:
    """Public code of a service; unknown codes give null."""
    return map_lookup(c, PUBLIC_SERVICE, F.lit(None).cast("string"))


def priority(nulls_as_zero: bool = True) -> Column:
    """Value times readiness per hundred. Documents count missing scores as 0 and round to 2
    places; the row store lets them propagate and does not round."""
    value, ready = F.col("customer_value_score"), F.col("advance_readiness_score")
    if nulls_as_zero:
        return half_even(F.coalesce(value, F.lit(0.0)) * F.coalesce(ready, F.lit(0.0)) / 100, 2)
    return value * ready / 100


def insight_columns() -> dict[str, Column]:
    """Reason text, strengths, three factor checks and a cross-sell hint."""
    # Texts of the insight panel.
    strengths = F.array(
        F.when(F.col("arpu_avg_6m") > 2000, "ARPU ổn định"),
        F.when(F.col("topup_frequency") == OFTEN, "Topup thường xuyên"),
        F.when(F.col("topup_advance_ratio") >= 3, "Tỷ lệ topup/ứng cao"),
        F.when(F.col("bad_debt_risk") == "LOW", "Rủi ro thấp"))
    return {
        "reason_text": F.concat(F.lit("Classified as "), F.coalesce(F.col("user_type"), F.lit("Unknown")),
                                F.lit(" based on revenue breakdown")),
        "strengths": F.filter(strengths, lambda s: s.isNotNull()),
        "ratio_ok": is_true(F.col("topup_advance_ratio") >= 2),
        "frequency_ok": is_true(F.col("topup_frequency") == OFTEN),
        "growth_ok": is_true(F.col("arpu_growth_rate") >= 0),
        "cross_sell_data": is_true(F.col("user_type") == HEAVY_DATA)}


def insights(profile: DataFrame) -> DataFrame:
    return profile.select("isdn", *[c.alias(n) for n, c in insight_columns().items()])


def eligibility(ids: DataFrame, recs: DataFrame, min_value: float = 60.0) -> DataFrame:
    """Decision per requested id: absent, wrong risk, low value, or eligible with the offer."""
    offer = ["service_type", "advance_amount", "revenue_per_advance", "customer_value_score",
             "advance_readiness_score", "bad_debt_risk", "user_type", "arpu_trend"]
    df = ids.select("isdn").join(recs.select("isdn", *offer, F.lit(True).alias("_listed")), "isdn", "left")
    risk, value = F.col("bad_debt_risk"), F.coalesce(F.col("customer_value_score"), F.lit(0)).cast("double")
    # Refusal texts.
    reason = case_when([
        (F.col("_listed").isNull(), "ISDN không có trong danh sách recommendation"),
        (~is_true(risk == "LOW"), F.concat(F.lit("Risk level "), F.coalesce(risk, F.lit("None")), F.lit(" - chỉ chấp nhận LOW risk"))),
        (value < min_value, F.concat(F.lit("Customer value score quá thấp: "), value.cast("string"), F.lit("/100")))],
        F.lit(None).cast("string"))
    df = df.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())
    shown = {c: F.when(F.col("eligible"), F.col(c)) for c in ("service_type", "advance_amount", "revenue_per_advance",
                                                                "advance_readiness_score", "user_type", "arpu_trend")}
    return df.withColumns(shown).select("isdn", "eligible", "reason", *offer)
