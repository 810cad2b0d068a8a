"""Bad-debt risk of an offer: an additive score, a level and a filter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subpanel.functions.columns import add_if, case_when, safe_ratio
from subpanel.operators.params import RiskParams

_DEFAULTS = RiskParams()


def risk_ratio() -> Column:
    return safe_ratio("topup_amount_last_1m", "advance_amount")


def risk_score(params: RiskParams = _DEFAULTS) -> Column:
    """Base plus independent deltas in four blocks.

    A block's deltas scale with its weight; the default weights give the deltas below. The result
    is integral for default weights.
    """
    p = params.validate()
    amount, advance, count = F.col("topup_amount_last_1m"), F.col("advance_amount"), F.col("topup_count_last_1m")
    arpu, avg, free = F.col("arpu"), F.col("avg_topup_amount"), F.col("service_type") == "MBFG"
    # Score deltas of the four blocks.
    blocks = {
        "topup_advance_ratio_weight": [
            (amount >= advance, -40), ((amount > 0) & (amount < advance), -10), (amount == 0, 40),
            (free & (amount == 0), -20)],
        "topup_frequency_weight": [
            (count >= 3, -15), (count == 2, -10), (count == 1, -5), (count == 0, 20)],
        "arpu_stability_weight": [
            (arpu >= 5000, -15), ((arpu >= 2000) & (arpu < 5000), -10), ((arpu >= 1000) & (arpu < 2000), -5),
            (arpu < 500, 10), (free & (arpu >= 2000), -10)],
        "avg_topup_weight": [
            (avg >= 100000, -15), ((avg >= 50000) & (avg < 100000), -10), ((avg >= 20000) & (avg < 50000), -5),
            ((avg > 0) & (avg < 10000), 5), (free & (avg >= 20000), -10)],
    }
    terms = [add_if(cond, delta * getattr(p, weight) / getattr(_DEFAULTS, weight))
             for weight, rules in blocks.items() for cond, delta in rules]
    total = reduce(lambda a, b: a + b, terms, F.lit(float(p.base_risk_score)))
    return total.cast("int") if p == _DEFAULTS else total


def risk_level(score: Column | str, params: RiskParams = _DEFAULTS) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return case_when([(s <= params.low_risk_threshold, "LOW"), (s <= params.high_risk_threshold, "MEDIUM")], "HIGH")


def score_risk(recs: DataFrame, params: RiskParams = _DEFAULTS) -> DataFrame:
    """Add topup_advance_ratio, risk_score and bad_debt_risk."""
    return (recs.withColumns({"risk_score": risk_score(params), "topup_advance_ratio": risk_ratio()})
            .withColumn("bad_debt_risk", risk_level("risk_score", params)))


def keep_risk(df: DataFrame, levels: Sequence[str] = ("LOW", "MEDIUM")) -> DataFrame:
    return df.filter(F.col("bad_debt_risk").isin(*levels))
