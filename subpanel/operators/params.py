"""Rule parameters with their defaults and bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import ClassVar


class Bounded:
    """Numbers checked against closed bounds on construction request."""

    BOUNDS: ClassVar[dict[str, tuple[float, float]]] = {}

    def problems(self) -> list[str]:
        out = []
        for f in fields(self):
            lo, hi = self.BOUNDS[f.name]
            value = getattr(self, f.name)
            if not lo <= value <= hi:
                out.append(f"{f.name}={value} outside [{lo}, {hi}]")
        return out

    def validate(self):
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self


@dataclass(frozen=True)
class OfferParams(Bounded):
    voice_sms_threshold: float = 70.0
    ungsanluong_arpu_multiplier: float = 0.8
    ungsanluong_min_amount: float = 10000
    ungsanluong_max_amount: float = 50000
    ungsanluong_revenue_rate: float = 0.20
    easycredit_min_topup_count_1m: int = 1
    easycredit_min_topup_amount: float = 50000
    easycredit_min_topup_count_2m: int = 1
    easycredit_vip_arpu_threshold: float = 100000
    easycredit_default_amount: float = 25000
    easycredit_vip_amount: float = 50000
    easycredit_revenue_rate: float = 0.30
    mbfg_min_topup_count_1m: int = 2
    mbfg_arpu_multiplier: float = 1.2
    mbfg_min_amount: float = 10000
    mbfg_max_amount: float = 50000
    mbfg_revenue_rate: float = 0.30

    # Allowed range of each parameter.
    BOUNDS: ClassVar = {
        "voice_sms_threshold": (0, 100),
        "ungsanluong_arpu_multiplier": (0, 2),
        "ungsanluong_min_amount": (5000, 50000),
        "ungsanluong_max_amount": (10000, 100000),
        "ungsanluong_revenue_rate": (0, 1),
        "easycredit_min_topup_count_1m": (0, 10),
        "easycredit_min_topup_amount": (0, 200000),
        "easycredit_min_topup_count_2m": (0, 10),
        "easycredit_vip_arpu_threshold": (50000, 500000),
        "easycredit_default_amount": (10000, 50000),
        "easycredit_vip_amount": (25000, 100000),
        "easycredit_revenue_rate": (0, 1),
        "mbfg_min_topup_count_1m": (0, 10),
        "mbfg_arpu_multiplier": (0, 2),
        "mbfg_min_amount": (5000, 50000),
        "mbfg_max_amount": (10000, 100000),
        "mbfg_revenue_rate": (0, 1),
    }


@dataclass(frozen=True)
class RiskParams(Bounded):
    topup_advance_ratio_weight: float = 40.0
    topup_frequency_weight: float = 20.0
    arpu_stability_weight: float = 20.0
    avg_topup_weight: float = 20.0
    base_risk_score: float = 50.0
    low_risk_threshold: float = 30.0
    high_risk_threshold: float = 60.0

    # Allowed range of each parameter.
    BOUNDS: ClassVar = {
        "topup_advance_ratio_weight": (0, 100),
        "topup_frequency_weight": (0, 100),
        "arpu_stability_weight": (0, 100),
        "avg_topup_weight": (0, 100),
        "base_risk_score": (0, 100),
        "low_risk_threshold": (0, 100),
        "high_risk_threshold": (0, 100),
    }


@dataclass(frozen=True)
class ClusterParams(Bounded):
    n_clusters: int = 3
    n_init: int = 20
    max_iter: int = 500
    random_state: int = 42

    # Allowed range of each parameter.
    BOUNDS: ClassVar = {
        "n_clusters": (2, 10),
        "n_init": (1, 100),
        "max_iter": (100, 2000),
        "random_state": (0, 1000),
    }
