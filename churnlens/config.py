"""Frozen parameter sets (the reference keeps them in a YAML file)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the reference for equal results.
# Event-type domain and integer codes (0 is padding):
EVENT_TYPES = ("page_view", "search", "add_to_cart", "remove_from_cart",
               "purchase", "coupon_use", "review", "cs_contact")
EVENT_CODES = {name: i + 1 for i, name in enumerate(EVENT_TYPES)}
# Allowed marketing responses:
MARKETING_RESPONSES = ("adverse", "conversion", "no_response")


@dataclass(frozen=True)
class ChurnParams:
    no_purchase_days: int = 30
    no_login_days: int = 60
    simulation_days: int = 365
    mode: str = "or"        # "or" | "and"


@dataclass(frozen=True)
class CohortParams:
    max_periods: int = 12
    min_cohort_size: int = 5
    milestones: tuple = (1, 3, 6, 12)


@dataclass(frozen=True)
class DriftParams:
    n_bins: int = 10
    psi_yellow: float = 0.10
    psi_red: float = 0.25
    ks_drift_p: float = 0.01
    ks_warning_p: float = 0.05
    epsilon: float = 1e-6


@dataclass(frozen=True)
class PerfThresholds:
    auc: float = 0.03
    precision: float = 0.05
    recall: float = 0.05


@dataclass(frozen=True)
class Params:
    churn: ChurnParams = field(default_factory=ChurnParams)
    cohort: CohortParams = field(default_factory=CohortParams)
    drift: DriftParams = field(default_factory=DriftParams)
    perf: PerfThresholds = field(default_factory=PerfThresholds)
