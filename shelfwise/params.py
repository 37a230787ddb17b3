"""Constants of the domain. Each is a default that an operator takes as an argument."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: must equal the published ones for right results -------------------------------
CHURN_CLOSED_STATUSES = ("INACTIVE", "CLOSED", "DELETED")
SKU_EXCLUSION_WORDS = ("COUPON", "COU", "DELIVERY", "FEE", "MISC", "LABOR")
SUSPICIOUS_NAMES = ("DELIVERY", "BIRTHDAY", "AUTORAMA", "ZAMBONI", "MISC", "MISCELLANEOUS", "TEST", "DUMMY",
                    "PLACEHOLDER", "SAMPLE", "DONATION", "GIFT", "RAFFLE", "PROMOTION")
LONE_CAPS_WORD = "^[A-Z]{5,20}$"
NULLISH_TOKENS = ("~", "---", "UNKNOWN", "N/A")
XYZ_SAFETY = {"X": 1.0, "Y": 1.3, "Z": 1.8, None: 1.2}
XYZ_CODE = {"X": 0, "Y": 1, "Z": 2, None: 1}
MODEL_PREFERENCE = {
    "A": ("prophet", "lightgbm", "rolling_avg"),
    "B": ("lightgbm", "rolling_avg"),
    "C": ("rolling_avg", "lightgbm"),
}
DEFAULT_MODELS = ("lightgbm", "rolling_avg")
NETWORK = "ALL"
NETWORK_MODEL = "rolling_avg_network"
EXCLUDED_LOCATIONS = ("LOC-021", "LOC-014", "LOC-019", "LOC-022", "LOC-023", "LOC-030", "LOC-031")
DISTRIBUTION_CENTER = "LOC-025"
NOT_BRANCHES = (*EXCLUDED_LOCATIONS, DISTRIBUTION_CENTER)
SALE_CODES = ("SL", "SL-I")
FREEZE_CATEGORIES = ("electrical", "cooling")
ACTION_RETURN = "Return to vendor"
ACTION_MARKDOWN = "Markdown — price reduction"
ACTION_WRITE_OFF = "Write off"
ACTION_LIQUIDATE = "Liquidate / delist"
CM_TO_INCH = 0.393701
# --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Reorder:
    horizon_days: int = 30
    safety_days: float = 7.0
    default_lead_days: float = 7.0
    min_order_qty: float = 0.01
    critical_days: float = 3.0
    warning_days: float = 7.0
    coverage_days: float = 60.0
    transfer_padding_days: float = 7.0
    chronic_multiplier: float = 1.5
    mismatch_ratio: float = 0.5
    basket_confidence: float = 0.30
    basket_supply_days: float = 14.0
    equal_share: float = 1.0 / 23.0


@dataclass(frozen=True)
class DeadStock:
    lookback_days: int = 365
    default_cost: float = 10.0
    frequent_sales: int = 12
    idle_days: int = 60
    liquidate_urgency: float = 2.0
    markdown_urgency: float = 1.0
    write_off_value: float = 25.0
    fast_units: float = 1.0


@dataclass(frozen=True)
class StockingGap:
    lookback_days: int = 90
    chronic_frequency: int = 10
    chronic_streak: int = 5
    recurring_frequency: int = 5
    trend_up: float = 1.20
    trend_down: float = 0.80
    boost: float = 1.5
    safety: float = 1.2
    cost_per_unit: float = 2.5
