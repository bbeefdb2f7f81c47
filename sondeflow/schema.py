"""Names, orders and limits of the water-quality readings table.

Everything here is a fixed value: header names, measure names, category orders
and the physical limits that the checks and reports use by default.
"""

from __future__ import annotations

from dataclasses import dataclass

# Raw CSV header -> clean column name.
RAW_TO_CLEAN = {
    "Timestamp": "timestamp",
    "Record number": "record_number",
    "Average Water Speed": "water_speed",
    "Average Water Direction": "water_direction",
    "Chlorophyll": "chlorophyll",
    "Chlorophyll [quality]": "chlorophyll_quality",
    "Temperature": "temperature",
    "Temperature [quality]": "temperature_quality",
    "Dissolved Oxygen": "dissolved_oxygen",
    "Dissolved Oxygen [quality]": "dissolved_oxygen_quality",
    "Dissolved Oxygen (%Saturation)": "dissolved_oxygen_pct_sat",
    "Dissolved Oxygen (%Saturation) [quality]": "dissolved_oxygen_pct_sat_quality",
    "pH": "ph",
    "pH [quality]": "ph_quality",
    "Salinity": "salinity",
    "Salinity [quality]": "salinity_quality",
    "Specific Conductance": "specific_conductance",
    "Specific Conductance [quality]": "specific_conductance_quality",
    "Turbidity": "turbidity",
    "Turbidity [quality]": "turbidity_quality",
}

# The measured parameters, in table order.
MEASURES = [
    "water_speed", "water_direction", "chlorophyll", "temperature",
    "dissolved_oxygen", "dissolved_oxygen_pct_sat", "ph",
    "salinity", "specific_conductance", "turbidity",
]

QUALITY_FLAGS = [name for name in RAW_TO_CLEAN.values() if name.endswith("_quality")]

# Category orders.
SEASONS = ["Summer", "Autumn", "Winter", "Spring"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Text that a CSV reader of the raw file takes for "missing".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Upper bound (exclusive) and label of each condition band.
# The last label takes everything at or above the last bound.
OXYGEN_BANDS = [
    (4.0, "Low (< 4 mg/L)"),
    (6.0, "Moderate (4-6 mg/L)"),
    (8.0, "Good (6-8 mg/L)"),
    (None, "High (>= 8 mg/L)"),
]
SALINITY_BANDS = [
    (0.5, "Freshwater (< 0.5)"),
    (30.0, "Brackish (0.5-30)"),
    (None, "Saline (>= 30)"),
]

# Known event windows (start, end, label), ends at midnight.
EVENT_WINDOWS = [
    ("2024-05-17 00:00:00", "2024-05-23 00:00:00", "Cross-validated anomaly"),
    ("2024-04-08 00:00:00", "2024-04-11 00:00:00", "Smaller anomaly"),
]


@dataclass(frozen=True)
class RangeRule:
    """A row fails when any of ``columns`` lies below ``low`` or above ``high``."""

    check: str
    columns: tuple[str, ...]
    low: float | None = None
    high: float | None = None


# Plausible physical limits.
PHYSICAL_RULES = [
    RangeRule("invalid_ph", ("ph",), low=0, high=14),
    RangeRule("invalid_water_direction", ("water_direction",), low=0, high=360),
    RangeRule("implausible_do_saturation", ("dissolved_oxygen_pct_sat",), high=200),
    RangeRule(
        "negative_values",
        ("water_speed", "chlorophyll", "dissolved_oxygen", "salinity",
         "specific_conductance", "turbidity"),
        low=0,
    ),
]
