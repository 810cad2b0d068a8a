"""Column lists, labels and declared schemas."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["isdn", "data_month"]

# Months of the panel and the reference date of the tenure feature.
MONTHS = ["202503", "202504", "202505", "202506", "202507", "202508"]
LATEST_MONTH = "202508"
TENURE_REFERENCE_DATE = "2025-08-01"

# Services whose transaction amounts arrive ten times too large.
TENFOLD_SERVICES = ["EasyCredit", "ungdata247"]

# Internal service code -> public service code.
PUBLIC_SERVICE = {"EasyCredit": "Fee", "MBFG": "Free", "ungsanluong": "Quota"}

# Domains checked on the serving tables.
SUBSCRIBER_TYPES = ["PRE", "POS"]
SERVICE_CODES = ["Fee", "Free", "Quota"]
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH"]

# Columns read from each extract; every one is text in the files.
SOURCE_COLUMNS = {
    "N10": ["isdn", "subscriber_type", "subscriber_status", "status_detail", "activation_date", "expire_date"],
    "N1": ["isdn", "arpu_call", "arpu_sms", "arpu_data", "arpu_total"],
    "N2": ["isdn", "package_code", "package_price", "package_cycle", "package_renewal_datetime"],
    "N3": ["isdn"],
    "N4": ["isdn", "amount", "source", "advance_service_type"],
    "N5": ["isdn", "topup_amount", "topup_channel"],
}
INVENTORY_SOURCES = ["N1", "N2", "N3", "N4", "N5", "N6", "N7", "N8", "N10"]

# Column names and order of the master table.
BASE_COLUMNS = ["isdn", "subscriber_type", "subscriber_status", "status_detail",
                "activation_date", "expire_date", "data_month"]
ARPU_COLUMNS = ["arpu_call", "arpu_sms", "arpu_data", "arpu_total"]
ADVANCE_COLUMNS = ["advance_count", "total_advance_amount", "avg_advance_amount", "max_advance_amount",
                   "total_repayment_amount", "most_used_advance_service", "avg_repayment_rate",
                   "outstanding_debt", "has_advance_in_month"]
TOPUP_COLUMNS = ["topup_count", "total_topup_amount", "avg_topup_amount", "std_topup_amount",
                 "max_topup_amount", "most_used_topup_channel"]
PACKAGE_COLUMNS = ["num_packages", "total_package_value", "avg_package_price", "max_package_price",
                   "avg_package_cycle", "num_active_packages", "num_renewed_packages"]
MASTER_COLUMNS = (BASE_COLUMNS + ARPU_COLUMNS + ADVANCE_COLUMNS + TOPUP_COLUMNS + PACKAGE_COLUMNS
                  + ["n3_record_count"])

MASTER_STRING_FILL = ["most_used_advance_service", "most_used_topup_channel"]
MASTER_BOOL_FILL = ["has_advance_in_month"]
MASTER_ZERO_FILL = [c for c in MASTER_COLUMNS
                    if c not in BASE_COLUMNS + MASTER_STRING_FILL + MASTER_BOOL_FILL]

# Columns of the feature table that identify a row or describe it in words; the rest are features.
NON_FEATURE_COLUMNS = BASE_COLUMNS + MASTER_STRING_FILL + MASTER_BOOL_FILL

# Column names and order of offers and profiles.
RECOMMENDATION_COLUMNS = [
    "isdn", "subscriber_type", "service_type", "advance_amount", "usage_time_hours", "revenue_per_advance",
    "arpu", "arpu_call", "arpu_sms", "arpu_data", "voice_sms_pct",
    "topup_count_last_1m", "topup_amount_last_1m", "avg_topup_amount", "classification_reason"]

PROFILE_COLUMNS = [
    "isdn", "subscriber_type", "service_type", "advance_amount", "revenue_per_advance",
    "arpu", "arpu_call", "arpu_sms", "arpu_data",
    "arpu_avg_6m", "arpu_std_6m", "arpu_min_6m", "arpu_max_6m", "arpu_growth_rate", "arpu_trend",
    "revenue_call_pct", "revenue_sms_pct", "revenue_data_pct", "voice_sms_pct", "user_type",
    "topup_count_last_1m", "topup_amount_last_1m", "avg_topup_amount", "topup_frequency",
    "topup_advance_ratio", "bad_debt_risk", "risk_score",
    "customer_value_score", "advance_readiness_score", "classification_reason", "months_count"]

# Columns the sinks expect beside the 31 of the profile.
PROFILE_EXTRA_COLUMNS = ["arpu_first_month", "arpu_last_month", "topup_frequency_class",
                         "topup_avg_amount", "topup_min_amount", "topup_max_amount", "cluster_group"]


def _type(name: str) -> T.DataType:
    if name.startswith("decimal"):
        precision, scale = name[len("decimal("):-1].split(",")
        return T.DecimalType(int(precision), int(scale))
    return {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "date": T.DateType(),
            "timestamp": T.TimestampType()}[name]


def _fields(*specs: tuple[str, str, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, _type(kind), nullable) for name, kind, nullable in specs])


# Declared columns of the serving tables; their types hold any count or amount that is computed.
SERVING_RECOMMENDATIONS = _fields(
    ("isdn", "string", False),
    ("subscriber_type", "string", False),
    ("service_type", "string", False),
    ("advance_amount", "decimal(22,2)", False),
    ("revenue_per_advance", "decimal(22,2)", False),
    ("cluster_group", "int", True),
    ("bad_debt_risk", "string", False),
    ("arpu_avg_6m", "decimal(22,2)", True),
    ("arpu_std_6m", "decimal(22,2)", True),
    ("arpu_min_6m", "decimal(22,2)", True),
    ("arpu_max_6m", "decimal(22,2)", True),
    ("arpu_growth_rate", "decimal(22,2)", True),
    ("arpu_trend", "string", True),
    ("revenue_call_pct", "decimal(22,2)", True),
    ("revenue_sms_pct", "decimal(22,2)", True),
    ("revenue_data_pct", "decimal(22,2)", True),
    ("user_type", "string", True),
    ("topup_frequency", "decimal(22,2)", True),
    ("topup_avg_amount", "decimal(22,2)", True),
    ("topup_advance_ratio", "decimal(24,4)", True),
    ("topup_frequency_class", "string", True),
    ("customer_value_score", "decimal(22,2)", True),
    ("advance_readiness_score", "decimal(22,2)", True),
    ("priority_score", "decimal(22,2)", True),
    ("recommendation_date", "date", False),
    ("created_at", "timestamp", True),
    ("updated_at", "timestamp", True),
)

SERVING_PROFILES = _fields(
    ("isdn", "string", False),
    ("subscriber_type", "string", False),
    ("service_type", "string", True),
    ("advance_amount", "decimal(22,2)", True),
    ("revenue_per_advance", "decimal(22,2)", True),
    ("arpu_avg_6m", "decimal(22,2)", True),
    ("arpu_std_6m", "decimal(22,2)", True),
    ("arpu_min_6m", "decimal(22,2)", True),
    ("arpu_max_6m", "decimal(22,2)", True),
    ("arpu_first_month", "decimal(22,2)", True),
    ("arpu_last_month", "decimal(22,2)", True),
    ("arpu_growth_rate", "decimal(22,2)", True),
    ("arpu_trend", "string", True),
    ("revenue_call_pct", "decimal(22,2)", True),
    ("revenue_sms_pct", "decimal(22,2)", True),
    ("revenue_data_pct", "decimal(22,2)", True),
    ("user_type", "string", True),
    ("topup_frequency", "decimal(22,2)", True),
    ("topup_avg_amount", "decimal(22,2)", True),
    ("topup_min_amount", "decimal(22,2)", True),
    ("topup_max_amount", "decimal(22,2)", True),
    ("topup_advance_ratio", "decimal(24,4)", True),
    ("topup_frequency_class", "string", True),
    ("bad_debt_risk", "string", True),
    ("risk_score", "decimal(22,2)", True),
    ("customer_value_score", "decimal(22,2)", True),
    ("advance_readiness_score", "decimal(22,2)", True),
    ("revenue_potential", "decimal(22,2)", True),
    ("cluster_group", "int", True),
    ("classification_reason", "string", True),
    ("strengths", "string", True),
    ("profile_date", "date", False),
    ("created_at", "timestamp", True),
    ("updated_at", "timestamp", True),
)

SERVING_MONTHLY = _fields(
    ("isdn", "string", False),
    ("data_month", "string", False),
    ("arpu_call", "decimal(22,2)", True),
    ("arpu_sms", "decimal(22,2)", True),
    ("arpu_data", "decimal(22,2)", True),
    ("arpu_total", "decimal(22,2)", True),
    ("created_at", "timestamp", True),
)

SERVING_STATS = _fields(
    ("dimension_type", "string", False),
    ("dimension_value", "string", False),
    ("total_count", "bigint", True),
    ("total_advance_amount", "decimal(30,2)", True),
    ("total_revenue_potential", "decimal(30,2)", True),
    ("avg_customer_value_score", "decimal(22,2)", True),
    ("avg_advance_readiness_score", "decimal(22,2)", True),
    ("stats_date", "date", False),
)
