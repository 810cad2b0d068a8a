"""The subscriber-month table: subscriber rows left-joined with the reduced extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subpanel.operators import monthly
from subpanel.schemas import KEYS, MASTER_BOOL_FILL, MASTER_COLUMNS, MASTER_STRING_FILL, MASTER_ZERO_FILL


def fill_master(df: DataFrame) -> DataFrame:
    """Missing numbers are 0, missing flags false, missing labels 'Unknown'; absent columns stay absent."""
    present = set(df.columns)
    out = df.fillna(0, subset=[c for c in MASTER_ZERO_FILL if c in present])
    out = out.fillna(False, subset=[c for c in MASTER_BOOL_FILL if c in present])
    return out.fillna("Unknown", subset=[c for c in MASTER_STRING_FILL if c in present])


def build_master(n10: DataFrame, n1: DataFrame | None = None, n4: DataFrame | None = None,
                 n5: DataFrame | None = None, n2: DataFrame | None = None, n3: DataFrame | None = None,
                 reduce: bool = True) -> DataFrame:
    """N10 left-joined with N1, N4, N5, N2 and N3 on (isdn, data_month); a missing extract adds no columns.

    `reduce=False` keeps repeated subscriber and ARPU rows of a key, which multiplies rows.
    """
    base = monthly.subscriber_months(n10) if reduce else monthly.parse_subscribers(n10)
    arpu = None
    if n1 is not None:
        arpu = monthly.agg_arpu(n1) if reduce else monthly.arpu_rows(n1).select(
            *KEYS, *[F.col(c).cast("double").alias(c) for c in ("arpu_call", "arpu_sms", "arpu_data", "arpu_total")])
    sides = [arpu,
             None if n4 is None else monthly.agg_advance(n4),
             None if n5 is None else monthly.agg_topup(n5),
             None if n2 is None else monthly.agg_package(n2),
             None if n3 is None else monthly.agg_usage(n3)]
    for side in sides:
        if side is not None:
            base = base.join(side, KEYS, "left")
    return fill_master(base.select(*[c for c in MASTER_COLUMNS if c in base.columns]))


def master_of(extracts: dict[str, DataFrame], reduce: bool = True) -> DataFrame:
    return build_master(extracts["N10"], extracts.get("N1"), extracts.get("N4"), extracts.get("N5"),
                        extracts.get("N2"), extracts.get("N3"), reduce=reduce)


def dedup_months(master: DataFrame) -> DataFrame:
    """One row per key with five columns, for totals over a table that may repeat keys.

    The four measures are equal inside a key; the type is its smallest value.
    """
    return (monthly.with_keys(master).groupBy(*KEYS)
            .agg(F.min("subscriber_type").alias("subscriber_type"),
                 F.max("has_advance_in_month").alias("has_advance_in_month"),
                 F.max("topup_count").alias("topup_count"),
                 F.max("total_advance_amount").alias("total_advance_amount"),
                 F.max("total_topup_amount").alias("total_topup_amount")))


def snapshot(df: DataFrame, month: str = "latest") -> DataFrame:
    """Rows of one month; "latest" takes the largest month of the table as a scalar subquery."""
    if month != "latest":
        return df.filter(F.col("data_month") == month)
    return df.filter(F.col("data_month") == df.agg(F.max("data_month")).scalar())


def first_per(df: DataFrame, key: str, order: list) -> DataFrame:
    """First row of each key in a total order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def latest_subscribers(df: DataFrame, month: str = "latest") -> DataFrame:
    """One row per subscriber of one month."""
    return first_per(snapshot(df, month), "isdn", [F.desc_nulls_last("activation_date"),
                                                   "subscriber_type", "subscriber_status"])

