"""Each extract reduced to one row per (isdn, data_month).

All reductions aggregate map-side before the shuffle, so a key that owns a large share of the raw
rows arrives as one row per task. Each result is hash-partitioned by the key, and the join chain in
`master` reuses that partitioning.

Extracts with a most frequent code are reduced twice: raw rows by key and code, with sums, counts and
maxima in fixed-width buffers that a hash aggregate updates in place, then the few codes of a key to
one row. The second step carries the first step's sums along, so raw rows are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subpanel.functions.columns import (MOMENTS, MONEY, deviation, merged_moments, moments, money0, most_frequent,
                                        safe_ratio, to_date_dmy)
from subpanel.schemas import ARPU_COLUMNS, KEYS, TENFOLD_SERVICES


def with_keys(df: DataFrame) -> DataFrame:
    """Rows without a subscriber or month belong to no group."""
    return df.filter(F.col("isdn").isNotNull() & F.col("data_month").isNotNull())


def parse_subscribers(n10: DataFrame) -> DataFrame:
    return with_keys(n10).withColumns({c: to_date_dmy(c) for c in ("activation_date", "expire_date")})


def subscriber_months(n10: DataFrame) -> DataFrame:
    """One row per key: the latest activation, then the latest expiry, then a fixed order.

    The `= 1` filter on the row number lets Spark keep only the first row of each key map-side.
    """
    order = Window.partitionBy(*KEYS).orderBy(
        F.desc_nulls_last("activation_date"), F.desc_nulls_last("expire_date"),
        "subscriber_type", "subscriber_status", "status_detail")
    return (parse_subscribers(n10).withColumn("_rn", F.row_number().over(order))
            .filter(F.col("_rn") == 1).drop("_rn"))


def split_advance(n4: DataFrame) -> DataFrame:
    """Signed transactions: `ut` rows are advances, `hu` rows are repayments."""
    amount, zero = money0("amount"), F.lit(0).cast(MONEY)
    return n4.withColumns({
        "advance_amount": F.when(F.col("source") == "ut", amount).otherwise(zero),
        "repayment_amount": F.when(F.col("source") == "hu", amount).otherwise(zero)})


def correct_units(df: DataFrame, services: Sequence[str] = tuple(TENFOLD_SERVICES), divisor: int = 10,
                  columns: Sequence[str] = ("advance_amount", "repayment_amount")) -> DataFrame:
    """Per-record unit correction of the listed services, before any aggregation."""
    return df.withColumns({
        c: F.when(F.col("advance_service_type").isin(*services), (F.col(c) / divisor).cast(MONEY)).otherwise(F.col(c))
        for c in columns})


def agg_advance(n4: DataFrame) -> DataFrame:
    total, repaid = F.col("total_advance_amount"), F.col("total_repayment_amount")
    by_code = (correct_units(split_advance(with_keys(n4))).groupBy(*KEYS, "advance_service_type")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("advance_amount").alias("advanced"),
                    F.max("advance_amount").alias("largest"), F.sum("repayment_amount").alias("repaid")))
    return (by_code.groupBy(*KEYS)
            .agg(F.sum("n").alias("advance_count"),
                 F.sum("advanced").cast("double").alias("total_advance_amount"),
                 F.max("largest").cast("double").alias("max_advance_amount"),
                 F.sum("repaid").cast("double").alias("total_repayment_amount"),
                 most_frequent("advance_service_type", "n").alias("most_used_advance_service"))
            .withColumns({
                "avg_advance_amount": total / F.col("advance_count"),
                "avg_repayment_rate": safe_ratio(repaid, total),
                "outstanding_debt": F.greatest(total - repaid, F.lit(0.0)),
                "has_advance_in_month": F.col("advance_count") > 0}))


def agg_topup(n5: DataFrame) -> DataFrame:
    by_code = (with_keys(n5).withColumn("topup_amount", money0("topup_amount")).groupBy(*KEYS, "topup_channel")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("topup_amount").alias("amount"),
                    F.max("topup_amount").alias("largest"), *moments("topup_amount")))
    return (by_code.groupBy(*KEYS)
            .agg(F.sum("n").alias("topup_count"), F.sum("amount").cast("double").alias("total_topup_amount"),
                 F.max("largest").cast("double").alias("max_topup_amount"),
                 *merged_moments(),
                 most_frequent("topup_channel", "n").alias("most_used_topup_channel"))
            .withColumn("std_topup_amount", deviation("topup_count"))
            .withColumn("avg_topup_amount", F.col("total_topup_amount") / F.col("topup_count"))
            .drop(*MOMENTS))


def agg_package(n2: DataFrame) -> DataFrame:
    rows = with_keys(n2).withColumns({
        "package_price": money0("package_price"), "package_cycle": money0("package_cycle"),
        "is_active": F.lit(1), "is_renewed": F.col("package_renewal_datetime").isNotNull().cast("int")})
    return (rows.groupBy(*KEYS)
            .agg(F.count("package_code").alias("num_packages"),
                 F.sum("package_price").cast("double").alias("total_package_value"),
                 F.max("package_price").cast("double").alias("max_package_price"),
                 F.sum("package_cycle").cast("double").alias("_cycles"),
                 F.sum("is_active").alias("num_active_packages"),
                 F.sum("is_renewed").alias("num_renewed_packages"))
            .withColumns({"avg_package_price": F.col("total_package_value") / F.col("num_active_packages"),
                          "avg_package_cycle": F.col("_cycles") / F.col("num_active_packages")})
            .drop("_cycles"))


def agg_usage(n3: DataFrame) -> DataFrame:
    return with_keys(n3).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n3_record_count"))


def arpu_rows(n1: DataFrame) -> DataFrame:
    return with_keys(n1).select(*KEYS, *[money0(c).alias(c) for c in ARPU_COLUMNS])


def agg_arpu(n1: DataFrame) -> DataFrame:
    """Mean of the package rows of a month."""
    n = F.count(F.lit(1))
    return arpu_rows(n1).groupBy(*KEYS).agg(*[(F.sum(c).cast("double") / n).alias(c) for c in ARPU_COLUMNS])
