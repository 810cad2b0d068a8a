"""Row-store style merges as table rewrites: plain Spark tables have no MERGE."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], update_columns: Sequence[str],
           now: datetime | str | None = None) -> DataFrame:
    """Rows of `base` with the listed columns replaced where `new` has the key, plus the new rows.

    Other columns of an existing row stay as they are, and its `updated_at` becomes `now`. Keys
    must be unique in `new`; `quality.check_unique` tells.
    """
    keys = list(keys)
    at = F.current_timestamp() if now is None else F.lit(str(now)).cast("timestamp")
    b = base.withColumn("_in_base", F.lit(True)).alias("b")
    n = new.withColumn("_in_new", F.lit(True)).alias("n")
    joined = b.join(n, keys, "full_outer")
    exists, arrives = F.col("_in_base").isNotNull(), F.col("_in_new").isNotNull()

    def column(name: str):
        if name in keys:
            return F.col(name)
        old = F.col(f"b.{name}")
        fresh = F.col(f"n.{name}") if name in new.columns else F.lit(None)
        if name == "updated_at":
            return F.when(exists & arrives, at).otherwise(F.when(exists, old).otherwise(fresh)).alias(name)
        if name in update_columns:
            return F.when(arrives, fresh).otherwise(old).alias(name)
        return F.when(exists, old).otherwise(fresh).alias(name)

    return joined.select(*[column(c) for c in base.columns])


RECOMMENDATION_UPDATES = ["service_type", "advance_amount", "revenue_per_advance", "customer_value_score",
                          "advance_readiness_score", "priority_score"]
PROFILE_UPDATES = ["customer_value_score", "advance_readiness_score", "revenue_potential"]


def insert_new(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add only rows whose key is absent."""
    return base.unionByName(new.join(base.select(*keys), list(keys), "left_anti").select(*base.columns))
