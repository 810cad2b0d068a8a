"""Data-quality checks. Each returns rows (check_name, violations) for one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subpanel.functions.columns import MONEY, is_true, lost_by_cast


def _count_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """All row-level checks of a table in one scan."""
    wide = df.agg(*[F.count_if(is_true(c)).alias(n) for n, c in checks.items()])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("violations")) for n in checks])).alias("x")).select("x.*")


def check_rows(df: DataFrame, table: str, domains: Mapping[str, Sequence[str]] | None = None,
               not_null: Sequence[str] = ()) -> DataFrame:
    """Domain and NOT NULL checks together, in one scan."""
    checks = {f"{table}.{c} in domain": ~F.col(c).isin(list(v)) for c, v in (domains or {}).items()}
    checks |= {f"{table}.{c} not null": F.col(c).isNull() for c in not_null}
    return _count_checks(df, checks)


def check_domain(df: DataFrame, table: str, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    return check_rows(df, table, domains=domains)


def check_not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    return check_rows(df, table, not_null=columns)


def check_unique(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Number of keys that occur more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(f"{table}.{'+'.join(keys)} unique").alias("check_name"), "violations")


def check_fk(child: DataFrame, parent: DataFrame, name: str, key: str = "isdn") -> DataFrame:
    """Number of child rows without a parent."""
    return (child.join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
            .select(F.lit(name).alias("check_name"), "violations"))


def lost_numbers(df: DataFrame, table: str, columns: Sequence[str], kind: str = MONEY) -> DataFrame:
    """For each raw number column: values present and how many count as 0, being unreadable or too wide."""
    found = df.agg(*[F.struct(F.count(c).alias("n_values"), F.count_if(lost_by_cast(c, kind)).alias("n_rejected")).alias(c)
                     for c in columns])
    return found.select(F.explode(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"{c}.n_values").alias("n_values"),
                 F.col(f"{c}.n_rejected").alias("n_rejected")) for c in columns])).alias("r")).select("r.*")


def union_checks(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def reconcile(recs: DataFrame, documents: DataFrame, index: DataFrame) -> DataFrame:
    """Recommendations without a document, and per service the gap between index and table size."""
    keys = documents.select(F.substring_index("key", ":", -1).alias("isdn"))
    missing = check_fk(recs.select("isdn"), keys, "recommendation has document")
    table = recs.groupBy("service_type").agg(F.count(F.lit(1)).alias("n"))
    indexed = index.groupBy("service_type").agg(F.count(F.lit(1)).alias("m"))
    sizes = table.join(indexed, "service_type", "full_outer").select(
        F.concat(F.lit("index size "), "service_type").alias("check_name"),
        F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))).alias("violations"))
    return missing.unionByName(sizes)
