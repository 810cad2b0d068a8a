"""Serving views: documents, indexes, lookups, lists, pages and typed tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subpanel.functions.columns import as_text, nan_to_null
from subpanel.operators.profile import insight_columns, priority, public_service
from subpanel.operators.ranking import rank_descending
from subpanel.schemas import (ARPU_COLUMNS, SERVING_MONTHLY, SERVING_PROFILES, SERVING_RECOMMENDATIONS)

# Lifetimes in days.
DOCUMENT_DAYS, INDEX_DAYS = 7, 30


def _now(now: datetime | str | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(str(now)).cast("timestamp")


def _today(day: date | str | None) -> Column:
    return F.current_date() if day is None else F.lit(str(day)).cast("date")


# --- typed tables ---------------------------------------------------------------------------

def to_serving_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the declared fields; NaN and unreadable values become null, absent columns are null.

    A floating-point value is settled at seven places before it is rounded to a DECIMAL field, so
    that its last bits do not decide a half.
    """
    def field(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        return _typed(df, f).alias(f.name)
    return df.select(*[field(f) for f in schema.fields])


def _typed(df: DataFrame, f: T.StructField) -> Column:
    c = F.col(f.name)
    if isinstance(df.schema[f.name].dataType, (T.DoubleType, T.FloatType)):
        c = nan_to_null(c)
        if isinstance(f.dataType, T.DecimalType):
            c = c.try_cast("decimal(38,7)")
    return c.try_cast(f.dataType)


def rejects(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """For each typed number: values present (not null, not NaN) and how many of them the serving type cannot hold.

    One aggregation over the untyped rows gives one row, which is turned into a row per column.
    """
    numbers = [f for f in schema.fields if f.name in df.columns and isinstance(f.dataType, (T.NumericType,))]
    floating = lambda f: isinstance(df.schema[f.name].dataType, (T.DoubleType, T.FloatType))
    present = lambda f: (nan_to_null(f.name) if floating(f) else F.col(f.name)).isNotNull()
    found = df.agg(*[F.struct(F.count_if(present(f)).alias("n_values"),
                              F.count_if(present(f) & _typed(df, f).isNull()).alias("n_rejected")).alias(f.name) for f in numbers])
    return found.select(F.explode(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.col(f"{f.name}.n_values").alias("n_values"),
                 F.col(f"{f.name}.n_rejected").alias("n_rejected")) for f in numbers])).alias("r")).select("r.*")


def enrich(recs: DataFrame, profile: DataFrame) -> DataFrame:
    """Recommendations with the profile columns they do not have; on overlap the left side wins."""
    extra = [c for c in profile.columns if c == "isdn" or c not in recs.columns]
    return recs.join(profile.select(*extra), "isdn", "left")


def publish(recs: DataFrame) -> DataFrame:
    """Public service code in `service_type`, the internal one kept in `service_code`."""
    return recs.withColumn("service_code", F.col("service_type")).withColumn("service_type", public_service("service_type"))


def recommendation_values(recs: DataFrame, profile: DataFrame, day: date | str | None = None,
                          now: datetime | str | None = None) -> DataFrame:
    """Columns of the serving table as computed, before they get their declared types."""
    return enrich(publish(recs), profile).withColumns({
        "priority_score": priority(nulls_as_zero=False), "topup_frequency": F.col("topup_count_last_1m"),
        "recommendation_date": _today(day), "created_at": _now(now), "updated_at": _now(now)})


def serving_recommendations(recs: DataFrame, profile: DataFrame, day: date | str | None = None,
                            now: datetime | str | None = None) -> DataFrame:
    return to_serving_schema(recommendation_values(recs, profile, day, now), SERVING_RECOMMENDATIONS)


def serving_profiles(profile: DataFrame, day: date | str | None = None, now: datetime | str | None = None) -> DataFrame:
    """Typed profiles with reason text and strengths."""
    texts = insight_columns()
    df = profile.withColumns({
        "classification_reason": texts["reason_text"], "strengths": F.to_json(texts["strengths"]),
        "topup_frequency": F.col("topup_count_last_1m"), "revenue_potential": F.col("revenue_per_advance"),
        "profile_date": _today(day), "created_at": _now(now), "updated_at": _now(now)})
    return to_serving_schema(df, SERVING_PROFILES)


def serving_monthly(monthly: DataFrame, now: datetime | str | None = None) -> DataFrame:
    return to_serving_schema(monthly.withColumn("created_at", _now(now)), SERVING_MONTHLY)


# --- documents ------------------------------------------------------------------------------

def compact_map(m: Column) -> Column:
    """Drop null, empty and 'nan' entries."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != "") & (v != "nan"))


# Field names of a recommendation document.
DOCUMENT_FIELDS = ["isdn", "subscriber_type", "service_type", "advance_amount", "revenue_per_advance",
                   "cluster_group", "bad_debt_risk", "arpu_avg_6m", "arpu_growth_rate", "arpu_trend",
                   "customer_value_score", "advance_readiness_score", "priority_score", "user_type",
                   "topup_frequency_class"]


def _document(key: Column, fields: dict[str, Column], now: Column, days: int) -> list[Column]:
    entries = [x for name, c in fields.items() for x in (F.lit(name), as_text(c))]
    return [key.alias("key"), compact_map(F.create_map(*entries)).alias("fields"),
            (now + F.make_dt_interval(F.lit(days))).alias("expires_at")]


def rec_documents(recs: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """One document per recommendation: up to 16 text fields, expiring after seven days."""
    at = _now(now)
    fields = {n: F.col(n) for n in DOCUMENT_FIELDS} | {"updated_at": at}
    return recs.select(*_document(F.concat(F.lit("rec:"), "isdn"), fields, at, DOCUMENT_DAYS))


def arpu_history(monthly: DataFrame) -> DataFrame:
    """Month-ordered array of the measures per subscriber; a subscriber has one entry per month."""
    entry = F.struct(F.col("data_month").alias("month"), *ARPU_COLUMNS)
    return monthly.groupBy("isdn").agg(F.sort_array(F.collect_list(entry)).alias("monthly_arpu"))


def profile_with_history(profile: DataFrame, monthly: DataFrame) -> DataFrame:
    return profile.join(arpu_history(monthly), "isdn", "left")


def profile_documents(profile: DataFrame, monthly: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """One document per profile: six JSON sections, the monthly array and the time of writing."""
    c = F.col

    def number(name: str) -> Column:
        # A zero counts as missing in these sections.
        return F.when(c(name) != 0, c(name).cast("double"))

    sections = {
        "basic": F.struct(c("isdn"), c("subscriber_type").alias("type"), c("service_type").alias("service"),
                          c("advance_amount").alias("advance"), c("revenue_per_advance").alias("revenue")),
        "arpu_stats": F.struct(*[number(f"arpu_{n}_6m").alias(n) for n in ("avg", "std", "min", "max")],
                               number("arpu_growth_rate").alias("growth_rate"), c("arpu_trend").alias("trend")),
        "revenue_breakdown": F.struct(*[number(f"revenue_{n}_pct").alias(f"{n}_pct") for n in ("call", "sms", "data")],
                                      c("user_type")),
        "topup_behavior": F.struct(number("topup_count_last_1m").alias("frequency"),
                                   number("topup_avg_amount").alias("avg_amount"),
                                   number("topup_advance_ratio").alias("ratio"),
                                   c("topup_frequency_class").alias("frequency_class")),
        "risk_assessment": F.struct(c("bad_debt_risk").alias("level"), number("customer_value_score").alias("score"),
                                    F.array().cast("array<string>").alias("factors")),
        "kpi_scores": F.struct(number("customer_value_score").alias("customer_value"),
                               number("advance_readiness_score").alias("advance_readiness"),
                               number("revenue_per_advance").alias("revenue_potential")),
    }
    keep_nulls = {"ignoreNullFields": "false"}
    at = _now(now)
    fields = {n: F.to_json(s, keep_nulls) for n, s in sections.items()}
    fields["monthly_arpu"] = F.coalesce(F.to_json("monthly_arpu", keep_nulls), F.lit("[]"))
    fields["updated_at"] = at
    df = profile_with_history(profile, monthly)
    return df.select(*_document(F.concat(F.lit("profile:"), "isdn"), fields, at, DOCUMENT_DAYS))


def read_document(docs: DataFrame, keys: Sequence[str] | DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Documents of the given keys, whole or with some fields only. Keys are a list or a DataFrame with column `key`."""
    if isinstance(keys, DataFrame):
        out = docs.join(keys.select("key"), "key", "left_semi")
    else:
        out = docs.filter(F.col("key").isin(list(keys)))
    if fields is None:
        return out
    return out.withColumn("fields", F.map_filter("fields", lambda k, v: k.isin(list(fields))))


def document_fields(docs: DataFrame) -> DataFrame:
    """One row per key and field."""
    return docs.select("key", F.explode("fields").alias("field", "value"), "expires_at")


def live(docs: DataFrame, now: datetime | str | None = None) -> DataFrame:
    return docs.filter(F.col("expires_at") > _now(now))


# --- indexes --------------------------------------------------------------------------------

def _expires(now, days: int) -> Column:
    return (_now(now) + F.make_dt_interval(F.lit(days))).alias("expires_at")


def service_index(recs: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """Members of each service by priority, highest first, rank from 0, ids descending on ties."""
    rows = recs.filter(F.col("service_type").isNotNull()).select(
        "service_type", "isdn", F.coalesce(F.col("priority_score").cast("double"), F.lit(0.0)).alias("score"))
    return rank_descending(rows, "service_type", "score", "isdn").select(
        "service_type", "isdn", "score", "rank", _expires(now, INDEX_DAYS))


def risk_index(recs: DataFrame, now: datetime | str | None = None) -> DataFrame:
    return (recs.filter(F.col("bad_debt_risk").isNotNull())
            .select("bad_debt_risk", "isdn", _expires(now, INDEX_DAYS)).distinct())


def cluster_index(recs: DataFrame, now: datetime | str | None = None) -> DataFrame:
    return (recs.filter(F.col("cluster_group").isNotNull())
            .select("cluster_group", "isdn", _expires(now, INDEX_DAYS)).distinct())


def is_member(ids: DataFrame, index: DataFrame, column: str, value) -> DataFrame:
    """Whether each id belongs to one set of an index."""
    members = index.filter(F.col(column) == value).select("isdn", F.lit(True).alias("is_member"))
    return (ids.select("isdn").join(members, "isdn", "left")
            .withColumn("is_member", F.coalesce(F.col("is_member"), F.lit(False))))


def cardinality(index: DataFrame, column: str) -> DataFrame:
    return index.groupBy(column).agg(F.count(F.lit(1)).alias("members"))


def sample_risk(recs: DataFrame, risk: str, n: int = 100, seed: int = 42) -> DataFrame:
    """Repeatable random sample of a risk set, without replacement: the smallest digests of id and seed."""
    return (recs.filter(F.col("bad_debt_risk") == risk).select("bad_debt_risk", "isdn")
            .orderBy(F.md5(F.concat("isdn", F.lit(str(seed)))), "isdn").limit(n))


# --- lists ----------------------------------------------------------------------------------

def by_priority(*extra: str) -> list[Column]:
    return [F.desc_nulls_last("priority_score"), F.asc("isdn"), *[F.asc(c) for c in extra]]


def top_by_priority(recs: DataFrame, service: str, k: int = 100) -> DataFrame:
    return recs.filter(F.col("service_type") == service).orderBy(*by_priority()).limit(k)


def campaign_list(recs: DataFrame, service: str, k: int = 1000, risk: str = "LOW") -> DataFrame:
    """The top k of a service first, of those only one risk level: fewer than k rows may remain."""
    return top_by_priority(recs, service, k).filter(F.col("bad_debt_risk") == risk)


def by_score_range(recs: DataFrame, service: str, low: float = 70, high: float = 100, n: int = 100) -> DataFrame:
    return (recs.filter((F.col("service_type") == service) & F.col("priority_score").between(low, high))
            .orderBy(*by_priority()).limit(n))


def high_value_low_risk(recs: DataFrame, n: int = 1000, min_value: float = 70, min_readiness: float = 80) -> DataFrame:
    return (recs.filter((F.col("bad_debt_risk") == "LOW") & (F.col("customer_value_score") >= min_value)
                        & (F.col("advance_readiness_score") >= min_readiness))
            .orderBy(*by_priority()).limit(n))


def search_subscribers(recs: DataFrame, search: str | None = None, service: str | None = None,
                       risk: str | None = None, regex: bool = False) -> DataFrame:
    """Case-insensitive id search with two optional filters; blank and 'all' mean no filter.

    The text is literal, since ids contain characters such as `+`; `regex=True` makes it a pattern.
    """
    out = recs
    if search and search.strip():
        text = search.strip()
        out = out.filter(F.col("isdn").rlike(f"(?i){text}") if regex else F.contains(F.lower("isdn"), F.lit(text.lower())))
    if service and service != "all":
        out = out.filter(F.col("service_type") == service)
    if risk and risk != "all":
        out = out.filter(F.col("bad_debt_risk") == risk)
    return out


def page(df: DataFrame, limit: int = 50, offset: int = 0, after: str | None = None) -> DataFrame:
    """One page ordered by id, each row with the total, whether more follow, and the page count.

    For deep pages pass `after`, the last id seen, instead of an offset: it becomes a filter on the scan.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df if after is None else df.filter(F.col("isdn") > after)
    remaining = total if after is None else rows.agg(F.count(F.lit(1))).scalar()
    return (rows.orderBy("isdn").offset(offset).limit(limit)
            .withColumns({"total": total, "has_more": remaining > offset + limit, "pages": F.ceil(total / limit)}))


def bulk_lookup(recs: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Recommendations of many ids; absent ids are skipped. The size of the list decides the join."""
    if not isinstance(ids, DataFrame):
        ids = recs.sparkSession.createDataFrame([(i,) for i in ids], "isdn string")
    return recs.join(ids.select("isdn"), "isdn", "left_semi")


def apply_campaign_results(recs: DataFrame, results: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """Set `updated_at` on the rows whose offer was accepted."""
    accepted = results.filter("accepted").select("isdn", F.lit(True).alias("_hit")).distinct()
    return (recs.join(accepted, "isdn", "left")
            .withColumn("updated_at", F.when(F.col("_hit"), _now(now)).otherwise(F.col("updated_at")))
            .drop("_hit"))


def history(monthly: DataFrame, isdn: str) -> DataFrame:
    return monthly.filter(F.col("isdn") == isdn).select("data_month", *ARPU_COLUMNS).orderBy("data_month")


def arpu_chart(monthly: DataFrame) -> DataFrame:
    """Bar heights in percent of the subscriber's best month, at least 5, with month labels."""
    best = F.max("arpu_total").over(Window.partitionBy("isdn"))
    height = F.when(best > 0, F.try_divide(F.col("arpu_total"), best) * 100).otherwise(0.0)
    return monthly.select("isdn", "data_month", F.concat(F.lit("T"), F.substring("data_month", 5, 2)).alias("label"),
                          "arpu_total", F.greatest(height, F.lit(5.0)).alias("height"))
