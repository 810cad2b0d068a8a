"""Summary tables of the pipeline's stages and of the serving store.

Percent-of-total windows run over already grouped rows, a handful each.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subpanel.functions.columns import exact_avg, exact_sum, half_even, n_rows, number_text, pct, right_closed_bin
from subpanel.functions.quantiles import exact_quantiles
from subpanel.operators.master import dedup_months, snapshot
from subpanel.operators.risk import keep_risk
from subpanel.operators.segment import cluster_stats, segment_stats
from subpanel.schemas import SERVING_STATS

# Edges and labels of the two amount histograms.
AMOUNT_EDGES_6 = [0, 5000, 10000, 15000, 25000, 50000, 100000]
AMOUNT_LABELS_6 = ["<5k", "5k-10k", "10k-15k", "15k-25k", "25k-50k", ">50k"]
AMOUNT_EDGES_5 = [0, 20000, 30000, 40000, 50000, 100000]
AMOUNT_LABELS_5 = ["< 20k", "20-30k", "30-40k", "40-50k", "50k+"]


def pct_of_total(n: str = "count", partition: Sequence[str] = ()) -> Column:
    return pct(n, F.sum(n).over(Window.partitionBy(*partition)))


def mix(df: DataFrame, key: str | Sequence[str], averages: dict[str, str] | None = None,
        sums: dict[str, str] | None = None) -> DataFrame:
    """Count, share, means and totals per key; {output: column}."""
    keys = [key] if isinstance(key, str) else list(key)
    aggs = [exact_avg(c).alias(n) for n, c in (averages or {}).items()]
    aggs += [exact_sum(c).alias(n) for n, c in (sums or {}).items()]
    return df.groupBy(*keys).agg(n_rows().alias("count"), *aggs).withColumn("pct", pct_of_total())


def service_mix(recs: DataFrame) -> DataFrame:
    return mix(recs, "service_type", {"avg_arpu": "arpu", "avg_advance": "advance_amount",
                                      "avg_revenue": "revenue_per_advance", "avg_voice_sms_pct": "voice_sms_pct"})


def _service_count(service: str) -> Column:
    return F.count_if(F.col("service_type") == service)


def rules_summary(recs: DataFrame) -> DataFrame:
    total = F.col("total_subscribers")
    names = {"easycredit": "EasyCredit", "mbfg": "MBFG", "ungsanluong": "ungsanluong"}
    out = recs.agg(n_rows().alias("total_subscribers"),
                   *[_service_count(s).alias(f"{n}_count") for n, s in names.items()],
                   exact_sum("revenue_per_advance").alias("total_revenue_potential"),
                   exact_avg("revenue_per_advance").alias("avg_revenue_per_subscriber"))
    return out.withColumns({f"{n}_pct": pct(f"{n}_count", total) for n in names})


def amount_histogram(df: DataFrame, edges: Sequence[float] = tuple(AMOUNT_EDGES_6),
                     labels: Sequence[str] = tuple(AMOUNT_LABELS_6), column: str = "advance_amount") -> DataFrame:
    """Counts per right-closed bin; the share is of all rows, also those outside the bins."""
    binned = df.groupBy(right_closed_bin(column, edges, labels).alias("bin")).agg(n_rows().alias("count"))
    return binned.withColumn("pct", pct_of_total()).filter(F.col("bin").isNotNull())


def describe_voice(recs: DataFrame) -> DataFrame:
    median = exact_quantiles(recs, {"m": ("voice_sms_pct", 0.5)})["m"]
    return recs.agg(exact_avg("voice_sms_pct").alias("mean_voice_sms_pct"),
                    F.lit(median).cast("double").alias("median_voice_sms_pct"))


def risk_mix(scored: DataFrame) -> DataFrame:
    return mix(scored, "bad_debt_risk", {"avg_topup": "topup_amount_last_1m", "avg_advance": "advance_amount",
                                         "avg_ratio": "topup_advance_ratio"})


def risk_by_service(scored: DataFrame) -> DataFrame:
    return (scored.groupBy("service_type", "bad_debt_risk").agg(n_rows().alias("count"))
            .withColumn("pct_in_service", pct_of_total(partition=["service_type"])))


def final_distribution(scored: DataFrame) -> DataFrame:
    """Per service after the risk filter: count, share, revenue, revenue share, and the pass rate."""
    out = mix(keep_risk(scored), "service_type", {"avg_revenue": "revenue_per_advance"},
              {"total_revenue": "revenue_per_advance"})
    initial = scored.agg(n_rows()).scalar()
    kept = F.sum("count").over(Window.partitionBy())
    return out.withColumns({"revenue_share_pct": pct_of_total("total_revenue"), "pass_rate_pct": pct(kept, initial)})


def risk_summary(scored: DataFrame) -> DataFrame:
    """One row: initial, kept and removed counts, services, revenue and levels of the kept rows."""
    kept = F.col("bad_debt_risk").isin("LOW", "MEDIUM")
    revenue = F.when(kept, F.col("revenue_per_advance"))
    level = lambda x: F.count_if(F.col("bad_debt_risk") == x)
    of = lambda s: F.count_if(kept & (F.col("service_type") == s))
    out = scored.agg(n_rows().alias("total_subscribers_initial"), F.count_if(kept).alias("total_subscribers_filtered"),
                     of("EasyCredit").alias("easycredit_count"), of("MBFG").alias("mbfg_count"),
                     of("ungsanluong").alias("ungsanluong_count"),
                     exact_sum(revenue).alias("total_revenue_potential"),
                     exact_avg(revenue).alias("avg_revenue_per_subscriber"),
                     level("LOW").alias("low_risk_count"), level("MEDIUM").alias("medium_risk_count"))
    return out.withColumns({
        "high_risk_removed": F.col("total_subscribers_initial") - F.col("total_subscribers_filtered"),
        "pass_rate_pct": pct("total_subscribers_filtered", "total_subscribers_initial")})


def advance_source_counts(n4: DataFrame) -> DataFrame:
    """Advance and repayment records, and their subscribers."""
    return n4.agg(F.count_if(F.col("source") == "ut").alias("advance_records"),
                  F.count_if(F.col("source") == "hu").alias("repayment_records"),
                  F.countDistinct("isdn").alias("subscribers"))


# --- stage summaries ------------------------------------------------------------------------

def _nested(df: DataFrame) -> Column:
    """A grouped table as one array; it has a row per group, so it stays small."""
    return df.agg(F.sort_array(F.collect_list(F.struct("*")))).scalar()


def phase1_summary(master: DataFrame) -> DataFrame:
    """One row. Counts of distinct subscribers come from one row per subscriber, so no wide
    distinct set is built."""
    months = dedup_months(master)
    per_id = months.groupBy("isdn").agg(
        F.max(F.coalesce("has_advance_in_month", F.lit(False))).alias("advanced"),
        F.max(F.col("topup_count") > 0).alias("topped_up"),
        F.sum(F.col("total_advance_amount").cast("decimal(28,9)")).alias("advance"),
        F.sum(F.col("total_topup_amount").cast("decimal(28,9)")).alias("topup"))
    rows = master.agg(n_rows()).scalar()
    # At most a few distinct months exist.
    listed = master.agg(F.array_join(F.array_sort(F.collect_set("data_month")), ",")).scalar()
    return per_id.agg(rows.alias("total_records"), n_rows().alias("unique_subscribers"), listed.alias("months"),
                      F.count_if("advanced").alias("advance_users"), F.count_if("topped_up").alias("topup_users"),
                      F.sum("advance").cast("double").alias("total_advance_amount"),
                      F.sum("topup").cast("double").alias("total_topup_amount"))


def monthly_stats(master: DataFrame) -> DataFrame:
    """Subscribers and amounts per month; after de-duplication a month has one row per subscriber."""
    return dedup_months(master).groupBy(F.col("data_month").alias("month")).agg(
        n_rows().alias("unique_subscribers"), exact_sum("total_topup_amount").alias("total_topup"),
        exact_sum("total_advance_amount").alias("total_advance"))


def phase1_document(master: DataFrame) -> DataFrame:
    """Totals with the type and month tables nested."""
    return phase1_summary(master).withColumns({
        "subscriber_type_distribution": _nested(type_distribution(master)),
        "monthly_stats": _nested(monthly_stats(master))})


def type_distribution(master: DataFrame) -> DataFrame:
    return (dedup_months(master).filter(F.col("subscriber_type").isNotNull())
            .groupBy("subscriber_type").agg(n_rows().alias("count")))


# Words that put a column into a feature family.
FEATURE_FAMILIES = {"advance": ["advance"], "topup": ["topup"], "financial": ["balance", "burn", "arpu"]}


def phase2_summary(features: DataFrame) -> DataFrame:
    """One row: feature counts and first names by family, and the latest month's subscribers."""
    names = [c for c in features.columns if c not in ("isdn", "subscriber_type", "subscriber_status", "data_month")]
    family = {f: [c for c in names if any(w in c.lower() for w in words)] for f, words in FEATURE_FAMILIES.items()}
    out = snapshot(features).agg(F.countDistinct("isdn").alias("total_subscribers"))
    return out.withColumns({
        "total_features": F.lit(len(names)),
        **{f"{f}_features": F.lit(len(c)) for f, c in family.items()},
        **{f"{f}_names": F.lit(",".join(c[:10])) for f, c in family.items()}})


def metric_distribution(features: DataFrame,
                        metrics: Sequence[str] = ("financial_stress_score", "usage_intensity")) -> DataFrame:
    """Value counts of the metrics on the latest month, in one pass."""
    present = [m for m in metrics if m in features.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in present])).alias("p")
    return (snapshot(features).select(pairs).filter(F.col("p.value").isNotNull())
            .groupBy("p.metric", "p.value").agg(n_rows().alias("count")))


def phase2_document(features: DataFrame) -> DataFrame:
    """Feature counts with the value counts of the metrics nested."""
    return phase2_summary(features).withColumn("key_metrics_distribution", _nested(metric_distribution(features)))


def phase3a_summary(segments: DataFrame) -> DataFrame:
    return segments.agg(n_rows().alias("total_subscribers"), F.countDistinct("cluster").alias("num_clusters"),
                        F.count_if(F.contains("segment", F.lit("GROUP_2"))).alias("expansion_target"))


def phase3a_document(segments: DataFrame) -> DataFrame:
    """Totals with the segment and cluster tables nested, as one row for the JSON sink."""
    return phase3a_summary(segments).withColumns({
        "segment_distribution": _nested(segment_stats(segments)), "cluster_statistics": _nested(cluster_stats(segments))})


def offer_totals(recs: DataFrame, count_name: str = "total_recommendations") -> DataFrame:
    return recs.agg(n_rows().alias(count_name), exact_sum("advance_amount").alias("total_advance_amount"),
                    exact_sum("revenue_per_advance").alias("total_expected_revenue"),
                    exact_avg("advance_amount").alias("avg_advance_amount"))


def offers_by_service(recs: DataFrame) -> DataFrame:
    return recs.groupBy("service_type").agg(
        n_rows().alias("subscribers"), exact_sum("advance_amount").alias("total_advance"),
        exact_sum("revenue_per_advance").alias("total_revenue"))


def phase3b_summary(recs: DataFrame) -> DataFrame:
    """Totals with the service table and the five-bin histogram nested."""
    return offer_totals(recs).withColumns({
        "service_type_distribution": _nested(offers_by_service(recs)),
        "amount_distribution": _nested(amount_histogram(recs, AMOUNT_EDGES_5, AMOUNT_LABELS_5).select("bin", "count"))})


def phase4_summary(filtered: DataFrame) -> DataFrame:
    """Totals with the risk and service tables nested."""
    return offer_totals(filtered, "final_recommendations").withColumns({
        "risk_distribution": _nested(filtered.groupBy("bad_debt_risk").agg(n_rows().alias("count"))),
        "service_type_distribution": _nested(offers_by_service(filtered))})


# --- serving store --------------------------------------------------------------------------

# Fixed value: data version of the metadata document.
DATA_VERSION = "v1.0"


def serving_metadata(recs: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """One metadata document as (field, value) rows."""
    at = F.current_timestamp() if now is None else F.lit(str(now)).cast("timestamp")
    service = lambda s: F.count_if(F.col("service_type") == s)
    level = lambda r: F.count_if(F.col("bad_debt_risk") == r)
    row = recs.agg(n_rows().alias("total_subscribers"), service("Fee").alias("total_fee"), service("Free").alias("total_free"),
                   service("Quota").alias("total_quota"), level("LOW").alias("total_low_risk"),
                   level("MEDIUM").alias("total_medium_risk"),
                   number_text(half_even(exact_avg("advance_amount"), 2), 2).alias("avg_advance_amount"),
                   number_text(half_even(exact_sum("revenue_per_advance"), 2), 2).alias("total_revenue_potential"))
    row = row.withColumns({"last_updated": at, "data_version": F.lit(DATA_VERSION)})
    return row.select(F.explode(F.create_map(*[x for c in row.columns for x in (
        F.lit(c), F.col(c).cast("string"))])).alias("field", "value"))


def subscriber_stats(recs: DataFrame) -> DataFrame:
    """One row of totals and means."""
    return recs.agg(n_rows().alias("total_subscribers"), exact_sum("advance_amount").alias("total_advance_amount"),
                    exact_sum("revenue_per_advance").alias("total_revenue"),
                    exact_avg("advance_amount").alias("avg_advance_amount"),
                    exact_avg("revenue_per_advance").alias("avg_revenue"), exact_avg("arpu").alias("avg_arpu"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per value of several columns in one grouped pass."""
    grouped = df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        n_rows().alias("count"), F.grouping_id().alias("_g"))
    last = len(columns) - 1
    label = lambda pick: F.coalesce(*[F.when(F.col("_g") == _mask(i, len(columns)), pick(c))
                                      for i, c in enumerate(columns)]) if last else pick(columns[0])
    return grouped.select(label(lambda c: F.lit(c)).alias("dimension"),
                          label(lambda c: F.col(c).cast("string")).alias("value"), "count")


def _mask(i: int, n: int) -> int:
    """Value of grouping_id() when only the i-th of n columns is grouped."""
    return ((1 << n) - 1) ^ (1 << (n - 1 - i))


def subscriber_breakdown(recs: DataFrame) -> DataFrame:
    return value_counts(recs, ["service_type", "bad_debt_risk"])


def profile_summary(profile: DataFrame) -> DataFrame:
    """Counts and shares of user types and trends."""
    counts = value_counts(profile, ["user_type", "arpu_trend"]).filter(F.col("value").isNotNull())
    total = profile.agg(n_rows()).scalar()
    return counts.withColumn("pct", pct("count", total))


def score_ranges(profile: DataFrame) -> DataFrame:
    names = {"value": "customer_value_score", "readiness": "advance_readiness_score"}
    return profile.agg(*[x for n, c in names.items() for x in (
        F.min(c).alias(f"min_{n}"), F.max(c).alias(f"max_{n}"), exact_avg(c).alias(f"avg_{n}"))])


def recommendation_stats(recs: DataFrame, day: date | str) -> DataFrame:
    """Statistics by service, risk, cluster and date in one grouping-sets pass."""
    dims = {"service": "service_type", "risk": "bad_debt_risk", "cluster": "cluster_group", "date": "recommendation_date"}
    cols = list(dims.values())
    grouped = recs.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("_g"), n_rows().alias("total_count"),
        F.sum("advance_amount").alias("total_advance_amount"), F.sum("revenue_per_advance").alias("total_revenue_potential"),
        exact_avg("customer_value_score").alias("avg_customer_value_score"),
        exact_avg("advance_readiness_score").alias("avg_advance_readiness_score"))
    masks = [_mask(i, len(cols)) for i in range(len(cols))]
    kind = F.coalesce(*[F.when(F.col("_g") == m, F.lit(n)) for m, n in zip(masks, dims)])
    value = F.coalesce(*[F.when(F.col("_g") == m, F.col(c).cast("string")) for m, c in zip(masks, cols)])
    out = grouped.withColumns({"dimension_type": kind, "dimension_value": value,
                               "stats_date": F.lit(str(day)).cast("date")}).filter(F.col("dimension_value").isNotNull())
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SERVING_STATS.fields])


def sync_report(recs: DataFrame, profiles: DataFrame, monthly: DataFrame) -> DataFrame:
    """Row counts per table and counts with totals per service and risk, as (section, item, ...) rows."""
    def table(df: DataFrame, name: str) -> DataFrame:
        return df.agg(n_rows().alias("count")).select(F.lit("table").alias("section"), F.lit(name).alias("item"), "count")
    tables = table(recs, "recommendations").unionByName(table(profiles, "subscriber_360_profiles")).unionByName(
        table(monthly, "subscriber_monthly_arpu"))
    service = recs.groupBy(F.col("service_type").alias("item")).agg(
        n_rows().alias("count"), exact_sum("advance_amount").alias("total_advance"),
        exact_sum("revenue_per_advance").alias("total_revenue")).withColumn("section", F.lit("service"))
    risk = recs.groupBy(F.col("bad_debt_risk").alias("item")).agg(n_rows().alias("count")).withColumn("section", F.lit("risk"))
    return (service.unionByName(risk, allowMissingColumns=True).unionByName(tables, allowMissingColumns=True)
            .select("section", "item", "count", "total_advance", "total_revenue"))


