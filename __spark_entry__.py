
from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracles import oracle_queries
from subpanel.operators import features as feat
from subpanel.operators import master as mst
from subpanel.operators import monthly, offers, profile, quality, risk, segment, serving
from subpanel.plans import reports
from subpanel.plans.catalogue import FRAMES
from subpanel.plans.stages import CENTROID_COLUMNS, CENTROIDS, Stages
from subpanel.schemas import (ARPU_COLUMNS, KEYS, MONTHS, RISK_LEVELS, SERVICE_CODES, SERVING_MONTHLY,
                              SERVING_RECOMMENDATIONS, SOURCE_COLUMNS, SUBSCRIBER_TYPES)
from subpanel.session import shuffling_into, work_dir
from subpanel.sources import files, merge, panel, tables, upserts

# The training-data operators are optional: without their folder all other queries work.
try:
    import corpus_pipeline
    from subpanel.llm import queries as corpus
except ImportError:
    corpus_pipeline = corpus = None

# The given tables of the panel.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
DAY, NOW, LATER = "2025-08-31", "2025-08-31 00:00:00", "2025-09-05 00:00:00"

_stages: dict[tuple[str, str], Stages] = {}


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    """Stage tables of one data folder, written once per session and read by the queries after."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stages:
        path = f"{work_dir(spark)}/stages-{zlib.crc32(sf_dir.encode()):08x}"
        _stages[key] = Stages(spark, lambda: panel.extracts(spark, sf_dir), path, centroids=CENTROIDS,
                              targets="never_advanced", day=DAY, now=NOW, buckets=panel.month_parts(spark, sf_dir),
                              shuffles=panel.fact_parts(spark, sf_dir))
    return _stages[key]


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Round columns whose last bits depend on the order of floating-point additions."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _best(recs: DataFrame) -> str | None:
    """Id of the subscriber with the highest priority; the point reads need a literal id to open one bucket only."""
    row = recs.orderBy(*serving.by_priority()).select("isdn").first()
    return row and row["isdn"]


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("isdn"), "c_acctbal")


def _campaign_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("isdn", (F.col("c_acctbal") > 4000).alias("accepted"))


# --- extracts and master --------------------------------------------------------------------

def q_master(spark, d):
    return rounded(mst.master_of(panel.extracts(spark, d)), "std_topup_amount")


def q_phase1_unreduced(spark, d):
    """Totals over a master that keeps every ARPU row of a key: more records, the same amounts."""
    with shuffling_into(spark, panel.fact_parts(spark, d)):
        df = mst.master_of(panel.extracts(spark, d), reduce=False)
        found = tables.kept(reports.phase1_summary(df), "phase1_unreduced")
    return rounded(found, "total_advance_amount", "total_topup_amount")


def q_source_counts(spark, d):
    return reports.advance_source_counts(panel.n4(spark, d))


def q_panel_coverage(spark, d):
    """Rows that the extracts read from each table, which is all of them."""
    read = {"customer": (panel.n10, len(panel.PANEL_MONTHS)), "lineitem_packages": (panel.n2, 1), "lineitem_advances": (panel.n4, 1),
            "events": (panel.n3, 1), "orders": (panel.n5, 1)}
    parts = [extract(spark, d).agg((F.count(F.lit(1)) / times).cast("long").alias("rows_read")).select(
        F.lit(name).alias("source_table"), "rows_read") for name, (extract, times) in read.items()]
    return reduce(DataFrame.unionByName, parts)


def q_global_quantiles(spark, d):
    found = stages(spark, d).quantiles()
    # The master decides the row, so that an empty panel gives an empty result.
    one = stages(spark, d).master().agg(F.count(F.lit(1)).alias("panel_rows"))
    return one.select("panel_rows", *[F.round(F.lit(v).cast("double"), 8).alias(n) for n, v in found.items()])


def _features(columns: list[str], noisy: tuple[str, ...] = ()):
    def run(spark, d):
        df = feat.build_features(stages(spark, d).master(), quantiles=stages(spark, d).quantiles()).select(*KEYS, *columns)
        return rounded(df, *noisy, digits=6)
    return run


# --- segments -------------------------------------------------------------------------------

def _standardized(spark, d):
    snap = stages(spark, d).snapshot().select("isdn", *CENTROID_COLUMNS)
    return segment.standardize(segment.clean_matrix(snap, CENTROID_COLUMNS), CENTROID_COLUMNS)


def q_never_advanced(spark, d):
    s = stages(spark, d)
    return segment.never_advanced(mst.snapshot(s.features()).select("isdn"), s.features())


def q_kmeans_segments(spark, d):
    """K-Means with its default restarts: size and advance rate of the resulting segments."""
    snap = stages(spark, d).snapshot()
    model = segment.fit_segments(snap)
    found = segment.label_segments(model.assign(snap))
    return segment.segment_stats(found).withColumn("inertia", F.lit(model.cost))


def q_segmentation_summary(spark, d):
    s = stages(spark, d)
    return rounded(segment.segmentation_summary(s.segments(), advance_base=s.advance_users()), "expansion_ratio")


def q_cluster_profiles(spark, d):
    return rounded(segment.cluster_profiles(stages(spark, d).segments()), "center", "overall_mean")


# --- offers and risk ------------------------------------------------------------------------

def q_offers(spark, d):
    s = stages(spark, d)
    return offers.recommend(s.features(), offers.rule_based_targets(s.features(), s.advance_users()))


def q_offers_group2(spark, d):
    s = stages(spark, d)
    targets = segment.expansion_targets(s.segments())
    return risk.score_risk(offers.recommend(s.features(), targets))


def q_describe_voice(spark, d):
    return rounded(reports.describe_voice(stages(spark, d).scored()), "mean_voice_sms_pct", "median_voice_sms_pct")


def q_public_codes(spark, d):
    return serving.publish(stages(spark, d).final()).groupBy("service_code", "service_type").agg(
        F.count(F.lit(1)).alias("count"))


# --- profile --------------------------------------------------------------------------------

def q_profile_360(spark, d):
    s = stages(spark, d)
    df = profile.build_profile(s.final(), s.monthly(), profile.topup_range(s.master(), s.final()), s.segments())
    return rounded(df, "arpu_avg_6m", "arpu_std_6m")


def q_priority(spark, d):
    return stages(spark, d).profiles().select("isdn", profile.priority().alias("priority_score"),
                                              profile.priority(False).alias("priority_raw"))


def q_insights(spark, d):
    return profile.insights(stages(spark, d).profiles()).withColumn("strengths", F.array_join("strengths", "; "))


def q_eligibility(spark, d):
    df = profile.eligibility(_customers(spark, d), stages(spark, d).store().recommendations)
    return as_double(df, "advance_amount", "revenue_per_advance", "customer_value_score", "advance_readiness_score")


# --- serving --------------------------------------------------------------------------------

def _recs(spark, d):
    return stages(spark, d).store().recommendations


_SHORT = ["isdn", "service_type", "bad_debt_risk", "priority_score"]


def q_service_index(spark, d):
    return serving.service_index(_recs(spark, d), NOW)


def q_membership(spark, d):
    return serving.is_member(_customers(spark, d), serving.risk_index(_recs(spark, d), NOW), "bad_debt_risk", "LOW")


def q_index_sizes(spark, d):
    recs = _recs(spark, d)
    part = lambda index, c: serving.cardinality(index, c).select(F.col(c).cast("string").alias("set_name"), "members")
    return (part(serving.risk_index(recs, NOW), "bad_debt_risk")
            .unionByName(part(serving.cluster_index(recs, NOW), "cluster_group"))
            .unionByName(part(serving.service_index(recs, NOW), "service_type")))


def q_search_page(spark, d):
    found = serving.search_subscribers(_recs(spark, d), "ER#0000", "Quota", "LOW")
    return serving.page(found.select("isdn", "service_type", "bad_debt_risk"), limit=50, offset=20)


def q_bulk_lookup(spark, d):
    """Offers of all subscribers with a top-up in the latest month."""
    ids = panel.n5(spark, d).filter(F.col("data_month") == MONTHS[-1]).select("isdn")
    return as_double(serving.bulk_lookup(_recs(spark, d), ids).select(*_SHORT, "advance_amount"),
                     "priority_score", "advance_amount")


def q_campaign_update(spark, d):
    return serving.apply_campaign_results(_recs(spark, d), _campaign_results(spark, d), LATER).select("isdn", "updated_at")


def q_profile_history(spark, d):
    s = stages(spark, d)
    df = serving.profile_with_history(s.profiles().select("isdn", "arpu_trend"), s.monthly())
    return rounded(df.select("isdn", "arpu_trend", F.posexplode("monthly_arpu").alias("position", "m"))
                   .select("isdn", "arpu_trend", "position", "m.*"), *ARPU_COLUMNS)


def q_rec_documents(spark, d):
    return serving.document_fields(serving.rec_documents(_recs(spark, d), NOW))


def q_profile_documents(spark, d):
    """Documents read back: values parsed from the JSON sections, one row per month of history."""
    s = stages(spark, d)
    f = lambda section, path: F.get_json_object(F.col("fields")[section], f"$.{path}")
    months = F.from_json(F.col("fields")["monthly_arpu"], "array<struct<month string, arpu_total double>>")
    return (serving.profile_documents(s.profiles(), s.monthly(), NOW)
            .select("key", f("basic", "service").alias("service"), f("arpu_stats", "trend").alias("trend"),
                    f("risk_assessment", "level").alias("risk"), f("revenue_breakdown", "user_type").alias("user_type"),
                    f("topup_behavior", "frequency_class").alias("frequency_class"),
                    f("kpi_scores", "customer_value").cast("double").alias("customer_value"),
                    F.explode(months).alias("m"))
            .select("*", F.col("m.month").alias("month"), F.round("m.arpu_total", 4).alias("arpu_total")).drop("m"))


def q_live_documents(spark, d):
    """Profile documents written on day 0 are gone on day 8, recommendation documents written on day 5 are not."""
    s = stages(spark, d)
    docs = (serving.profile_documents(s.profiles(), s.monthly(), NOW).select("key", "expires_at")
            .unionByName(serving.rec_documents(_recs(spark, d), LATER).select("key", "expires_at")))
    return serving.live(docs, "2025-09-08 00:00:00").select("key", "expires_at")


def q_read_documents(spark, d):
    """Two fields of the document of the best subscriber of each service."""
    recs = _recs(spark, d)
    best = serving.service_index(recs, NOW).filter("rank = 0").select(F.concat(F.lit("rec:"), "isdn").alias("key"))
    wanted = ["advance_amount", "bad_debt_risk"]
    found = serving.read_document(serving.rec_documents(recs, NOW), best, wanted)
    return found.select("key", F.explode("fields").alias("field", "value"))


def q_serving_profiles(spark, d):
    df = stages(spark, d).store().profiles.drop("created_at", "updated_at")
    return as_double(df, *[f.name for f in df.schema if f.dataType.typeName() == "decimal"])


def q_serving_recommendations(spark, d):
    df = _recs(spark, d).drop("created_at", "updated_at")
    return as_double(df, *[f.name for f in df.schema if f.dataType.typeName() == "decimal"])


def q_arpu_chart(spark, d):
    return rounded(serving.arpu_chart(stages(spark, d).monthly()), "height", "arpu_total")


# --- upserts and checks ---------------------------------------------------------------------

def _delivered_to(spark, base: DataFrame, name: str, keys: list[str], parts: int, by: str | None = None) -> upserts.FolderTable:
    """A stored copy of a serving table that takes deliveries."""
    table = upserts.FolderTable(spark, f"{work_dir(spark)}/deliveries/{name}-{uuid.uuid4().hex[:16]}", base.schema,
                                tuple(keys), parts, by)
    table.create(base)
    return table


def _arrivals(spark, d):
    """A second delivery: every offer of the panel's Group 2, amounts raised, risk altered."""
    recs = _recs(spark, d)
    known = recs.withColumns({"advance_amount": (F.col("advance_amount") + 1000).cast(recs.schema["advance_amount"].dataType),
                              "bad_debt_risk": F.lit("HIGH")})
    fresh = recs.withColumn("isdn", F.concat(F.lit("new:"), "isdn"))
    return known.filter(F.col("service_type") == "Fee").unionByName(fresh.filter(F.col("service_type") == "Free"))


def q_upsert_recommendations(spark, d):
    table = _delivered_to(spark, _recs(spark, d), "recommendations", ["isdn"], panel.month_parts(spark, d))
    table.upsert(_arrivals(spark, d), merge.RECOMMENDATION_UPDATES, LATER)
    df = table.read()
    return as_double(df.select("isdn", "service_type", "bad_debt_risk", "advance_amount", "priority_score", "updated_at"),
                     "advance_amount", "priority_score")


def q_upsert_profiles(spark, d):
    base = stages(spark, d).store().profiles
    new = base.filter(F.col("bad_debt_risk") == "LOW").withColumns({
        "revenue_potential": (F.col("revenue_potential") * 2).cast(base.schema["revenue_potential"].dataType), "user_type": F.lit("changed")})
    table = _delivered_to(spark, base, "profiles", ["isdn"], panel.month_parts(spark, d))
    table.upsert(new, merge.PROFILE_UPDATES, LATER)
    df = table.read()
    return as_double(df.select("isdn", "user_type", "revenue_potential", "updated_at"), "revenue_potential")


def q_insert_new(spark, d):
    """The monthly table of LOW-risk subscribers, completed with all months of the others."""
    monthly_table = stages(spark, d).store().monthly
    low = _recs(spark, d).filter(F.col("bad_debt_risk") == "LOW").select("isdn")
    base = monthly_table.join(low, "isdn", "left_semi")
    new = monthly_table.withColumn("arpu_total", (F.col("arpu_total") + 1).cast(base.schema["arpu_total"].dataType))
    table = _delivered_to(spark, base, "monthly", KEYS, panel.month_parts(spark, d), by="data_month")
    table.insert(new)
    return as_double(table.read().select(*KEYS, "arpu_total"), "arpu_total")


def q_quality_report(spark, d):
    store = stages(spark, d).store()
    return quality.union_checks(
        quality.check_rows(store.recommendations, "recommendations",
                           {"subscriber_type": SUBSCRIBER_TYPES, "service_type": SERVICE_CODES, "bad_debt_risk": RISK_LEVELS},
                           [f.name for f in store.recommendations.schema if f.name in (
                               "isdn", "subscriber_type", "service_type", "advance_amount", "revenue_per_advance",
                               "bad_debt_risk", "recommendation_date")]),
        quality.check_rows(store.profiles, "profiles", not_null=["isdn", "subscriber_type", "profile_date"]),
        quality.check_rows(store.monthly, "monthly", not_null=KEYS),
        quality.check_unique(store.recommendations, "recommendations", ["isdn"]),
        quality.check_unique(store.profiles, "profiles", ["isdn"]),
        quality.check_unique(store.monthly, "monthly", KEYS),
        quality.check_unique(reports.recommendation_stats(store.recommendations, DAY), "stats",
                             ["dimension_type", "dimension_value", "stats_date"]),
        quality.check_fk(store.profiles, store.recommendations, "profiles -> recommendations"))


def q_reconcile(spark, d):
    recs = _recs(spark, d)
    return quality.reconcile(recs, serving.rec_documents(recs, NOW), serving.service_index(recs, NOW))


# --- files ----------------------------------------------------------------------------------

_written: set[tuple[str, str]] = set()


def csv_root(spark, d) -> str:
    """The six extracts as CSV, one folder per source and month, written once per session."""
    key = (spark.sparkContext.applicationId, d)
    root = f"{work_dir(spark)}/csv-{zlib.crc32(d.encode()):08x}"
    if key not in _written:
        for source, df in panel.extracts(spark, d).items():
            files.write_extract(df, root, source)
        _written.add(key)
    return root


def q_csv_ingest(spark, d):
    out = None
    for source, df in files.read_extracts(spark, csv_root(spark, d)).items():
        one = df.groupBy("data_month").agg(F.count(F.lit(1)).alias("rows")).withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one)
    return out.select("source", "data_month", "rows")


def q_csv_master(spark, d):
    """The panel built from the CSV files."""
    return rounded(reports.monthly_stats(mst.master_of(files.read_extracts(spark, csv_root(spark, d)))),
                   "total_topup", "total_advance")


def q_file_inventory(spark, d):
    """Files and rows of every given table."""
    return files.table_inventory(spark, d, TABLES).select("table_name", "file_count", "row_count",
                                                          F.col("modified").isNotNull().alias("dated"))


def q_csv_inventory(spark, d):
    """Monthly extracts found below the CSV folder."""
    return files.list_source_files(spark, csv_root(spark, d), list(SOURCE_COLUMNS)).select("source", "name", "month").distinct()


def q_serving_rejects(spark, d):
    """Numbers that an extract or a serving table could not hold, counted per column before they become 0 or null."""
    s = stages(spark, d)
    raw = {"N1": (panel.n1, ARPU_COLUMNS), "N2": (panel.n2, ["package_price", "package_cycle"]),
           "N4": (panel.n4, ["amount"]), "N5": (panel.n5, ["topup_amount"])}
    parts = [quality.lost_numbers(extract(spark, d), name, columns) for name, (extract, columns) in raw.items()]
    parts += [serving.rejects(serving.recommendation_values(s.final(), s.profiles(), DAY, NOW), SERVING_RECOMMENDATIONS, "recommendations"),
              serving.rejects(s.monthly(), SERVING_MONTHLY, "monthly")]
    return reduce(DataFrame.unionByName, parts)


def entry(spark: SparkSession) -> DataFrame:
    """Revenue by service and risk: the whole chain from extracts to the serving table."""
    return queries()["q04"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(method: str, report: Callable, *noisy: str, digits: int = 4, **kwargs):
        return lambda spark, d: rounded(report(getattr(stages(spark, d), method)(), **kwargs), *noisy, digits=digits)

    def on_recs(report: Callable, *doubles: str, **kwargs):
        return lambda spark, d: as_double(report(_recs(spark, d), **kwargs), *doubles)

    def catalogue(name: str, *doubles: str, **kwargs):
        return lambda spark, d: as_double(FRAMES[name](stages(spark, d).store(), **kwargs), *doubles)

    def point(name: str, *doubles: str):
        return lambda spark, d: as_double(FRAMES[name](stages(spark, d).store(), isdn=_best(_recs(spark, d))), *doubles)

    money = ("total_advance", "total_revenue")
    return {
        "topup_monthly": lambda s, d: rounded(monthly.agg_topup(panel.n5(s, d)), "std_topup_amount"),
        "advance_monthly": lambda s, d: monthly.agg_advance(panel.n4(s, d)),
        "package_monthly": lambda s, d: monthly.agg_package(panel.n2(s, d)),
        "usage_monthly": lambda s, d: monthly.agg_usage(panel.n3(s, d)),
        "arpu_monthly": lambda s, d: monthly.agg_arpu(panel.n1(s, d)),
        "subscriber_months": lambda s, d: monthly.subscriber_months(panel.n10(s, d)),
        "advance_source_counts": q_source_counts,
        "master": q_master,
        "phase1_summary": of("master", reports.phase1_summary, "total_advance_amount", "total_topup_amount"),
        "phase1_unreduced": q_phase1_unreduced,
        "monthly_stats": of("master", reports.monthly_stats, "total_topup", "total_advance"),
        "type_distribution": of("master", reports.type_distribution),
        "global_quantiles": q_global_quantiles,
        "features_advance": _features(feat.ADVANCE_FEATURES),
        "features_topup": _features(feat.TOPUP_FEATURES, ("topup_cv", "topup_amount_last_2m", "topup_amount_last_3m")),
        "features_financial": _features(feat.FINANCIAL_FEATURES),
        "features_profile": _features(feat.PROFILE_FEATURES + feat.INTERACTION_FEATURES),
        "phase2_summary": of("features", reports.phase2_summary),
        "stress_distribution": of("features", reports.metric_distribution),
        "advance_users": lambda s, d: stages(s, d).advance_users(),
        "never_advanced": q_never_advanced,
        "standardized_matrix": lambda s, d: rounded(_standardized(s, d), *CENTROID_COLUMNS, digits=6),
        "assign_fixed_centroids": lambda s, d: segment.assign_clusters(_standardized(s, d), CENTROIDS).select("isdn", "cluster"),
        "segments_by_rank": lambda s, d: stages(s, d).segments().select("isdn", "cluster", "is_advance_user", "segment"),
        "cluster_stats": of("segments", segment.cluster_stats),
        "segment_stats": of("segments", segment.segment_stats),
        "segmentation_summary": q_segmentation_summary,
        "phase3a_summary": of("segments", reports.phase3a_summary),
        "expansion_targets": of("segments", segment.expansion_targets),
        "cluster_profiles": q_cluster_profiles,
        "kmeans_segments": q_kmeans_segments,
        "offers": q_offers,
        "offers_group2": q_offers_group2,
        "service_mix": of("scored", reports.service_mix, "avg_arpu", "avg_voice_sms_pct"),
        "rules_summary": of("scored", reports.rules_summary),
        "amount_histogram_6": of("scored", reports.amount_histogram),
        "amount_histogram_5": of("scored", reports.amount_histogram, edges=reports.AMOUNT_EDGES_5, labels=reports.AMOUNT_LABELS_5),
        "describe_voice": q_describe_voice,
        "offer_totals": of("scored", reports.offer_totals),
        "offers_by_service": of("scored", reports.offers_by_service),
        "risk_scored": lambda s, d: risk.score_risk(q_offers(s, d)),
        "risk_mix": of("scored", reports.risk_mix, "avg_topup", "avg_ratio"),
        "risk_by_service": of("scored", reports.risk_by_service),
        "final_distribution": of("scored", reports.final_distribution),
        "risk_summary": of("scored", reports.risk_summary),
        "phase4_totals": lambda s, d: reports.offer_totals(stages(s, d).final(), "final_recommendations"),
        "phase4_by_service": of("final", reports.offers_by_service),
        "public_codes": q_public_codes,
        "monthly_arpu": lambda s, d: profile.monthly_arpu(stages(s, d).master(), stages(s, d).final()).transform(rounded, *ARPU_COLUMNS),
        "arpu_stats": of("monthly", profile.arpu_stats, "arpu_avg_6m", "arpu_std_6m", "arpu_call_avg", "arpu_sms_avg", "arpu_data_avg"),
        "profile_360": q_profile_360,
        "priority": q_priority,
        "insights": q_insights,
        "eligibility": q_eligibility,
        "profile_summary": of("profiles", reports.profile_summary),
        "score_ranges": of("profiles", reports.score_ranges),
        "subscriber_stats": lambda s, d: rounded(reports.subscriber_stats(stages(s, d).final()), "avg_arpu"),
        "subscriber_breakdown": on_recs(reports.subscriber_breakdown),
        "serving_metadata": on_recs(reports.serving_metadata, now=NOW),
        "serving_recommendations": q_serving_recommendations,
        "serving_profiles": q_serving_profiles,
        "recommendation_stats": lambda s, d: as_double(
            reports.recommendation_stats(_recs(s, d), DAY), "total_advance_amount", "total_revenue_potential",
            "avg_customer_value_score", "avg_advance_readiness_score"),
        "sync_report": lambda s, d: reports.sync_report(*(lambda t: (t.recommendations, t.profiles, t.monthly))(stages(s, d).store())),
        "top_by_service": lambda s, d: as_double(serving.top_by_priority(_recs(s, d), "Fee", 100).select(*_SHORT), "priority_score"),
        "campaign_list": lambda s, d: as_double(serving.campaign_list(_recs(s, d), "Free", 60).select(*_SHORT), "priority_score"),
        "score_range": lambda s, d: as_double(serving.by_score_range(_recs(s, d), "Quota").select(*_SHORT), "priority_score"),
        "high_value_low_risk": lambda s, d: as_double(serving.high_value_low_risk(_recs(s, d), 10000).select(*_SHORT), "priority_score"),
        "service_index": q_service_index,
        "risk_index": on_recs(serving.risk_index, now=NOW),
        "cluster_index": on_recs(serving.cluster_index, now=NOW),
        "index_sizes": q_index_sizes,
        "membership": q_membership,
        "sample_risk": lambda s, d: serving.sample_risk(_recs(s, d), "LOW", 100),
        "search_page": q_search_page,
        "bulk_lookup": q_bulk_lookup,
        "campaign_update": q_campaign_update,
        "profile_history": q_profile_history,
        "rec_documents": q_rec_documents,
        "profile_documents": q_profile_documents,
        "live_documents": q_live_documents,
        "read_documents": q_read_documents,
        "arpu_chart": q_arpu_chart,
        "q01": lambda s, d: as_double(FRAMES["q01"](stages(s, d).store(), isdn=_best(_recs(s, d))).select(*_SHORT), "priority_score"),
        "q02": lambda s, d: as_double(
            FRAMES["q02"](stages(s, d).store(), isdn=_best(_recs(s, d)))
            .select("isdn", "arpu_trend", F.posexplode("monthly_arpu").alias("position", "m"))
            .select("isdn", "arpu_trend", "position", "m.month", "m.arpu_total"), "arpu_total"),
        "q03": catalogue("q03", "advance_amount", "revenue_per_advance", "customer_value_score",
                         "advance_readiness_score", "priority_score", service="Fee"),
        "q04": catalogue("q04", *money),
        "q05": catalogue("q05", "total_advance", "total_revenue_potential"),
        "q06": catalogue("q06", "advance_amount", "revenue_per_advance", "customer_value_score", "advance_readiness_score"),
        "q07": catalogue("q07"),
        "q08": catalogue("q08"),
        "q09": catalogue("q09"),
        "q10": point("q10", *ARPU_COLUMNS),
        "q11": catalogue("q11"),
        "q12": catalogue("q12", *money),
        "q13": catalogue("q13"),
        "q14": catalogue("q14", *money, service="Quota"),
        "q15": catalogue("q15"),
        "q16": lambda s, d: FRAMES["q16"](stages(s, d).store(), campaign_results=_campaign_results(s, d), now=LATER)
        .select("isdn", "service_type", "updated_at"),
        "q17": catalogue("q17"),
        "q18": lambda s, d: FRAMES["q18"](stages(s, d).store()).select("isdn", "service_type", "bad_debt_risk"),
        "q19": catalogue("q19", "total_advance"),
        "upsert_recommendations": q_upsert_recommendations,
        "upsert_profiles": q_upsert_profiles,
        "insert_new": q_insert_new,
        "quality_report": q_quality_report,
        "reconcile": q_reconcile,
        "csv_ingest": q_csv_ingest,
        "csv_master": q_csv_master,
        "file_inventory": q_file_inventory,
        "csv_inventory": q_csv_inventory,
        "serving_rejects": q_serving_rejects,
        "panel_coverage": q_panel_coverage,
    } | ({**corpus.queries(), "pipeline": corpus_pipeline.run} if corpus else {})


def oracle_sql() -> dict[str, str]:
    return oracle_queries() | (corpus.oracles() if corpus else {})
