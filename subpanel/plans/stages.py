"""The whole run: each stage is a stored table that the next stage reads.

A stage is built on first use and read back afterwards, so lineage stays short, a lost executor
costs one stage at most, and the latest month is read by partition pruning. With `buckets` set, the
master is shuffled by subscriber once, and all later windows, groupings and joins on the subscriber
read files that are already so divided.
"""

from __future__ import annotations

import threading
import zlib
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from subpanel.operators import features as feat
from subpanel.operators import master as mst
from subpanel.operators import offers, profile, risk, segment, serving
from subpanel.operators.params import ClusterParams, OfferParams, RiskParams
from subpanel.plans import reports
from subpanel.plans.catalogue import Store
from subpanel.schemas import LATEST_MONTH
from subpanel.session import shuffling_into
from subpanel.sources import tables

# Fixed centroids on the standardised scale, for segments that do not depend on a random start.
CENTROID_COLUMNS = ["topup_count", "total_topup_amount", "num_packages", "burn_rate_capped"]
CENTROIDS = [dict(zip(CENTROID_COLUMNS, c)) for c in (
    (1.0, 1.0, 0.5, -0.5), (0.0, 0.0, 0.0, 0.0), (-1.0, -1.0, -0.5, 0.5))]


class Stages:
    """Stage tables below `path`, built from the six extracts.

    centroids: cluster by these fixed centroids; None fits K-Means.
    targets: "segments" offers to Group 2, "never_advanced" to all who never advanced.
    buckets: number of files by subscriber of each stage table; give about one per 200 MB of
    the largest table; None writes plain tables.
    ref_date: day up to which tenure counts, by default the first of `month`.
    shuffles: partitions that stages shuffle into at least; None leaves the session's setting.
    """

    def __init__(self, spark: SparkSession, extracts: Callable[[], Mapping[str, DataFrame]], path: str,
                 month: str = LATEST_MONTH, centroids: Sequence[Mapping[str, float]] | None = None,
                 targets: str = "segments", offer_params: OfferParams = OfferParams(),
                 risk_params: RiskParams = RiskParams(), cluster_params: ClusterParams = ClusterParams(),
                 day: date | str | None = None, now: datetime | str | None = None, buckets: int | None = 8,
                 ref_date: str | None = None, shuffles: int | None = None):
        self.spark, self.extracts, self.path, self.month = spark, extracts, path.rstrip("/"), month
        self.centroids, self.target_mode = centroids, targets
        self.offer_params, self.risk_params, self.cluster_params = offer_params, risk_params, cluster_params
        self.day, self.now, self.buckets, self.shuffles = day, now, buckets, shuffles
        self.ref_date = ref_date or f"{month[:4]}-{month[4:6]}-01"
        self.model: segment.SegmentModel | None = None
        self._quantiles: dict[str, float | None] | None = None
        self._done: dict[str, DataFrame] = {}
        self._lock = threading.RLock()

    def stored(self, name: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = (),
               spread: bool = False, point_reads: bool = False) -> DataFrame:
        with self._lock:
            if name not in self._done:
                with shuffling_into(self.spark, self.shuffles):
                    self._done[name] = self._write(f"{self.path}/{name}", name, build(), partition_by, spread, point_reads)
            return self._done[name]

    def _write(self, location: str, name: str, df: DataFrame, partition_by: Sequence[str], spread: bool,
               point_reads: bool) -> DataFrame:
        if self.buckets:
            table = f"subpanel_{zlib.crc32(self.path.encode()):08x}_{name}"
            return tables.write_bucketed(df, location, table, "isdn", self.buckets, partition_by, spread, point_reads)
        tables.write_table(df, location, partition_by)
        # The schema is known, so reading back infers neither it nor the type of partition values.
        return tables.read_table(self.spark, location, schema=df.schema)

    def _build_master(self) -> DataFrame:
        return mst.master_of(dict(self.extracts()))

    def master(self) -> DataFrame:
        return self.stored("master", self._build_master, ["data_month"], spread=True)

    def quantiles(self) -> dict[str, float | None]:
        """Thresholds over the whole master, fitted once and stored as one row."""
        with self._lock:
            if self._quantiles is None:
                found, location = feat.global_quantiles(self.master()), f"{self.path}/quantiles"
                schema = ", ".join(f"{name} double" for name in found)
                tables.write_table(self.spark.createDataFrame([tuple(found.values())], schema), location)
                self._quantiles = tables.read_table(self.spark, location, schema=schema).first().asDict()
            return self._quantiles

    def features(self) -> DataFrame:
        return self.stored("features", lambda: feat.build_features(
            self.master(), self.ref_date, self.quantiles()), ["data_month"])

    def advance_users(self) -> DataFrame:
        return segment.advance_users(self.features())

    def snapshot(self) -> DataFrame:
        """Latest month, one row per subscriber, with the advance flag. Read by fit, assignment and reports."""
        return self.stored("snapshot", lambda: segment.flag_membership(
            mst.latest_subscribers(self.features(), self.month), self.advance_users(), "is_advance_user"))

    def clustered(self) -> DataFrame:
        snapshot = self.snapshot()
        if self.centroids is None:
            self.model = segment.fit_segments(snapshot, params=self.cluster_params)
            return self.model.assign(snapshot)
        columns, prefix = list(self.centroids[0]), "_z_"
        names = [f"{prefix}{n}" for n in columns]
        scaled = segment.standardize(segment.clean_matrix(snapshot, columns, prefix=prefix), names)
        centres = [{f"{prefix}{n}": v for n, v in c.items()} for c in self.centroids]
        return segment.assign_clusters(scaled, centres).drop(*names)

    def segments(self) -> DataFrame:
        """Snapshot with cluster and segment."""
        return self.stored("segments", lambda: segment.label_segments(self.clustered()))

    def target_ids(self) -> DataFrame:
        if self.target_mode == "segments":
            return segment.expansion_targets(self.segments()).select("isdn")
        return offers.rule_based_targets(self.features(), self.advance_users(), self.month)

    def scored(self) -> DataFrame:
        """All offers with risk score and level."""
        return self.stored("scored", lambda: risk.score_risk(
            offers.recommend(self.features(), self.target_ids(), self.offer_params, self.month), self.risk_params))

    def final(self) -> DataFrame:
        return risk.keep_risk(self.scored())

    def monthly(self) -> DataFrame:
        return self.stored("monthly_arpu", lambda: profile.monthly_arpu(self.master(), self.final()))

    def profiles(self) -> DataFrame:
        return self.stored("profiles", lambda: profile.build_profile(
            self.final(), self.monthly(), profile.topup_range(self.master(), self.final()), self.segments()))

    def store(self) -> Store:
        """The three typed serving tables."""
        return Store(
            self.stored("serving_recommendations", lambda: serving.serving_recommendations(
                self.final(), self.profiles(), self.day, self.now), point_reads=True),
            self.stored("serving_profiles", lambda: serving.serving_profiles(self.profiles(), self.day, self.now),
                        point_reads=True),
            self.stored("serving_monthly", lambda: serving.serving_monthly(self.monthly(), self.now),
                        point_reads=True))

    def summaries(self) -> dict[str, DataFrame]:
        """One JSON document per phase."""
        return {
            "phase1_summary": reports.phase1_document(self.master()),
            "phase2_summary": reports.phase2_document(self.features()),
            "phase3a_summary": reports.phase3a_document(self.segments()),
            "phase3b_summary": reports.phase3b_summary(self.scored()),
            "phase4_summary": reports.phase4_summary(self.final())}

    def export(self, path: str) -> None:
        """The files other systems read: target lists, offers whole and by service, and summaries."""
        segments, scored, final = self.segments(), self.scored(), self.final()
        inertia = self.model.cost if self.model else None
        if self.model:
            # A later month is scored with the same clusters from this folder (`segment.load_model`).
            segment.save_model(self.model, segment.rank_clusters(segments), f"{path}/model")
        tables.write_csv(segment.expansion_targets(segments, "high"), f"{path}/expansion_group2_similar_high_priority")
        tables.write_csv(segment.expansion_targets(segments, "medium"), f"{path}/expansion_group2_medium_priority")
        tables.write_csv(segment.expansion_targets(segments, "all"), f"{path}/expansion_group2_all_targets")
        tables.write_csv(segment.segmentation_summary(segments, inertia, self.advance_users()), f"{path}/clustering_summary")
        tables.write_csv(scored, f"{path}/recommendations_with_risk_full")
        tables.write_csv(final, f"{path}/recommendations_final_filtered")
        tables.write_csv(serving.publish(final), f"{path}/recommendations_final_filtered_public")
        tables.write_by(scored, "service_type", f"{path}/recommendations_by_service")
        tables.write_by(final, "service_type", f"{path}/final_by_service")
        tables.write_csv(reports.rules_summary(scored), f"{path}/business_rules_summary")
        tables.write_csv(reports.risk_summary(scored), f"{path}/final_summary_with_risk")
        tables.write_csv(feat.feature_catalog(self.features()), f"{path}/feature_list")
        for name, df in self.summaries().items():
            tables.write_json(df, f"{path}/{name}")

    def publish(self, path: str) -> None:
        """Documents, indexes, metadata and statistics of the serving side, as a full refresh."""
        store = self.store()
        recs = store.recommendations
        tables.write_table(serving.rec_documents(recs, self.now), f"{path}/rec_documents")
        tables.write_table(serving.profile_documents(self.profiles(), self.monthly(), self.now), f"{path}/profile_documents")
        tables.write_table(serving.service_index(recs, self.now), f"{path}/service_index", ["service_type"])
        tables.write_table(serving.risk_index(recs, self.now), f"{path}/risk_index", ["bad_debt_risk"])
        tables.write_table(serving.cluster_index(recs, self.now), f"{path}/cluster_index", ["cluster_group"])
        tables.write_table(reports.serving_metadata(recs, self.now), f"{path}/metadata")
        if self.day is not None:
            tables.write_table(reports.recommendation_stats(recs, self.day), f"{path}/recommendation_stats")

    def run(self) -> Store:
        """Build every stage."""
        return self.store()
