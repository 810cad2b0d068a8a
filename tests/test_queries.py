"""Registered queries against their SQL, catalogue texts against their DataFrames, and plan shapes."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from subpanel.plans import reports
from subpanel.plans.catalogue import FRAMES, SQL, run_sql
from subpanel.session import work_dir
from tests.compare import connect, difference
from tests.conftest import values

SQLS = entry.oracle_sql()
ROWS_ONLY = {"kmeans_segments"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def own_queries() -> dict:
    """Queries of the panel; those of the training-data operators have tests of their own."""
    return {k: q for k, q in entry.queries().items() if k != "pipeline" and not re.match(r"op\d+_", k)}


def test_every_query_has_sql_or_a_reason():
    assert set(own_queries()) - set(SQLS) == ROWS_ONLY and set(SQLS) <= set(entry.queries())


# At the smallest scale two lists may be empty: no free service reaches the campaign list.
@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_equals_sql(spark, sf_dir, con, name):
    found = difference(entry.queries()[name](spark, sf_dir), con, SQLS[name])
    assert found in (None, "no rows")


def test_sample_is_a_subset_of_its_risk_set(spark, sf_dir):
    low = entry.stages(spark, sf_dir).store().recommendations.filter("bad_debt_risk = 'LOW'")
    got = entry.queries()["sample_risk"](spark, sf_dir)
    assert got.count() == min(100, low.count()) and got.join(low, "isdn", "left_anti").count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


ARGS = {"q01": "isdn", "q02": "isdn", "q10": "isdn", "q03": "service", "q14": "service"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_catalogue_text_equals_frame(spark, sf_dir, stages, name):
    store = stages.store()
    value = {"isdn": store.recommendations.first().isdn, "service": "Quota"}
    args = {ARGS[name]: value[ARGS[name]]} if name in ARGS else {}
    if name == "q16":
        args = {"now": entry.LATER, "campaign_results": entry._campaign_results(spark, sf_dir)}
    text, frame = run_sql(store, name, **args), FRAMES[name](store, **args)
    assert set(text.columns) == set(frame.columns)
    a, b = values(text, *text.columns), values(frame, *text.columns)
    assert a == b and a


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_no_python_and_no_cross_join_in_any_plan(spark, sf_dir):
    for name, query in own_queries().items():
        if name == "kmeans_segments":
            continue
        text = plan(query(spark, sf_dir))
        assert not re.search(r"Python|CartesianProduct|BroadcastNestedLoopJoin", text), name


def test_features_share_one_shuffle_and_window(spark, stages, tmp_path):
    from subpanel.operators import features as feat
    stages.master().write.parquet(str(tmp_path / "master"))
    text = plan(feat.build_features(spark.read.parquet(str(tmp_path / "master")), quantiles={n: 0.0 for n in feat.QUANTILES}))
    assert text.count("Exchange") == 1 and text.count("+- Window [") == 1


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_master_shuffles_each_extract_once(spark, sf_dir, no_broadcast):
    """Six reductions by the key, two of them by key and code before; the five joins reuse the partitioning."""
    from subpanel.operators import master
    from subpanel.sources import panel
    stored = {}
    for k, v in panel.extracts(spark, sf_dir).items():
        path = f"{work_dir(spark)}/plan-{k}"
        v.write.mode("overwrite").parquet(path)
        stored[k] = spark.read.parquet(path)
    text = plan(master.master_of(stored))
    assert text.count("Exchange hashpartitioning") == 8 and "ObjectHashAggregate" not in text and text.count("SortMergeJoin") == 5
    assert text.count("WindowGroupLimit") == 2


def test_no_shuffle_after_the_master(spark, sf_dir, tmp_path, no_broadcast):
    """Bucketed stages: windows, groupings and joins on the subscriber read co-located files."""
    from subpanel.operators import features as feat
    from subpanel.operators import offers, profile
    from subpanel.plans.stages import CENTROIDS, Stages
    from subpanel.sources import panel
    run = Stages(spark, lambda: panel.extracts(spark, sf_dir), str(tmp_path), centroids=CENTROIDS, targets="never_advanced",
                 day="2025-08-31", now="2025-08-31", buckets=3)
    store = run.run()
    final = run.final()
    plans = {
        "features": feat.build_features(run.master(), quantiles={n: 0.0 for n in feat.QUANTILES}),
        "offers": offers.recommend(run.features(), run.target_ids()),
        "monthly": profile.monthly_arpu(run.master(), final),
        "profile": profile.build_profile(final, run.monthly(), profile.topup_range(run.master(), final), run.segments()),
        "serving": entry.serving.serving_recommendations(final, run.profiles(), "2025-08-31", "2025-08-31"),
        "history": entry.serving.profile_with_history(run.profiles(), run.monthly())}
    assert {n: plan(df).count("Exchange") for n, df in plans.items()} == dict.fromkeys(plans, 0)
    plain = entry.stages(spark, sf_dir).store()
    assert values(store.recommendations) == values(plain.recommendations)


def test_offers_read_one_month_of_the_feature_table(spark, sf_dir):
    assert re.search(r"PartitionFilters: \[[^\]]*data_month[^\]]*202508", plan(entry.q_offers(spark, sf_dir)))


def test_scan_reads_the_needed_columns_of_all_rows(spark, sf_dir):
    from subpanel.sources import panel
    text = plan(panel.n5(spark, sf_dir))
    assert "o_orderdate" in text and "o_orderstatus" not in text and "GreaterThan" not in text


def test_histogram_counts_add_up(stages):
    scored = stages.scored()
    assert sum(r["count"] for r in reports.amount_histogram(scored).collect()) == scored.count()


def test_nested_summaries(stages):
    doc = reports.phase3b_summary(stages.scored()).first()
    assert sum(s.subscribers for s in doc.service_type_distribution) == doc.total_recommendations
    doc = reports.phase4_summary(stages.final()).first()
    assert sum(s["count"] for s in doc.risk_distribution) == doc.final_recommendations
    doc = reports.phase3a_document(stages.segments()).first()
    assert sum(s.total for s in doc.segment_distribution) == doc.total_subscribers


def test_whole_run_with_fitted_clusters(spark, sf_dir, tmp_path):
    from subpanel.operators.params import ClusterParams
    from subpanel.plans.stages import Stages
    from subpanel.sources import panel
    run = Stages(spark, lambda: panel.extracts(spark, sf_dir), str(tmp_path), cluster_params=ClusterParams(n_init=2, max_iter=100),
                 day="2025-08-31", now="2025-08-31", buckets=None)
    store = run.run()
    targets = run.segments().filter("segment LIKE 'GROUP_2%' AND subscriber_type = 'PRE'")
    assert run.scored().count() == targets.count()
    assert store.recommendations.count() == store.profiles.count() == run.final().count()
