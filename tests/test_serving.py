import json

import pytest
from pyspark.sql import functions as F

from subpanel.operators import quality, serving
from subpanel.operators.ranking import rank_descending
from subpanel.sources import merge
from tests.conftest import values


def brute_rank(rows):
    out = {}
    for g in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]), reverse=True)
        out.update({r[1]: i for i, r in enumerate(members)})
    return out


@pytest.mark.parametrize("slices", [1, 4, 50])
def test_rank_with_a_hot_group_and_a_hot_score(spark, slices):
    rows = [("hot" if i % 3 else "cold", f"id{(i * 37) % 1000:04d}", 0.0 if i % 2 else float(i % 13)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, id string, s double").repartition(7)
    got = {r.id: r["rank"] for r in rank_descending(df, "g", "s", "id", slices).collect()}
    assert got == brute_rank(rows)


def test_partitions_are_balanced(spark):
    from subpanel.operators.ranking import in_rank_order
    df = spark.range(20000).select(F.lit("g").alias("g"), F.sha1(F.col("id").cast("string")).alias("id"), F.lit(1.0).alias("s"))
    sizes = [r["count"] for r in in_rank_order(df, "g", "s", "id", 16).groupBy("_part").count().collect()]
    assert 14 <= len(sizes) <= 16 and max(sizes) <= 2 * 20000 / 16


def test_search_is_literal(spark):
    df = spark.createDataFrame([("++/hZ==", "Fee", "LOW"), ("abhZcd", "Free", "LOW")], "isdn string, service_type string, bad_debt_risk string")
    found = lambda *a: [r[0] for r in values(serving.search_subscribers(df, *a), "isdn")]
    assert found("+/") == ["++/hZ=="]
    assert found("HZ") == ["++/hZ==", "abhZcd"]
    assert [r[0] for r in values(serving.search_subscribers(df, "^ab.z", regex=True), "isdn")] == ["abhZcd"]
    assert found(" ", "all", "all") == ["++/hZ==", "abhZcd"] and found(None, "Free") == ["abhZcd"]


def test_pages(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(25)], "isdn string").repartition(3)
    r = serving.page(df, 10, 10).collect()
    assert [x.isdn for x in r] == [f"{i:03d}" for i in range(10, 20)]
    assert {(x.total, x.has_more, x.pages) for x in r} == {(25, True, 3)}
    last = serving.page(df, 10, after="019").collect()
    assert [x.isdn for x in last] == [f"{i:03d}" for i in range(20, 25)] and not last[0].has_more and last[0].total == 25


def test_compact_map(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '', 'c', 'nan', 'd', CAST(NULL AS STRING)) AS m")
    assert df.select(serving.compact_map(F.col("m"))).first()[0] == {"a": "1"}


def test_campaign_filters_after_the_limit(spark):
    df = spark.createDataFrame([("a", "Fee", "LOW", 9.0), ("b", "Fee", "MEDIUM", 8.0), ("c", "Fee", "LOW", 7.0)],
                               "isdn string, service_type string, bad_debt_risk string, priority_score double")
    assert [r[0] for r in values(serving.campaign_list(df, "Fee", 2), "isdn")] == ["a"]


def test_documents(stages):
    store = stages.store()
    docs = serving.rec_documents(store.recommendations, "2025-08-31 00:00:00")
    one = docs.first()
    assert one.key == f"rec:{one.fields['isdn']}" and len(one.fields) <= 16 and str(one.expires_at) == "2025-09-07 00:00:00"
    assert serving.live(docs, "2025-09-06 23:59:59").count() == docs.count()
    assert serving.live(docs, "2025-09-07 00:00:00").count() == 0
    some = serving.read_document(docs, [one.key], ["isdn", "arpu_trend"]).first()
    assert set(some.fields) <= {"isdn", "arpu_trend"}


def test_profile_document_json(stages):
    doc = serving.profile_documents(stages.profiles(), stages.monthly(), "2025-08-31").first()
    basic, months = json.loads(doc.fields["basic"]), json.loads(doc.fields["monthly_arpu"])
    assert f"profile:{basic['isdn']}" == doc.key
    assert [m["month"] for m in months] == sorted(m["month"] for m in months) and len(months) == 7
    assert set(json.loads(doc.fields["arpu_stats"])) == {"avg", "std", "min", "max", "growth_rate", "trend"}
    assert json.loads(doc.fields["risk_assessment"])["factors"] == []


def test_typed_cast(spark):
    from subpanel.schemas import SERVING_MONTHLY
    df = spark.createDataFrame([("a", "202503", float("nan"), 1603.1249999998, 2.0)],
                               "isdn string, data_month string, arpu_call double, arpu_sms double, arpu_data double")
    r = serving.to_serving_schema(df, SERVING_MONTHLY).first()
    assert r.arpu_call is None and str(r.arpu_sms) == "1603.13" and r.arpu_total is None


def test_index_sets(stages):
    recs = stages.store().recommendations
    index = serving.risk_index(recs, "2025-08-31")
    assert sum(r.members for r in serving.cardinality(index, "bad_debt_risk").collect()) == recs.count()


def test_bulk_lookup(stages):
    recs = stages.store().recommendations
    known = [r.isdn for r in recs.select("isdn").limit(5).collect()]
    assert sorted(r.isdn for r in serving.bulk_lookup(recs, known + ["absent"]).collect()) == sorted(known)


def test_sample_is_repeatable(stages):
    recs = stages.store().recommendations
    a, b = (values(serving.sample_risk(recs, "LOW", 10)) for _ in range(2))
    assert a == b and len({r[1] for r in a}) == 10
    assert values(serving.sample_risk(recs, "LOW", 10, seed=1)) != a


BASE = "isdn string, risk string, amount double, updated_at timestamp"


def test_upsert_changes_only_listed_columns(spark):
    base = spark.sql("SELECT * FROM VALUES ('a', 'LOW', 1.0, TIMESTAMP'2025-01-01'), ('b', 'LOW', 2.0, TIMESTAMP'2025-01-01') AS t(isdn, risk, amount, updated_at)")
    new = spark.sql("SELECT * FROM VALUES ('a', 'HIGH', 9.0, TIMESTAMP'2025-02-02'), ('c', 'HIGH', 3.0, TIMESTAMP'2025-02-02') AS t(isdn, risk, amount, updated_at)")
    got = {r.isdn: (r.risk, r.amount, str(r.updated_at)[:10]) for r in merge.upsert(base, new, ["isdn"], ["amount"], "2025-03-03").collect()}
    assert got == {"a": ("LOW", 9.0, "2025-03-03"), "b": ("LOW", 2.0, "2025-01-01"), "c": ("HIGH", 3.0, "2025-02-02")}
    assert quality.check_unique(new.unionByName(new), "t", ["isdn"]).first().violations == 2


def test_upsert_can_set_null(spark):
    base = spark.sql("SELECT 'a' AS isdn, 1.0D AS amount")
    new = spark.sql("SELECT 'a' AS isdn, CAST(NULL AS DOUBLE) AS amount")
    assert merge.upsert(base, new, ["isdn"], ["amount"]).first().amount is None


def test_insert_new_skips_known_keys(spark):
    base = spark.createDataFrame([("a", "1", 1.0)], "isdn string, data_month string, x double")
    new = spark.createDataFrame([("a", "1", 9.0), ("a", "2", 2.0)], "isdn string, data_month string, x double")
    assert values(merge.insert_new(base, new, ["isdn", "data_month"])) == [("a", "1", 1.0), ("a", "2", 2.0)]


def test_quality_counts_violations(spark):
    df = spark.createDataFrame([("a", "Fee"), ("a", "Gold"), (None, None)], "isdn string, service_type string")
    got = dict(values(quality.union_checks(
        quality.check_domain(df, "t", {"service_type": ["Fee"]}), quality.check_not_null(df, "t", ["isdn", "service_type"]),
        quality.check_unique(df, "t", ["isdn"]),
        quality.check_fk(df, spark.createDataFrame([("a",)], "isdn string"), "fk"))))
    assert got == {"t.service_type in domain": 1, "t.isdn not null": 1, "t.service_type not null": 1, "t.isdn unique": 1, "fk": 1}


def test_reconcile_sees_gaps(spark):
    recs = spark.createDataFrame([("a", "Fee"), ("b", "Fee")], "isdn string, service_type string")
    docs = spark.createDataFrame([("rec:a",)], "key string")
    index = spark.createDataFrame([("a", "Fee")], "isdn string, service_type string")
    assert values(quality.reconcile(recs, docs, index)) == [("index size Fee", 1), ("recommendation has document", 1)]


def test_wide_values_are_kept(spark):
    """A subscriber with over 1,000 top-ups in the month keeps them, and so do large amounts and shares."""
    rows = spark.createDataFrame([("a", 1234, 2.5e9, 4321.5)], "isdn string, topup_frequency long, arpu_avg_6m double, revenue_call_pct double")
    for schema in (serving.SERVING_RECOMMENDATIONS, serving.SERVING_PROFILES):
        row = serving.to_serving_schema(rows, schema).first()
        assert (float(row["topup_frequency"]), float(row["arpu_avg_6m"]), float(row["revenue_call_pct"])) == (1234.0, 2.5e9, 4321.5)
