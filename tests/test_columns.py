from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from subpanel.functions import columns as c


def one(spark, expr, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("text, want", [("12.5", 12.5), ("x", 0.0), (None, 0.0), ("NaN", 0.0), ("1e3", 1000.0), ("", 0.0)])
def test_number_from_text(spark, text, want):
    assert one(spark, c.to_num0("x"), text) == want
    assert float(one(spark, c.money0("x"), text)) == want


@pytest.mark.parametrize("text, want", [
    ("1/3/2025", date(2025, 3, 1)), ("01/03/2025", date(2025, 3, 1)), ("31/02/2025", None), (None, None), ("soon", None)])
def test_date_from_text(spark, text, want):
    assert one(spark, c.to_date_dmy("x"), text) == want


@pytest.mark.parametrize("x, digits, want", [
    (12500.0, -3, 12000.0), (13500.0, -3, 14000.0), (12501.0, -3, 13000.0), (2.5, 0, 2.0), (3.5, 0, 4.0), (0.125, 2, 0.12)])
def test_half_even(spark, x, digits, want):
    assert one(spark, c.half_even("x", digits), x, "double") == want


@pytest.mark.parametrize("x, want", [(None, None), (-1.0, 0.0), (5.0, 5.0), (50.0, 40.0)])
def test_clamp_keeps_null(spark, x, want):
    assert one(spark, c.clamp("x", 0.0, 40.0), x, "double") == want


def test_unknown_condition_is_false_and_its_negation_true(spark):
    cond = F.col("x") > 70
    assert one(spark, c.is_true(cond), None, "double") is False
    assert one(spark, ~c.is_true(cond), None, "double") is True
    assert one(spark, c.flag(cond), None, "double") == 0


@pytest.mark.parametrize("den, want", [(4.0, 0.5), (0.0, 9.0), (-1.0, 9.0), (None, 9.0)])
def test_safe_ratio(spark, den, want):
    assert one(spark, c.safe_ratio(F.lit(2.0), "x", 9), den, "double") == want


@pytest.mark.parametrize("amount, want", [(5000, 24), (5001, 36), (15000, 36), (30000, 48), (30001, 60)])
def test_usage_hours(spark, amount, want):
    assert one(spark, c.usage_hours("x"), amount, "int") == want


@pytest.mark.parametrize("amount, want", [(0, None), (5000, "<5k"), (10000, "5k-10k"), (10001, "10k-15k"), (100001, None)])
def test_bins_are_right_closed(spark, amount, want):
    from subpanel.plans.reports import AMOUNT_EDGES_6, AMOUNT_LABELS_6
    assert one(spark, c.right_closed_bin("x", AMOUNT_EDGES_6, AMOUNT_LABELS_6), amount, "int") == want


def test_month_index_crosses_a_year(spark):
    assert one(spark, c.month_index(F.lit("202601")) - c.month_index("x"), "202512") == 1


@pytest.mark.parametrize("name, want", [("N5_202503.csv", "202503"), ("N5_20250399.csv", "202503"), ("N5.csv", None)])
def test_month_from_name(spark, name, want):
    assert one(spark, c.month_from_name("x"), name) == want


@pytest.mark.parametrize("x, want", [(28421400.0, "28421400.0"), (16098.3, "16098.3"), (0.25, "0.25")])
def test_number_text_has_no_exponent(spark, x, want):
    assert one(spark, c.number_text("x", 2), x, "double") == want


def test_sums_do_not_depend_on_order(spark):
    xs = [0.1 * i for i in range(200)] + [1e7 + 0.3]
    a = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(c.exact_sum("x")).first()[0]
    b = spark.createDataFrame([(x,) for x in reversed(xs)], "x double").repartition(7).select(c.exact_sum("x")).first()[0]
    assert a == b


def test_tenure(spark):
    assert one(spark, c.tenure_days("x", "2025-08-01"), date(2025, 7, 2), "date") == 30
    assert one(spark, c.tenure_days("x", "2025-08-01"), date(2026, 1, 1), "date") == 0
    assert one(spark, c.tenure_days("x", "2025-08-01"), None, "date") is None


def test_rounding_equals_numpy(spark):
    xs = [i * 250.0 for i in range(-40, 401)] + [12499.999, 12500.001, 0.5, 1.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", c.half_even("x", -3).alias("k"), c.half_even("x").alias("n")).collect()
    assert all(r.k == np.round(r.x, -3) and r.n == np.round(r.x, 0) for r in rows)
