"""The six extracts as views over the star-schema test tables (mapping in FIXTURES.md).

Calendar years stand for months, 1996 for the first of MONTHS. Every row of the tables is read into an extract. Lines,
orders and events are read from the star, which joins them with their customers once.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subpanel.functions.columns import MONEY
from subpanel.schemas import MONTHS
from subpanel.session import parts_for
from subpanel.sources.star import Star, star

FIRST_YEAR = 1996
#: Months of the subscriber rows: the year before the first of MONTHS has orders too.
PANEL_MONTHS = [str(int(MONTHS[0]) - 1), *MONTHS]
#: Subscriber-months of one stored file or task.
MONTHS_PER_PART = 150_000


@lru_cache(maxsize=256)
def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One DataFrame per table, so that its files are listed and their schema read once."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=256)
def _rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table, from the footers of its files."""
    return _table(spark, sf_dir, name).count()


def fact_parts(spark: SparkSession, sf_dir: str) -> int:
    """Shuffle partitions for the rows of the largest table."""
    return parts_for(spark, max(_rows(spark, sf_dir, t) for t in ("lineitem", "orders", "events")))


def month_parts(spark: SparkSession, sf_dir: str) -> int:
    """Files for the subscriber-months, which are wide rows."""
    return parts_for(spark, _rows(spark, sf_dir, "customer") * len(PANEL_MONTHS), MONTHS_PER_PART)


def _month_of_year(year: Column) -> Column:
    return (F.lit(int(MONTHS[0])) + year - FIRST_YEAR).cast("string")


def _month(c: str) -> Column:
    return _month_of_year(F.year(c))


def _star(spark: SparkSession, sf_dir: str) -> Star:
    return star(spark, sf_dir, lambda name: _table(spark, sf_dir, name), fact_parts(spark, sf_dir))


def n10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriber rows, one per customer and month, dates as day/month/year text.

    Customers may all lie in one file, whose only task would sort all rows of all months. So they are dealt out first,
    by subscriber, which keeps the rows of a key together.
    """
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    if _rows(spark, sf_dir, "customer") * len(PANEL_MONTHS) > MONTHS_PER_PART:
        customer = customer.repartition(month_parts(spark, sf_dir), "c_name")
    started = F.date_add(F.lit("2021-01-01").cast("date"), ((F.col("c_custkey") * 37) % 1700).cast("int"))
    return customer.select(
        F.col("c_name").alias("isdn"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "POS").otherwise("PRE").alias("subscriber_type"),
        F.when(F.col("c_nationkey") % 5 == 0, "DEACT").otherwise("ACTIF").alias("subscriber_status"),
        F.col("c_mktsegment").alias("status_detail"),
        F.date_format(started, "dd/MM/yyyy").alias("activation_date"),
        F.date_format(F.date_add(started, 3650), "dd/MM/yyyy").alias("expire_date"),
        F.explode(F.array(*[F.lit(m) for m in PANEL_MONTHS])).alias("data_month"))


def n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARPU rows, one per order of a subscriber in a month, so several per key."""
    v = F.col("usage").cast("decimal(8,2)")
    zero = F.lit(0).cast("decimal(8,2)")
    part = lambda letter: F.sum(F.when(F.col("l_returnflag") == letter, F.col("v")).otherwise(zero))
    factor = F.when(F.col("c_custkey") % 7 == 0, 12).otherwise(1)
    sums = ["arpu_call", "arpu_sms", "arpu_data", "arpu_total"]
    # The stored lines lie by order, so its sums need no shuffle.
    order = ["isdn", "c_custkey", "l_orderkey", "year"]
    return (_star(spark, sf_dir).lines()
            .select(*order[:-1], F.year("l_shipdate").alias("year"), "l_returnflag", v.alias("v"))
            .groupBy(*order)
            .agg(part("A").alias("arpu_call"), part("R").alias("arpu_sms"),
                 part("N").alias("arpu_data"), F.sum("v").alias("arpu_total"))
            .select("isdn", _month_of_year(F.col("year")).alias("data_month"),
                    *[(F.col(c) * factor).cast(MONEY).alias(c) for c in sums]))


def n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package purchases, one per line with a known part."""
    return _star(spark, sf_dir).packages().select(
        "isdn", _month_of_year(F.col("year")).alias("data_month"), F.col("p_brand").alias("package_code"),
        (F.col("p_retailprice") * 30).alias("package_price"), F.col("p_size").alias("package_cycle"),
        F.col("renewal").alias("package_renewal_datetime"))


def n3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records."""
    sixth = F.least(F.floor((F.dayofmonth("ts") - 1) / 5), F.lit(5))  # a 31st day belongs to the last
    month = (F.lit(int(MONTHS[0])) + sixth).cast("string")
    return _star(spark, sf_dir).usage().select("isdn", month.alias("data_month"), "event_id")


def n4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advance (ut), repayment (hu) and other (oth) transactions, one per line.

    A line is booked on the payer of its customer, so all lines are read, and two thirds of the subscribers never advance.
    """
    service = F.element_at(F.array(*[F.lit(s) for s in ("EasyCredit", "ungdata247", "MBFG", "UT_SPLUS")]),
                           F.col("service") + 1)
    source = F.when(F.col("l_returnflag") == "A", "ut").when(F.col("l_returnflag") == "R", "hu").otherwise("oth")
    return (_star(spark, sf_dir).lines().where(F.col("payer").isNotNull())
            .select(F.col("payer").alias("isdn"), _month("l_shipdate").alias("data_month"),
                    F.col("l_extendedprice").alias("amount"), source.alias("source"), service.alias("advance_service_type")))


def n5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-ups."""
    return _star(spark, sf_dir).orders().select(
        "isdn", _month("o_orderdate").alias("data_month"), (F.col("o_totalprice") / 5).alias("topup_amount"),
        F.col("o_orderpriority").alias("topup_channel"))


def extracts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"N10": n10(spark, sf_dir), "N1": n1(spark, sf_dir), "N2": n2(spark, sf_dir),
            "N3": n3(spark, sf_dir), "N4": n4(spark, sf_dir), "N5": n5(spark, sf_dir)}
