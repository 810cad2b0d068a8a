"""The star of lines, orders and customers, joined once and stored by customer.

All extracts of lines and orders are projections of these stored tables, so the large tables are scanned and shuffled
for their joins once. A customer may own a large share of all orders. Such customers are found first (fewer than there
are partitions, whatever the data), their rows get one of several salts, and orders and events are cut by customer and
salt. So no join task and no file holds a whole hot customer, and a reduction by customer and month adds up partial sums
of the salts: first within each file, then over the files. Orders, events and lines stay where their joins put them, cut by
customer and salt, or by order, which has few lines: storing them needs no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subpanel.session import shuffling_into, work_dir
from subpanel.sources import tables
from subpanel.sources.tables import ROWS_PER_FILE, kept

SALT = "_salt"


def hot_keys(fact: DataFrame, key: str, parts: int) -> DataFrame:
    """Keys with more than 1/parts of all rows, and the number of salts that brings each below: fewer than `parts` rows."""
    total = fact.agg(F.count(F.lit(1))).scalar()
    counts = fact.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") * parts > total).select("_hot", F.ceil(F.col("_n") * parts / total).cast("int").alias("_salts"))


def salted_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, spread: str, parts: int) -> DataFrame:
    """Rows of both sides with equal keys, and the salt of the fact's row. `dim` holds each key once.

    Rows of a hot key are dealt to its salts by a hash of `spread`, and its row of `dim` is repeated for each. The list
    of hot keys has fewer than `parts` rows, so it is broadcast.
    """
    hot = F.broadcast(hot_keys(fact, fact_key, parts))
    left = (fact.join(hot, F.col(fact_key) == F.col("_hot"), "left")
            .withColumn(SALT, F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))).drop("_hot", "_salts"))
    right = (dim.join(hot, F.col(dim_key) == F.col("_hot"), "left")
             .withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hot", "_salts"))
    return left.join(right, (F.col(fact_key) == F.col(dim_key)) & (F.col(SALT) == F.col("_dim_salt"))).drop("_dim_salt")


def customers(customer: DataFrame) -> DataFrame:
    """Key, id and payer's id of each customer. The payer is the nearest smaller key that 3 divides, or 3; null if absent."""
    rows = customer.select("c_custkey", F.col("c_name").alias("isdn"))
    payers = rows.select(F.col("c_custkey").alias("_payer_key"), F.col("isdn").alias("payer"))
    payer = F.greatest(F.col("c_custkey") - F.col("c_custkey") % 3, F.lit(3))
    return rows.join(payers, payer == F.col("_payer_key"), "left").drop("_payer_key")


def _under_join_key(joined: DataFrame, fact_key: str) -> DataFrame:
    """The customer's key as the fact had it: with the salt, the rows are already cut by it, so storing them needs no shuffle."""
    return joined.drop("c_custkey").withColumnRenamed(fact_key, "c_custkey")


def booked_orders(orders: DataFrame, customer: DataFrame, parts: int) -> DataFrame:
    rows = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    return _under_join_key(salted_join(rows, customers(customer), "o_custkey", "c_custkey", "o_orderkey", parts), "o_custkey")


def repeated_parts(part: DataFrame) -> DataFrame:
    """Parts that have several rows, and how many: mostly none."""
    return (part.where(F.col("p_partkey").isNotNull()).groupBy("p_partkey").agg(F.count(F.lit(1)).cast("int").alias("_rows"))
            .where(F.col("_rows") > 1))


def booked_lines(lineitem: DataFrame, booked: DataFrame, repeats: DataFrame) -> DataFrame:
    """Lines with their customer and payer, usage (quantity x discount x 1000) and service (0 to 3, by supplier).

    An order has few lines, so the join with orders has no hot key, and it leaves the lines of an order together. Columns
    of parts are left to the one extract that reads them (`packages`), whose rows are far narrower. A line counts once
    per row of its part in the other extracts too: `copy` numbers these from 1.
    """
    lines = lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate",
                            (F.col("l_quantity") * F.col("l_discount") * 1000).alias("usage"),
                            (F.col("l_suppkey") % 4).cast("int").alias("service"))
    owner = booked.select("o_orderkey", "c_custkey", "isdn", "payer")
    return (lines.join(repeats, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")
            .join(owner, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("_rows", F.lit(1))))).drop("_rows"))


def packages(lines: DataFrame, part: DataFrame) -> DataFrame:
    """Lines with a known part: customer, year, renewal (the day of an open line), brand, price and size.

    What the lines give is worked out before the join, so that narrow rows are moved.
    """
    rows = lines.where(F.col("copy") == 1).select(
        "l_partkey", "isdn", F.year("l_shipdate").alias("year"), F.when(F.col("l_linestatus") == "O", F.col("l_shipdate")).alias("renewal"))
    parts = part.select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def booked_usage(events: DataFrame, customer: DataFrame, parts: int) -> DataFrame:
    rows = events.select("event_id", "ts", "user_id")
    return _under_join_key(salted_join(rows, customers(customer).drop("payer"), "user_id", "c_custkey", "event_id", parts), "user_id")


class Star:
    """The stored tables of one data folder, each built on first use: orders and events cut by customer and salt, lines by
    order, all into `parts` files, which is also what their joins shuffle into; packages as their join leaves them."""

    def __init__(self, spark: SparkSession, read: Callable[[str], DataFrame], path: str, parts: int):
        self.spark, self.read, self.path, self.parts = spark, read, path, parts
        self._done: dict[str, DataFrame] = {}

    def _stored(self, name: str, build: Callable[[], DataFrame], keys: Sequence[str] = ("c_custkey", SALT)) -> DataFrame:
        if name not in self._done:
            path = f"{self.path}/{name}"
            table = f"subpanel_{hashlib.sha256(path.encode()).hexdigest()[:24]}_{name}"
            with shuffling_into(self.spark, self.parts):
                self._done[name] = tables.write_bucketed(build(), path, table, keys, self.parts, spread=True)
        return self._done[name]

    def orders(self) -> DataFrame:
        return self._stored("booked_orders", lambda: booked_orders(self.read("orders"), self.read("customer"), self.parts))

    def lines(self) -> DataFrame:
        return self._stored("booked_lines", lambda: booked_lines(
            self.read("lineitem"), self.orders(), kept(repeated_parts(self.read("part")), "repeated_parts")), ["l_orderkey"])

    def packages(self) -> DataFrame:
        if "packages" not in self._done:
            lines = self.lines()
            with shuffling_into(self.spark, self.parts):
                self._done["packages"] = kept(packages(lines, self.read("part")), "packages", "zstd", ROWS_PER_FILE)
        return self._done["packages"]

    def usage(self) -> DataFrame:
        return self._stored("booked_usage", lambda: booked_usage(self.read("events"), self.read("customer"), self.parts))


_stars: dict[tuple[str, str], Star] = {}


def star(spark: SparkSession, sf_dir: str, read: Callable[[str], DataFrame], parts: int) -> Star:
    """The star of a data folder, kept for the session; cut into `parts` files."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stars:
        path = f"{work_dir(spark)}/star-{hashlib.sha256(sf_dir.encode()).hexdigest()[:24]}"
        _stars[key] = Star(spark, read, path, parts)
    return _stars[key]
