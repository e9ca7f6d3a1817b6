"""Graphs made of the tables of TESTDATA.md: ``src, dst, weight``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supp_part(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers (``2 * key``) and parts (``2 * key + 1``) of the same lineitem, both ways, each pair once. No sinks."""
    p = table(spark, d, "lineitem").where("l_suppkey is not null and l_partkey is not null").select(
        (F.col("l_suppkey") * 2).alias("s"), (F.col("l_partkey") * 2 + 1).alias("p")).distinct()
    both = F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("p").alias("dst")), F.struct(F.col("p").alias("src"), F.col("s").alias("dst"))))
    return p.select(both.alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("weight"))


def user_next(spark: SparkSession, d: str) -> DataFrame:
    """From each event's user to the user of the next event in time; weight is the event's value. Parallel edges and self-loops stay.

    The next event is looked for within a day; the last of a day is followed by the first of the next day there is, so no
    task orders more than a day's events and one row per day is ordered as a whole.
    """
    e = table(spark, d, "events").select("ts", "event_id", "user_id", "value", F.to_date("ts").alias("day"))
    in_day = Window.partitionBy("day").orderBy("ts", "event_id")
    nxt = e.withColumn("dst", F.lead("user_id").over(in_day)).withColumn("last", F.lead("event_id").over(in_day).isNull())
    firsts = e.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user"))
    after = firsts.withColumn("first_next", F.lead("first_user").over(Window.orderBy("day"))).select(F.col("day").alias("d2"), "first_next")
    j = nxt.join(after, F.col("day") == F.col("d2"))
    return j.select(F.col("user_id").alias("src"), F.when(F.col("last"), F.col("first_next")).otherwise(F.col("dst")).alias("dst"), F.col("value").alias("weight")).where("dst is not null")


def nation_trade(spark: SparkSession, d: str) -> DataFrame:
    """From the customer's to the supplier's nation, one edge per pair, weighted with the price of what was sold."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("l_extendedprice").alias("weight"))


def customer_nation(spark: SparkSession, d: str) -> DataFrame:
    """Customers (``2 * key``) to nations (``2 * key + 1``), which are all sinks."""
    return table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("src"), (F.col("c_nationkey").cast("long") * 2 + 1).alias("dst"), F.lit(1.0).alias("weight"))


def vertex_edges(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``edge_with_value`` with both ends; weight is the payload where it is one number."""
    return table(spark, d, "edge_with_value").where("src is not null and dst is not null").select("src", "dst", F.col("value").try_cast("double").alias("weight"))
