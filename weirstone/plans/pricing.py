"""The pricing queries: a summary by flag and status, and the revenue of a three-way predicate over narrow and wide rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.plans.tables import table


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price, off, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    disc = price * (1 - off)
    return (
        rows.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(price), 2).alias("sum_base_price"),
            F.round(F.sum(disc), 2).alias("sum_disc_price"),
            F.round(F.sum(disc * (1 + tax)), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg(price), 4).alias("avg_price"),
            F.round(F.avg(off), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


PRICING_SUMMARY = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
"""


def _revenue(rows: DataFrame) -> DataFrame:
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    wanted = (F.col("l_shipdate") >= day("1995-01-01")) & (F.col("l_shipdate") < day("1996-01-01")) & F.col("l_discount").between(0.0499, 0.0701) & (F.col("l_quantity") < 24)
    return rows.where(wanted).agg(F.round(F.coalesce(F.sum(F.col("l_extendedprice") * F.col("l_discount")), F.lit(0.0)), 2).alias("revenue"))


def revenue(spark: SparkSession, folder: str) -> DataFrame:
    return _revenue(table(spark, folder, "lineitem"))


def revenue_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The same over rows with eighteen more columns, none of which is needed."""
    extra = {}
    for k in range(6):
        extra |= {f"junk_i64_{k}": F.col("l_orderkey") + k, f"junk_f64_{k}": F.col("l_tax") * k, f"junk_bool_{k}": F.col("l_linenumber") % 2 == k % 2}
    return _revenue(table(spark, folder, "lineitem").withColumns(extra))


REVENUE = """
SELECT round(coalesce(sum(l_extendedprice * l_discount), 0.0), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.0499 AND 0.0701 AND l_quantity < 24
"""

QUERIES = {"q1_pricing_summary": pricing_summary, "q6_revenue": revenue, "q6_revenue_wide": revenue_wide}
ORACLES = {"q1_pricing_summary": PRICING_SUMMARY, "q6_revenue": REVENUE, "q6_revenue_wide": REVENUE}
