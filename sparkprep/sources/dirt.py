"""Dirty inputs derived from the driver tables by key arithmetic.

The driver tables have no nulls, so cleaning operators are exercised on
views that inject dirt deterministically; every view is a projection (or
union) of a whole table, so it grows with the data.  Each builder has a
DuckDB SQL twin with the same rules for the oracle checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("string")
    price_txt = (F.when(k % 11 == 0, F.lit(None))
                 .when(k % 13 == 0, F.lit("unknown"))
                 .when(k % 3 == 0, F.concat(F.lit("Rs. "), price))
                 .when(k % 3 == 1, F.concat(F.lit("$"), price))
                 .otherwise(F.concat(F.lit(" "), price, F.lit(" PKR"))))
    prio = F.when(k % 7 == 0, F.lit(None)).otherwise(F.lower("o_orderpriority"))
    amt = (F.when(k % 17 == 0, F.lit(-999.0)).when(k % 19 == 0, F.lit(-5.5))
           .otherwise(F.col("o_totalprice")))
    return o.select("o_orderkey", price_txt.alias("price_txt"), prio.alias("prio"),
                    amt.alias("amt"), "o_orderdate")


def extreme_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with outliers on both sides, NaN and null in a double, and outliers in an integer."""
    o = table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    amt = (F.when(k % 31 == 0, F.lit(None)).when(k % 37 == 0, F.lit(float("nan")))
           .when(k % 41 == 0, price * 50).when(k % 43 == 0, price * -50).otherwise(price))
    qty = F.when(k % 47 == 0, F.col("o_custkey") * 50).when(k % 53 == 0, F.col("o_custkey") * -50).otherwise(F.col("o_custkey"))
    return o.select("o_orderkey", amt.alias("amt"), qty.alias("qty"), "o_orderstatus")


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    gap = (F.col("event_id") % 5).isin(0, 1)
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when(gap, F.lit(None)).otherwise(F.col("value")).alias("value"))


def gappy_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", "p_name", "p_brand", "p_type",
                    F.when(k % 14 == 0, F.lit(None)).otherwise(F.col("p_size")).alias("p_size"),
                    F.when(k % 9 == 0, F.lit(None)).otherwise(F.col("p_retailprice")).alias("p_retailprice"))


def dup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.unionByName(o.where(F.col("o_orderkey") % 10 == 0))


# DuckDB twins (CTE bodies) of the builders above.
DIRTY_ORDERS_SQL = """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL
       WHEN o_orderkey % 13 = 0 THEN 'unknown'
       WHEN o_orderkey % 3 = 0 THEN concat('Rs. ', CAST(o_totalprice AS VARCHAR))
       WHEN o_orderkey % 3 = 1 THEN concat('$', CAST(o_totalprice AS VARCHAR))
       ELSE concat(' ', CAST(o_totalprice AS VARCHAR), ' PKR') END AS price_txt,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE lower(o_orderpriority) END AS prio,
  CASE WHEN o_orderkey % 17 = 0 THEN CAST(-999 AS DOUBLE)
       WHEN o_orderkey % 19 = 0 THEN CAST(-5.5 AS DOUBLE)
       ELSE o_totalprice END AS amt,
  o_orderdate
FROM orders"""

# NaN is a missing value to the operators, so the twin has null for it.
EXTREME_ORDERS_SQL = """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN o_totalprice * 50
       WHEN o_orderkey % 43 = 0 THEN o_totalprice * -50 ELSE o_totalprice END AS amt,
  CASE WHEN o_orderkey % 47 = 0 THEN o_custkey * 50 WHEN o_orderkey % 53 = 0 THEN o_custkey * -50 ELSE o_custkey END AS qty,
  o_orderstatus
FROM orders"""

GAPPY_EVENTS_SQL = """
SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE value END AS value
FROM events"""

GAPPY_PART_SQL = """
SELECT p_partkey, p_name, p_brand, p_type,
  CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE p_size END AS p_size,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice
FROM part"""

DUP_ORDERS_SQL = """
SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0"""


def with_views(sql: str, *names: str) -> str:
    """Prefix a query with the named dirt views as CTEs."""
    bodies = {"dirty_orders": DIRTY_ORDERS_SQL, "gappy_events": GAPPY_EVENTS_SQL,
              "gappy_part": GAPPY_PART_SQL, "dup_orders": DUP_ORDERS_SQL, "extreme_orders": EXTREME_ORDERS_SQL}
    ctes = ",\n".join(f"{n} AS ({bodies[n]})" for n in names)
    body = sql.lstrip()
    if body.startswith(","):          # caller continues the WITH list
        return f"WITH {ctes}\n{body}"
    return f"WITH {ctes}\n{body}" if names else body
