"""Pairs of tables to compare, made of the sample tables by portable SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS_LEFT = """
SELECT CAST(o_orderkey AS STRING) AS o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, o_orderstatus,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS o_totalprice,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate, o_orderpriority
FROM orders"""
ORDERS_RIGHT = """
SELECT CAST(o_orderkey AS STRING) AS o_orderkey, CAST(o_custkey AS STRING) AS o_custkey,
  CASE WHEN o_orderkey % 10 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS STRING)
       WHEN o_orderkey % 13 = 0 THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(0.04 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS STRING)
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS o_totalprice,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN ''
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS o_orderdate,
  CASE WHEN o_orderkey % 11 = 0 THEN concat(' ', o_orderpriority) WHEN o_orderkey % 31 = 0 THEN 'UNKNOWN'
       ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 17 <> 3
UNION ALL
SELECT CAST(o_orderkey + 10000000 AS STRING), CAST(o_custkey AS STRING), o_orderstatus,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), CAST(CAST(o_orderdate AS DATE) AS STRING), o_orderpriority
FROM orders WHERE o_orderkey % 23 = 0"""
LINES_LEFT = """
SELECT CAST(l_orderkey AS STRING) AS l_orderkey, CAST(l_linenumber AS STRING) AS l_linenumber, CAST(l_partkey AS STRING) AS l_partkey,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS STRING) AS l_quantity, l_returnflag, l_linestatus, ord AS {order} FROM numbered_lines"""
LINES_RIGHT = """
SELECT CAST(l_orderkey AS STRING) AS l_orderkey, CAST(l_linenumber AS STRING) AS l_linenumber, CAST(l_partkey AS STRING) AS l_partkey,
  CAST(CAST(CAST(l_quantity AS DECIMAL(18,2)) + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS STRING) AS l_quantity,
  l_returnflag, CASE WHEN l_partkey % 40 = 0 THEN lower(l_linestatus) ELSE l_linestatus END AS l_linestatus,
  CASE WHEN l_orderkey % 2 = 1 THEN -ord ELSE ord END AS {order} FROM numbered_lines"""


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A unique key; case, number, date, null and blank changes; keys on one side only."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return tuple(spark.sql(q.replace("FROM orders", "FROM {orders}"), orders=orders) for q in (ORDERS_LEFT, ORDERS_RIGHT))


def lines_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Repeated keys in a known source order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("*", (F.col("_metadata.row_index") + 1).alias("ord"))
    return tuple(spark.sql(q.format(order="__source_order").replace("FROM numbered_lines", "FROM {lines}"), lines=lines) for q in (LINES_LEFT, LINES_RIGHT))
