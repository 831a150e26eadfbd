"""The input tables of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A table with known faults, derived from every row of customer. The same text runs in
# Spark and in the checking engine.
DIRTY_CUSTOMER_SQL = """
WITH base AS (
  SELECT c_custkey AS cust_id,
    CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'N/A'
         WHEN c_custkey % 19 = 0 THEN '  ' WHEN c_custkey % 23 = 0 THEN '' ELSE c_mktsegment END AS segment,
    CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment_case,
    CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 101 = 0 THEN c_acctbal * 1000 ELSE c_acctbal END AS balance_amount,
    CAST(CASE WHEN c_custkey % 97 = 0 THEN 200 WHEN c_custkey % 89 = 0 THEN -1 ELSE c_custkey % 90 END AS INT) AS age,
    CAST(c_custkey % 14 AS INT) AS birth_month,
    c_acctbal AS bal_a,
    c_acctbal * 2 + 1 AS bal_b,
    c_acctbal AS bal_a_copy,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS STRING) ELSE c_name END AS mixed_code,
    CAST(c_nationkey AS STRING) AS nation_text,
    CASE WHEN c_custkey % 2 = 0 THEN concat('2024-01-', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'))
         ELSE concat(lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'), '/01/2024') END AS joined_on,
    'x' AS const_flag,
    CASE WHEN c_custkey % 5 = 0 THEN c_name END AS sparse_note,
    CASE WHEN c_custkey % 50 = 0 THEN 'cafÃ©' WHEN c_custkey % 3 = 0 THEN 'male' WHEN c_custkey % 3 = 1 THEN 'ma' ELSE 'shop' END AS label
  FROM customer)
SELECT * FROM base
UNION ALL SELECT * FROM base WHERE cust_id % 40 = 0
UNION ALL SELECT CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS INT), CAST(NULL AS INT),
  CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
  CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM region WHERE r_regionkey < 2
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = DIRTY_CUSTOMER_SQL.replace("FROM customer)", "FROM {customer})").replace("FROM region ", "FROM {region} ")
    return spark.sql(text, customer=table(spark, sf_dir, "customer"), region=table(spark, sf_dir, "region"))
