"""Matrices out of the driver's tables, as long tables (var, sample, x); and their groups and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _months(ts: str) -> Column:
    return ((F.year(ts) - 1992) * 12 + F.month(ts) - 1).cast("int")


def _completed(cells: DataFrame) -> DataFrame:
    """All combinations of variables and samples that occur; a missing cell is 0."""
    keys = cells.select("var").distinct().crossJoin(cells.select("sample").distinct())
    return keys.join(cells, ["var", "sample"], "left").select("var", "sample", F.coalesce("x", F.lit(0.0)).alias("x"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables are vector positions, samples are vectors."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("int").alias("sample"), F.posexplode("embedding").alias("var", "x")).select(
        F.col("var").cast("int"), "sample", F.col("x").cast("double")
    )


def sample_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, grp: the label of each vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("sample"), F.col("label").cast("int").alias("grp"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by supplier and month."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("var"), _months("l_shipdate").alias("sample"))
    return _completed(rows.agg(F.sum("l_quantity").alias("x")))


def brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_brand").distinct()
    return names.select("p_brand", (F.row_number().over(W.orderBy("p_brand")) - 1).cast("int").alias("var"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by brand and month."""
    parts = table(spark, sf_dir, "part").join(brand_names(spark, sf_dir), "p_brand").select("p_partkey", "var")
    rows = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return _completed(rows.groupBy("var", _months("l_shipdate").alias("sample")).agg(F.sum("l_quantity").alias("x")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of events by user and day."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("int").alias("var"), F.dayofmonth("ts").alias("sample"))
    return _completed(rows.agg(F.sum("value").alias("x")))


def supplier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id (region), member (supplier), grp (nation): memberships, and groups whose own pairs are left out."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("n_regionkey").cast("int").alias("set_id"), F.col("s_suppkey").cast("int").alias("member"), F.col("n_nationkey").cast("int").alias("grp")
    )


#: The same matrices as common table expressions: m(var, sample, x).
SQL = {
    "emb": """m AS (
  SELECT CAST(i - 1 AS INTEGER) AS var, CAST(vec_id AS INTEGER) AS sample, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))""",
    "grp": "g AS (SELECT CAST(vec_id AS INTEGER) AS sample, CAST(label AS INTEGER) AS grp FROM embeddings)",
    "sup": """cells AS (
  SELECT CAST(l_suppkey AS INTEGER) AS var, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS INTEGER) AS sample, sum(l_quantity) AS x
  FROM lineitem GROUP BY 1, 2),
m AS (
  SELECT v.var, s.sample, coalesce(c.x, 0.0) AS x FROM (SELECT DISTINCT var FROM cells) v CROSS JOIN (SELECT DISTINCT sample FROM cells) s
  LEFT JOIN cells c ON c.var = v.var AND c.sample = s.sample)""",
    "brd": """names AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS var FROM (SELECT DISTINCT p_brand FROM part)),
cells AS (
  SELECT var, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS INTEGER) AS sample, sum(l_quantity) AS x
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN names USING (p_brand) GROUP BY 1, 2),
m AS (
  SELECT v.var, s.sample, coalesce(c.x, 0.0) AS x FROM (SELECT DISTINCT var FROM cells) v CROSS JOIN (SELECT DISTINCT sample FROM cells) s
  LEFT JOIN cells c ON c.var = v.var AND c.sample = s.sample)""",
    "usr": """cells AS (SELECT CAST(user_id AS INTEGER) AS var, CAST(day(ts) AS INTEGER) AS sample, sum(value) AS x FROM events GROUP BY 1, 2),
m AS (
  SELECT v.var, s.sample, coalesce(c.x, 0.0) AS x FROM (SELECT DISTINCT var FROM cells) v CROSS JOIN (SELECT DISTINCT sample FROM cells) s
  LEFT JOIN cells c ON c.var = v.var AND c.sample = s.sample)""",
    "sets": """sets AS (
  SELECT CAST(n_regionkey AS INTEGER) AS set_id, CAST(s_suppkey AS INTEGER) AS member, CAST(n_nationkey AS INTEGER) AS grp
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
}
