"""Bin counts for variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 5, 50


def clamped(n: Column, low: int = LOW, high: int = HIGH) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), n)).cast("int")


def sturges(n: Column) -> Column:
    return F.ceil(F.log2(n)) + 1


def per_variable(m: DataFrame, rule: str = "fd", low: int = LOW, high: int = HIGH) -> DataFrame:
    """var, nb by the rule "fd" (Freedman-Diaconis), "scott" or "sturges".

    Without a spread (no range, or bin width 0) the count is Sturges'.
    """
    s = m.groupBy("var").agg(
        F.count("*").alias("n"),
        (F.max("x") - F.min("x")).alias("span"),
        F.stddev_samp("x").alias("sd"),
        (F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"),
    )
    width = {"fd": 2 * F.col("iqr"), "scott": 3.5 * F.col("sd"), "sturges": F.lit(None).cast("double")}[rule] * F.pow("n", F.lit(-1.0 / 3))
    count = F.when((width > 0) & (F.col("span") > 0), F.ceil(F.col("span") / width)).otherwise(sturges(F.col("n")))
    return s.select("var", clamped(count, low, high).alias("nb"))


def common(m: DataFrame, rule: str, low: int = LOW, high: int = HIGH) -> DataFrame:
    """var, nb: the same count for all, the median of the rule's, halves to even; "scott2d" uses its own width."""
    if rule == "scott2d":
        s = m.groupBy("var").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("span"), F.stddev_samp("x").alias("sd"))
        width = 3.5 * F.col("sd") * F.pow("n", F.lit(-0.25))
        counts = s.select("var", F.when(width > 0, F.ceil(F.col("span") / width)).otherwise(sturges(F.col("n"))).cast("double").alias("nb"))
    else:
        counts = per_variable(m, rule, low, high)
    one = counts.agg(clamped(F.bround(F.percentile("nb", F.lit(0.5)), 0), low, high).alias("nb"))
    return counts.select("var").crossJoin(F.broadcast(one))


def joint(m: DataFrame) -> DataFrame:
    """var, nb: the count at which all cells of a pair's table are well filled, from the samples alone."""
    n = F.count("*").cast("double")
    return m.groupBy("var").agg(F.greatest(F.lit(5), F.bround(F.sqrt((1 + F.sqrt(1 + 24 * n)) / 2), 0)).cast("int").alias("nb"))


def fixed(m: DataFrame, nb: int) -> DataFrame:
    if nb < 2:
        raise ValueError("at least 2 bins")
    return m.select("var").distinct().withColumn("nb", F.lit(nb))


def counts(m: DataFrame, rule: str | int = "hg") -> DataFrame:
    if isinstance(rule, int):
        return fixed(m, rule)
    if rule == "hg":
        return joint(m)
    if rule.startswith("median-"):
        return common(m, rule.removeprefix("median-"))
    return common(m, rule) if rule == "scott2d" else per_variable(m, rule)
