"""Sparse row-stochastic operators (src, dst, w) from scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.numeric import ordered, perplexity_weights
from netloom.operators.calibrate import symmetric
from netloom.sources.store import kept


def top_k(scores: DataFrame, k: int, value: str = "score", digits: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, src, dst, w: the k largest positive scores of each row (to `digits`); ties to the smaller dst."""
    both = symmetric(scores, value, keys).filter(F.col(value) > 0)
    rank = F.row_number().over(W.partitionBy(*keys, "src").orderBy(ordered(F.col(value), digits).desc(), "dst"))
    return both.withColumn("k", rank).filter(F.col("k") <= k).select(*keys, "src", "dst", F.col(value).alias("w"))


def contenders(scores: DataFrame, k: int, value: str = "score", digits: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The pairs that can be among the k largest positive scores (to `digits`) of a row of either member, in one more pass over the scores.

    A row's partners are put into parts by hash; its k-th largest of the parts' largest scores is no more than its k-th largest score.
    """
    own = scores.withColumn("_v", ordered(F.col(value), digits))
    part = F.pmod(F.hash("dst"), F.lit(4 * k))
    most = symmetric(own, "_v", keys).groupBy(*keys, "src", part.alias("part")).agg(F.max("_v").alias("most")).groupBy(*keys, "src").agg(F.sort_array(F.collect_list("most"), False).alias("most"))
    least = kept(most.select(*keys, "src", F.coalesce(F.get("most", F.lit(k - 1)), F.lit(0.0)).alias("least")))
    a, b = (F.broadcast(least.select(*keys, F.col("src").alias(n), F.col("least").alias(f"_least_{n}"))) for n in ("i", "j"))
    reach = (F.col("_v") >= F.col("_least_i")) | (F.col("_v") >= F.col("_least_j"))
    return own.join(a, [*keys, "i"]).join(b, [*keys, "j"]).filter((F.col(value) > 0) & reach).select(*scores.columns)


def above(scores: DataFrame, tau: float, value: str = "score") -> DataFrame:
    """src, dst, w of scores that reach tau."""
    if tau < 0:
        raise ValueError("tau is 0 or more")
    return symmetric(scores, value).filter((F.col(value) >= tau) & (F.col(value) > 0)).select("src", "dst", F.col(value).alias("w"))


def of_edges(scores: DataFrame, edges: DataFrame, value: str = "score") -> DataFrame:
    """src, dst, w of the selected pairs; a score of 0 has no weight."""
    return symmetric(scores.join(edges.select("i", "j"), ["i", "j"], "left_semi").filter(F.col(value) > 0), value).withColumnRenamed(value, "w")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("src", "dst").agg(F.max("w").alias("w"))


def softmax(scores: DataFrame, keff: float | Column = 10.0, cap: int = 50, value: str = "score", digits: int | None = None) -> DataFrame:
    """src, dst, w: softmax over each row's cap largest positive scores, at the temperature of perplexity keff."""
    if isinstance(keff, (int, float)) and keff <= 1:
        raise ValueError("keff is above 1")
    top = top_k(scores, cap, value, digits)
    rows = top.groupBy("src").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), "dst", "w"))).alias("own"))
    weights = rows.select("src", F.col("own.dst").alias("dst"), perplexity_weights(F.col("own.w"), keff).alias("w"))
    return weights.select("src", F.explode(F.arrays_zip("dst", "w")).alias("e")).select("src", "e.dst", "e.w")


def softmax_at(scores: DataFrame, tau: float, cap: int = 50, value: str = "score", digits: int | None = None) -> DataFrame:
    """src, dst, w: softmax at one temperature."""
    top = top_k(scores, cap, value, digits)
    e = F.exp((F.col("w") - F.max("w").over(W.partitionBy("src"))) / tau)
    return top.withColumn("w", e).withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("src")))


def normalised(a: DataFrame, variables: DataFrame | None = None, self_loops: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows that add up to 1; with self_loops a variable (keys, var) without weights gets one of itself."""
    rows = a.filter("w > 0").withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy(*keys, "src")))
    if not self_loops or variables is None:
        return rows
    lone = variables.select(*keys, F.col("var").alias("src")).join(rows.select(*keys, "src").distinct(), [*keys, "src"], "left_anti")
    return rows.select(*keys, "src", "dst", "w").unionByName(lone.select(*keys, "src", F.col("src").alias("dst"), F.lit(1.0).alias("w")))


def external(a: DataFrame) -> DataFrame:
    """An operator from elsewhere: weights must be finite and not negative."""
    bad = F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0) | (F.col("w") == float("inf"))
    if a.filter(bad).limit(1).count():
        raise ValueError("an operator's weights are finite and not negative")
    return a.select("src", "dst", "w")


def block(scores: DataFrame, variables: list[int], value: str = "score") -> DataFrame:
    """src, dst, value among the given variables."""
    return symmetric(scores.filter(F.col("i").isin(variables) & F.col("j").isin(variables)), value)


def perplexity(a: DataFrame) -> DataFrame:
    return a.filter("w > 0").groupBy("src").agg(F.exp(-F.sum(F.col("w") * F.ln("w"))).alias("perplexity"))


def statistics(a: DataFrame, variables: DataFrame, correlations: DataFrame) -> DataFrame:
    """One row: directed edges, mean out-degree, variables with a self-loop only, share of edges with negative correlation."""
    edges = a.filter("src <> dst")
    r = symmetric(correlations, "r")
    signs = edges.join(r, ["src", "dst"]).agg(F.avg((F.col("r") < 0).cast("double")).alias("negative_share"))
    degree = variables.select(F.col("var").alias("src")).join(edges.groupBy("src").agg(F.count("*").alias("d")), "src", "left")
    return degree.agg(
        F.sum(F.coalesce("d", F.lit(0))).alias("edges"),
        F.avg(F.coalesce("d", F.lit(0)).cast("double")).alias("mean_degree"),
        F.sum(F.when(F.col("d").isNull(), 1).otherwise(0)).cast("long").alias("isolated"),
    ).crossJoin(signs)


def heads(scores: DataFrame, keffs: tuple[float, ...] = (3, 10, 30), cap: int = 50, value: str = "score", digits: int | None = None) -> DataFrame:
    """head, src, dst, w: an operator for each perplexity."""
    out = None
    for k in keffs:
        own = softmax(scores, k, cap, value, digits).withColumn("head", F.lit(float(k)))
        out = own if out is None else out.unionByName(own)
    return out


def symmetric_max(a: DataFrame) -> DataFrame:
    """i, j, w of directed weights, the larger of both directions."""
    return a.filter("src <> dst").groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.max("w").alias("w"))
