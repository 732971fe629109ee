"""Calibration of pair values against the backgrounds of both members."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symmetric(edges: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Both directions of each pair: keys, src, dst, value; one pass over the pairs."""
    ways = F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst")))
    return edges.select(*keys, F.inline(ways), value)


def combined(a: Column, b: Column, how: str) -> Column:
    if how == "stouffer":
        return (a + b) / F.sqrt(F.lit(2.0))
    if how == "euclidean":
        return F.sqrt(a * a + b * b)
    raise ValueError("combine is stouffer or euclidean")


def backgrounds(edges: DataFrame, value: str = "mi", keys: tuple[str, ...] = ()) -> DataFrame:
    """src, mu, sd of each variable's values, its own counted as one 0."""
    both = edges.select(*keys, F.explode(F.array("i", "j")).alias("src"), value)  # one pass over the pairs
    s = both.groupBy(*keys, "src").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"), (F.count("*") + 1).alias("n"))
    mu = F.col("s") / F.col("n")
    return s.select(*keys, "src", mu.alias("mu"), F.sqrt(F.greatest(F.col("ss") - F.col("n") * mu * mu, F.lit(0.0)) / (F.col("n") - 1)).alias("sd"))


def calibrated(edges: DataFrame, value: str = "mi", combine: str = "stouffer", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, i, j, value, score: both members' z-scores of the value, below 0 clipped, combined. Backgrounds, a row a variable, are sent to the pairs."""
    g = backgrounds(edges, value, keys)
    gi = g.select(*keys, F.col("src").alias("i"), F.col("mu").alias("mu_i"), F.col("sd").alias("sd_i"))
    gj = g.select(*keys, F.col("src").alias("j"), F.col("mu").alias("mu_j"), F.col("sd").alias("sd_j"))
    z = lambda k: F.greatest(F.when(F.col(f"sd_{k}") > 0, (F.col(value) - F.col(f"mu_{k}")) / F.col(f"sd_{k}")).otherwise(0.0), F.lit(0.0))
    rows = edges.join(F.broadcast(gi), [*keys, "i"]).join(F.broadcast(gj), [*keys, "j"])
    return rows.select(*keys, "i", "j", value, combined(z("i"), z("j"), combine).alias("score"))


def rayleigh(edges: DataFrame, self_values: DataFrame, value: str = "mi") -> DataFrame:
    """i, j, score: a + b - ab of the Rayleigh distributions of both rows, a variable's own value included."""
    own = self_values.select(F.col("var").alias("src"), F.col("self_mi").alias(value))
    rows = symmetric(edges, value).select("src", value).unionByName(own)
    g = rows.groupBy("src").agg((F.avg(F.col(value) * F.col(value)) / 2).alias("s2"))
    gi, gj = g.select(F.col("src").alias("i"), F.col("s2").alias("si")), g.select(F.col("src").alias("j"), F.col("s2").alias("sj"))
    f = lambda k: F.when(F.col(k) > 0, 1 - F.exp(-F.col(value) * F.col(value) / (2 * F.col(k)))).otherwise(0.0)
    return edges.join(gi, "i").join(gj, "j").select("i", "j", (f("si") + f("sj") - f("si") * f("sj")).alias("score"))


def kde(edges: DataFrame, self_values: DataFrame, value: str = "mi", grid: int = 1000) -> DataFrame:
    """i, j, score: summed logs of both rows' cumulative kernel densities, a variable's own value included."""
    rows = symmetric(edges, value).unionByName(self_values.select(F.col("var").alias("src"), F.col("var").alias("dst"), F.col("self_mi").alias(value)))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[value].to_numpy()
        sd, iqr = v.std(ddof=1), np.subtract(*np.percentile(v, [75, 25]))
        spread = min(sd, iqr / 1.34) or sd or abs(v[0]) or 1.0
        h = 0.9 * spread * len(v) ** -0.2
        at = np.linspace(v.min(), v.max(), grid)
        density = np.exp(-0.5 * ((at[:, None] - v[None, :]) / h) ** 2).sum(axis=1)
        total = np.cumsum(density) / density.sum()
        where = np.minimum(np.searchsorted(at, v, "left"), grid - 1)
        return pd.DataFrame({"src": pdf.src, "dst": pdf.dst, "f": total[where]})

    f = rows.groupBy("src").applyInPandas(own, "src int, dst int, f double")
    a = f.filter("src < dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("f").alias("fi"))
    b = f.filter("src > dst").select(F.col("dst").alias("i"), F.col("src").alias("j"), F.col("f").alias("fj"))
    score = F.ln("fi") + F.ln("fj")
    return a.join(b, ["i", "j"]).select("i", "j", F.when(score.isNull() | (score > 0) | (score == float("-inf")), 0.0).otherwise(score).alias("score"))


def calibrate(edges: DataFrame, method: str = "normal", combine: str | None = None, value: str = "mi", self_values: DataFrame | None = None) -> DataFrame:
    """Scores of pairs by the method "normal", "rayleigh" or "kde"; only "normal" combines in ways of choice."""
    if method == "normal":
        return calibrated(edges, value, combine or "stouffer")
    if combine is not None:
        raise ValueError("combine is for the normal method only")
    if self_values is None:
        raise ValueError(f"{method} needs the variables' own values")
    return {"rayleigh": rayleigh, "kde": kde}[method](edges, self_values, value)


def averaged(edges: DataFrame, score: str = "score") -> DataFrame:
    """Mean score of pairs over replicates."""
    return edges.groupBy("i", "j").agg(F.avg(score).alias(score))
