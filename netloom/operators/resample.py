"""Resampling by hash, and inference on replicate tables. All draws are functions of ids, so reruns agree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def key(*parts: Column | str | int) -> Column:
    """A hash to order rows by; equal in other SQL engines: md5 of the parts joined by ~."""
    return F.md5(F.concat_ws("~", *[(F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts]))


def uniform(hash_: Column) -> Column:
    """[0, 1) from the first 7 hexadecimal digits of a hash."""
    return F.conv(F.substring(hash_, 1, 7), 16, 10).cast("double") / F.lit(float(16**7))


def cluster_columns(chips: DataFrame, draws: int) -> DataFrame:
    """draw, slot, grp, sample: groups (grp, sample) drawn with replacement, as many as there are; the
    k-th occurrence of a group in a draw takes its next sample, from a hashed start."""
    spark = chips.sparkSession
    groups = chips.groupBy("grp").agg(F.sort_array(F.collect_set("sample")).alias("samples"))
    numbered = groups.withColumn("g", F.row_number().over(W.orderBy("grp")) - 1).withColumn("n_groups", F.count("*").over(W.partitionBy()))
    slots = spark.range(1, draws + 1).select(F.col("id").cast("int").alias("draw")).crossJoin(F.broadcast(numbered.select((F.col("g") + 1).alias("slot"), "n_groups")))
    picked = slots.withColumn("g", F.floor(uniform(key("draw", "slot")) * F.col("n_groups")).cast("int")).drop("n_groups")
    picked = picked.withColumn("occ", F.row_number().over(W.partitionBy("draw", "g").orderBy("slot")) - 1)
    out = picked.join(numbered.select("g", "grp", "samples"), "g")
    n = F.size("samples")
    start = F.floor(uniform(key("draw", "grp")) * n).cast("int")
    return out.select("draw", "slot", "grp", F.element_at("samples", (F.pmod(F.col("occ") + start, n) + 1).cast("int")).alias("sample"))


def one_each(chips: DataFrame, draws: int) -> DataFrame:
    """draw, grp, sample: one sample of every group in each draw, the least by hash."""
    reps = chips.sparkSession.range(1, draws + 1).select(F.col("id").cast("int").alias("draw"))
    return chips.crossJoin(F.broadcast(reps)).groupBy("draw", "grp").agg(F.min_by("sample", key("draw", "grp", "sample")).alias("sample"))


def balanced_split(sizes: DataFrame, splits: int) -> DataFrame:
    """split, grp, half: groups (grp, n) in hash order, each to the lighter half. One task a split; groups are few."""
    reps = sizes.sparkSession.range(1, splits + 1).select(F.col("id").cast("int").alias("split"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        weight, half = [0, 0], []
        pdf = pdf.sort_values("o")
        for n in pdf.n:
            k = 0 if weight[0] <= weight[1] else 1
            weight[k] += n
            half.append(k + 1)
        return pd.DataFrame({"split": pdf.split, "grp": pdf.grp, "half": half})

    rows = sizes.crossJoin(F.broadcast(reps)).withColumn("o", key("split", "grp"))
    kind = sizes.schema["grp"].dataType.simpleString()
    return rows.groupBy("split").applyInPandas(assign, f"split int, grp {kind}, half int")


def usable_profiles(profiles: DataFrame, level: float = 1e-3) -> DataFrame:
    """Profiles (var, p, control) of perturbations that aren't controls and took effect."""
    return profiles.filter((F.col("p") < level) & ~F.col("control"))


def kept_halves(variables: DataFrame, reps: int, share: float = 0.5) -> DataFrame:
    """rep, var: that share of the variables, by hash, in every replicate."""
    spark = variables.sparkSession
    n = F.count("*").over(W.partitionBy("rep"))
    rows = variables.select("var").crossJoin(F.broadcast(spark.range(1, reps + 1).select(F.col("id").cast("int").alias("rep"))))
    at = rows.withColumn("k", F.row_number().over(W.partitionBy("rep").orderBy(key("rep", "var"), "var"))).withColumn("n", n)
    return at.filter(F.col("k") <= F.floor(F.col("n") * share)).select("rep", "var")


def jackknife(pairs: DataFrame, kept: DataFrame, metric) -> DataFrame:
    """rep and the metric's columns on pairs whose members are both kept; each variable's replicates, a row a variable, are sent to the pairs."""
    own = kept.groupBy("var").agg(F.collect_set("rep").alias("reps"))
    a, b = own.select(F.col("var").alias("i"), F.col("reps").alias("_ri")), own.select(F.col("var").alias("j"), F.col("reps").alias("_rj"))
    both = pairs.join(F.broadcast(a), "i").join(F.broadcast(b), "j")
    return metric(both.withColumn("rep", F.explode(F.array_intersect("_ri", "_rj"))).drop("_ri", "_rj"), ["rep"])


def standard_error(replicates: DataFrame, keys: list[str], value: str, factor: float = 1.0) -> DataFrame:
    """keys, mean, se (root of factor times the variance), low, high: the mean -+ 1.96 se."""
    g = replicates.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) * math.sqrt(factor)).alias("se"), F.count("*").alias("reps"))
    return g.withColumn("low", F.col("mean") - 1.96 * F.col("se")).withColumn("high", F.col("mean") + 1.96 * F.col("se"))


def delete_d(replicates: DataFrame, keys: list[str], value: str, n: int, d: int, reps: int) -> DataFrame:
    """Delete-d jackknife: the factor (n - d) / d, of keys with all replicates only."""
    full = replicates.groupBy(*keys).agg(F.count("*").alias("c")).filter(F.col("c") == reps).select(*keys)
    return standard_error(replicates.join(full, keys, "left_semi"), keys, value, (n - d) / d)


def bootstrap_median(values: DataFrame, draws: int) -> DataFrame:
    """One row: the median difference and its 95% percentile interval over resampled rows (id, d)."""
    spark = values.sparkSession
    rows = values.select((F.row_number().over(W.orderBy("id")) - 1).alias("k"), "d").withColumn("n", F.count("*").over(W.partitionBy()))
    reps = spark.range(1, draws + 1).select(F.col("id").cast("int").alias("draw"))
    picks = rows.select(F.col("k").alias("slot"), "n").crossJoin(F.broadcast(reps)).withColumn("k", F.floor(uniform(key("draw", "slot")) * F.col("n")).cast("int"))
    medians = picks.join(rows.select("k", "d"), "k").groupBy("draw").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    interval = medians.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return values.agg(F.percentile("d", F.lit(0.5)).alias("median")).crossJoin(interval)


def bootstrap_means(values: DataFrame, draws: int, by: str = "id", value: str = "d") -> DataFrame:
    """draw, m: means of resampled rows, picked by a hash of draw and slot; values have one narrow row a case."""
    rows = values.withColumn("k", F.row_number().over(W.orderBy(by)) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    reps = values.sparkSession.range(1, draws + 1).select(F.col("id").alias("draw"))
    picks = rows.select(F.col("k").alias("slot"), "n").crossJoin(F.broadcast(reps)).withColumn("k", F.floor(uniform(key("draw", "slot")) * F.col("n")).cast("int"))
    return picks.join(rows.select("k", F.col(value).alias("v")), "k").groupBy("draw").agg(F.avg("v").alias("m"))


def bca_ends(means: np.ndarray, mean: float, second: float, third: float, level: float) -> dict[str, float]:
    """The interval from the draws' means and the sums of squared and cubed deviations: leave-one-out means differ from
    the mean by what a value does, over n - 1, which goes out of the acceleration."""
    from statistics import NormalDist

    normal, means, draws = NormalDist(), np.sort(means), len(means)
    share = min(max(float((means < mean).mean()), 0.5 / draws), 1 - 0.5 / draws)
    z0 = normal.inv_cdf(share)
    a = third / (6 * max(second, 1e-300) ** 1.5)

    def ends(alpha: float) -> tuple[float, float]:
        at = [normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (normal.inv_cdf(alpha / 2), normal.inv_cdf(1 - alpha / 2))]
        return tuple(float(np.quantile(means, p)) for p in at)

    low, high = math.log(1 / draws / 10), math.log(1.0 - 1e-9)
    for _ in range(60):
        middle = (low + high) / 2
        e = ends(math.exp(middle))
        low, high = (middle, high) if e[0] <= 0 <= e[1] else (low, middle)
    e = ends(1 - level)
    return {"mean": float(mean), "low": e[0], "high": e[1], "p": math.exp((low + high) / 2)}


def bca(values: list[float], draws: int = 2000, level: float = 0.95, seed: int = 1) -> dict[str, float]:
    """Mean, bias-corrected accelerated interval, and the p-value at which the interval meets 0, of a few values."""
    x = np.asarray(values, float)
    means = x[np.random.default_rng(seed).integers(0, len(x), (draws, len(x)))].mean(axis=1)
    dev = x - x.mean()
    return bca_ends(means, x.mean(), (dev**2).sum(), (dev**3).sum(), level)


def bca_interval(values: DataFrame, draws: int = 2000, level: float = 0.95, by: str = "id", value: str = "d") -> DataFrame:
    """mean, low, high, p of a column: means of draws and moments are aggregates, a number a draw is on the driver."""
    means = np.array([r["m"] for r in bootstrap_means(values, draws, by, value).select("m").collect()])  # a number a draw
    mean = values.agg(F.avg(value)).first()[0]
    dev = F.col(value) - mean
    second, third = values.agg(F.sum(dev * dev), F.sum(dev * dev * dev)).first()
    found = bca_ends(means, mean, second, third, level)
    return values.sparkSession.createDataFrame([tuple(found.values())], "mean double, low double, high double, p double")


def signed_rank(values: DataFrame, keys: list[str], value: str = "d") -> DataFrame:
    """keys, n, w (sum of ranks of positive differences), z (normal approximation with ties), n_up."""
    d = values.filter(F.round(value, 12) != 0).withColumn("a", F.round(F.abs(value), 12))
    rank = F.rank().over(W.partitionBy(*keys).orderBy("a")) + (F.count("*").over(W.partitionBy(*keys, "a")) - 1) / 2.0
    r = d.withColumn("r", rank).withColumn("t", F.count("*").over(W.partitionBy(*keys, "a")))
    g = r.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col(value) > 0, F.col("r")).otherwise(0.0)).alias("w"),
        F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"),
        F.sum(F.when(F.col(value) > 0, 1).otherwise(0)).cast("long").alias("n_up"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return g.select(*keys, "n", "w", ((F.col("w") - n * (n + 1) / 4) / F.sqrt(variance)).alias("z"), "n_up")


def signed_rank_exact(d: list[float]) -> float:
    """Two-sided exact p-value of the signed-rank statistic for up to 25 different non-zero differences."""
    x = [v for v in d if v]
    if len(x) > 25:
        raise ValueError("at most 25 differences")
    order = sorted(range(len(x)), key=lambda k: abs(x[k]))
    w = sum(r + 1 for r, k in enumerate(order) if x[k] > 0)
    ways = {0: 1}
    for r in range(1, len(x) + 1):
        more: dict[int, int] = dict(ways)
        for s, n in ways.items():
            more[s + r] = more.get(s + r, 0) + n
        ways = more
    total = 2 ** len(x)
    below = sum(n for s, n in ways.items() if s <= w) / total
    over = sum(n for s, n in ways.items() if s >= w) / total
    return min(1.0, 2 * min(below, over))


def holm(ps: DataFrame, keys: list[str], family: int | None = None) -> DataFrame:
    """ps (id, p) with adjusted p by Holm; a fixed family size counts missing tests."""
    w = W.partitionBy(*keys).orderBy("p", "id")
    n = F.count("*").over(W.partitionBy(*keys)) if family is None else F.lit(family)
    at = ps.withColumn("raw", F.least(F.lit(1.0), F.col("p") * (n - F.row_number().over(w) + 1)))
    return at.withColumn("adjusted", F.max("raw").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("raw")


def benjamini_hochberg(ps: DataFrame, keys: list[str], family: int | None = None) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("p", "id")
    n = F.count("*").over(W.partitionBy(*keys)) if family is None else F.lit(family)
    at = ps.withColumn("rank", F.row_number().over(w)).withColumn("raw", F.least(F.lit(1.0), F.col("p") * n / F.col("rank")))
    return at.withColumn("adjusted", F.min("raw").over(W.partitionBy(*keys).orderBy(F.col("rank").desc()).rowsBetween(W.unboundedPreceding, 0))).drop("raw", "rank")


def shapley(values: DataFrame, n: int) -> DataFrame:
    """component, shapley, drop_one of a game over subsets (s: bits, v): exact, from all 2^n subsets."""
    spark: SparkSession = values.sparkSession
    parts = spark.range(n).select(F.col("id").cast("int").alias("component"))
    without = values.crossJoin(F.broadcast(parts)).filter(F.expr("(s & shiftleft(1, component)) = 0"))
    joined = without.select("component", "s", "v", F.expr("s + shiftleft(1, component)").alias("t")).join(
        values.select(F.col("s").alias("t"), F.col("v").alias("vt")), "t"
    )
    size = F.bit_count("s")
    weight = F.factorial(size).cast("double") * F.factorial(F.lit(n - 1) - size) / math.factorial(n)
    full = (1 << n) - 1
    return joined.groupBy("component").agg(
        F.sum(weight * (F.col("vt") - F.col("v"))).alias("shapley"), F.max(F.when(F.col("t") == full, F.col("vt") - F.col("v"))).alias("drop_one")
    )


def two_sided_p(z: Column) -> Column:
    """Of a normal deviate; absolute error below 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def unstable(replicates: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """keys, unstable: whether fewer than `least` replicates have a value."""
    return replicates.groupBy(*keys).agg((F.count(value) < least).alias("unstable"))
