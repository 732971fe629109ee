"""Permutation null of pair values, and selection of pairs by false discovery rate or higher criticism."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators import dependence
from netloom.operators.calibrate import calibrated
from netloom.operators.transform import shuffled
from netloom.sources.store import kept

NBINS = 20_000


def checked(n_vars: int, b: int, q: float, method: str, level: float, alpha0: float) -> None:
    if n_vars < 4:
        raise ValueError("at least 4 variables")
    if b < (2 if method == "hc" else 1):
        raise ValueError("too few replicates")
    if not (0 < q < 1 and 0 < level < 1 and 0 < alpha0 <= 1):
        raise ValueError("q and level lie between 0 and 1, alpha0 above 0 up to 1")
    if method not in ("fdr", "hc"):
        raise ValueError("method is fdr or hc")
    if method == "hc" and (b + 1) * level < 1:
        warnings.warn("too few replicates for this level", stacklevel=2)


def replicates(m: DataFrame, b: int) -> DataFrame:
    """rep, var, sample, x: each replicate shuffles every variable by itself, in hash order."""
    reps = m.sparkSession.range(1, b + 1).select(F.col("id").cast("int").alias("rep"))
    return shuffled(m.crossJoin(F.broadcast(reps)), F.col("rep"))


def null_values(m: DataFrame, nb: DataFrame, b: int, order: int = 3, statistic: str = "clr") -> DataFrame:
    """rep, i, j, v: the statistic of all pairs in each replicate, with the observed bin counts."""
    edges = dependence.block_mi(replicates(m, b), nb, order, keys=("rep",))
    if statistic == "mi":
        return edges.select("rep", "i", "j", F.col("mi").alias("v"))
    return calibrated(edges, "mi", keys=("rep",)).select("rep", "i", "j", F.col("score").alias("v"))


def top_of(values: DataFrame) -> float:
    """Upper end of the histogram: 1.25 times the greatest value of the first replicate."""
    return max(1e-8, 1.25 * (values.filter("rep = 1").agg(F.max("v")).first()[0] or 0.0))


def bin_of(v: str, hi: float, nbins: int = NBINS, hair: float = 0.0) -> Column:
    """0 to nbins; the last holds what is beyond. The greatest value of the first replicate lies on an
    edge by construction; where engines have to agree on it, a hair is added before rounding down."""
    return F.greatest(F.lit(0), F.least(F.floor(F.col(v) / (hi / nbins) + hair), F.lit(nbins))).cast("int")


def histogram(values: DataFrame, hi: float, nbins: int = NBINS, hair: float = 0.0) -> DataFrame:
    """rep, bin, n: mergeable counts."""
    return values.groupBy("rep", bin_of("v", hi, nbins, hair).alias("bin")).agg(F.count("*").alias("n"))


def survival(hist: DataFrame, nbins: int = NBINS) -> DataFrame:
    """bin, suf: null values in the bin or above, for every bin."""
    spark = hist.sparkSession
    every = spark.range(0, nbins + 1).select(F.col("id").cast("int").alias("bin"))
    counts = every.join(hist.groupBy("bin").agg(F.sum("n").alias("n")), "bin", "left")
    # a fixed number of bins, so one task sums them up
    up = W.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    return counts.select("bin", F.sum(F.coalesce("n", F.lit(0))).over(up).alias("suf"))


def pvalues(scores: DataFrame, suf: DataFrame, hi: float, value: str = "score", nbins: int = NBINS, hair: float = 0.0) -> DataFrame:
    """scores with p: (1 + null values in the score's bin or above) / (1 + null values)."""
    total = suf.filter("bin = 0").select(F.col("suf").alias("n_null"))
    at = scores.withColumn("bin", bin_of(value, hi, nbins, hair)).join(F.broadcast(suf), "bin").crossJoin(F.broadcast(total))
    return at.withColumn("p", (1.0 + F.col("suf")) / (1.0 + F.col("n_null"))).drop("bin", "suf", "n_null")


def bh_cutoff(ps: DataFrame, q: float = 0.05, value: str = "score", m: int | None = None) -> DataFrame:
    """One row (tau): the least score of those up to the largest p with p <= i q / m; infinite if none.

    Ranks come from counts per distinct p, of which there are no more than bins.
    """
    blocks = ps.groupBy("p").agg(F.count("*").alias("n"), F.min(value).alias("low"))
    upto = W.orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    all_ = F.sum("n").over(W.partitionBy()) if m is None else F.lit(m)
    at = blocks.withColumn("i", F.sum("n").over(upto)).withColumn("least", F.min("low").over(upto)).withColumn("m", all_)
    passed = at.filter(F.col("p") <= F.col("i") * q / F.col("m"))
    return passed.agg(F.coalesce(F.min_by("least", -F.col("p")), F.lit(float("inf"))).alias("tau"))


def selected(scores: DataFrame, tau: DataFrame, value: str = "score") -> DataFrame:
    """Edges: pairs whose value reaches tau (one row)."""
    return scores.crossJoin(F.broadcast(tau)).filter(F.col(value) >= F.col("tau")).drop("tau")


def hc_curve(observed: DataFrame, suf: DataFrame, hi: float, alpha0: float = 0.1, value: str = "score", nbins: int = NBINS, hair: float = 0.0) -> DataFrame:
    """bin, i, p, hc of the candidate bins: i observed values in the bin or above, p their null share."""
    counts = observed.groupBy(bin_of(value, hi, nbins, hair).alias("bin")).agg(F.count("*").alias("n"))
    up = W.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    m = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy())
    at = suf.join(counts, "bin", "left").withColumn("i", F.sum(F.coalesce("n", F.lit(0))).over(up)).withColumn("m", m)
    total = suf.filter("bin = 0").select(F.col("suf").alias("n_null"))
    at = at.crossJoin(F.broadcast(total)).withColumn("p", (1.0 + F.col("suf")) / (1.0 + F.col("n_null")))
    fits = at.filter((F.col("i") >= 1) & (F.col("i") <= F.greatest(alpha0 * F.col("m"), F.lit(10.0))) & (F.col("p") < 1))
    hc = F.sqrt(F.col("m").cast("double")) * (F.col("i") / F.col("m") - F.col("p")) / F.sqrt(F.col("p") * (1 - F.col("p")))
    return fits.select("bin", "i", "p", hc.alias("hc"))


def hc_threshold(curve: DataFrame, hi: float, nbins: int = NBINS) -> DataFrame:
    """One row (hc, tau): the first maximum and the lower edge of its bin."""
    best = curve.agg(F.max_by(F.struct("hc", "bin"), F.struct(F.round("hc", 9), -F.col("bin"))).alias("b"))
    return best.select(F.col("b.hc").alias("hc"), (F.col("b.bin") * (hi / nbins)).alias("tau"))


def hc_gate(values: DataFrame, hi: float, b: int, level: float = 0.05, alpha0: float = 0.1, nbins: int = NBINS, hair: float = 0.0) -> list[float]:
    """Null HC values, ascending: each replicate against the pool of the others. The gate is the
    ceil((b + 1) (1 - level))-th, or the last."""
    hist = histogram(values, hi, nbins, hair).groupBy("rep", "bin").agg(F.sum("n").alias("n")).toPandas()  # b times nbins rows at most
    per = np.zeros((b, nbins + 1))
    per[hist.rep.to_numpy() - 1, hist.bin.to_numpy()] = hist.n.to_numpy()
    pool, out = per.sum(axis=0), []
    for r in range(b):
        suf, i = np.cumsum((pool - per[r])[::-1])[::-1], np.cumsum(per[r][::-1])[::-1]
        m, p = i[0], (1 + suf) / (1 + suf[0])
        fits = (i >= 1) & (i <= max(alpha0 * m, 10)) & (p < 1)
        out.append(float(np.max(np.sqrt(m) * (i[fits] / m - p[fits]) / np.sqrt(p[fits] * (1 - p[fits])), initial=-math.inf)))
    return sorted(out)


def gate_value(null_hc: list[float], level: float = 0.05) -> float:
    return null_hc[min(len(null_hc), math.ceil((len(null_hc) + 1) * (1 - level))) - 1]


#: Cells into which a range is cut at a time.
CELLS = 4096


def order_statistics(values: DataFrame, value: str, places: list[int]) -> dict[int, float]:
    """The values at these places (from 0) of the ascending order, exactly: by counts in cells of the range, then in
    cells of the cell that has the place, until it holds one different value. A pass has CELLS rows a place."""
    span = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    open_ = {k: (span["lo"], span["hi"], k) for k in places}  # range, and the place within it
    found = {}
    while open_:
        found |= {k: lo for k, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {k: x for k, x in open_.items() if k not in found}
        if not open_:
            break
        ranges = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi")) for k, (lo, hi, _) in open_.items()]))
        inside = values.select(F.col(value).alias("v"), ranges.alias("r")).filter("v BETWEEN r.lo AND r.hi")
        cell = F.least(F.floor((F.col("v") - F.col("r.lo")) / (F.col("r.hi") - F.col("r.lo")) * CELLS), F.lit(CELLS - 1))
        counts = inside.groupBy(F.col("r.k").alias("k"), cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "cell").collect()
        for k, (_, _, place) in open_.items():
            for r in (r for r in counts if r["k"] == k):
                if place < r["n"]:
                    open_[k] = (r["lo"], r["hi"], place)
                    break
                place -= r["n"]
    return found


def quantiles(values: DataFrame, value: str, n: int, shares: list[float]) -> list[float]:
    """Quantiles of n values, linear between places."""
    at = [q * (n - 1) for q in shares]
    found = order_statistics(values, value, sorted({k for x in at for k in (math.floor(x), math.ceil(x))}))
    return [found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)]) for x in at]


def local_fdr(scores: DataFrame, nulls: DataFrame, value: str = "score", grid: int = 4096) -> DataFrame:
    """i, j, lfdr: two-group local false discovery rate of positive scores, kernel densities on a grid.

    Densities come from counts per grid cell, which are sums, their widths from order statistics by counts and
    from an aggregate: the driver has `grid` numbers of each sample, and tasks read the ratio off for
    their own scores. Nulls have one value (v) a row.
    """
    both = kept(scores.select(F.col(value).cast("double").alias("v"), F.lit(False).alias("is_null")).unionByName(nulls.select(F.col("v").cast("double").alias("v"), F.lit(True).alias("is_null"))))
    positive = F.when(F.col("v") > 0, F.col("v"))
    sizes = {r["is_null"]: r for r in both.groupBy("is_null").agg(F.count("*").alias("n"), F.count(positive).alias("above"), F.stddev_samp(positive).alias("sd"), F.max("v").alias("high")).collect()}
    high = max([1e-9, *(r["high"] for r in sizes.values())])
    edges = np.linspace(0, high, grid + 1)
    at = (edges[1:] + edges[:-1]) / 2

    def count(batches):
        sums = {}
        for pdf in batches:
            for null, own in pdf[pdf.v > 0].groupby("is_null"):
                sums[null] = sums.get(null, 0) + np.histogram(own.v, edges)[0]
        for null, n in sums.items():
            some = np.flatnonzero(n)
            yield pd.DataFrame({"is_null": null, "cell": some, "n": n[some]})

    cells = both.mapInPandas(count, "is_null boolean, cell int, n long").groupBy("is_null", "cell").agg(F.sum("n").alias("n")).toPandas()  # grid rows a sample

    def density(null: bool) -> np.ndarray:
        size = sizes.get(null)
        if size is None or size["above"] < 2:
            return np.full(grid, 1e-300)
        low, up = quantiles(both.filter(F.col("is_null") == null).filter("v > 0"), "v", size["above"], [0.25, 0.75])
        h = max(0.9 * min(size["sd"], (up - low) / 1.34 or size["sd"]) * size["above"] ** -0.2, high / grid)
        counts = np.zeros(grid)
        own = cells[cells.is_null == null]
        counts[own.cell] = own.n
        k = np.exp(-0.5 * (np.arange(-grid, grid + 1) * (high / grid) / h) ** 2)
        width = 1 << int(np.ceil(np.log2(3 * grid)))
        smooth = np.fft.irfft(np.fft.rfft(counts, width) * np.fft.rfft(k, width), width)[grid : 2 * grid]
        return np.maximum(smooth, 1e-300) / max(smooth.sum() * high / grid, 1e-300)

    n_null, n_own = (sizes[x]["n"] if x in sizes else 0 for x in (True, False))
    pi0 = 1.0
    if n_null and n_own:  # the p-value is above a half up to the null's value at this place
        place = n_null - (n_null - 1) // 2 - 1
        middle = order_statistics(both.filter("is_null"), "v", [place])[place]
        pi0 = min(1.0, both.filter(~F.col("is_null") & (F.col("v") <= middle)).count() / n_own / 0.5)
    ratio = pi0 * density(True) / density(False)

    def rate(batches):
        for pdf in batches:
            z = pdf.v.to_numpy()
            yield pd.DataFrame({"i": pdf.i, "j": pdf.j, "lfdr": np.where(z > 0, np.minimum(1, np.interp(z, at, ratio)), 1.0)})

    return scores.select("i", "j", F.col(value).cast("double").alias("v")).mapInPandas(rate, "i int, j int, lfdr double")


def central_matching(scores: DataFrame, value: str = "score", grid: int = 64) -> DataFrame:
    """src, mu, sigma of each row's null by a quadratic fit of the log density between its quartiles."""
    from netloom.operators.calibrate import symmetric

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[value].to_numpy()
        lo, hi = np.percentile(v, [25, 75])
        mu, sigma = float(np.median(v)), float(v.std(ddof=1)) if len(v) > 1 else 0.0
        if hi > lo:
            h = max(0.9 * min(v.std(ddof=1), (hi - lo) / 1.34) * len(v) ** -0.2, 1e-12)
            at = np.linspace(lo, hi, grid)
            density = np.exp(-0.5 * ((at[:, None] - v[None, :]) / h) ** 2).sum(axis=1)
            a, b, _ = np.polyfit(at, np.log(np.maximum(density, 1e-300)), 2)
            if a < 0:
                mu, sigma = float(-b / (2 * a)), float(np.sqrt(-1 / (2 * a)))
        return pd.DataFrame({"src": [int(pdf.src.iloc[0])], "mu": [mu], "sigma": [sigma]})

    return symmetric(scores, value).groupBy("src").applyInPandas(fit, "src int, mu double, sigma double")
