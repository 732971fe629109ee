"""Hartigan's dip of a sample from the unimodal distributions, and its p-value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Uniform samples drawn of each size, the share of a quantile, and the largest size drawn: beyond it, the root of the size times the dip hardly changes.
DRAWS, QUANTILES, LARGEST = 2000, 500, 4096


def dip(x: np.ndarray) -> float:
    """Hartigan's dip: half the least greatest distance of the empirical distribution from a unimodal one."""
    x = np.sort(x)
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return 1 / (2 * n)

    def hull(points: list[int], sign: int) -> list[int]:
        out: list[int] = []
        for i in points:
            while len(out) > 1 and sign * ((out[-1] - out[-2]) * (x[i] - x[out[-1]]) - (i - out[-1]) * (x[out[-1]] - x[out[-2]])) >= 0:
                out.pop()
            out.append(i)
        return out

    low, high, worst = 0, n - 1, 1.0
    while True:
        g, l = hull(list(range(low, high + 1)), 1), hull(list(range(low, high + 1)), -1)
        gv, lv = np.interp(x[low : high + 1], x[g], g), np.interp(x[low : high + 1], x[l], l)
        d = lv - gv
        k = int(d.argmax())
        if d[k] <= worst:
            return worst / (2 * n)
        a = max((i for i in g if i <= low + k), default=low)
        b = min((i for i in l if i >= low + k), default=high)
        left = np.abs(np.interp(x[low : a + 1], x[g], g) - np.arange(low, a + 1)).max(initial=0) + 1
        right = np.abs(np.interp(x[b : high + 1], x[l], l) - np.arange(b, high + 1)).max(initial=0) + 1
        worst = max(worst, left, right)
        if (a, b) == (low, high) or b <= a:
            return worst / (2 * n)
        low, high = a, b


def sizes_around(n: list[int]) -> list[int]:
    """The sizes of the grid (4, 6, 8, 12, 16, 23, ..., each the next by the root of two) next to and between those given."""
    grid = sorted({min(LARGEST, int(np.ceil(4 * 2 ** (j / 2)))) for j in range(21)})
    low, high = min(max(min(n), grid[0]), LARGEST), min(max(max(n), grid[0]), LARGEST)
    first = max(k for k, g in enumerate(grid) if g <= low)
    last = min(k for k, g in enumerate(grid) if g >= high)
    return grid[first : last + 1]


def null_dips(spark: SparkSession, sizes: list[int], draws: int = DRAWS, seed: int = 1) -> DataFrame:
    """size, quantiles: of the root of the size times the dip of uniform samples, at equal steps of probability.

    A row a sample, so that draws of all sizes fill all tasks; a sample hangs on its size, draw and seed alone.
    """

    def draw(batches):
        for pdf in batches:
            dips = [dip(np.random.default_rng((seed, int(n), int(k))).random(int(n))) for n, k in zip(pdf["size"], pdf["draw"])]
            yield pd.DataFrame({"size": pdf["size"], "scaled": np.sqrt(pdf["size"].to_numpy()) * dips})

    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = spark.range(draws).select(F.col("id").cast("int").alias("draw"), F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size")).repartition(tasks)
    at = F.array(*[F.lit(k / QUANTILES) for k in range(QUANTILES + 1)])
    return rows.mapInPandas(draw, "size int, scaled double").groupBy("size").agg(F.percentile("scaled", at).alias("quantiles"))


class DipNull:
    """P-values from the null table's few rows: quantiles between two sizes by the root of the size, and
    probabilities between two quantiles, linearly. The largest dip of all draws and any above have 1 / draws at most."""

    def __init__(self, table: DataFrame, draws: int = DRAWS):
        rows = table.orderBy("size").collect()  # a row a size of the grid
        self.sizes = np.array([r["size"] for r in rows], float)
        self.quantiles = np.array([r["quantiles"] for r in rows])
        self.draws = draws

    def p_value(self, value: float, n: int) -> float:
        root, roots = np.sqrt(n), np.sqrt(self.sizes)
        k = int(np.clip(np.searchsorted(roots, root) - 1, 0, max(len(roots) - 2, 0)))
        if len(roots) == 1:
            own = self.quantiles[0]
        else:
            t = float(np.clip((root - roots[k]) / (roots[k + 1] - roots[k]), 0, 1))
            own = (1 - t) * self.quantiles[k] + t * self.quantiles[k + 1]
        below = np.interp(value * root, own, np.linspace(0, 1, len(own)))
        return float(max(1 - below, 1 / self.draws))
