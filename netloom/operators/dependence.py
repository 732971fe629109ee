"""B-spline weights, entropies and pairwise dependence of the variables of a long matrix.

Two ways give the same mutual information: a join of exploded weights, all in Spark, for tables whose
pairs are few, and blocks of variables multiplied as matrices, a task a pair of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators import bins as B
from netloom.operators.spectral import gram, prepared
from netloom.operators.transform import ranked
from netloom.sources.store import kept

#: Variables a block, at least and at most, blocks until they grow, and values (variables x samples x
#: bins of 8 bytes) a block: a task holds two blocks' weights.
LEAST, MOST, BLOCKS, HELD = 64, 512, 16, 1 << 23
#: Blocks a side of a square, at most, and pairs of squares for each core.
SIDE, PER_SLOT = 4, 4
#: Variables whose joint tables are made at once.
AT_ONCE = 32
#: Samples of a Gram matrix that is inverted.
MOST_SAMPLES = 5000


def basis(m: DataFrame, nb: DataFrame, order: int = 3) -> DataFrame:
    """var, sample, first, w: the non-zero weights of each value, from bin `first` on, in closed form."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    w = W.partitionBy("var")
    lo, hi = F.min("x").over(w), F.max("x").over(w)
    z = (F.col("x") - lo) * (F.col("nb") - order + 1) / (hi - lo)
    at = m.join(nb, "var").withColumn("z", z)
    return at.select("var", "sample", F.least(F.floor("z"), F.col("nb") - order).cast("int").alias("first"), "z", "nb").select(
        "var", "sample", "first", _weights(F.col("z"), F.col("first"), F.col("nb"), order).alias("w")
    )


def _weights(z: Column, q: Column, nb: Column, order: int) -> Column:
    if order == 2:
        return F.array(q + 1 - z, z - q)
    low = (q + 1 - z) * (q + 1 - z) / (q + 1 - F.greatest(q - 1, F.lit(0)))
    high = (z - q) * (z - q) / (F.least(q + 2, nb - 2) - q)
    return F.array(low, 1 - low - high, high)


def weights_at(values: DataFrame, ranges: DataFrame, order: int = 3) -> DataFrame:
    """var, sample, bin, w of values (var, sample, x) on fitted ranges (var, lo, hi, nb), clamped to them."""
    x = F.greatest(F.least(F.col("x"), F.col("hi")), F.col("lo"))
    z = (x - F.col("lo")) * (F.col("nb") - order + 1) / (F.col("hi") - F.col("lo"))
    at = values.join(ranges, "var").withColumn("z", z).withColumn("first", F.least(F.floor("z"), F.col("nb") - order).cast("int"))
    own = at.select("var", "sample", "first", F.posexplode(_weights(F.col("z"), F.col("first"), F.col("nb"), order)).alias("k", "w"))
    return own.select("var", "sample", (F.col("first") + F.col("k")).alias("bin"), "w")


def weights(m: DataFrame, nb: DataFrame, order: int = 3) -> DataFrame:
    """var, sample, bin, w: a row for each weight."""
    own = basis(m, nb, order).select("var", "sample", "first", F.posexplode("w").alias("k", "w"))
    return own.select("var", "sample", (F.col("first") + F.col("k")).alias("bin"), "w")


def entropy(w: DataFrame) -> DataFrame:
    """var, h: marginal entropy in bits."""
    n = w.groupBy("var").agg(F.countDistinct("sample").alias("n"))
    p = w.groupBy("var", "bin").agg(F.sum("w").alias("s")).join(n, "var").withColumn("p", F.col("s") / F.col("n")).filter("p > 0")
    return p.groupBy("var").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"))


def joined_mi(w: DataFrame) -> DataFrame:
    """i, j, mi by a join of weights on samples: as many rows as pairs, samples and pairs of weights."""
    h = entropy(w)
    n = w.agg(F.countDistinct("sample").cast("double").alias("n"))
    a = w.select("sample", F.col("var").alias("i"), F.col("bin").alias("bi"), F.col("w").alias("wi"))
    b = w.select("sample", F.col("var").alias("j"), F.col("bin").alias("bj"), F.col("w").alias("wj"))
    cells = a.join(b, (a["sample"] == b["sample"]) & (F.col("i") < F.col("j"))).groupBy("i", "j", "bi", "bj").agg(F.sum(F.col("wi") * F.col("wj")).alias("s"))
    p = cells.crossJoin(F.broadcast(n)).withColumn("p", F.col("s") / F.col("n")).filter("p > 0")
    hxy = p.groupBy("i", "j").agg(F.sum(-F.col("p") * F.log2("p")).alias("hxy"))
    hi, hj = h.select(F.col("var").alias("i"), F.col("h").alias("hi")), h.select(F.col("var").alias("j"), F.col("h").alias("hj"))
    return hxy.join(hi, "i").join(hj, "j").select("i", "j", (F.col("hi") + F.col("hj") - F.col("hxy")).alias("mi"))


def self_mi(w: DataFrame) -> DataFrame:
    """var, self_mi: a variable's mutual information with itself, its weights as both marginals."""
    h = entropy(w)
    n = w.groupBy("var").agg(F.countDistinct("sample").alias("n"))
    a = w.select("var", "sample", F.col("bin").alias("bi"), F.col("w").alias("wi"))
    b = w.select("var", "sample", F.col("bin").alias("bj"), F.col("w").alias("wj"))
    cells = a.join(b, ["var", "sample"]).groupBy("var", "bi", "bj").agg(F.sum(F.col("wi") * F.col("wj")).alias("s"))
    p = cells.join(n, "var").withColumn("p", F.col("s") / F.col("n")).filter("p > 0")
    return p.groupBy("var").agg(F.sum(-F.col("p") * F.log2("p")).alias("hxx")).join(h, "var").select("var", (2 * F.col("h") - F.col("hxx")).alias("self_mi"))


def _spread(x: np.ndarray, nb: np.ndarray, order: int) -> np.ndarray:
    """Dense weights, a row for each variable and bin: shape (variables, max bins, samples)."""
    lo, hi = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    z = (x - lo) * (nb[:, None] - order + 1) / (hi - lo)
    q = np.minimum(np.floor(z), nb[:, None] - order)
    if order == 2:
        parts = [q + 1 - z, z - q]
    else:
        low = (q + 1 - z) ** 2 / (q + 1 - np.maximum(q - 1, 0))
        high = (z - q) ** 2 / (np.minimum(q + 2, nb[:, None] - 2) - q)
        parts = [low, 1 - low - high, high]
    out = np.zeros((len(x), int(nb.max()), x.shape[1]))
    v, s = np.indices(x.shape)
    for k, w in enumerate(parts):
        out[v, q.astype(int) + k, s] = w
    return out


def _block_pairs(m: DataFrame, extra: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Variables as rows (keys, block, square, var, extra..., x: values in the order of samples), dealt to pairs of
    squares (p, q), p <= q, of neighbouring blocks; `_pairs` has the pairs of blocks of one.

    Blocks are numbered from the variables alone, one narrow row each, and grow with their number up to MOST,
    as far as HELD allows. Squares have up to SIDE blocks a side, as many as leave some PER_SLOT pairs of squares
    for each core: so a variable is sent to about the root of so many tasks, and not to each block.
    """
    names = m.select("var").distinct()
    shape = names.agg(F.count("*").alias("n")).crossJoin(m.agg(F.approx_count_distinct("sample").alias("samples")))
    fits = F.floor(HELD / (8 * F.greatest(F.col("samples"), F.lit(1))))
    size = F.greatest(F.lit(1), F.least(fits, F.lit(MOST), F.greatest(F.lit(LEAST), F.ceil(F.col("n") / BLOCKS))))
    wanted = math.ceil(math.sqrt(2 * PER_SLOT * m.sparkSession.sparkContext.defaultParallelism))  # squares a side of the triangle
    shape = shape.select(size.alias("size"), F.ceil(F.col("n") / size).alias("blocks"))
    shape = shape.select("size", "blocks", F.greatest(F.lit(1), F.least(F.lit(SIDE), F.floor(F.col("blocks") / wanted))).alias("side"))
    shape = shape.select("size", "side", F.floor((F.col("blocks") - 1) / F.col("side")).cast("int").alias("last"))
    numbered = names.select("var", (F.row_number().over(W.orderBy("var")) - 1).alias("k")).crossJoin(F.broadcast(shape))
    block = F.floor(F.col("k") / F.col("size")).cast("int")
    blocks = numbered.select("var", "last", block.alias("block"), F.floor(block / F.col("side")).cast("int").alias("square"))
    rows = m.groupBy(*keys, "var", *extra).agg(F.sort_array(F.collect_list(F.struct("sample", "x"))).alias("xs"))
    rows = rows.withColumn("x", F.col("xs.x")).drop("xs").join(blocks, "var")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return dealt.withColumn("p", F.least("square", "other")).withColumn("q", F.greatest("square", "other")).drop("other", "last")


def _pairs(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """The pairs of blocks, in the order of variables, of a pair of squares; a block with itself is one."""
    p, q = pdf.p.iloc[0], pdf.q.iloc[0]
    own = {k: t.sort_values("var") for k, t in pdf.groupby("block")}
    square = {k: t.square.iloc[0] for k, t in own.items()}
    for x in own:
        for y in own:
            if square[x] == p and square[y] == q and (p != q or x <= y):
                yield own[x], own[y]


def _by_blocks(rows: DataFrame, keys: tuple[str, ...], pair: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """pair(a, b) of all pairs of blocks of `_block_pairs`; a task sends each on before it makes the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b in _pairs(pd.concat(list(batches))):
            yield pair(a, b)

    return rows.groupBy(*keys, "p", "q").applyInPandas(run, schema)


def _plogp(p: np.ndarray) -> np.ndarray:
    """p log2 p, 0 at 0."""
    p = np.maximum(p, np.finfo(p.dtype).tiny)
    out = np.log2(p)
    out *= p
    return out


def block_mi(m: DataFrame, nb: DataFrame, order: int = 3, self_pairs: bool = False, keys: tuple[str, ...] = (), single: bool = False) -> DataFrame:
    """keys, i, j, mi (i < j; with self_pairs i = j too) by products of blocks of weights; keys are integers.

    With `single`, weights, tables and results have 32 bits: half the memory, and values within 1e-5.
    """
    kind = np.float32 if single else np.float64

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        wa, wb = (_spread(np.stack(t.x.to_list()), t.nb.to_numpy(), order).astype(kind, copy=False) for t in (a, b))
        n = wa.shape[2]
        mi = -_plogp(wa.mean(axis=2)).sum(axis=1)[:, None] - _plogp(wb.mean(axis=2)).sum(axis=1)[None, :]
        right = np.ascontiguousarray(wb.reshape(-1, n).T) / kind(n)
        for k in range(0, len(a), AT_ONCE):  # some variables at a time keep the joint tables small
            some = wa[k : k + AT_ONCE]
            joint = _plogp(some.reshape(-1, n) @ right)
            mi[k : k + AT_ONCE] += joint.reshape(len(some), wa.shape[1], len(b), wb.shape[1]).sum(axis=(1, 3))
        i, j = np.meshgrid(a["var"], b["var"], indexing="ij")
        keep = i <= j if self_pairs else i < j
        return pd.DataFrame({**{k: a[k].iloc[0] for k in keys}, "i": i[keep], "j": j[keep], "mi": mi[keep]})

    rows = _block_pairs(m.join(nb, "var"), ["nb"], keys)
    return _by_blocks(rows, keys, pair, ", ".join([*(f"{k} int" for k in keys), f"i int, j int, mi {'float' if single else 'double'}"]))


def mutual_information(m: DataFrame, rule: str | int = "hg", order: int = 3, transform: str = "none", path: str = "auto", single: bool = False) -> DataFrame:
    """i, j, mi of all pairs. transform "rank": of average ranks. path "sql" joins weights, "block" multiplies blocks, with `single` in 32 bits."""
    if transform == "rank":
        m = ranked(m).select("var", "sample", F.col("r").alias("x"))
    nb = B.counts(m, rule)
    return joined_mi(weights(m, nb, order)) if path == "sql" else block_mi(m, nb, order, single=single)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Centred rows of length 1, or 0: their products are correlations."""
    c = x - x.mean(axis=1, keepdims=True)
    s = np.sqrt((c * c).sum(axis=1, keepdims=True))
    return np.divide(c, s, out=np.zeros_like(x), where=s > 0)


def correlation(m: DataFrame, rank: bool = False, keys: tuple[str, ...] = (), least: float | None = None) -> DataFrame:
    """keys (integers), i, j, r: Pearson's (of ranks: Spearman's) correlation of all pairs, 0 where it is undefined.

    With `least`, only pairs whose absolute correlation reaches it leave their tasks."""
    if rank:
        m = ranked(m, *keys).select(*keys, "var", "sample", F.col("r").alias("x"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        xa, xb = (np.stack(t.x.to_list()) for t in (a, b))
        r, i, j = unit_rows(xa) @ unit_rows(xb).T, a["var"].to_numpy(), b["var"].to_numpy()
        keep = i[:, None] < j[None, :]
        if least is not None:
            keep &= np.abs(r) >= least
        at, of = np.nonzero(keep)
        return pd.DataFrame({**{k: a[k].iloc[0] for k in keys}, "i": i[at], "j": j[of], "r": r[at, of]})

    schema = ", ".join([*(f"{k} int" for k in keys), "i int, j int, r double"])
    return _by_blocks(_block_pairs(m, [], keys), keys, pair, schema)


def gaussian_mi(r: DataFrame, bits: bool = True) -> DataFrame:
    """i, j, g: the mutual information of a normal pair of that correlation."""
    log = F.log2 if bits else F.ln
    return r.select("i", "j", (-0.5 * log(1 - F.least(F.col("r") * F.col("r"), F.lit(1 - 1e-12)))).alias("g"))


def partial_correlation(m: DataFrame, ridge: float = 0.1) -> DataFrame:
    """i, j, r: absolute partial correlations from the ridge inverse of the covariance.

    With Z the centred variables and l the ridge, (Z Z' / (n - 1) + l I)^-1 is (I - Y Y') / l, where Y = Z L'^-1 and
    L L' = Z' Z + l (n - 1) I: only samples x samples are inverted, for up to MOST_SAMPLES, tasks
    make the variables' rows of Y, and pairs are products of blocks of them, as correlations are.
    """
    samples = m.select("sample").distinct().count()
    if samples > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    rows = kept(m.groupBy("var").agg(F.sort_array(F.collect_list(F.struct("sample", "x"))).alias("xs")).select("var", F.col("xs.x").alias("x")))
    inner, n_vars = gram(rows), rows.count()
    level = ridge * np.trace(inner) / max(n_vars, 1)  # times n - 1, as the Gram matrix is
    lower = np.linalg.cholesky(inner + level * np.eye(len(inner)))
    shared = m.sparkSession.sparkContext.broadcast(np.linalg.inv(lower).T)

    def solved(batches):
        for pdf in batches:
            if len(pdf):
                y = prepared(np.stack(pdf.x.to_list()), False) @ shared.value
                yield pd.DataFrame({"var": np.repeat(pdf["var"].to_numpy(), y.shape[1]), "sample": np.tile(np.arange(y.shape[1]), len(y)), "x": y.ravel()})

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ya, yb = (np.stack(t.x.to_list()) for t in (a, b))
        left = lambda y: np.sqrt(1 - (y * y).sum(axis=1))
        r = np.abs(ya @ yb.T) / (left(ya)[:, None] * left(yb)[None, :])
        i, j = np.meshgrid(a["var"], b["var"], indexing="ij")
        return pd.DataFrame({"i": i[i < j], "j": j[i < j], "r": r[i < j]})

    y = kept(rows.mapInPandas(solved, "var int, sample int, x double"))
    return _by_blocks(_block_pairs(y, []), (), pair, "i int, j int, r double")


def excess_summary(mi: DataFrame, r: DataFrame, margin: float = 0.1) -> DataFrame:
    """One row: shares of pairs whose mutual information is above or below the Gaussian one by more
    than the margin, and Spearman's correlation of it with absolute correlation."""
    both = mi.join(r, ["i", "j"]).join(gaussian_mi(r), ["i", "j"]).withColumn("a", F.abs("r"))
    one = W.partitionBy()
    rank = lambda c: F.rank().over(W.orderBy(c)) + (F.count("*").over(W.partitionBy(c)) - 1) / 2.0
    both = both.withColumn("mi", F.round("mi", 9)).withColumn("a", F.round("a", 9))
    both = both.withColumn("rm", rank("mi")).withColumn("ra", rank("a")).withColumn("n", F.count("*").over(one))
    return both.agg(
        F.avg((F.col("mi") > F.col("g") + margin).cast("double")).alias("above"),
        F.avg((F.col("mi") < F.col("g") - margin).cast("double")).alias("below"),
        F.corr("rm", "ra").alias("spearman"),
        F.count("*").alias("pairs"),
    )


def histogram2d(both: DataFrame, x: str, y: str, n: int = 120) -> DataFrame:
    """x_bin, y_bin, pairs: equal-width counts over the ranges of x and y."""
    span = both.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cell = lambda v, a, b: F.least(F.floor((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * n), F.lit(n - 1)).cast("int")
    at = both.crossJoin(F.broadcast(span)).select(cell(x, "x0", "x1").alias("x_bin"), cell(y, "y0", "y1").alias("y_bin"))
    return at.groupBy("x_bin", "y_bin").agg(F.count("*").alias("pairs"))
