"""Diffusion of profiles and random walks over operators (src, dst, w)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators import dependence
from netloom.operators.calibrate import symmetric

def kept(df: DataFrame) -> DataFrame:
    """df computed once: each step uses the one before more than once, so plans would double with every step.

    A checkpoint where a folder for it is set, which also cuts the lineage; else cached.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def step(a: DataFrame, e: DataFrame, alpha: float, signs: DataFrame | None = None) -> DataFrame:
    """var, sample, e after E <- (1 - alpha) E + alpha A E."""
    if signs is not None:
        a = a.join(signs, ["src", "dst"], "left").withColumn("w", F.col("w") * F.when(F.col("src") == F.col("dst"), 1.0).otherwise(F.coalesce("sign", F.lit(0.0))))
    moved = a.join(e.withColumnRenamed("var", "dst"), "dst").groupBy(F.col("src").alias("var"), "sample").agg(F.sum(F.col("w") * F.col("e")).alias("m"))
    out = e.join(moved, ["var", "sample"], "left")
    return out.select("var", "sample", ((1 - alpha) * F.col("e") + alpha * F.coalesce("m", F.lit(0.0))).alias("e"))


def diffused(a: DataFrame, e: DataFrame, steps: int, alpha: float = 0.5, correlations: DataFrame | None = None) -> DataFrame:
    """t, var, sample, e for t = 0 to steps; with correlations, messages take their signs."""
    signs = None if correlations is None else symmetric(correlations, "r").select("src", "dst", F.signum("r").alias("sign"))
    a, now = kept(a), kept(e)
    signs = None if signs is None else kept(signs)
    out = now.select(F.lit(0).alias("t"), "var", "sample", "e")
    for t in range(1, steps + 1):
        now = kept(step(a, now, alpha, signs))
        out = out.unionByName(now.select(F.lit(t).alias("t"), "var", "sample", "e"))
    return out


def conditional_model(a: DataFrame, m: DataFrame, z: DataFrame, nb: DataFrame) -> DataFrame:
    """dst, src, bin, mu: the mean standardised value of src in each bin of dst, for the operator's edges."""
    w = dependence.weights(m, nb).select(F.col("var").alias("dst"), "sample", "bin", "w")
    edges = a.filter("src <> dst").select("src", "dst")
    at = edges.join(w, "dst").join(z.select(F.col("var").alias("src"), "sample", "z"), ["src", "sample"])
    sums = at.groupBy("dst", "src", "bin").agg(F.sum(F.col("w") * F.col("z")).alias("s"), F.sum("w").alias("n"))
    return sums.select("dst", "src", "bin", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("mu"))


def conditional_step(a: DataFrame, model: DataFrame, e: DataFrame, ranges: DataFrame, alpha: float) -> DataFrame:
    """One step whose messages are conditional expectations of src given dst's value, clamped to the fitted range."""
    w = dependence.weights_at(e.withColumnRenamed("e", "x"), ranges).select(F.col("var").alias("dst"), "sample", "bin", "w")
    told = model.join(w, ["dst", "bin"]).groupBy("dst", "src", "sample").agg(F.sum(F.col("w") * F.col("mu")).alias("msg"))
    own = e.select(F.col("var").alias("dst"), F.col("var").alias("src"), "sample", F.col("e").alias("msg"))
    weights = a.withColumnRenamed("w", "p")
    moved = weights.join(told.unionByName(own.select("dst", "src", "sample", "msg")), ["src", "dst"]).groupBy(F.col("src").alias("var"), "sample")
    out = e.join(moved.agg(F.sum(F.col("p") * F.col("msg")).alias("m")), ["var", "sample"], "left")
    return out.select("var", "sample", ((1 - alpha) * F.col("e") + alpha * F.coalesce("m", F.lit(0.0))).alias("e"))


def walked(a: DataFrame, steps: int, alpha: float = 0.5, columns: DataFrame | None = None, keys: tuple[str, ...] = (), start: DataFrame | None = None) -> DataFrame:
    """keys, src, dst, p: the lazy walk's power ((1 - alpha) I + alpha A)^steps, of the given columns (var) only, or on from a walk."""
    a = kept(a)
    nodes = a.select(*keys, F.explode(F.array("src", "dst")).alias("v")).distinct()
    ends = nodes if columns is None else nodes.join(columns.select(F.col("var").alias("v")), "v", "left_semi")
    now = start if start is not None else ends.select(*keys, F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(1.0).alias("p"))
    for t in range(1, steps + 1):
        moved = a.select(*keys, F.col("src").alias("s"), F.col("dst").alias("src"), "w").join(now, [*keys, "src"])
        moved = moved.select(*keys, F.col("s").alias("src"), "dst", (alpha * F.col("w") * F.col("p")).alias("p"))
        stay = now.withColumn("p", (1 - alpha) * F.col("p"))
        now = kept(stay.unionByName(moved.select(*stay.columns)).groupBy(*keys, "src", "dst").agg(F.sum("p").alias("p")))
    return now


def walked_at(a: DataFrame, depths: list[int], alpha: float = 0.5, columns: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """t, keys, src, dst, p of several depths, each walked on from the one before."""
    out, now, at = None, None, 0
    for t in sorted(set(depths)):
        now = walked(a, t - at, alpha, columns, keys, now)
        at = t
        own = now.select(F.lit(t).alias("t"), *keys, "src", "dst", "p")
        out = own if out is None else out.unionByName(own)
    return out


#: Share of pairs with a weight from which a walk is dense.
DENSE = 0.1


def is_dense(a: DataFrame) -> bool:
    """Whether more than DENSE of all pairs of variables have a weight: one pass over the operator."""
    n = a.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.countDistinct("v")).first()[0]
    return a.count() > DENSE * n * n


def walked_auto(a: DataFrame, steps: int, alpha: float = 0.5) -> DataFrame:
    """src, dst, p: by row blocks where the operator is dense, by joins where it is sparse."""
    return walk_blocks(a, [steps], alpha).drop("t") if is_dense(a) else walked(a, steps, alpha)


def attention(walk: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, i, j, s: the mean of both directions' walk probabilities."""
    own = walk.filter("src <> dst").groupBy(*keys, F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
    return own.agg((F.sum("p") / 2).alias("s"))


#: Edges of an operator that is collected, and values of a task's moved rows.
MOST_EDGES, HELD = 20_000_000, 1 << 23


def collected(a: DataFrame) -> pd.DataFrame:
    """The edges of an operator, if they are few enough for the driver and a copy a task."""
    if a.count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges; walk by joins (walked)")
    return a.toPandas()


def walk_blocks(a: DataFrame, depths: list[int], alpha: float = 0.5, block: int = 256) -> DataFrame:
    """t, src, dst, p of dense depths: each task walks a block of rows against the whole sparse operator.

    The operator's edges are broadcast, up to MOST_EDGES; blocks get smaller as there are more.
    """
    spark = a.sparkSession
    edges = collected(a)
    block = max(1, min(block, HELD // max(len(edges), 1)))
    nodes = np.unique(np.concatenate([edges.src, edges.dst]))
    at = {v: k for k, v in enumerate(nodes)}
    src, dst = edges.src.map(at).to_numpy(), edges.dst.map(at).to_numpy()
    shared = spark.sparkContext.broadcast((src, dst, edges.w.to_numpy(), nodes))

    def walk(batches):
        s, d, w, names = shared.value
        order = np.argsort(d, kind="stable")
        s, d, w = s[order], d[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, int)
        for pdf in batches:
            for b in pdf.id:
                rows = np.arange(b * block, min((b + 1) * block, len(names)))
                p = np.zeros((len(rows), len(names)))
                p[np.arange(len(rows)), rows] = 1
                for t in range(max(depths) + 1):
                    if t in depths:
                        i, j = np.nonzero(p)
                        yield pd.DataFrame({"t": np.full(len(i), t, np.int32), "src": names[rows[i]].astype(np.int32), "dst": names[j].astype(np.int32), "p": p[i, j]})
                    moved = np.zeros_like(p)
                    if len(d):
                        moved[:, d[first]] = np.add.reduceat(p[:, s] * w, first, axis=1)
                    p = (1 - alpha) * p + alpha * moved

    n = -(-len(nodes) // block)
    return spark.range(0, n, 1, max(1, n)).mapInPandas(walk, "t int, src int, dst int, p double")


class Thin:
    """Products of a sparse matrix (row, col, w), whose entries stay in their tasks, with thin matrices on the driver.

    Variables are numbered, one narrow row each; a task adds up what its entries give, an aggregate adds up
    tasks. Thin matrices of more than THIN_BYTES raise ValueError.
    """

    def __init__(self, entries: DataFrame, names: np.ndarray, columns: int):
        if 8 * len(names) * columns > THIN_BYTES:
            raise ValueError("thin matrices of the variables are too large for the driver")
        self.entries, self.n = entries, len(names)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        shared = self.entries.sparkSession.sparkContext.broadcast(x)
        columns = [f"y{c}" for c in range(x.shape[1])]

        def multiply(batches):
            total = None
            for pdf in batches:
                if total is None:
                    total, seen = np.zeros(shared.value.shape), np.zeros(len(shared.value), bool)
                row = pdf["row"].to_numpy()
                np.add.at(total, row, pdf.w.to_numpy()[:, None] * shared.value[pdf["col"].to_numpy()])
                seen[row] = True
            if total is not None:
                some = np.flatnonzero(seen)
                yield pd.DataFrame({"row": some, **dict(zip(columns, total[some].T))})

        parts = self.entries.mapInPandas(multiply, ", ".join(["row int", *(f"{c} double" for c in columns)]))
        own = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()  # a row a variable
        shared.unpersist()
        out = np.zeros(x.shape)
        out[own["row"]] = own[columns]
        return out


#: Bytes of thin matrices on the driver.
THIN_BYTES = 1 << 30


def _numbered(a: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The variables (var, k) numbered in their order, and their names in it."""
    names = a.select(F.explode(F.array("src", "dst")).alias("var")).distinct()
    numbers = kept(names.select("var", (F.row_number().over(W.orderBy("var")) - 1).alias("k")))  # one narrow row a variable
    return numbers, numbers.orderBy("k").select("var").toPandas()["var"].to_numpy()


def stationary(a: DataFrame, teleport: float = 1e-3, tolerance: float = 1e-13, most: int = 300, space: int = 30) -> DataFrame:
    """var, pi: the walk's stationary distribution with teleport; what rows without weights lose goes to all alike.

    The fixed point x = L x + 1 / n, L x = (1 - teleport) (P' x - its mean), is solved by minimal residuals over
    Krylov spaces of `space` products, started again until the residual is within the tolerance or no
    longer falls: a power iteration takes as many products as 30 over the teleport.
    """
    numbers, names = _numbered(a)
    n = len(names)
    rows, columns = numbers.select(F.col("var").alias("dst"), F.col("k").alias("row")), numbers.select(F.col("var").alias("src"), F.col("k").alias("col"))
    moved = Thin(kept(a.join(rows, "dst").join(columns, "src").select("row", "col", "w")), names, space + 2)

    def left(x: np.ndarray) -> np.ndarray:  # (I - L) x
        y = moved(x[:, None])[:, 0]
        return x - (1 - teleport) * (y - y.mean())

    x, goal = np.full(n, 1 / n), np.full(n, 1 / n)
    residual, products, before = goal - left(x), 1, np.inf
    while np.abs(residual).sum() > tolerance and np.abs(residual).sum() < before / 2 and products < most:
        before = np.abs(residual).sum()
        basis, h = [residual / np.linalg.norm(residual)], np.zeros((space + 1, space))
        for k in range(space):
            y = left(basis[-1])
            products += 1
            for _ in range(2):
                for i, q in enumerate(basis):
                    part = q @ y
                    h[i, k] += part
                    y = y - part * q
            h[k + 1, k] = np.linalg.norm(y)
            start = np.zeros(k + 2)
            start[0] = np.linalg.norm(residual)
            weights = np.linalg.lstsq(h[: k + 2, : k + 1], start, rcond=None)[0]
            if h[k + 1, k] < 1e-15 or np.linalg.norm(h[: k + 2, : k + 1] @ weights - start) < tolerance / np.sqrt(n) / 10:
                break
            basis.append(y / h[k + 1, k])
        x = x + np.stack(basis[: len(weights)], axis=1) @ weights
        residual = goal - left(x)
        products += 1
    x = np.maximum(x + residual, 0)
    return a.sparkSession.createDataFrame(pd.DataFrame({"var": names.astype(int), "pi": x / x.sum()}), "var int, pi double")


#: Random probes of a trace; as many variables or fewer are probed one by one, which is exact.
PROBES = 64


def spectrum(a: DataFrame, pi: DataFrame, depths: list[int], seed: int = 1) -> DataFrame:
    """t, n_modules, return_probability, slope, error: from the reversibilised walk (I + B) / 2, whose eigenvalues' t-th
    powers add up to n_modules.

    The sum is a trace, the mean over probes z of random signs of z' ((I + B) / 2)^t z, by Lanczos quadrature:
    for all probes at once, as many products as half the largest depth make a small tridiagonal matrix
    a probe, whose eigenvalues stand for those of B as z weighs them; they are kept within -1 and 1, as B's
    would be if pi were without teleports. Entries stay in tasks. error: the standard error over probes, 0
    where each variable is a probe of its own.
    """
    numbers, names = _numbered(a)
    n = len(names)
    weight = numbers.join(pi, "var")
    ws, wd = weight.select(F.col("var").alias("src"), F.col("k").alias("row"), F.col("pi").alias("pr")), weight.select(F.col("var").alias("dst"), F.col("k").alias("col"), F.col("pi").alias("pc"))
    flow = a.join(ws, "src").join(wd, "dst").select("row", "col", (F.col("pr") * F.col("w") / 2 / F.sqrt(F.col("pr") * F.col("pc"))).alias("w"))
    both = flow.select(F.inline(F.array(F.struct("row", "col", "w"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"), "w"))))
    exact = n <= PROBES
    z = np.eye(n) if exact else np.random.default_rng(seed).choice([-1.0, 1.0], size=(n, PROBES))
    steps = min(n, max(depths) // 2 + 2)
    product = Thin(kept(both.groupBy("row", "col").agg(F.sum("w").alias("w"))), names, 4 * z.shape[1])
    size = (z * z).sum(axis=0)
    q, last = z / np.sqrt(size), np.zeros(z.shape)
    alpha, beta = np.zeros((steps, z.shape[1])), np.zeros((steps, z.shape[1]))
    for k in range(steps):
        y = product(q) - (beta[k - 1] * last if k else 0)
        alpha[k] = (q * y).sum(axis=0)
        y -= alpha[k] * q
        beta[k] = np.linalg.norm(y, axis=0)
        last, q = q, np.divide(y, beta[k], out=np.zeros_like(y), where=beta[k] > 1e-12)
    own = np.zeros((len(depths), z.shape[1]))
    for c in range(z.shape[1]):
        ended = np.flatnonzero(beta[:, c] <= 1e-12)
        m = ended[0] + 1 if len(ended) else steps
        values, vectors = np.linalg.eigh(np.diag(alpha[:m, c]) + np.diag(beta[: m - 1, c], 1) + np.diag(beta[: m - 1, c], -1))
        mu = (1 + np.clip(values, -1, 1)) / 2
        own[:, c] = [size[c] * (vectors[0] ** 2 * mu**t).sum() for t in depths]
    total = dict(zip(depths, own.sum(axis=1) if exact else own.mean(axis=1)))
    error = dict(zip(depths, np.zeros(len(depths)) if exact else own.std(axis=1, ddof=1) / np.sqrt(z.shape[1])))
    n_modules = np.array([total[t] for t in depths])
    slope = np.gradient(np.log(np.maximum(n_modules, 1e-300)), np.log(np.maximum(depths, 1))) if len(depths) > 1 else np.zeros(len(depths))
    rows = pd.DataFrame({"t": depths, "n_modules": n_modules, "return_probability": n_modules / n, "slope": slope, "error": [error[t] for t in depths]})
    return a.sparkSession.createDataFrame(rows, "t int, n_modules double, return_probability double, slope double, error double")


def plateaus(curve: DataFrame, most_slope: float = 0.1, least_n: float = 2.0, least_length: int = 3) -> DataFrame:
    """from_t, to_t, length of runs of depths with a flat curve."""
    by = W.orderBy("t")
    flat = curve.withColumn("flat", (F.abs("slope") < most_slope) & (F.col("n_modules") >= least_n)).withColumn("k", F.row_number().over(by))
    runs = flat.filter("flat").withColumn("g", F.col("k") - F.row_number().over(by))
    out = runs.groupBy("g").agg(F.min("t").alias("from_t"), F.max("t").alias("to_t"), F.count("*").alias("length"))
    return out.filter(F.col("length") >= least_length).drop("g")


def affiliation(walk: DataFrame, cores: DataFrame) -> DataFrame:
    """src, module, mass of the walk in fixed cores (module, member)."""
    return walk.join(cores.withColumnRenamed("member", "dst"), "dst").groupBy("src", "module").agg(F.sum("p").alias("mass"))


def affiliation_entropy(mass: DataFrame, n_modules: int) -> DataFrame:
    """src, unexplained (mass outside the cores), entropy over modules, normalised by its most."""
    total = F.sum("mass").over(W.partitionBy("src"))
    p = mass.withColumn("total", total).withColumn("q", F.col("mass") / F.col("total"))
    return p.groupBy("src").agg(
        (1 - F.max("total")).alias("unexplained"),
        (F.sum(F.when(F.col("q") > 0, -F.col("q") * F.ln("q")).otherwise(0.0)) / F.ln(F.lit(float(n_modules)))).alias("entropy"),
    )


def collapse(correlations: DataFrame, cores: DataFrame) -> DataFrame:
    """One row: mean correlation within and between modules, and the median of all."""
    ci, cj = cores.select(F.col("member").alias("i"), F.col("module").alias("mi")), cores.select(F.col("member").alias("j"), F.col("module").alias("mj"))
    both = correlations.join(ci, "i").join(cj, "j")
    return both.agg(
        F.avg(F.when(F.col("mi") == F.col("mj"), F.col("r"))).alias("within"),
        F.avg(F.when(F.col("mi") != F.col("mj"), F.col("r"))).alias("between"),
        F.percentile("r", F.lit(0.5)).alias("median"),
    )


def golden_depth(criterion, low: int = 1, high: int = 64) -> tuple[int, dict[int, float]]:
    """The depth of the largest criterion: powers of two first, then golden sections between them; values are kept."""
    seen: dict[int, float] = {}

    def at(t: int) -> float:
        if t not in seen:
            seen[t] = float(criterion(t))
        return seen[t]

    scan = [low]
    while scan[-1] * 2 <= high:
        scan.append(scan[-1] * 2)
    best = max(scan, key=lambda t: (at(t), -t))
    a, b = max(low, best // 2), min(high, best * 2)
    while b - a > 2:
        c, d = round(b - (b - a) * 0.618), round(a + (b - a) * 0.618)
        if c == d:
            d = min(b - 1, d + 1)
            c = max(a + 1, c if c < d else d - 1)
        if at(c) >= at(d):
            b = d
        else:
            a = c
        if c == d:
            break
    for t in range(a, b + 1):
        at(t)
    return max(seen, key=lambda t: (seen[t], -t)), seen
