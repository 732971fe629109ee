"""Leading principal components of a matrix whose rows stay in their tasks, and of its permuted replicates.

Only thin matrices, samples x components, reach the driver: each product of the samples' Gram matrix with one
is summed over the variables in tasks, then per sample by an aggregate, and orthonormalised on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond those asked for, products a round, rounds, and the residual at which a component is found, as a share of the largest eigenvalue.
SPARE, PRODUCTS, ROUNDS, TOLERANCE = 10, 3, 100, 1e-11
#: Variables that are multiplied at a time.
AT_ONCE = 256


def prepared(x: np.ndarray, scale: bool) -> np.ndarray:
    """Rows without their means, and with `scale` over their standard deviations; one of 0 counts as 1."""
    z = x - x.mean(axis=1, keepdims=True)
    if scale:
        s = np.sqrt((z * z).sum(axis=1, keepdims=True) / max(z.shape[1] - 1, 1))
        z /= np.where(s > 0, s, 1)
    return z


def permuted(z: np.ndarray, names: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """Each row in an order of its own, which hangs on its variable, the replicate and the seed alone."""
    return np.stack([row[np.random.default_rng((seed, rep, int(name))).permutation(len(row))] for row, name in zip(z, names)])


def _orthonormal(y: np.ndarray, *against: np.ndarray) -> np.ndarray:
    for _ in range(2):  # twice, as the first leaves what rounding does
        for q in against:
            y = y - q @ (q.T @ y)
        y = np.linalg.qr(y)[0]
    return y


def _products(rows: DataFrame, thin: dict[int, np.ndarray], scale: bool, seed: int) -> dict[int, np.ndarray]:
    """The Gram matrix of each replicate times its thin matrix. Replicate 0 is the matrix itself."""
    width = next(iter(thin.values())).shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(thin)
    names = [f"y{c}" for c in range(width)]

    def multiply(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[at : at + AT_ONCE]
                z, variables = prepared(np.stack(part.x.to_list()), scale), part["var"].to_numpy()
                for rep, v in shared.value.items():
                    own = permuted(z, variables, rep, seed) if rep else z
                    sums[rep] = sums.get(rep, 0) + own.T @ (own @ v)
        for rep, y in sums.items():
            yield pd.DataFrame({"rep": rep, "s": np.arange(len(y)), **dict(zip(names, y.T))})

    parts = rows.mapInPandas(multiply, ", ".join(["rep int", "s int", *(f"{n} double" for n in names)]))
    total = parts.groupBy("rep", "s").agg(*[F.sum(n).alias(n) for n in names]).toPandas().sort_values("s")  # thin: samples x width a replicate
    shared.unpersist()
    return {rep: total[total.rep == rep][names].to_numpy() for rep in thin}


def leading(rows: DataFrame, samples: int, k: int, scale: bool, most_bytes: int, replicates: int = 0, seed: int = 1) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For the matrix (0) and each of its permuted replicates (1, ...) the k largest eigenvalues of its samples' Gram
    matrix, descending, and their eigenvectors (samples x k).

    rows: (var, x: values in the order of samples). Block Krylov spaces of PRODUCTS products each, started
    again with their best vectors until the residuals of all k are within TOLERANCE. Thin matrices of more
    than most_bytes in all raise ValueError.
    """
    k = min(k, samples)
    width = min(samples, k + SPARE)
    if 8 * samples * width * 2 * PRODUCTS * (replicates + 1) > most_bytes:
        raise ValueError("thin matrices of samples and components are too large for the driver")
    widths = [width]
    while len(widths) < PRODUCTS and sum(widths) < samples:
        widths.append(min(width, samples - sum(widths)))
    rng = np.random.default_rng(seed)
    first = np.linalg.qr(rng.standard_normal((samples, width)))[0]
    open_ = {rep: first for rep in range(replicates + 1)}
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for _ in range(ROUNDS):
        basis = {rep: [v] for rep, v in open_.items()}
        images: dict[int, list[np.ndarray]] = {rep: [] for rep in open_}
        for n in range(len(widths)):
            new = _products(rows, {rep: q[-1] for rep, q in basis.items()}, scale, seed)
            for rep, y in new.items():
                images[rep].append(y)
                if n + 1 < len(widths):
                    basis[rep].append(_orthonormal(y[:, : widths[n + 1]], *basis[rep]))
        for rep in list(open_):
            q, w = np.hstack(basis[rep]), np.hstack(images[rep])
            h = q.T @ w
            values, u = np.linalg.eigh((h + h.T) / 2)
            values, u = values[::-1][:width], u[:, ::-1][:, :width]
            v = q @ u
            residual = np.linalg.norm(w @ u - v * values, axis=0)[:k]
            if q.shape[1] == samples or residual.max(initial=0) <= TOLERANCE * max(values[0], 1e-300):
                found[rep] = (np.maximum(values[:k], 0), v[:, :k])
                del open_[rep]
            else:
                open_[rep] = v
        if not open_:
            return found
    raise ValueError(f"no {k} components within {ROUNDS} rounds")


def gram(rows: DataFrame, scale: bool = False) -> np.ndarray:
    """The samples' Gram matrix of (var, x: values in the order of samples): summed over variables in tasks, then a
    row of it by row; samples x samples on the driver, so callers bound the samples."""

    def part(batches):
        total = None
        for pdf in batches:
            for at in range(0, len(pdf), AT_ONCE):
                z = prepared(np.stack(pdf.x.iloc[at : at + AT_ONCE].to_list()), scale)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pd.DataFrame({"s": np.arange(len(total)), "g": list(total)})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [pdf.s.iloc[0]], "g": [np.stack(pdf.g.to_list()).sum(axis=0)]})

    parts = rows.mapInPandas(part, "s int, g array<double>").groupBy("s").applyInPandas(added, "s int, g array<double>")
    return np.stack(parts.toPandas().sort_values("s").g.to_list())
