"""Bayesian blocks, and partial information decomposition of all triples without a task that has all variables.

A pair of variables needs one joint table, made from blocks of variables as correlations are. What the
target's values tell about each source goes into one row a target and block of sources. The redundancy of two sources
is the sum over the target's values of the smaller of both; summed over all third variables, that hangs on
the order of the sources alone, so a target's sources are sorted once for each of its values: the work
is that of pairs, not of triples, and no row of a triple is made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.dependence import _block_pairs, _by_blocks
from netloom.sources.store import kept

#: What each block costs, against the logarithm of its density.
PRIOR = 4.0
#: Members of a row of equal variables that meet others at once.
PART = 1024


def block_edges(x: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Edges of the blocks of constant density that explain the values best (Scargle's dynamic programme).

    Cells lie between the midpoints of neighbouring different values. A block of n values and width w is worth
    n ln(n / w) - prior; the best partition of the first cells ends in some block after a best partition of
    what is before it. One different value is one block; of equal partitions the one whose last block starts first.
    """
    values, counts = np.unique(x, return_counts=True)
    if len(values) < 2:
        return np.array([values[0], values[0]])
    edges = np.concatenate([values[:1], (values[1:] + values[:-1]) / 2, values[-1:]])
    up_to = np.concatenate([[0], np.cumsum(counts)])
    best, start = np.zeros(len(values) + 1), np.zeros(len(values) + 1, int)
    for end in range(1, len(values) + 1):
        n, width = up_to[end] - up_to[:end], edges[end] - edges[:end]
        with np.errstate(divide="ignore"):
            worth = best[:end] + n * (np.log(n) - np.log(width)) - prior
        start[end] = int(worth.argmax())
        best[end] = worth[start[end]]
    cuts, end = [len(values)], len(values)
    while end:
        end = start[end]
        cuts.append(end)
    return edges[cuts[::-1]]


def bayesian_blocks(m: DataFrame, prior: float = PRIOR) -> DataFrame:
    """var, edges: the edges of each variable's blocks, ascending; a task has some variables whole."""

    def fit(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"var": pdf["var"].astype(int), "edges": [block_edges(np.asarray(x), prior) for x in pdf.x]})

    return m.groupBy("var").agg(F.collect_list("x").alias("x")).mapInPandas(fit, "var int, edges array<double>")


def in_blocks(m: DataFrame, edges: DataFrame) -> DataFrame:
    """var, sample, x: the number of the block that has the value; a value on an edge is in the block above, the largest in the last."""
    above = F.aggregate("edges", F.lit(-1), lambda n, e: n + (e <= F.col("x")).cast("int"))
    return m.join(edges, "var").select("var", "sample", F.least(above, F.size("edges") - 2).cast("double").alias("x"))


def uniform_bins(m: DataFrame, nb: int = 5) -> DataFrame:
    """var, sample, x: the number of the bin of equal width; a value on an edge, but for its last bit, is in the bin above."""
    span = m.groupBy("var").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.floor((F.col("x") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * nb + 1e-9)
    return m.join(span, "var").select("var", "sample", F.least(at, F.lit(nb - 1)).cast("double").alias("x"))


def copies(m: DataFrame) -> DataFrame:
    """rep, var: the variables of each different row of values; rep is the smallest of them."""
    rows = m.groupBy("var").agg(F.sort_array(F.collect_list(F.struct("sample", "x"))).alias("xs"))
    # variables of one row are narrow once they have met: a list of numbers
    return rows.groupBy("xs").agg(F.min("var").alias("rep"), F.collect_list("var").alias("own")).select("rep", F.explode("own").alias("var"))


def specific_information(binned: DataFrame) -> DataFrame:
    """dst, src, n, told: for each value of dst, its share of what each src tells about it, in bits; they add up to the pair's mutual information.

    binned is var, sample, x, and n where a variable stands for n equal ones. A row has a target and a block of sources, n of
    them each, with told as the rows of a matrix, one after another; of a target itself there are n - 1.
    """
    if "n" not in binned.columns:
        binned = binned.withColumn("n", F.lit(1).cast("long"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        xa, xb = (np.stack(t.x.to_list()).astype(int) for t in (a, b))
        hot = lambda x: (x[:, None, :] == np.arange(x.max() + 1)[None, :, None]).astype(float)
        ha, hb = hot(xa), hot(xb)
        n = xa.shape[1]
        pa_, pb = ha.sum(axis=2) / n, hb.sum(axis=2) / n  # counts first: what is independent gives 0 to the last bit
        right = hb.reshape(-1, n).T
        names_a, names_b = (t["var"].to_numpy() for t in (a, b))
        many_a, many_b = (t["n"].to_numpy() for t in (a, b))
        same = a.block.iloc[0] == b.block.iloc[0]
        out = {"dst": [], "src": [], "n": [], "told": []}
        back = None if same else np.empty((len(b), len(a), hb.shape[1]))
        for k, name in enumerate(names_a):
            joint = (ha[k] @ right).reshape(ha.shape[1], len(b), hb.shape[1]) / n  # values of a, variables and values of b
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = np.where(joint > 0, joint * np.log2(joint / (pa_[k][:, None, None] * pb[None])), 0)
            out["dst"].append(name)
            out["src"].append(names_b)
            out["n"].append(many_b - (names_b == name))
            out["told"].append(bits.sum(axis=2).T.ravel())
            if not same:
                back[:, k] = bits.sum(axis=0)
        if not same:
            out["dst"] += list(names_b)
            out["src"] += [names_a] * len(b)
            out["n"] += [many_a] * len(b)
            out["told"] += list(back.reshape(len(b), -1))
        return pd.DataFrame(out)

    return _by_blocks(_block_pairs(binned, ["n"]), (), pair, "dst int, src array<int>, n array<long>, told array<double>")


def unique_shares(told: DataFrame) -> DataFrame:
    """src, dst, n, u: the share of what src (n of them) tells about dst that another variable doesn't, summed over all others.

    A target's sources meet in one task, a row of numbers each. What a source shares of a value with those that
    tell less is what they tell, and with the rest all of its own: what it doesn't share is its own for each of those
    below, without what they tell.
    """

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        src, n = (np.concatenate(pdf[c].to_list()) for c in ("src", "n"))
        parts = [t.reshape(len(x), -1) for t, x in zip(pdf.told, pdf.src)]
        width = max(t.shape[1] for t in parts)
        s = np.concatenate([np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in parts])[n > 0]
        src, n = src[n > 0], n[n > 0]
        mi, alone = s.sum(axis=1), np.zeros(len(s))
        for column in s.T:
            order = np.argsort(column, kind="stable")
            value, many = column[order], n[order]
            alone[order] += value * (np.cumsum(many) - many) - (np.cumsum(value * many) - value * many)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.where(mi > 0, alone / mi, 0)
        return pd.DataFrame({"src": src, "dst": pdf.dst.iloc[0], "n": n, "u": u})

    return told.groupBy("dst").applyInPandas(own, "src int, dst int, n long, u double")


def pidc(m: DataFrame, discretiser: str = "blocks", nb: int = 5, digits: int | None = None) -> DataFrame:
    """i, j, score: the pair's share of unique information over all third variables, as sums of both members' cumulative
    distributions. Values are put into Bayesian blocks, or into nb bins of equal width ("uniform").

    Variables that are in the same blocks everywhere tell the same: one of them stands for all, with their number,
    until scores are dealt to the pairs of their members, which are sent to them.
    """
    if discretiser not in ("blocks", "uniform"):
        raise ValueError("discretiser is blocks or uniform")
    binned = kept(in_blocks(m, bayesian_blocks(m)) if discretiser == "blocks" else uniform_bins(m, nb))
    members = kept(copies(binned))
    numbers = members.groupBy("rep").agg(F.count("*").alias("n"))
    u = unique_shares(specific_information(binned.join(numbers.withColumnRenamed("rep", "var"), "var")))
    ends = F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")
    pair = u.groupBy(*ends).agg(F.sum(F.when(F.col("src") == F.col("dst"), 2 * F.col("u")).otherwise(F.col("u"))).alias("u"), F.max(F.when(F.col("src") < F.col("dst"), F.col("n"))).alias("n_i"), F.max(F.when(F.col("src") >= F.col("dst"), F.col("n"))).alias("n_j"))
    ways = F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("n_j").alias("n")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst"), F.col("n_i").alias("n")))
    both = pair.select("u", F.inline(ways)).filter("n IS NOT NULL")
    by = F.round("u", digits) if digits is not None else F.col("u")
    row = W.partitionBy("src")
    both = both.withColumn("c", F.sum("n").over(row.orderBy(by)) / F.sum("n").over(row))
    twice = F.when(F.col("src") == F.col("dst"), 2 * F.col("c")).otherwise(F.col("c"))
    return _dealt(both.groupBy(*ends).agg(F.sum(twice).alias("score")), members)


def _dealt(scores: DataFrame, members: DataFrame) -> DataFrame:
    """i, j, score of all pairs of members (rep, var) of scored pairs of representatives (i <= j); members are sent, in parts
    of PART, and no pair of members is shuffled."""
    sizes = members.groupBy("rep").agg(F.ceil(F.count("*") / PART).alias("parts"))
    own = kept(members.join(sizes, "rep").groupBy("rep", F.pmod(F.hash("var"), F.col("parts").cast("int")).alias("part")).agg(F.collect_list("var").alias("own")))
    a, b = (F.broadcast(own.select(F.col("rep").alias(k), F.col("part").alias(f"part_{k}"), F.col("own").alias(f"own_{k}"))) for k in ("i", "j"))
    at = scores
    if own.filter("part > 0").isEmpty():
        at = at.join(a, "i")
    else:  # a pair of large ones is dealt out by their parts, numbers only
        at = at.join(a.drop("own_i"), "i").repartition(4 * scores.sparkSession.sparkContext.defaultParallelism, "i", "j", "part_i").join(a, ["i", "part_i"])
    x, y = F.col("x"), F.col("y")
    at = at.join(b, "j").select("i", "j", "score", "own_j", F.explode("own_i").alias("x")).select("i", "j", "score", "x", F.explode("own_j").alias("y"))
    return at.filter((F.col("i") < F.col("j")) | (x < y)).select(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"), "score")
