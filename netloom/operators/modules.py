"""Modules of operators, and their alignment with reference modules: tables (module, member)."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.numeric import ordered
from netloom.sources.store import kept

#: Edges that a task takes in at once, at least.
AT_ONCE = 1 << 18


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges from the smallest node of each component to its others."""
    nodes, at = np.unique(np.concatenate([pdf.a.to_numpy(), pdf.b.to_numpy()]), return_inverse=True)
    a, b = at[: len(pdf)], at[len(pdf) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    member = root != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[root[member]], "b": nodes[member]})


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect in each partition what its edges connect; a task holds some of them and the forest so far."""

    def own(batches):
        so_far, new, n = None, [], 0
        for pdf in batches:
            new.append(pdf)
            n += len(pdf)
            if n >= max(AT_ONCE, 0 if so_far is None else len(so_far)):
                so_far = _forest(pd.concat(new if so_far is None else [so_far, *new]))
                new, n = [], 0
        if new or so_far is not None:
            yield _forest(pd.concat(new if so_far is None else [so_far, *new]))

    return edges.mapInPandas(own, edges.schema)


def components(a: DataFrame, least_size: int = 1) -> DataFrame:
    """module, member: connected components of the undirected positive edges, largest first.

    Each partition of the edges first keeps a forest of them, no more edges than nodes. Every round a node and its root
    so far take the smallest root of the node's neighbours, then roots are followed one step. Each round is cut off
    from the ones before.
    """
    nodes = a.select(F.col("src").alias("v")).unionByName(a.select(F.col("dst").alias("v"))).distinct()
    edges = forest(a.filter("w > 0 AND src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = kept(edges.select(F.inline(ways)).distinct())  # one pass over the forests
    roots = kept(nodes.select("v", F.col("v").alias("root")))
    while True:
        near = both.join(roots.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b").join(roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a")
        told = near.filter("rb < ra").select(F.explode(F.array("a", "ra")).alias("v"), F.col("rb").alias("root"))
        if told.isEmpty():
            break
        lower = kept(roots.unionByName(told).groupBy("v").agg(F.min("root").alias("root")))
        up = lower.select(F.col("v").alias("root"), F.col("root").alias("top"))
        roots = kept(lower.join(up, "root").select("v", F.col("top").alias("root")))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    # one row a component
    named = sizes.withColumn("k", F.row_number().over(W.orderBy(F.col("n").desc(), "root"))).filter(F.col("n") >= least_size)
    out = roots.join(named, "root").select(F.concat(F.lit("module_"), F.col("k").cast("string")).alias("module"), F.col("v").alias("member"))
    if out.isEmpty():
        raise ValueError("no module has that many members")
    return out


def complete_linkage(correlations: DataFrame, height: float) -> DataFrame:
    """module, member: complete-linkage clusters of 1 - |r|, cut at the height, largest first.

    Only pairs within the height count: a pair of clusters can merge if all pairs across have such. In each
    round all clusters that are each other's nearest merge at once, which gives what merging the
    nearest two, one after another, gives: the distance to a merged cluster is never less than to its parts,
    and ties go to the smaller members, by which clusters are known. No task has more than some of the pairs.
    """
    pairs = correlations.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (1 - F.abs("r")).alias("d"))
    labels = kept(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("label", F.col("v")))
    edges = kept(pairs.filter(F.col("d") <= height))
    while True:
        near = edges.select(F.explode(F.array("a", "b")).alias("v"), F.struct("d", "a", "b").alias("pair")).groupBy("v").agg(F.min("pair").alias("pair"))
        merges = kept(near.groupBy("pair").agg(F.count("*").alias("n")).filter("n = 2").select(F.col("pair.a").alias("into"), F.col("pair.b").alias("gone")))
        if merges.isEmpty():
            break
        # both members of a merge go by the first; of the pairs of two clusters all have to be there
        to = merges.select(F.inline(F.array(F.struct(F.col("into").alias("v"), "into"), F.struct(F.col("gone").alias("v"), "into"))))
        ta, tb = to.select(F.col("v").alias("a"), F.col("into").alias("to_a")), to.select(F.col("v").alias("b"), F.col("into").alias("to_b"))
        at = edges.join(ta, "a", "left").join(tb, "b", "left")
        parts = F.when(F.col("to_a").isNull(), 1).otherwise(2) * F.when(F.col("to_b").isNull(), 1).otherwise(2)
        at = at.select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"), "d", parts.alias("parts")).filter("x <> y")
        merged = at.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("d").alias("d"), F.count("*").alias("n"), F.first("parts").alias("parts"))
        edges = kept(merged.filter("n = parts").select("a", "b", "d"))
        labels = kept(labels.join(merges.select(F.col("gone").alias("label"), "into"), "label", "left").select("v", F.coalesce("into", "label").alias("label")))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    named = sizes.withColumn("k", F.row_number().over(W.orderBy(F.col("n").desc(), "label")))  # one row a module
    return labels.join(named, "label").select(F.concat(F.lit("module_"), F.col("k").cast("string")).alias("module"), F.col("v").cast("int").alias("member"))


def validated(modules: DataFrame) -> DataFrame:
    """Distinct members, without nulls and empty names; modules must be named."""
    if modules.filter(F.col("module").isNull() | (F.col("module").cast("string") == "")).limit(1).count():
        raise ValueError("modules have names")
    out = modules.filter(F.col("member").isNotNull() & (F.trim(F.col("member").cast("string")) != "")).select("module", "member").distinct()
    if out.isEmpty():
        raise ValueError("no module has members")
    return out


def pair_statistics(reference: DataFrame, found: DataFrame, every: bool = True) -> DataFrame:
    """ref, found, overlap, size_ref, size_found, precision, recall, f1, jaccard of all pairs of modules.

    Without `every` only of pairs that share members, which is all that alignments need; a module that shares
    none has one row, whose partner is null. Pairs are joined on members, and no task has all of them.
    """
    r, f = reference.select(F.col("module").alias("ref"), "member"), found.select(F.col("module").alias("found"), "member")
    shared = r.join(f, "member").groupBy("ref", "found").agg(F.count("*").alias("overlap"))
    rs, fs = r.groupBy("ref").agg(F.count("*").alias("size_ref")), f.groupBy("found").agg(F.count("*").alias("size_found"))
    if every:
        pairs = rs.crossJoin(fs).join(shared, ["ref", "found"], "left")
    else:
        pairs = rs.join(shared, "ref", "left").join(fs, "found", "full")
    pairs = pairs.withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    o = F.col("overlap").cast("double")
    return pairs.select(
        "ref", "found", "overlap", "size_ref", "size_found",
        (o / F.col("size_found")).alias("precision"),
        (o / F.col("size_ref")).alias("recall"),
        (2 * o / (F.col("size_ref") + F.col("size_found"))).alias("f1"),
        (o / (F.col("size_ref") + F.col("size_found") - o)).alias("jaccard"),
    )


def _aligned(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """A row a reference module; without a partner all are 0."""
    refs = stats.filter("ref IS NOT NULL").select("ref", "size_ref").distinct()
    own = chosen.select("ref", F.col("found").alias("top_found"), "f1", "precision", "recall", "jaccard")
    zero = {c: 0.0 for c in ("f1", "precision", "recall", "jaccard")}
    return refs.join(own, "ref", "left").fillna(zero)


def best(stats: DataFrame, digits: int | None = None) -> DataFrame:
    """Each reference module's found one of largest F1 (to `digits`), the first of several; many may share one."""
    rank = F.row_number().over(W.partitionBy("ref").orderBy(ordered(F.col("f1"), digits).desc(), "found"))
    return _aligned(stats, stats.filter("overlap > 0").withColumn("k", rank).filter("k = 1"))


def matching(ref: np.ndarray, found: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which of the pairs (ref, found), numbered from 0, are in the one-to-one matching of largest total value.

    References are added one after another. Each time the exchange that gains most is made: a chain of pairs
    to take and to give up, from the new reference to a free module, or to a reference that is left without.
    """
    taken = np.full(found.max() + 1, -1)  # the pair that a found module is in
    of_ref = np.full(ref.max() + 1, -1)  # the pair that a reference is in
    for new in range(len(of_ref)):
        gain, by = np.full(len(taken), -np.inf), np.full(len(taken), -1)
        at = np.flatnonzero(ref == new)
        while len(at):
            # gains at the modules that these pairs lead to, where they are better than before
            held = of_ref[ref[at]]
            left = np.where(held < 0, 0.0, gain[found[held]] - value[held])
            got = left + value[at]
            better = (got > gain[found[at]] + 1e-12) & (at != held)
            at, got = at[better], got[better]
            order = np.argsort(got, kind="stable")
            gain[found[at[order]]], by[found[at[order]]] = got[order], at[order]
            moved = taken[np.unique(found[at])]
            at = np.flatnonzero(np.isin(ref, ref[moved[moved >= 0]]))
        ends = np.where(taken < 0, gain, gain - np.where(taken < 0, 0.0, value[taken]))
        last = int(np.argmax(ends))
        if ends[last] <= 1e-12:
            continue
        if taken[last] >= 0:
            of_ref[ref[taken[last]]] = -1
        while last >= 0:
            pair = by[last]
            before = of_ref[ref[pair]]
            taken[last], of_ref[ref[pair]] = pair, pair
            last = -1 if before < 0 else int(found[before])
    return np.isin(np.arange(len(ref)), of_ref)


def _bids(pairs: DataFrame, rounds: int, step: float) -> DataFrame:
    """found, price, owner after rounds of an auction: each reference without a module bids for its best one what
    that is worth to it above the second best and the step; the highest bid has it."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    prices = pairs.sparkSession.createDataFrame([], f"found {kinds['found']}, price double, owner {kinds['ref']}")
    by = W.partitionBy("ref").orderBy(F.col("net").desc(), "found")
    for _ in range(rounds):
        free = pairs.join(prices.select(F.col("owner").alias("ref")).filter("ref IS NOT NULL"), "ref", "left_anti")
        net = free.join(prices, "found", "left").select("ref", "found", F.coalesce("price", F.lit(0.0)).alias("price"), (F.col("f1") - F.coalesce("price", F.lit(0.0))).alias("net"))
        two = net.filter("net > 0").withColumn("k", F.row_number().over(by)).filter("k <= 2")
        best = two.groupBy("ref").agg(F.min_by(F.struct("found", "price", "net"), "k").alias("b"), F.max(F.when(F.col("k") == 2, F.col("net"))).alias("second"))
        bids = best.select("ref", "b.found", (F.col("b.price") + F.col("b.net") - F.coalesce("second", F.lit(0.0)) + step).alias("bid"))
        won = kept(bids.groupBy("found").agg(F.max(F.struct("bid", "ref")).alias("w")))
        if won.isEmpty():
            break
        prices = kept(prices.join(won, "found", "full").select("found", F.coalesce("w.bid", "price").alias("price"), F.coalesce("w.ref", "owner").alias("owner")))
    return prices


def _needed(pairs: DataFrame, prices: DataFrame) -> DataFrame:
    """The pairs that a best matching can hold, by group: what a price and the best net value of a reference leave
    a pair short of is at most what bounds the total from above less what the auction has reached."""
    at = pairs.join(prices, "found", "left").withColumn("price", F.coalesce("price", F.lit(0.0)))
    nets = at.groupBy("group", "ref").agg(F.greatest(F.max(F.col("f1") - F.col("price")), F.lit(0.0)).alias("net"))
    paid = at.groupBy("group", "found").agg(F.max("price").alias("price"), F.sum(F.when(F.col("owner") == F.col("ref"), F.col("f1"))).alias("reached"))
    gap = nets.groupBy("group").agg(F.sum("net").alias("nets")).join(paid.groupBy("group").agg(F.sum("price").alias("prices"), F.sum("reached").alias("reached")), "group")
    gap = gap.select("group", (F.col("nets") + F.col("prices") - F.coalesce("reached", F.lit(0.0)) + 1e-9).alias("gap"))
    return at.join(nets, ["group", "ref"]).join(gap, "group").filter(F.col("net") + F.col("price") - F.col("f1") <= F.col("gap")).select(*pairs.columns)


def _grouped(pairs: DataFrame) -> DataFrame:
    """Pairs with the number of their component of modules that share members."""
    r, f = F.concat(F.lit("r"), F.col("ref").cast("string")), F.concat(F.lit("f"), F.col("found").cast("string"))
    own = components(pairs.select(r.alias("src"), f.alias("dst"), F.lit(1.0).alias("w"))).select(F.col("module").alias("group"), F.col("member").alias("node"))
    return pairs.drop("group").withColumn("node", r).join(own, "node").drop("node")


def hungarian(stats: DataFrame, largest: int = 100_000, rounds: int = 32, step: float = 1e-3) -> DataFrame:
    """The one-to-one alignment of largest total F1.

    Pairs without a shared member add nothing, so components of modules that share members are solved apart,
    each in a task. Where one has more pairs than `largest`, an auction of `rounds` first bounds the total, and pairs
    that no best matching can hold go; what is left falls into components again, with steps a tenth as
    large while some are too large. The total is exact in any case. Of alignments of equal totals one is taken.
    """
    names = ["ref", "found", "overlap", "f1", "precision", "recall", "jaccard"]
    pairs = kept(stats.filter("overlap > 0").select(*names))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    if pairs.isEmpty():
        return _aligned(stats, pairs)
    pairs = kept(_grouped(pairs))
    while (most := _most(pairs)) > largest:
        fewer = kept(_grouped(kept(_needed(pairs, _bids(pairs, rounds, step)))))
        if _most(fewer) >= most and step < 1e-9:
            raise ValueError(f"{most} pairs of modules depend on each other; at most {largest} are solved in a task")
        pairs, step = fewer, step / 10

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ref", "found"])
        return pdf[matching(pd.factorize(pdf.ref)[0], pd.factorize(pdf.found)[0], pdf.f1.to_numpy())][names]

    return _aligned(stats, pairs.groupBy("group").applyInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in names)))


def _most(pairs: DataFrame) -> int:
    return pairs.groupBy("group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]


def _started(own: DataFrame, key: str, other: DataFrame, other_key: str, pairs: DataFrame) -> DataFrame:
    """own with potentials at which no entry of the plan exceeds 1, and one for each module is 1."""
    top = F.max(F.col("h") + F.col("b"))
    near = pairs.join(other.select(other_key, F.col("at").alias("b")), other_key).groupBy(key).agg(top.alias("top"))
    return own.join(near, key, "left").select(key, "copies", (-F.greatest(F.coalesce("top", F.lit(float("-inf"))), other.agg(F.max("at")).scalar())).alias("at"))


def _scaled(own: DataFrame, key: str, other: DataFrame, other_key: str, pairs: DataFrame, n: int) -> DataFrame:
    """key, copies, was, mass, at: each module's mass in the plan, and its potential moved so that it is 1 / n.

    Pairs that share nothing have no reward, so their part of a mass is a product of two sums; only pairs that
    share members are added one by one. With the other side scaled before, no entry exceeds 1 / n.
    """
    both = pairs.join(own.select(key, F.col("at").alias("a")), key).join(other.select(other_key, F.col("at").alias("b")), other_key)
    more = both.groupBy(key).agg(F.sum(F.exp(F.col("h") + F.col("a") + F.col("b")) * -F.expm1(-F.col("h"))).alias("more"))
    top = own.agg(F.max("at")).scalar()
    flat = other.agg(F.sum(F.col("copies") * F.exp(F.col("at") + top))).scalar()
    mass = F.exp(F.col("at") - top) * flat + F.coalesce("more", F.lit(0.0))
    return own.join(more, key, "left").select(key, "copies", F.col("at").alias("was"), mass.alias("mass")).withColumn("at", F.col("was") - F.log(n * F.col("mass")))


def soft(stats: DataFrame, epsilon: float = 0.1, tolerance: float = 1e-5, most: int = 1000) -> DataFrame:
    """ref, size_ref, expected f1, precision, recall and jaccard, dummy_mass, entropy (nats, dummies as one), top_found,
    top_prob, rounds, converged: the transport plan of uniform margins and rewards F1 / epsilon, sides padded alike.

    A round is two aggregations, of the pairs that share members; the margin furthest from 1 / n, one number,
    ends them. Modules and pairs stay in tables; each round is cut off from the ones before.
    """
    if not (0 < epsilon < float("inf") and tolerance > 0 and most >= 1):
        raise ValueError("epsilon, tolerance and rounds are positive")
    names = ["f1", "precision", "recall", "jaccard"]
    pairs = kept(stats.filter("overlap > 0").select("ref", "found", *names, (F.col("f1") / epsilon).alias("h")))
    refs = kept(stats.filter("ref IS NOT NULL").select("ref", "size_ref").distinct())
    founds = kept(stats.filter("found IS NOT NULL").select("found").distinct())
    nr, nf = refs.count(), founds.count()
    n = max(nr, nf)

    def padded(side: DataFrame, key: str, more: int) -> DataFrame:
        own = side.select(key, F.lit(1).alias("copies"), F.lit(0.0).alias("at"))
        dummy = side.sparkSession.range(1 if more else 0).select(F.lit(None).cast(side.schema[key].dataType).alias(key), F.lit(more).alias("copies"), F.lit(0.0).alias("at"))
        return own.unionByName(dummy)

    rows, cols = padded(refs, "ref", n - nr), padded(founds, "found", n - nf)
    def scaled(own: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
        return kept(_scaled(own, key, other, other_key, pairs, n))

    rows = scaled(_started(rows, "ref", cols, "found", pairs), "ref", cols, "found")
    cols = scaled(_started(cols, "found", rows, "ref", pairs), "found", rows, "ref")
    for rounds in range(1, most + 1):
        at = scaled(rows, "ref", cols, "found")
        error = at.agg(F.max(F.abs(F.col("mass") - 1 / n))).first()[0]
        if error < tolerance or rounds == most:
            break
        rows, cols = at, scaled(cols, "found", at, "ref")
    if error >= tolerance:
        warnings.warn("the transport plan has not converged", stacklevel=2)
    return _expected(refs, pairs, at, cols, names).withColumns({"rounds": F.lit(rounds), "converged": F.lit(error < tolerance)})


def _expected(refs: DataFrame, pairs: DataFrame, rows: DataFrame, cols: DataFrame, names: list[str]) -> DataFrame:
    """What each reference expects of its row of the plan, which is divided by its mass."""
    top = rows.agg(F.max("was")).scalar()
    each = F.exp(F.col("at") + top)
    real = cols.filter("found IS NOT NULL")
    flat, logs = real.agg(F.sum(each)).scalar(), real.agg(F.sum(each * F.col("at"))).scalar()
    dummies = F.coalesce(cols.filter("found IS NULL").agg(F.sum(F.col("copies") * each)).scalar(), F.lit(0.0))
    first = real.agg(F.min(F.struct((-F.round("at", 9)).alias("o"), "found", "at")).alias("t"))
    p, q = F.exp(F.col("h") + F.col("was") + F.col("at")) / F.col("mass"), F.exp(F.col("was") + F.col("at")) / F.col("mass")
    log = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    own = pairs.join(rows.select("ref", "was", "mass"), "ref").join(real.select("found", "at"), "found").withColumns({"p": p, "q": q})
    sums = own.groupBy("ref").agg(
        *[F.sum(F.col("p") * F.col(c)).alias(c) for c in names],
        F.sum(log(F.col("p")) - log(F.col("q"))).alias("logs"),
        F.min(F.struct((-F.round("p", 9)).alias("o"), "found", "p")).alias("t"),
    )
    share = F.exp(F.col("was") - top) / F.col("mass")
    flat_log = share * (logs + flat * (F.col("was") - F.log("mass")))
    far = F.exp(F.col("was") + first.select("t.at").scalar()) / F.col("mass")
    best = F.least("t", F.struct((-F.round(far, 9)).alias("o"), first.select("t.found").scalar().alias("found"), far.alias("p")))
    at = refs.join(rows.filter("ref IS NOT NULL").select("ref", "was", "mass"), "ref").join(sums, "ref", "left")
    at = at.withColumns({"dummy_mass": share * dummies, "best": best}).withColumn("entropy", -flat_log - F.coalesce("logs", F.lit(0.0)) - log(F.col("dummy_mass")))
    return at.select("ref", "size_ref", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names], "dummy_mass", "entropy", F.col("best.found").alias("top_found"), F.col("best.p").alias("top_prob"))


def summary(aligned: DataFrame, n_found: int) -> DataFrame:
    """One row over the reference modules of an alignment; of a soft one also its dummy mass, entropy and rounds."""
    size = F.col("size_ref").cast("double")
    return aligned.agg(
        F.count("*").alias("n_ref"),
        F.lit(n_found).cast("long").alias("n_found"),
        F.avg("f1").alias("mean_f1"),
        (F.sum(F.col("f1") * size) / F.sum(size)).alias("weighted_f1"),
        F.percentile("f1", F.lit(0.5)).alias("median_f1"),
        F.avg((F.col("f1") >= 0.5).cast("double")).alias("recovery_rate"),
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
        *([F.avg("dummy_mass").alias("mean_dummy_mass"), F.avg("entropy").alias("mean_entropy"), F.max("rounds").alias("rounds"), F.every("converged").alias("converged")] if "dummy_mass" in aligned.columns else []),
    )
