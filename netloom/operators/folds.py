"""All pairs of correlated variables, counted or handed on by the tasks that make them.

Tasks take pairs of squares of variables, multiply them, round absolute correlations to some digits and fold their pairs into counts
of equal scores, so that no pair becomes a row unless it is a row of the result. What is sent are variables, to about the root of as
many tasks as there are pairs of squares, and counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.numeric import half_up_codes
from netloom.operators.dependence import unit_rows
from netloom.operators.truths import member_sets
from netloom.sources.store import kept

#: Variables of a square, at least and at most, pairs of squares for each core, and pairs that a task has at once.
LEAST, MOST, PER_SLOT, AT_ONCE = 128, 1 << 14, 4, 1 << 18
#: Bins of a pass that looks for places in an order.
BINS = 1 << 16


@dataclass
class Side:
    """Variables of a square in their order: groups as numbers (missing ones NaN, so unlike all), sets, and the columns sent with them."""

    var: np.ndarray
    grp: np.ndarray
    of: dict
    unit: np.ndarray | None
    columns: pd.DataFrame

    def within(self, a: int, b: int) -> dict:
        """The sets of the variables a to b - 1, with their places from a on."""
        out = {}
        for s, at in self.of.items():
            low, high = np.searchsorted(at, (a, b))
            if high > low:
                out[s] = at[low:high] - a
        return out


@dataclass
class Chunk:
    """Pairs of the left side's variables a to b - 1 with the right side's from `first` on: codes of scores (1 + score * 10 ^ digits, 0
    where there is none), and which are pairs."""

    a: int
    b: int
    first: int
    code: np.ndarray | None
    keep: np.ndarray

    def labels(self, left: Side, right: Side) -> np.ndarray:
        """Whether pairs share a set."""
        out = np.zeros(self.keep.shape, bool)
        for _, x, y in self.shared(left, right):
            out[np.ix_(x, y)] = True
        return out

    def shared(self, left: Side, right: Side, name: str = "of") -> Iterator[tuple]:
        """Sets that occur on both sides, with the places of their members."""
        there = right.within(self.first, len(right.var))
        for s, x in left.within(self.a, self.b).items():
            if s in there:
                yield s, x, there[s]


def _side(pdf: pd.DataFrame) -> Side:
    grp = pdf.grp.to_numpy(float) if "grp" in pdf else np.full(len(pdf), np.nan)
    of: dict = {}
    if "own" in pdf:
        for at, own in enumerate(pdf.own):
            for s in own if own is not None else ():
                of.setdefault(s, []).append(at)
    unit = unit_rows(np.stack(pdf.x.to_list())) if "x" in pdf and len(pdf) else None
    return Side(pdf["var"].to_numpy(), grp, {s: np.array(at) for s, at in of.items()}, unit, pdf)


def _chunks(left: Side, right: Side, digits: int) -> Iterator[Chunk]:
    same, odd = left is right, left.unit is not None and bool(np.isnan(left.unit).any() or np.isnan(right.unit).any())
    step = max(1, AT_ONCE // max(1, len(right.var)))
    for a in range(0, len(left.var), step):
        b, first = min(len(left.var), a + step), a if same else 0
        keep = left.grp[a:b, None] != right.grp[None, first:]
        if left.var[b - 1] >= right.var[first]:
            keep &= left.var[a:b, None] < right.var[None, first:]
        code = None
        if left.unit is not None:
            r = np.abs(left.unit[a:b] @ right.unit[first:].T)
            none = np.isnan(r) if odd else None
            code = half_up_codes(np.where(none, 0, r) if odd else r, digits) + 1
            if odd:
                code[none] = 0
        yield Chunk(a, b, first, code, keep)


def folded(
    variables: DataFrame, fold: Callable[[Side, Side, Iterator[Chunk]], Iterator[pd.DataFrame]], schema: str, digits: int = 2
) -> DataFrame:
    """What fold makes of all pairs of squares of variables: var, and any of x (values in the order of samples; without it there are no
    scores), own (sets), grp (pairs of one group are left out) and columns of its own. Pairs have i < j; each is in one pair of squares."""
    cores = variables.sparkSession.sparkContext.defaultParallelism
    variables = kept(variables)
    many = variables.select("var").distinct().count()
    size = min(MOST, max(LEAST, math.ceil(many / math.ceil(math.sqrt(2 * PER_SLOT * cores)))))
    squares = max(1, math.ceil(many / size))
    numbered = variables.select("var").distinct().select("var", (F.row_number().over(W.orderBy("var")) - 1).alias("k"))
    own = variables.join(F.broadcast(numbered), "var").withColumn("square", F.floor(F.col("k") / size).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(squares - 1))))
    dealt = dealt.withColumn("p", F.least("square", "other")).withColumn("q", F.greatest("square", "other")).drop("square", "other")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("k", kind="stable", ignore_index=True)
        p, q = int(pdf.p.iloc[0]), int(pdf.q.iloc[0])
        square = pdf.k // size
        left = _side(pdf[square == p].reset_index(drop=True))
        right = left if p == q else _side(pdf[square == q].reset_index(drop=True))
        if len(left.var) and len(right.var):
            yield from fold(left, right, _chunks(left, right, digits))

    return dealt.repartition(squares * (squares + 1), "p", "q").groupBy("p", "q").applyInPandas(run, schema)


def rows_of(m: DataFrame) -> DataFrame:
    """var, x: a variable's values in the order of samples."""
    return m.groupBy("var").agg(F.sort_array(F.collect_list(F.struct("sample", "x"))).alias("xs")).select("var", F.col("xs.x").alias("x"))


def with_members(rows: DataFrame, sets: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """rows of members of any set (set_id, member), with their sets and groups; members, a narrow row each, are sent."""
    return rows.join(F.broadcast(member_sets(sets, groups).withColumnRenamed("v", "var")), "var")


def scores(code: np.ndarray, digits: int) -> np.ndarray:
    """Scores of codes; a missing one is -infinity."""
    return np.where(code > 0, (code - 1) / 10.0**digits, -np.inf)


def _table(counts: dict, names: list[str], digits: int) -> pd.DataFrame:
    """Rows of counts {key: an array by code}, without zeros."""
    out = []
    for key, n in counts.items():
        at = np.flatnonzero(n)
        out.append(pd.DataFrame({**{c: [k] * len(at) for c, k in zip(names, key, strict=True)}, "score": scores(at, digits), "n": n[at]}))
    return pd.concat(out) if out else pd.DataFrame(columns=[*names, "score", "n"])


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"))


def label_counts(members: DataFrame, digits: int = 2, keyed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, keys: int = 1) -> DataFrame:
    """label, score, n: how many pairs of `with_members` share a set, or not, with that score; with keyed, key as well: numbers below `keys` of i and j."""
    width = 10**digits + 2

    def fold(left, right, chunks):
        found = np.zeros(2 * keys * width + 1, np.int64)
        for c in chunks:
            at = c.code.astype(np.int64)
            at += c.labels(left, right) * width
            if keyed is not None:
                at += keyed(left.var[c.a : c.b, None], right.var[None, c.first :]) * (2 * width)
            at[~c.keep] = 2 * keys * width
            found += np.bincount(at.ravel(), minlength=len(found))
        found = found[:-1].reshape(keys, 2, width)
        yield _table({(k, label): found[k, label] for k in range(keys) for label in range(2)}, ["key", "label"], digits)

    own = _summed(folded(members, fold, "key int, label int, score double, n long", digits), "key", "label", "score")
    return own if keyed is not None else own.drop("key")


def set_counts(members: DataFrame, kind: str, digits: int = 2) -> DataFrame:
    """set_id, label, score, n: of pairs of `with_members` those of both labels (set_id null), and of each set those that share it. kind: of set_id."""
    width = 10**digits + 2

    def fold(left, right, chunks):
        every, own = np.zeros((2, width), np.int64), {}
        for c in chunks:
            labels = c.labels(left, right)
            at = c.code.astype(np.int64)
            at += labels * width
            at[~c.keep] = 2 * width
            every += np.bincount(at.ravel(), minlength=2 * width + 1)[:-1].reshape(2, width)
            for s, x, y in c.shared(left, right):
                some = np.ix_(x, y)
                own[s] = own.get(s, 0) + np.bincount(c.code[some][c.keep[some]], minlength=width)
        yield _table({(None, label): every[label] for label in range(2)} | {(s, 1): n for s, n in own.items()}, ["set_id", "label"], digits)

    return _summed(folded(members, fold, f"set_id {kind}, label int, score double, n long", digits), "set_id", "label", "score")


def coherence_counts(rows: DataFrame, sets: DataFrame, variables: DataFrame, groups: DataFrame | None = None, least: int = 3, digits: int = 2) -> DataFrame:
    """set_id, label, score, n: counts of what `truths.labelled_sets` gives for rows (var, x)."""
    width, kind = 10**digits + 2, dict(sets.dtypes)["set_id"]
    own = sets.select("set_id", "member").distinct()
    big = own.withColumn("n", F.count("*").over(W.partitionBy("set_id"))).withColumn("big", F.when(F.col("n") >= least, F.col("set_id")))
    members = big.groupBy(F.col("member").alias("var")).agg(F.collect_set("set_id").alias("own"), F.collect_set("big").alias("big"))
    members = members.join(variables.select("var", F.lit(True).alias("known")).distinct(), "var", "full").withColumn("known", F.coalesce("known", F.lit(False)))
    if groups is not None:
        members = members.join(groups.select(F.col("member").alias("var"), "grp").distinct(), "var", "left")

    def fold(left, right, chunks):
        same, bigs = left is right, [{s for b in t.columns.big if b is not None for s in b} for t in (left, right)]
        found = [np.zeros((len(t.var), width), np.int64) for t in ((left,) if same else (left, right))]  # of pairs that share no set
        known = [t.columns.known.to_numpy(bool) for t in (left, right)]
        positive: dict = {}
        for c in chunks:
            apart = c.keep & ~c.labels(left, right)
            for s, x, y in c.shared(left, right):
                if s in bigs[0] and s in bigs[1]:
                    some = np.ix_(x, y)
                    positive[s] = positive.get(s, 0) + np.bincount(c.code[some][c.keep[some]], minlength=width)
            for t, (a, b), (u, v), axis in ((0, (c.a, c.b), (c.first, len(right.var)), 0), (1, (c.first, len(right.var)), (c.a, c.b), 1)):
                there = apart & (known[1][None, u:v] if axis == 0 else known[0][u:v, None])
                at = np.arange(b - a)[:, None] if axis == 0 else np.arange(b - a)[None, :]
                at = np.where(there, at * width + c.code, (b - a) * width)
                found[0 if same else t][a:b] += np.bincount(at.ravel(), minlength=(b - a) * width + 1)[:-1].reshape(b - a, width)
        negative: dict = {}
        for t, n in zip((left, right), found):
            of: dict = {}
            for at, b in enumerate(t.columns.big):
                for s in b if b is not None else ():
                    of.setdefault(s, []).append(at)
            for s, at in of.items():
                negative[s] = negative.get(s, 0) + n[at].sum(axis=0)
        yield _table({(s, 1): n for s, n in positive.items()} | {(s, 0): n for s, n in negative.items()}, ["set_id", "label"], digits)

    return _summed(folded(rows.join(F.broadcast(members), "var"), fold, f"set_id {kind}, label int, score double, n long", digits), "set_id", "label", "score")


def replicate_counts(members: DataFrame, replicates: DataFrame, digits: int = 2) -> DataFrame:
    """rep, label, score, n: of pairs of `with_members` whose variables are both in a replicate (rep, var)."""
    width = 10**digits + 2
    own = replicates.groupBy("var").agg(F.collect_set("rep").alias("reps"))

    def fold(left, right, chunks):
        sides = []
        for t in (left, right):
            of: dict = {}
            for at, reps in enumerate(t.columns.reps):
                for r in reps:
                    of.setdefault(r, []).append(at)
            sides.append({r: np.array(at) for r, at in of.items()})
        found: dict = {}
        for c in chunks:
            at = c.code.astype(np.int64)
            at += c.labels(left, right) * width
            at[~c.keep] = 2 * width
            for r, x in sides[0].items():
                y = sides[1].get(r)
                if y is not None:
                    x = x[np.searchsorted(x, c.a) : np.searchsorted(x, c.b)] - c.a
                    y = y[np.searchsorted(y, c.first) :] - c.first
                    found[r] = found.get(r, 0) + np.bincount(at[np.ix_(x, y)].ravel(), minlength=2 * width + 1)
        yield _table({(r, label): n[label * width : (label + 1) * width] for r, n in found.items() for label in range(2)}, ["rep", "label"], digits)

    return _summed(folded(members.join(F.broadcast(own), "var"), fold, "rep int, label int, score double, n long", digits), "rep", "label", "score")


def top_pairs(members: DataFrame, most: int, digits: int = 2) -> DataFrame:
    """i, j, label, score of some pairs of `with_members`, among which are the `most` first by descending score, i and j."""

    def fold(left, right, chunks):
        best, least = None, -1
        for c in chunks:
            x, y = np.nonzero(c.keep & (c.code >= least))
            if not len(x):
                continue
            own = pd.DataFrame({"i": left.var[c.a + x], "j": right.var[c.first + y], "label": c.labels(left, right)[x, y].astype(int), "score": c.code[x, y]})
            best = (own if best is None else pd.concat([best, own])).sort_values(["score", "i", "j"], ascending=[False, True, True]).head(most)
            if len(best) == most:
                least = int(best.score.iloc[-1])
        if best is not None:
            yield best.assign(score=scores(best.score.to_numpy(), digits))

    return folded(members, fold, "i int, j int, label int, score double", digits)


def emitted(variables: DataFrame, values: Callable[[Side, Side, Chunk, np.ndarray, np.ndarray], dict], schema: str, digits: int = 2) -> DataFrame:
    """i, j and what `values` gives for pairs at places (x, y) of a chunk: rows of a result that has all pairs."""

    def fold(left, right, chunks):
        for c in chunks:
            x, y = np.nonzero(c.keep)
            if len(x):
                yield pd.DataFrame({"i": left.var[c.a + x], "j": right.var[c.first + y], **values(left, right, c, x, y)})

    return folded(variables, fold, f"i int, j int, {schema}", digits)


def _packed(n: np.ndarray) -> bytes:
    return zlib.compress(n.astype(np.uint32).tobytes(), 1)


def by_variable(variables: DataFrame, cells: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, kinds: int, merged: Callable, schema: str, digits: int = 2) -> DataFrame:
    """What merged(vars, counts) makes of some variables and their counts of partners by score and kind (variables x codes x kinds); cells(var, partner) gives
    a pair's kind for var. Tasks send a packed row of counts for each variable of theirs."""
    width = 10**digits + 2

    def fold(left, right, chunks):
        same = left is right
        found = [np.zeros((len(t.var), width * kinds), np.int64) for t in ((left,) if same else (left, right))]
        for c in chunks:
            i, j = left.var[c.a : c.b, None], right.var[None, c.first :]
            code = c.code.astype(np.int64) * kinds
            for t, (a, b), at, (own, other) in ((0, (c.a, c.b), np.arange(c.b - c.a)[:, None], (i, j)), (1, (c.first, len(right.var)), np.arange(len(right.var) - c.first)[None, :], (j, i))):
                cell = at * (width * kinds) + code
                if cells is not None:
                    cell += cells(own, other)
                cell[~c.keep] = (b - a) * width * kinds
                found[0 if same else t][a:b] += np.bincount(cell.ravel(), minlength=(b - a) * width * kinds + 1)[:-1].reshape(b - a, -1)
        for t, n in zip((left, right), found):
            yield pd.DataFrame({"var": t.var, "n": [_packed(x) for x in n]})

    return _merged(folded(variables, fold, "var int, n binary", digits), width * kinds, lambda v, n: merged(v, n.reshape(len(v), width, kinds)), schema)


def _merged(parts: DataFrame, cells: int, made: Callable, schema: str) -> DataFrame:
    cores = parts.sparkSession.sparkContext.defaultParallelism

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        var, at = np.unique(pdf["var"].to_numpy(), return_inverse=True)
        n = np.zeros((len(var), cells), np.int64)
        for k, data in zip(at.tolist(), pdf.n):
            n[k] += np.frombuffer(zlib.decompress(data), np.uint32)
        return made(var, n)

    # buckets are ranges of hashes, a few for each core: a bucket's counts are some numbers for each of its variables
    return parts.groupBy(F.pmod(F.hash("var"), F.lit(8 * cores)).alias("bucket")).applyInPandas(run, schema)


def graded(variables: DataFrame, grade: Callable[[np.ndarray, np.ndarray], np.ndarray], grades: int, digits: int = 2) -> DataFrame:
    """src, rho, n: Spearman's correlation of a variable's scores with the grades (numbers below `grades`) of its pairs."""

    def merged(var, n):
        total = n.sum(axis=(1, 2)).astype(float)
        centred = []
        for axis in (2, 1):
            c = n.sum(axis=axis)
            centred.append(np.cumsum(c, axis=1) - (c - 1) / 2.0 - (total[:, None] + 1) / 2.0)
        x, y = centred
        xy = np.einsum("vab,va,vb->v", n, x, y, optimize=True)
        root = np.sqrt((n.sum(axis=2) * x * x).sum(axis=1)) * np.sqrt((n.sum(axis=1) * y * y).sum(axis=1))
        rho = pd.Series(np.divide(xy, root, out=np.full(len(var), np.nan), where=root > 0)).astype(object).where(root > 0, None)
        some = total > 0
        return pd.DataFrame({"src": var[some], "rho": rho[some].to_numpy(), "n": total[some].astype(np.int64)})

    return by_variable(variables, grade, grades, merged, "src int, rho double, n long", digits)


def rowwise(variables: DataFrame, held_out: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, digits: int = 2) -> DataFrame:
    """src, ap: of each variable's pairs, the average precision of their scores for its k partners of largest positive held_out(i, j), ties
    to the smaller one; scores that tie count at the end of their block. Variables without such partners are left out."""
    width = 10**digits + 2

    def best_of(at, held, dst, code):
        """The k best of each place."""
        order = np.lexsort((dst, -held, at))
        at, held, dst, code = (v[order] for v in (at, held, dst, code))
        first = np.append(True, at[1:] != at[:-1])
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        return tuple(v[rank < k] for v in (at, held, dst, code))

    def fold(left, right, chunks):
        same = left is right
        sides = (left,) if same else (left, right)
        counts = [np.zeros((len(t.var), width), np.int64) for t in sides]
        none = tuple(np.empty(0, kind) for kind in (np.int64, float, np.int64, np.int64))
        best, least = [none for _ in sides], [np.zeros(len(t.var)) for t in sides]
        for c in chunks:
            held = np.where(c.keep, held_out(left.var[c.a : c.b, None], right.var[None, c.first :]), 0.0)
            for t, start, axis in ((0, c.a, 0), (1, c.first, 1)):
                t, many = 0 if same else t, c.keep.shape[axis]
                at = np.arange(many).reshape((-1, 1) if axis == 0 else (1, -1))
                cell = np.where(c.keep, at * width + c.code, many * width)
                counts[t][start : start + many] += np.bincount(cell.ravel(), minlength=many * width + 1)[:-1].reshape(many, width)
                low = least[t][start : start + many]
                if axis == 0 and held.shape[1] > k:
                    low = np.maximum(low, np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k])
                x, y = np.nonzero((held >= (low[:, None] if axis == 0 else low[None, :])) & (held > 0))
                if len(x):
                    own, dst = (x, right.var[c.first + y]) if axis == 0 else (y, left.var[c.a + x])
                    new = (own + start, held[x, y], dst, c.code[x, y])
                    best[t] = best_of(*(np.concatenate(v) for v in zip(best[t], new, strict=True)))
                    full = np.bincount(best[t][0], minlength=len(sides[t].var)) == k
                    last = np.full(len(full), 0.0)
                    last[best[t][0]] = best[t][1]  # the last of a place is its least
                    least[t] = np.where(full, last, 0.0)
        for t, n, b in zip(sides, counts, best, strict=True):
            cuts = np.searchsorted(b[0], np.arange(len(t.var) + 1))
            lists = [[v[x:y].tolist() for x, y in zip(cuts, cuts[1:])] for v in b[1:]]
            yield pd.DataFrame({"var": t.var, "n": [_packed(x) for x in n], "held": lists[0], "dst": lists[1], "code": lists[2]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        var, at = np.unique(pdf["var"].to_numpy(), return_inverse=True)
        n, tp = np.zeros((len(var), width), np.int64), np.zeros((len(var), width), np.int64)
        for p, data in zip(at.tolist(), pdf.n):
            n[p] += np.frombuffer(zlib.decompress(data), np.uint32)
        sizes = [len(x) for x in pdf.held]
        own = best_of(np.repeat(at, sizes), *(np.concatenate([np.asarray(x, kind) for x in pdf[c]]) for c, kind in (("held", float), ("dst", np.int64), ("code", np.int64))))
        np.add.at(tp, (own[0], own[3]), 1)
        n, tp = n[:, ::-1], tp[:, ::-1]  # from the largest score down
        above, hits, all_ = np.cumsum(n, axis=1), np.cumsum(tp, axis=1), tp.sum(axis=1)
        ap = (tp * (hits / np.maximum(above, 1))).sum(axis=1) / np.maximum(all_, 1)
        return pd.DataFrame({"src": var, "ap": ap})[all_ > 0]

    parts = folded(variables, fold, "var int, n binary, held array<double>, dst array<int>, code array<int>", digits)
    cores = parts.sparkSession.sparkContext.defaultParallelism
    return parts.groupBy(F.pmod(F.hash("var"), F.lit(8 * cores)).alias("bucket")).applyInPandas(merged, "src int, ap double")


def value_counts(variables: DataFrame, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """value, n: pairs of each different whole number value(i, j)."""

    def fold(left, right, chunks):
        found: dict = {}
        for c in chunks:
            v = np.broadcast_to(value(left.var[c.a : c.b, None], right.var[None, c.first :]), c.keep.shape)[c.keep]
            if len(v):
                low = int(v.min())
                if int(v.max()) - low <= 16 * AT_ONCE:
                    n = np.bincount(v - low)
                    at = np.flatnonzero(n)
                    own = zip((at + low).tolist(), n[at].tolist())
                else:
                    own = zip(*(x.tolist() for x in np.unique(v, return_counts=True)))
                for x, many in own:
                    found[x] = found.get(x, 0) + many
        yield pd.DataFrame({"value": list(found), "n": list(found.values())}, dtype="int64")

    return _summed(folded(variables.select(*[c for c in variables.columns if c != "x"]), fold, "value long, n long"), "value")


def places(variables: DataFrame, order: Callable[[np.ndarray, np.ndarray], np.ndarray], ranks: Callable[[int], list[int]]) -> list[tuple[int, int, int]]:
    """(order, i, j) of the pairs at ranks(number of pairs), from 1 in the order of the whole number order(i, j), i and j.

    Each pass counts pairs by BINS ranges of what is left of the order's numbers, then of i and of j, so no pair is kept or sorted.
    """
    members = kept(variables.select(*[c for c in variables.columns if c not in ("x", "own")]))

    def keys(left, right, c):
        i, j = (np.broadcast_to(v, c.keep.shape)[c.keep].astype(np.int64) for v in (left.var[c.a : c.b, None], right.var[None, c.first :]))
        return order(i, j).astype(np.int64), i, j

    def ends(left, right, chunks):
        out = []
        for c in chunks:
            own = keys(left, right, c)
            if len(own[0]):
                out.append([len(own[0]), *(f(v) for v in own for f in (np.min, np.max))])
        if out:
            v = np.array(out)
            yield pd.DataFrame([[v[:, 0].sum(), *(v[:, k].min() if k % 2 else v[:, k].max() for k in range(1, 7))]], columns=names)

    names = ["n", "o0", "o1", "i0", "i1", "j0", "j1"]
    at = folded(members, ends, ", ".join(f"{c} long" for c in names)).agg(F.sum("n"), *(F.min(c) if c.endswith("0") else F.max(c) for c in names[1:])).first()  # one row
    if not at[0]:
        return []
    ranges = [(at[1], at[2]), (at[3], at[4]), (at[5], at[6])]
    found = [((), *ranges[0], rank) for rank in ranks(at[0])]  # what is known, the range of what comes next, the rank in it
    while any(len(known) < 3 for known, *_ in found):
        wanted = sorted({(known, low, high) for known, low, high, _ in found if len(known) < 3})

        def count(left, right, chunks):
            sums: dict = {}
            for c in chunks:
                own = keys(left, right, c)
                for w, (known, low, high) in enumerate(wanted):
                    some = np.ones(len(own[0]), bool) if not known else own[0] == known[0]
                    if len(known) > 1:
                        some &= own[1] == known[1]
                    v = own[len(known)][some] if known else own[0]
                    v = v[(v >= low) & (v <= high)]
                    if len(v):
                        sums[w] = sums.get(w, 0) + np.bincount((v - low) // (-(-(high - low + 1) // BINS)), minlength=BINS)
            for w, n in sums.items():
                b = np.flatnonzero(n)
                yield pd.DataFrame({"w": w, "bin": b, "n": n[b]})

        rows = _summed(folded(members, count, "w int, bin int, n long"), "w", "bin").orderBy("w", "bin").toPandas()  # up to BINS rows a range
        counts = {w: (t.bin.to_numpy(), np.cumsum(t.n.to_numpy())) for w, t in rows.groupby("w")}
        new = []
        for known, low, high, rank in found:
            if len(known) < 3:
                bins, upto = counts[wanted.index((known, low, high))]
                k, width = int(np.searchsorted(upto, rank)), -(-(high - low + 1) // BINS)
                rank -= int(upto[k - 1]) if k else 0
                low = low + int(bins[k]) * width
                high = min(high, low + width - 1)
                if width == 1:
                    known = (*known, low)
                    low, high = ranges[len(known)] if len(known) < 3 else (0, 0)
            new.append((known, low, high, rank))
        found = new
    return [known for known, *_ in found]


def parts_of(cuts: list[tuple[int, int, int]], order: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """How many of the cuts, ascending (order, i, j), stand before the pair (i, j)."""
    tops = np.array([c[0] for c in cuts], np.int64)

    def of(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        own = np.asarray(order(i.astype(np.int64), j.astype(np.int64)))
        out = np.searchsorted(tops, own, "left")
        for o, x, y in cuts:
            if (same := own == o).any():
                out += same & ((i > x) | ((i == x) & (j > y)))
        return out

    return of


def decile_ends(n: int) -> list[int]:
    """The last ranks of the first nine deciles by equal widths of rank, max(1, ceil(10 (rank - 1) / (n - 1)))."""
    out = []
    for d in range(1, 10):
        r = d * (n - 1) // 10 + 2
        while r > 1 and (n < 2 or math.ceil(10 * (r - 1) / (n - 1)) > d):
            r -= 1
        out.append(r)
    return out


def stratified_ranks(members: DataFrame, value: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int = 10, digits: int = 2, to: int = 6) -> DataFrame:
    """i, j, stratum (by quantiles of the whole number value(i, j)) and pct: the score's average rank within it, over its size, rounded."""
    some = F.percentile("value", F.array(*[F.lit(k / n) for k in range(1, n)]), F.col("n"))
    cuts = np.array(value_counts(members, value).agg(F.array_distinct(some)).first()[0] or [])  # below n numbers
    stratum = lambda i, j: np.searchsorted(cuts, value(i, j), "left")
    counts = label_counts(members, digits, stratum, n).groupBy("key", _code(digits)).agg(F.sum("n").alias("n"))
    up = W.partitionBy("key").orderBy(_last("code"))
    rank = (F.sum("n").over(up) - (F.col("n") - 1) / 2.0) / F.sum("n").over(W.partitionBy("key"))
    table = np.zeros((n, 10**digits + 2))
    for r in counts.select("key", "code", F.round(rank, to).alias("pct")).collect():  # a number a stratum and score
        table[r["key"], r["code"]] = r["pct"]

    def values(left, right, c, x, y):
        at = stratum(left.var[c.a + x], right.var[c.first + y])
        return {"stratum": at.astype(np.int32), "pct": table[at, c.code[x, y]]}

    return emitted(members, values, "stratum int, pct double", digits)


def _code(digits: int):
    return F.when(F.col("score") >= 0, F.round(F.col("score") * 10**digits) + 1).otherwise(0).cast("int").alias("code")


def _last(code: str):
    """Missing scores after all others, as engines order NaN."""
    return F.when(F.col(code) > 0, F.col(code)).otherwise(2**31 - 1)


def normal_sums(members: DataFrame, other: Callable[[np.ndarray, np.ndarray], np.ndarray], kinds: int, digits: int = 2, to: int = 6) -> DataFrame:
    """i, j, combined: the normal scores of the ranks of the score and of other(i, j), a number below `kinds`, summed over the root of 2, rounded."""
    from netloom.functions.numeric import inverse_normal

    counts = kept(label_counts(members, digits, other, kinds).select("key", _code(digits), "n"))
    z = []
    for name, order in (("code", _last("code")), ("key", F.col("key"))):
        own = counts.groupBy(name).agg(F.sum("n").alias("n"))
        rank = F.sum("n").over(W.orderBy(order)) - (F.col("n") - 1) / 2.0
        z.append(own.select(name, inverse_normal((rank - 0.375) / (F.sum("n").over(W.partitionBy()) + 0.25)).alias(f"z_{name}")))
    both = z[0].crossJoin(z[1]).select("code", "key", F.round((F.col("z_code") + F.col("z_key")) / F.sqrt(F.lit(2.0)), to).alias("z"))
    table = np.zeros((10**digits + 2, kinds))
    for r in both.collect():  # a number a score and kind
        table[r["code"], r["key"]] = r["z"] + 0.0
    values = lambda left, right, c, x, y: {"combined": table[c.code[x, y], other(left.var[c.a + x], right.var[c.first + y])]}
    return emitted(members, values, "combined double", digits)


def hub_scores(members: DataFrame, sum_to: int = 6, product_to: int = 9) -> DataFrame:
    """i, j, hub_sum, hub_product of the variables' masses (pi), rounded."""
    from netloom.functions.numeric import rounded_half_up

    rounded = lambda v, to: np.copysign(rounded_half_up(np.abs(v), to), v) + 0.0

    def values(left, right, c, x, y):
        a, b = left.columns.pi.to_numpy()[c.a + x], right.columns.pi.to_numpy()[c.first + y]
        return {"hub_sum": rounded(a + b, sum_to), "hub_product": rounded(a * b, product_to)}

    return emitted(members.select("var", "grp", "pi"), values, "hub_sum double, hub_product double")
