"""Values of pairs dealt to other pairs: pairs on their way take some bytes each, and tasks take a range of hashes each."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.digest import PairDigests, pair_digests
from netloom.functions.numeric import rounded_half_up
from netloom.operators.dependence import unit_rows
from netloom.sources.store import brief_shuffles, kept

#: Pairs of a range of hashes, about, that a task sorts at once, and pairs that are packed at once.
RANGE, AT_ONCE = 1 << 20, 1 << 21
#: Pairs, about, that are on their way at once, some 2 bytes each; and pairs of squares of variables for each core.
UNDER_WAY, PER_SLOT = 1 << 29, 4


def _packed(v: np.ndarray) -> bytes:
    """Numbers as deflated planes of bytes, each with codes of its own."""
    made = zlib.compressobj(6, zlib.DEFLATED, 15, 9, zlib.Z_RLE)
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T)
    return b"".join(made.compress(p.tobytes()) + made.flush(zlib.Z_SYNC_FLUSH) for p in planes) + made.flush()


def _unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_values(v: np.ndarray) -> tuple[int, bytes]:
    """Digits and packed values: as whole numbers where all are decimals of up to four digits, exactly, else as they are."""
    for digits in range(5):
        with np.errstate(invalid="ignore"):
            whole = np.rint(v * 10.0**digits)
            if ((whole >= 0) & (whole < 1 << 16) & (whole / 10.0**digits == v) & ~np.signbit(v)).all():
                return digits, _packed(whole.astype("<u2"))
    return -1, _packed(v)


def _unpacked_values(digits: int, data: bytes, n: int) -> np.ndarray:
    return _unpacked(data, "<f8", n) if digits < 0 else _unpacked(data, "<u2", n) / 10.0**digits


def _bits(rows: DataFrame, n: int) -> int:
    """Bits of a hash that a range of them shares."""
    return min(max(n // RANGE, 4 * rows.sparkSession.sparkContext.defaultParallelism, 1).bit_length(), 30)


def dealt_values(pairs: DataFrame, rep: int, value: str, n: int) -> DataFrame:
    """bucket, n, digits, data: the values of some n pairs (i, j integers) in the order of md5(rep~i~j); a bucket is a
    range of hashes, a row.

    Tasks pack the pairs that they make by buckets: gaps between pairs and values, 2 to 3 bytes a pair where they are
    made by blocks and have few digits. A bucket's task makes their hashes anew, sorts them and keeps the values only.
    """
    bits = _bits(pairs, n)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= AT_ONCE:
                yield packed(pd.concat(held))
                held, size = [], 0
        if size:
            yield packed(pd.concat(held))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, v = (pdf[c].to_numpy() for c in ("i", "j", value))
        i0, j0 = int(i.min()), int(j.min())
        width = int(j.max()) - j0 + 1
        at = (i.astype(np.int64) - i0) * width + (j.astype(np.int64) - j0)
        bucket = (pair_digests(rep, i, j)[0] >> np.uint64(64 - bits)).astype(np.int32)
        order = np.lexsort((at, bucket))
        at, v, bucket = at[order], v[order], bucket[order]
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
        rows, a = [], 0
        for b in ends.tolist():
            rows.append((bucket[a], b - a, i0, j0, width, _packed(np.diff(at[a:b], prepend=0)), *_packed_values(v[a:b])))
            a = b
        return pd.DataFrame(rows, columns=["bucket", "n", "i0", "j0", "width", "at", "digits", "data"])

    def dealt(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, v = [], [], []
        for r in pdf.itertuples():
            at = np.cumsum(_unpacked(r.at, "<i8", r.n))
            i.append(at // r.width + r.i0)
            j.append(at % r.width + r.j0)
            v.append(_unpacked_values(r.digits, r.data, r.n))
        v = np.concatenate(v)
        first, second = pair_digests(rep, np.concatenate(i), np.concatenate(j))
        order = np.argsort(first)
        if (np.diff(first[order]) == 0).any():
            order = np.lexsort((second, first))
        return pd.DataFrame([(key[0], len(v), *_packed_values(v[order]))], columns=["bucket", "n", "digits", "data"])

    narrow = pairs.select("i", "j", F.col(value).cast("double").alias(value))
    rows = narrow.mapInPandas(pack, "bucket int, n int, i0 int, j0 int, width long, at binary, digits int, data binary")
    return kept(rows.repartition(1 << bits, "bucket").groupBy("bucket").applyInPandas(dealt, "bucket int, n int, digits int, data binary"))


class Places:
    """The pairs i < j of variables of different groups, or of any where a group is missing, in their order."""

    def __init__(self, var: np.ndarray, grp: np.ndarray):
        """Different variables in ascending order; grp NaN: no group."""
        n = len(var)
        self.var, own = var.astype(np.int32), np.unique(grp, return_inverse=True)[1].astype(np.int64)
        self.grp = np.where(np.isnan(grp), n + np.arange(n), own)
        after = pd.Series(self.grp[::-1]).groupby(self.grp[::-1]).cumcount().to_numpy()[::-1]  # later ones of the group
        self.before = np.concatenate([[0], np.cumsum(n - 1 - np.arange(n) - after)]).astype(np.int64)
        self.made: dict[int, PairDigests] = {}

    def digests(self, rep: int) -> PairDigests:
        """Made once a process."""
        if rep not in self.made:
            self.made[rep] = PairDigests(rep, self.var)
        return self.made[rep]

    def __len__(self) -> int:
        return int(self.before[-1])

    def between(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """i and j of the pairs at places a to b - 1."""
        i, j = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        p = int(np.searchsorted(self.before, a, "right")) - 1
        while a < b:
            end = min(b, int(self.before[p + 1]))
            if end > a:
                others = self.var[p + 1 :][self.grp[p + 1 :] != self.grp[p]]
                j.append(others[a - self.before[p] : end - self.before[p]])
                i.append(np.full(end - a, self.var[p]))
                a = end
            p += 1
        return np.concatenate(i), np.concatenate(j)


def dealt_correlations(rows: DataFrame, places: Places, rep: int, digits: int) -> DataFrame:
    """bucket, n, digits, data as of `dealt_values`: rounded absolute correlations of the pairs of places; rows are var, x (values in
    the order of samples).

    Tasks take pairs of squares of variables, multiply them, hash their pairs and pack those of the ranges of a pass,
    so that no pair is a row and only UNDER_WAY of them are shuffled before their values are kept.
    """
    spark, n, many = rows.sparkSession, len(places), len(places.var)
    bits, side = _bits(rows, n), math.ceil(math.sqrt(2 * PER_SLOT * rows.sparkSession.sparkContext.defaultParallelism))
    size = max(1, -(-many // side))
    shared = spark.sparkContext.broadcast(places)

    def packed(held: list[tuple[np.ndarray, ...]], p: int, q: int) -> pd.DataFrame:
        bucket, at, v = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(bucket, kind="stable")
        bucket, at, v = bucket[order], at[order], v[order]
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)).tolist()
        out = [(int(bucket[a]), b - a, p, q, _packed(np.diff(at[a:b], prepend=0)), *_packed_values(v[a:b])) for a, b in zip([0, *ends], ends)]
        return pd.DataFrame(out, columns=["bucket", "n", "p", "q", "at", "digits", "data"])

    def pack(low: int, high: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(list(batches)).sort_values("k")
            p, q = int(pdf.p.iloc[0]), int(pdf.q.iloc[0])
            (ka, ua), (kb, ub) = ((t.k.to_numpy(), unit_rows(np.stack(t.x.to_list()))) for t in (pdf[pdf.k // size == s] for s in (p, q)))
            grp, digests = shared.value.grp, shared.value.digests(rep)
            held, count, step = [], 0, max(1, AT_ONCE // 2 // len(kb))
            for a in range(0, len(ka), step):
                i, first = ka[a : a + step], a if p == q else 0
                j = kb[first:]
                bucket = digests.tops(i, j) >> np.uint32(32 - bits)
                keep = (bucket >= low) & (bucket < high) & (grp[i][:, None] != grp[j][None, :])
                if p == q:
                    keep &= i[:, None] < j[None, :]
                at = np.flatnonzero(keep)
                r = (ua[a : a + step] @ ub[first:].T).ravel()[at]
                at = at.astype(np.uint32)
                x = at // np.uint32(len(j))
                own = ((i - p * size) * size)[x] + (j - q * size)[at - x * np.uint32(len(j))]
                held.append((bucket.ravel()[at].astype(np.uint16 if bits <= 16 else np.uint32), own, rounded_half_up(np.abs(r), digits)))
                count += len(at)
                if count >= AT_ONCE:
                    yield packed(held, p, q)
                    held, count = [], 0
            if count:
                yield packed(held, p, q)

        return run

    def dealt(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, v = [], [], []
        for r in pdf.itertuples():
            at = np.cumsum(_unpacked(r.at, "<i8", r.n))
            x = at // size
            a.append(x + r.p * size)
            b.append(at - x * size + r.q * size)
            v.append(_unpacked_values(r.digits, r.data, r.n))
        a, b, v = np.concatenate(a), np.concatenate(b), np.concatenate(v)
        first = shared.value.digests(rep).firsts(a, b)
        order = np.argsort(first)
        if (np.diff(first[order]) == 0).any():
            order = np.lexsort((pair_digests(rep, shared.value.var[a], shared.value.var[b])[1], first))
        return pd.DataFrame([(key[0], len(v), *_packed_values(v[order]))], columns=["bucket", "n", "digits", "data"])

    passes = max(1, -(-n // UNDER_WAY))
    ends = [(1 << bits) * k // passes for k in range(passes + 1)]
    with brief_shuffles(spark):
        numbered = spark.createDataFrame(pd.DataFrame({"var": places.var, "k": np.arange(many)}), "var int, k long")
        own = kept(rows.join(F.broadcast(numbered), "var").select("k", F.floor(F.col("k") / size).cast("int").alias("square"), "x"))
        other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(0, many - 1) // size))))
        squares = other.select("k", "x", F.least("square", "other").alias("p"), F.greatest("square", "other").alias("q")).repartition(2 * side * side, "p", "q")
        out = []
        for low, high in zip(ends, ends[1:]):
            sent = squares.groupBy("p", "q").applyInPandas(pack(low, high), "bucket int, n int, p int, q int, at binary, digits int, data binary")
            out.append(kept(sent.repartition(high - low, "bucket").groupBy("bucket").applyInPandas(dealt, "bucket int, n int, digits int, data binary")))
    return reduce(DataFrame.unionByName, out)


def placed(values: DataFrame, places: Places | None, value: str) -> DataFrame:
    """i, j, value, or without places k (from 1), value: the values of `dealt_values` with before, the number of those in buckets before."""
    shared = values.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                v = _unpacked_values(r.digits, r.data, r.n)
                for a in range(0, r.n, RANGE):
                    b = min(r.n, a + RANGE)
                    if shared.value is None:
                        yield pd.DataFrame({"k": np.arange(r.before + a + 1, r.before + b + 1), value: v[a:b]})
                    else:
                        i, j = shared.value.between(r.before + a, r.before + b)
                        yield pd.DataFrame({"i": i, "j": j, value: v[a:b]})

    return values.mapInPandas(run, f"{'k long' if places is None else 'i int, j int'}, `{value}` double")
