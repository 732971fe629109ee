"""Operator 3: exact top-k by integer inner product, with norm-bucketed retrieval.

Candidates are range-partitioned by descending length and cut into buckets of similar lengths. For a
query with a k-th score t so far, a bucket with lengths up to L can only help if the cosine reaches
t / (|q| L), the bucket's local threshold. Above 1 the bucket is skipped. A high threshold picks
coordinate pruning: along the query's largest coordinate, only unit vectors within the interval that
the threshold leaves. A low one picks length pruning: only the candidates of length t / |q| or more.
What is left is verified by exact integer products.

t starts from a bound: the k-th score of each query over the SEEDS longest vectors. It needs candidates
of length t / |q| or more, and the table of queries in the shared folder is sorted by that length, so a
chunk of candidates reads only the queries that its longest one can serve. Queries are read in blocks, so
no task holds more than a block of queries and a chunk of candidates.

Defined results: components become floor(scale * x) as 64-bit integers (beyond that range, its
ends). Vectors that are null or hold null, NaN or infinite components take no part. Vectors of
different dimension compare as if padded with zeros. Rows with the query's own id are not its
candidates; other repeated rows count each; exactly repeated query rows are one query. Ties go to
the smaller id. Products beyond 64 bits count as the ends of that range. Null ids take no part. Empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.shared import fresh_path, shuffle_width

SEEDS, BUCKET, BLOCK = 1024, 1024, 1024
#: Bytes of the candidates that are searched together.
CHUNK_BYTES = 32 << 20
#: Local cosine threshold from which coordinate pruning is chosen.
STEEP = 0.5
#: Slack of floating-point bounds.
EPS = 1e-9
FOUND = "query_id long, vec_id long, score long"
INT64 = np.iinfo(np.int64)


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (integers) and length of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    floor = F.transform(x, lambda c: _long(c * F.lit(float(scale))))
    ints = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), floor.alias("v")
    )
    return ints.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))


def _long(value: Column) -> Column:
    """floor of value, at the ends of the 64-bit range beyond it."""
    top = F.lit(float(2**63))
    return F.when(value >= top, F.lit(INT64.max)).when(value < -top, F.lit(INT64.min)).otherwise(F.floor(value).cast("long"))


def matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def vectors_of(column: pa.ListArray) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == sizes[0]).all():
        return column.flatten().to_numpy().reshape(len(sizes), sizes[0])
    return matrix(column.to_pylist(), int(sizes.max()) if len(sizes) else 0)


def padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles where they hold every partial sum, else in unbounded integers."""
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, INT64.min, INT64.max).astype(np.int64)


def below(score: int) -> float:
    """The score as a double, or one below it where doubles are coarser than integers."""
    return float(score) if abs(int(score)) <= 1 << 53 else float(np.nextafter(float(score), -np.inf))


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, bounds: np.ndarray, k: int):
        self.k, self.bounds = k, bounds.copy()  # a candidate below its query's bound can't be among the best
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(bounds)
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(bounds)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.bounds[q]
        if not keep.any():
            return
        scores, ids = np.concatenate([self.scores[q], scores[keep]]), np.concatenate([self.ids[q], ids[keep]])
        order = np.lexsort((ids, ~scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.bounds[q] = max(self.bounds[q], below(scores[order[-1]]))


class Bucket:
    def __init__(self, ids: np.ndarray, v: np.ndarray, lengths: np.ndarray):
        self.ids, self.v, self.lengths = ids, v, lengths  # lengths descend
        unit = v / np.maximum(lengths, 1e-300)[:, None]
        self.by_coordinate = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, self.by_coordinate, axis=0)

    def candidates(self, q: np.ndarray, length: float, t: float) -> np.ndarray | None:
        """Rows that may score t or more with q; None: all."""
        if t <= 0 or length == 0 or not len(q):
            return None
        threshold = t / (length * max(self.lengths[0], 1e-300)) - EPS
        if threshold > 1:
            return np.zeros(0, np.int64)
        if threshold >= STEEP:
            f = int(np.argmax(np.abs(q)))
            c = q[f] / length
            reach = np.sqrt(max(0.0, 1 - threshold**2) * max(0.0, 1 - c * c)) + EPS
            low = -2.0 if -c >= threshold else c * threshold - reach
            high = 2.0 if c >= threshold else c * threshold + reach
            a, b = np.searchsorted(self.sorted[:, f], [low - EPS, high + EPS])
            return self.by_coordinate[a:b, f]
        n = int(np.searchsorted(-self.lengths, -(t / length) * (1 - EPS), "right"))
        return None if n == len(self.lengths) else np.arange(n)


def search(buckets: list[Bucket], ids: np.ndarray, v: np.ndarray, bounds: np.ndarray, k: int) -> Best:
    best, lengths = Best(bounds, k), np.sqrt((v.astype(float) ** 2).sum(axis=1))
    for bucket in buckets:
        width = max(v.shape[1], bucket.v.shape[1])
        rows, own = padded(v, width), padded(bucket.v, width)
        whole = []
        for q in range(len(ids)):
            some = bucket.candidates(rows[q, : bucket.v.shape[1]], lengths[q], best.bounds[q])
            if some is None or len(some) > len(own) // 4:
                whole.append(q)
            elif len(some):
                some = some[bucket.ids[some] != ids[q]]
                best.add(q, bucket.ids[some], products(rows[q : q + 1], own[some])[0])
        if whole:
            scores = products(rows[whole], own)
            for q, line in zip(whole, scores):
                if line.max(initial=INT64.min) >= best.bounds[q]:
                    other = bucket.ids != ids[q]
                    best.add(q, bucket.ids[other], line[other])
    return best


def bucketed(ids: np.ndarray, v: np.ndarray, lengths: np.ndarray) -> list[Bucket]:
    order = np.argsort(-lengths, kind="stable")
    return [Bucket(ids[o], v[o], lengths[o]) for o in (order[i : i + BUCKET] for i in range(0, len(order), BUCKET))]


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query."""
    spark = vectors.sparkSession
    rows = scaled(vectors, scale)
    candidates = rows.repartitionByRange(shuffle_width(spark), F.col("length").desc(), F.col("vec_id"))
    seeds = rows.orderBy(F.col("length").desc(), "vec_id").limit(SEEDS).collect()  # a bounded number of vectors
    seed_ids = np.array([r["vec_id"] for r in seeds], np.int64)
    seed_v = matrix([r["v"] for r in seeds], max((len(r["v"]) for r in seeds), default=0))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                ids, v = part["vec_id"].to_numpy(), vectors_of(part["v"])
                width = max(v.shape[1], seed_v.shape[1])
                scores = products(padded(v, width), padded(seed_v, width))
                bound, length = np.full(len(ids), -np.inf), np.sqrt((v.astype(float) ** 2).sum(axis=1))
                for i, line in enumerate(scores):
                    line = line[seed_ids != ids[i]]
                    if len(line) >= k:
                        bound[i] = below(np.partition(line, len(line) - k)[len(line) - k])
                need = np.where(bound > 0, bound / np.maximum(length, 1e-300), -np.inf)
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], pa.array(bound), pa.array(need)], ["vec_id", "v", "bound", "need"])

    path = fresh_path(spark, "top-queries")
    queries = rows.filter(is_query).select("vec_id", "v").distinct()
    found = queries.mapInArrow(bounded, "vec_id long, v array<long>, bound double, need double")
    found.repartitionByRange(shuffle_width(spark), "need", "vec_id").sortWithinPartitions("need", "vec_id").write.parquet(path)

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        files = sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            width = max(x[1].shape[1] for x in held)
            lengths = np.concatenate([x[2] for x in held])
            buckets = bucketed(np.concatenate([x[0] for x in held]), np.concatenate([padded(x[1], width) for x in held]), lengths)
            held.clear()
            for name in files:
                for block in pq.ParquetFile(store.open_input_file(name)).iter_batches(BLOCK, columns=["vec_id", "v", "bound", "need"]):
                    served = int(np.searchsorted(block["need"].to_numpy() * (1 - EPS), lengths.max(), "right"))
                    if not served:
                        break
                    block = block.slice(0, served)
                    ids = block["vec_id"].to_numpy()
                    best = search(buckets, ids, vectors_of(block["v"]), block["bound"].to_numpy(), k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(ids, [len(x) for x in best.ids]), pa.int64()),
                            pa.array(np.concatenate([*best.ids, np.zeros(0, np.int64)]), pa.int64()),
                            pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]), pa.int64()),
                        ],
                        ["query_id", "vec_id", "score"],
                    )

        for batch in batches:
            if len(batch):
                held.append((batch["vec_id"].to_numpy(), vectors_of(batch["v"]), batch["length"].to_numpy()))
                if sum(x[1].nbytes for x in held) >= CHUNK_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    best = candidates.mapInArrow(retrieve, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
