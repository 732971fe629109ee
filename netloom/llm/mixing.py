"""Operator 5: mixing sources to target weights by weighted fair queueing (native).

Every source has a queue of its documents in a hash-shuffled order. A document's virtual finish
time is the number of words queued up to and with it, divided by the source's target. All queues
are merged by finish time, a global range sort, and the merge is cut where the words taken reach
the total budget. A source whose target exceeds its size is queued up to `max_epochs` times.

Cumulative sums never put a source, or the whole corpus, into one task: rows fall into ordered
buckets, about PER_BUCKET rows each, bucket sums are pre-aggregated, and rows are summed within their
bucket only. Turns after a time by which the budget is surely used up aren't queued. In each epoch the
mix takes a source's queue up to some document, so `mixture` reads the documents once more and compares
their keys with one row a source and epoch: texts aren't shuffled.

Defined results: null text counts as size 0; null source is a source of its own, last; null doc_id
and repeated rows are kept, each row by itself; the order is a hash of doc_id, source and text, so rows
without an id, or with the same one, are shuffled like all others; a source of size 0 has target 0; empty
tables give empty results. Columns other than doc_id, source and text are ignored by `mixed` and handed
on by `mixture`, whatever their names. Of rows equal in doc_id, source and text, the mix may take some: then
`mixture` takes any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.shared import discard, written

#: What is a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket, about; a hash has so many hexadecimal digits for buckets.
PER_BUCKET, DIGITS = 5000, 6
#: Tables of fewer sources are broadcast.
FEW_SOURCES = 100_000
#: Integer weights, repeating over the sources in order.
WEIGHTS = (1, 2, 3)


def _key() -> Column:
    """The shuffled order."""
    return F.md5(F.concat_ws("~", F.lit("mix"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, the key of the shuffled order, and copies: how many rows are equal in these."""
    each = docs.select("doc_id", "source", _size().alias("size"), _key().alias("key"))
    return each.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies"))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """df with the running total of `value` within `keys`, in the order of bucket, then `order`.

    Buckets' sums are added up first (one row a bucket), rows only within their bucket.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(offsets, [*keys, bucket]).withColumn(out, F.col("_before") + F.sum(value).over(within)).drop("_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """rank, source, source_size, rows, longest (document), target: one row a source.

    Weighted shares of all words, none above max_epochs times its source's size: with sources in
    ascending order of cap / weight, the level at the first that stays below its cap; levels fall after it,
    so it is the largest that fits.
    """
    words = F.col("size") * F.col("copies")
    sources = sizes.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum("copies").alias("rows"), F.max("size").alias("longest"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sources.select(rank.alias("rank"), "source", "source_size", "rows", "longest").select(
        "*",
        F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
    )
    ratio = F.col("cap") / F.col("weight")
    by = W.orderBy(ratio, F.col("rank"))
    total = W.partitionBy()
    level = (
        F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ) / F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    levels = ranked.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= ratio, F.col("level")))
    return levels.select(
        "rank",
        "source",
        "source_size",
        "rows",
        "longest",
        F.least(F.col("cap").cast("double"), F.coalesce(F.max("fits").over(total), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def _queued(sizes: DataFrame, dims: DataFrame) -> DataFrame:
    """A row a document, with its source's rank, source_size and target, and `queued`: the words queued up to and with it."""
    small = F.broadcast(dims) if dims.count() < FEW_SOURCES else dims
    with_source = sizes.join(small, sizes["source"].eqNullSafe(dims["source"])).drop("source")
    part = F.conv(F.substring("key", 1, DIGITS), 16, 10).cast("long")
    bucket = F.floor(part * F.ceil(F.col("rows") / PER_BUCKET) / float(16**DIGITS)).cast("long")
    of_copies = with_source.withColumn("bucket", bucket).withColumn("words", F.col("size") * F.col("copies"))
    queued = running_total(of_copies, ["rank"], "bucket", [F.col("key"), F.col("size"), F.col("doc_id").asc_nulls_first()], "words", "queued").drop("rows", "longest", "words")
    each = queued.withColumn("after", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.withColumn("queued", F.col("queued") - F.col("after") * F.col("size")).drop("copies", "after")


def _turn(epoch: int) -> Column:
    """A row's place in the global order when it is queued for the epoch."""
    time = (F.lit(epoch) * F.col("source_size") + F.col("queued")).cast("double") / F.col("target")
    return F.struct(time.alias("time"), F.col("rank"), F.lit(epoch).alias("epoch"), F.col("key"), F.col("size"))


def _latest(dims: DataFrame, max_epochs: int) -> tuple[int, float, int]:
    """The budget, a time by which more than it is queued or every queue is at its end, and the number of rows.

    At a time t a source has queued t * target words, less than its longest document short of it, or all it has.
    """
    times = [2.0**k for k in range(0, 41)]
    ready = lambda t: F.sum(F.least(F.col("source_size") * max_epochs, F.col("target") * t - F.col("longest")))
    found = dims.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.array(*[ready(t) for t in times]).alias("ready")).first()  # one row
    enough = [t for t, words in zip(times, found["ready"]) if words is not None and words > found["total"]]
    return found["total"], min(enough, default=float("inf")), found["rows"]


def _plan(docs: DataFrame, weights: tuple[int, ...], max_epochs: int) -> tuple[DataFrame, DataFrame, Column]:
    """Sources, the queue of all documents, and how often a row of the queue is taken: up to the last
    turn, in the order of finish times, before the words taken exceed all words."""
    sizes = written(sized(docs), "mix-sizes")
    dims = written(targets(sizes, weights, max_epochs), "mix-targets")
    queued = written(_queued(sizes, dims), "mix-queue")
    discard(docs.sparkSession, sizes)
    total, latest, rows = _latest(dims, max_epochs)
    slots = max(1, rows // PER_BUCKET)  # in a unit of time
    turns = (
        queued.filter((F.col("size") > 0) & (F.col("target") > 0))
        .select(F.explode(F.array(*[_turn(e) for e in range(max_epochs)])).alias("turn"))
        .select("turn", "turn.time", "turn.size", F.floor(F.col("turn.time") * slots).alias("slot"))
        .filter(F.col("time") <= latest)
    )
    merged = running_total(turns, [], "slot", [F.col("turn")], "size", "words")
    last = merged.filter(F.col("words") <= total).agg(F.max("turn").alias("cut")).first()["cut"]  # one row
    if last is None:
        return dims, queued, [F.lit(0)]
    kinds = (("time", "double"), ("rank", "int"), ("epoch", "int"), ("key", "string"), ("size", "long"))
    bound = F.struct(*[F.lit(last[f]).cast(t).alias(f) for f, t in kinds])
    return dims, queued, [((F.col("size") > 0) & (F.col("target") > 0) & (_turn(e) <= bound)).cast("int") for e in range(max_epochs)]


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, and epochs: how often the mix takes the document."""
    _, queued, taken = _plan(docs, weights, max_epochs)
    epochs = sum(taken[1:], taken[0])
    return queued.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * epochs).alias("taken"), epochs.cast("int").alias("epochs")
    )


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """The documents of the mix, with their columns, each as often as it is taken.

    Of each source and epoch: the greatest key that is taken, and how many rows that have it. Rows of lesser
    keys are all taken; of those with that key, which are equal rows, so many.
    """
    dims, queued, taken = _plan(docs, weights, max_epochs)
    epochs = range(len(taken))
    own = queued.select("rank", "key", *[t.alias(f"t{e}") for e, t in zip(epochs, taken)])
    last = written(own.groupBy("rank").agg(*[F.max(F.when(F.col(f"t{e}") == 1, F.col("key"))).alias(f"k{e}") for e in epochs]), "mix-last")
    at_end = [F.sum(F.when(F.col("key") == F.col(f"k{e}"), F.col(f"t{e}")).otherwise(0)).alias(f"c{e}") for e in epochs]
    ends = written(own.join(last, "rank").groupBy("rank", *[f"k{e}" for e in epochs]).agg(*at_end).join(dims.select("rank", "source"), "rank"), "mix-ends")
    discard(docs.sparkSession, last, queued, dims)
    small = F.broadcast(ends) if ends.count() < FEW_SOURCES else ends

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("source").alias("own"), _key().alias("key"))
    rows = rows.join(small, F.col("own").eqNullSafe(F.col("source"))).filter(F.col("doc.text").rlike(WORD))
    at_last = F.coalesce(F.array_contains(F.array(*[F.coalesce(f"k{e}", F.lit("")) for e in epochs]), F.col("key")), F.lit(False))
    before = sum((F.coalesce(F.col("key") < F.col(f"k{e}"), F.lit(False)).cast("int") for e in epochs), F.lit(0))
    # rows of a last key are equal in all but columns handed on; equal ones of these are counted first
    ties = rows.filter(at_last).groupBy("rank", "key", "doc", *[f"{x}{e}" for x in "kc" for e in epochs]).agg(F.count("*").alias("n"))
    end = F.sum("n").over(W.partitionBy("rank", "key").orderBy(F.to_json("doc")).rowsBetween(W.unboundedPreceding, 0))
    ties = ties.withColumn("start", end - F.col("n"))
    taken_here = lambda e: F.greatest(F.least(F.col(f"c{e}") - F.col("start"), F.col("n")), F.lit(0))
    first = sum((F.when(F.col("key") == F.col(f"k{e}"), taken_here(e)).otherwise(0) for e in epochs), F.lit(0))
    every = rows.filter(~at_last).select("doc", before.alias("times")).unionByName(ties.select("doc", (before * F.col("n") + first).alias("times")))
    return every.filter("times > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
