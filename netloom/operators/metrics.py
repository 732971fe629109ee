"""Evaluation of scored pairs (score, label) within keys. A null or NaN score ranks last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.transform import with_ranks
from netloom.sources.store import kept

DIGITS = 9
#: Terms of a harmonic sum that are added one by one.
LEAST_HARMONIC = 64
#: Ranges of a key's scores that are ranked apart.
RANGES = 4096


def prepared(pairs: DataFrame, score: str = "score") -> DataFrame:
    """Scores rounded, so that ties don't hang on the last bit; missing ones are -infinity."""
    s = F.when(F.col(score).isNull() | F.isnan(score), F.lit(float("-inf"))).otherwise(F.col(score))
    return pairs.withColumn(score, F.when(F.abs(s) == float("inf"), s).otherwise(F.round(s, DIGITS) + 0.0))


def blocks(pairs: DataFrame, keys: list[str], score: str = "score", weight: str | None = None) -> DataFrame:
    """keys, score, n, tp, k, cum: pairs and positives of each distinct score, and of it and all above; a row counts `weight` times, or once."""
    many = F.lit(1) if weight is None else F.col(weight)
    own = prepared(pairs, score).groupBy(*keys, score).agg(F.sum(many.cast("long")).alias("n"), F.sum((F.col("label") * many).cast("long")).alias("tp"))
    down = W.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(W.unboundedPreceding, 0)
    return own.withColumn("k", F.sum("n").over(down)).withColumn("cum", F.sum("tp").over(down))


def average_precision(pairs: DataFrame, keys: list[str], score: str = "score", weight: str | None = None) -> DataFrame:
    """keys, ap, n, n_pos, base_rate, ratio; tied pairs count at the end of their block. Without positives ap and ratio are null."""
    b = blocks(pairs, keys, score, weight)
    out = b.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("tp") * (F.col("cum").cast("double") / F.col("k"))), F.sum("tp")).alias("ap"), F.sum("n").alias("n"), F.sum("tp").alias("n_pos")
    )
    base = F.col("n_pos").cast("double") / F.col("n")
    return out.withColumn("base_rate", base).withColumn("ratio", F.try_divide(F.col("ap"), base))


def _harmonic(a: Column, b: Column) -> Column:
    """1 / (a + 1) + ... + 1 / b: added up where they are few, else by the asymptotic series of harmonic numbers, exact to the last bits."""
    add = lambda lo, hi: F.when(hi > lo, F.aggregate(F.sequence(lo + 1, hi), F.lit(0.0), lambda s, t: s + 1.0 / t)).otherwise(0.0)
    rest = lambda x: 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    low = F.least(F.greatest(a, F.lit(LEAST_HARMONIC)), b)
    x, y = low.cast("double"), b.cast("double")
    return F.when(b - a <= LEAST_HARMONIC, add(a, b)).otherwise(add(a, low) + F.log1p((y - x) / x) + rest(y) - rest(x))


def expected_average_precision(pairs: DataFrame, keys: list[str], score: str = "score", weight: str | None = None) -> DataFrame:
    """keys, ap: its expectation over random orders of tied pairs.

    At place t of a block of n pairs with r positives, after c pairs with p positives, a positive
    stands with probability r / n, and then p + 1 + (t - 1) (r - 1) / (n - 1) positives are expected. Over
    c + t that is b + (p + 1 - b (c + 1)) / (c + t), b = (r - 1) / (n - 1), so a block is a sum of 1 / (c + t).
    """
    before, above = F.col("cum") - F.col("tp"), F.col("k") - F.col("n")
    more = F.when(F.col("n") > 1, (F.col("tp") - 1) / (F.col("n") - 1).cast("double")).otherwise(0.0)
    share = F.col("tp").cast("double") / F.col("n")
    term = F.when(F.col("tp") > 0, share * (more * F.col("n") + (before + 1 - more * (above + 1)) * _harmonic(above, F.col("k"))))
    out = blocks(pairs, keys, score, weight).withColumn("term", term).groupBy(*keys).agg(F.sum("term").alias("s"), F.sum("tp").alias("n_pos"))
    return (out.filter("s IS NOT NULL") if keys else out).select(*keys, (F.col("s") / F.col("n_pos")).alias("ap"), "n_pos")


def pessimistic_average_precision(pairs: DataFrame, keys: list[str], score: str = "score", order: Column | None = None) -> DataFrame:
    """keys, ap with negatives before positives among ties, or with ties in the given order (which sorts the pairs of a key in one task)."""
    if order is None:
        # the r positives of a block stand at its end, at k - r + 1 to k, with p + 1 to p + r: each is 1 + (p + r - k) / place
        first = F.col("k") - F.col("tp")
        term = F.col("tp") + (F.col("cum") - F.col("k")) * _harmonic(first, F.col("k"))
        return blocks(pairs, keys, score).withColumn("term", term).groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col("tp") > 0, F.col("term"))), F.sum("tp")).alias("ap"))
    w = W.partitionBy(*keys).orderBy(F.col(score).desc(), order)
    at = prepared(pairs, score).withColumn("k", F.row_number().over(w))
    at = at.withColumn("cum", F.sum(F.col("label").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return at.groupBy(*keys).agg((F.sum(F.when(F.col("label") == 1, F.col("cum").cast("double") / F.col("k"))) / F.sum("label")).alias("ap"))


def auroc(pairs: DataFrame, keys: list[str], score: str = "score", weight: str | None = None) -> DataFrame:
    """keys, auroc, n_pos, n_neg: the share of positive-negative pairs in order, ties half."""
    b = blocks(pairs, keys, score, weight)
    # in a block, the average rank from below is (all - k) + (n + 1) / 2
    total = F.sum("n").over(W.partitionBy(*keys))
    r = b.withColumn("rank", (total - F.col("k")) + (F.col("n") + 1) / 2.0)
    out = r.groupBy(*keys).agg(F.sum(F.col("tp") * F.col("rank")).alias("s"), F.sum("tp").cast("double").alias("p"), F.sum(F.col("n") - F.col("tp")).cast("double").alias("q"))
    value = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return out.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), value).alias("auroc"), F.col("p").cast("long").alias("n_pos"), F.col("q").cast("long").alias("n_neg"))


def ranked_apart(pairs: DataFrame, keys: list[str], score: str = "score", ranges: int = RANGES) -> DataFrame:
    """keys, n, n_pos, ap, base_rate, auroc, as `average_precision` and `auroc` have them, where scores are about as many as pairs.

    A key's scores are put into ranges of equal width, whose counts are few and are added up first; pairs are shuffled once, by
    key and range, so that no task ranks all of a key.
    """
    own = prepared(pairs, score).select(*keys, F.col(score).alias("_s"), F.col("label").cast("long").alias("_l"))
    finite = F.when(F.abs("_s") < float("inf"), F.col("_s"))
    ends = kept(own.groupBy(*keys).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.count("*").alias("_all")))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in keys] or F.lit(True)
    at = own.join(F.broadcast(ends), same(own, ends)).drop(*[ends[c] for c in keys])
    width = F.col("_hi") - F.col("_lo")
    place = F.when(width > 0, F.floor((F.col("_s") - F.col("_lo")) / width * ranges)).otherwise(0)
    place = F.when(F.col("_s") == float("-inf"), -1).when(F.col("_s") == float("inf"), ranges).otherwise(F.least(place, F.lit(ranges - 1))).cast("int")
    at = at.select(*keys, "_all", "_s", "_l", place.alias("_at"))
    down = W.partitionBy(*keys).orderBy(F.col("_at").desc()).rowsBetween(W.unboundedPreceding, -1)
    sums = at.groupBy(*keys, "_at").agg(F.count("*").alias("_n"), F.sum("_l").alias("_tp"))
    above = kept(sums.select(*keys, "_at", F.coalesce(F.sum("_n").over(down), F.lit(0)).alias("_k0"), F.coalesce(F.sum("_tp").over(down), F.lit(0)).alias("_cum0")))
    b = at.repartition(*keys, "_at").groupBy(*keys, "_at", "_s").agg(F.count("*").alias("n"), F.sum("_l").alias("tp"), F.first("_all").alias("_all"))
    up = W.partitionBy(*keys, "_at").orderBy(F.col("_s").desc()).rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("k", F.sum("n").over(up)).withColumn("cum", F.sum("tp").over(up))
    b = b.join(F.broadcast(above), [b["_at"] == above["_at"], *([] if not keys else same(b, above))]).drop(above["_at"], *[above[c] for c in keys])
    k, cum = F.col("k") + F.col("_k0"), F.col("cum") + F.col("_cum0")
    out = b.groupBy(*keys).agg(
        F.sum(F.col("tp") * (cum.cast("double") / k)).alias("a"), F.sum("n").alias("n"), F.sum("tp").alias("n_pos"), F.sum(F.col("tp") * ((F.col("_all") - k) + (F.col("n") + 1) / 2.0)).alias("s")
    )
    p, q = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    area = F.when((p > 0) & (q > 0), (F.col("s") - p * (p + 1) / 2) / (p * q))
    return out.select(*keys, "n", "n_pos", F.try_divide(F.col("a"), F.col("n_pos")).alias("ap"), (p / F.col("n")).alias("base_rate"), area.alias("auroc"))


def positives_at_precision(pairs: DataFrame, keys: list[str], levels: tuple[float, ...] = (0.8, 0.6, 0.4), least: int = 10, score: str = "score") -> DataFrame:
    """keys, tp_<level>: positives in the longest prefix of at least `least` pairs with that precision, else 0."""
    b = blocks(pairs, keys, score)
    precision = F.col("cum").cast("double") / F.col("k")
    aggs = [F.coalesce(F.max(F.when((F.col("k") >= least) & (precision >= x), F.col("cum"))), F.lit(0)).alias(f"tp_{round(100 * x)}") for x in levels]
    return b.groupBy(*keys).agg(*aggs)


def early_precision(pairs: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys, epr, epr_ratio: expected precision among the k best pairs, k the number of positives, and over the base rate."""
    b = blocks(pairs, keys, score)
    w = W.partitionBy(*keys)
    b = b.withColumn("want", F.sum("tp").over(w)).withColumn("all", F.sum("n").over(w))
    room = F.greatest(F.lit(0), F.least(F.col("n"), F.col("want") - (F.col("k") - F.col("n"))))
    hits = F.sum(F.col("tp").cast("double") * room / F.col("n"))
    out = b.groupBy(*keys).agg(hits.alias("hits"), F.max("want").alias("want"), F.max("all").alias("all"))
    epr = F.col("hits") / F.col("want")
    return out.select(*keys, epr.alias("epr"), (epr / (F.col("want") / F.col("all"))).alias("epr_ratio"))


def selection(pairs: DataFrame, chosen: str = "chosen") -> DataFrame:
    """One row: precision and recall of a selected set within a labelled universe."""
    c, l = F.col(chosen).cast("double"), F.col("label").cast("double")
    return pairs.agg(F.sum(c).cast("long").alias("selected"), (F.sum(c * l) / F.sum(c)).alias("precision"), (F.sum(c * l) / F.sum(l)).alias("recall"))


def graded(pairs: DataFrame, keys: list[str], grade: str = "grade", score: str = "score") -> DataFrame:
    """keys, rho: Spearman's correlation of scores and grades, from the counts of their different pairs of values."""
    cells = prepared(pairs, score).groupBy(*keys, F.col(score).alias("a"), F.col(grade).alias("b")).agg(F.count("*").alias("c"))
    for v, r in (("a", "ra"), ("b", "rb")):
        # the last of a value's ranks, less half of all but one of them
        upto = F.sum("c").over(W.partitionBy(*keys).orderBy(v))
        cells = cells.withColumn(r, upto - (F.sum("c").over(W.partitionBy(*keys, v)) - 1) / 2.0)
    cells = cells.withColumn("n", F.sum("c").over(W.partitionBy(*keys)))
    x, y, c = F.col("ra") - (F.col("n") + 1) / 2.0, F.col("rb") - (F.col("n") + 1) / 2.0, F.col("c")
    sums = cells.groupBy(*keys).agg(F.sum(c * x * y).alias("xy"), F.sum(c * x * x).alias("xx"), F.sum(c * y * y).alias("yy"), F.sum("c").alias("n"))
    return sums.select(*keys, F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("rho"), "n")


def stratified_auroc(pairs: DataFrame, strata: str, score: str = "score", weight: str | None = None) -> DataFrame:
    """One row: the shares in order of all strata, weighted by their positive-negative pairs."""
    per = auroc(pairs, [strata], score, weight).filter("auroc IS NOT NULL")
    weight = F.col("n_pos").cast("double") * F.col("n_neg")
    return per.agg((F.sum(F.col("auroc") * weight) / F.sum(weight)).alias("auroc"), F.count("*").alias("strata"))


def decile(value: str) -> Column:
    """1 to 10 by equal widths of rank."""
    n = F.count("*").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(value))
    return F.greatest(F.lit(1), F.ceil(10 * (rank - 1) / (n - 1))).cast("int")


def stratified_rank(pairs: DataFrame, value: str, score: str = "score", n: int = 10) -> DataFrame:
    """pairs with stratum (by quantiles of value) and pct: the score's average rank within it, over its size."""
    cuts = kept(pairs.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(k / n) for k in range(1, n)]))).alias("cuts")))
    at = pairs.crossJoin(F.broadcast(cuts)).withColumn("stratum", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    return with_ranks(at, {score: "pct"}, ["stratum"], lambda r, size: r / size)


def hits_in_top(pairs: DataFrame, keys: list[str], k: int = 100, score: str = "score", totals: DataFrame | None = None) -> DataFrame:
    """keys, sensitivity: the share of positives among the k best, ties in order of (i, j).

    With totals (keys, label, n: counts of all pairs) pairs may be some, among which are the k best."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc(), "i", "j"))
    # only the best of each task are sorted; all others are counted
    best = prepared(pairs, score).withColumn("k", rank).filter(F.col("k") <= k).select(*keys, F.col("label").cast("long").alias("hit"), F.lit(0).cast("long").alias("label"))
    many = pairs.select(*keys, F.col("label").cast("long").alias("label")) if totals is None else totals.select(*keys, (F.col("label") * F.col("n")).alias("label"))
    every = best.unionByName(many.select(*keys, F.lit(0).cast("long").alias("hit"), "label"))
    return every.groupBy(*keys).agg(F.try_divide(F.sum("hit").cast("double"), F.sum("label").cast("double")).alias("sensitivity"))


def rowwise(scores: DataFrame, held_out: DataFrame, k: int = 20, score: str = "score") -> DataFrame:
    """One row: mean over rows of the average precision for each row's k best held-out partners, which are sent to the scores."""
    from netloom.operators.calibrate import symmetric
    from netloom.operators.graph import contenders, top_k

    best = kept(top_k(contenders(held_out, k), k).select("src", "dst", F.lit(1).alias("label")))
    pairs = symmetric(scores, score).join(F.broadcast(best), ["src", "dst"], "left").fillna({"label": 0})
    return average_precision(pairs, ["src"], score).filter("n_pos > 0").agg(F.avg("ap").alias("criterion"), F.count("*").alias("rows"))
