"""Composite summaries of evaluations over depths, draws, cases and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.numeric import ordered
from netloom.operators.dependence import correlation
from netloom.operators.permuted import Places, dealt_correlations, dealt_values, placed
from netloom.sources.store import kept


def best_depth(curve: DataFrame, keys: list[str], value: str = "value", digits: int | None = None) -> DataFrame:
    """keys, t (the first of the largest value), value, gain over t = 0."""
    best = F.max_by(F.struct(F.col("t"), F.col(value)), F.struct(ordered(F.col(value), digits), -F.col("t")))
    g = curve.groupBy(*keys).agg(best.alias("b"), F.max(F.when(F.col("t") == 0, F.col(value))).alias("base"))
    return g.select(*keys, F.col("b.t").alias("t"), F.col(f"b.{value}").alias(value), (F.col(f"b.{value}") - F.col("base")).alias("gain"))


def flat_depths(curve: DataFrame, keys: list[str], value: str = "value", share: float = 0.99, digits: int | None = None) -> DataFrame:
    """keys, low, high: depths whose value is within that share of the largest."""
    top = F.max(value).over(W.partitionBy(*keys))
    near = curve.withColumn("top", top).filter(ordered(F.col(value), digits) >= ordered(share * F.col("top"), digits))
    return near.groupBy(*keys).agg(F.min("t").alias("low"), F.max("t").alias("high"))


def held_out_depth(curve: DataFrame, keys: list[str], by: str = "split", direction: str = "direction", value: str = "value") -> DataFrame:
    """keys, t: the median over splits of the geometric mean over directions of the best depths."""
    best = best_depth(curve, [*keys, by, direction], value)
    means = best.groupBy(*keys, by).agg(F.exp(F.avg(F.ln(F.greatest(F.col("t"), F.lit(1)).cast("double")))).alias("g"))
    return means.groupBy(*keys).agg(F.percentile("g", F.lit(0.5)).alias("t"))


def snapped(values: Column, grid: list[float]) -> Column:
    """The grid's value nearest on a log scale."""
    pairs = F.array(*[F.struct(F.abs(F.ln(values) - F.ln(F.lit(float(g)))).alias("d"), F.lit(float(g)).alias("g")) for g in grid])
    return F.array_min(pairs)["g"]


def draw_summary(draws: DataFrame, keys: list[str], method: str, reference: str, value: str = "value") -> DataFrame:
    """keys, method, mean, low, high of paired differences to the reference method over draws."""
    ref = draws.filter(F.col(method) == reference).select(*keys, "draw", F.col(value).alias("ref"))
    d = draws.filter(F.col(method) != reference).join(ref, [*keys, "draw"]).withColumn("d", F.col(value) - F.col("ref"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    g = d.groupBy(*keys, method).agg(F.avg("d").alias("mean"), q.alias("q"), F.avg((F.col("d") > 0).cast("double")).alias("share_up"))
    return g.select(*keys, method, "mean", F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"), "share_up")


def method_summary(cases: DataFrame, method: str, reference: str, value: str = "ratio") -> DataFrame:
    """method, median, relative (to the reference's median), beats: the share of cases above the reference."""
    ref = cases.filter(F.col(method) == reference).select("case_id", F.col(value).alias("ref"))
    g = cases.join(ref, "case_id").groupBy(method).agg(
        F.percentile(value, F.lit(0.5)).alias("median"), F.percentile("ref", F.lit(0.5)).alias("base"), F.avg((F.col(value) > F.col("ref")).cast("double")).alias("beats")
    )
    return g.select(method, "median", (F.col("median") / F.col("base")).alias("relative"), "beats")


def blocked_log_ratio(cases: DataFrame, method: str, reference: str, value: str = "ratio") -> DataFrame:
    """method, log2_ratio: means over datasets of their cases' means, of cases that all methods have."""
    n = cases.select(method).distinct().count()
    full = cases.groupBy("dataset", "case_id").agg(F.count("*").alias("c")).filter(F.col("c") == n).select("dataset", "case_id")
    own = cases.join(full, ["dataset", "case_id"], "left_semi")
    ref = own.filter(F.col(method) == reference).select("dataset", "case_id", F.col(value).alias("ref"))
    per = own.join(ref, ["dataset", "case_id"]).withColumn("l", F.log2(F.col(value) / F.col("ref"))).groupBy(method, "dataset").agg(F.avg("l").alias("l"))
    return per.groupBy(method).agg(F.avg("l").alias("log2_ratio"), F.count("*").alias("datasets"))


def case_interval(draws: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, median, low, high: of each draw the median over cases, then percentiles over draws."""
    per = draws.groupBy(*keys, "draw").agg(F.percentile(value, F.lit(0.5)).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return per.groupBy(*keys).agg(q.alias("q")).select(*keys, F.element_at("q", 2).alias("median"), F.element_at("q", 1).alias("low"), F.element_at("q", 3).alias("high"))


def macro_levels(sets: DataFrame) -> DataFrame:
    """sets (set_id, ap, base_rate, size) with normalised ap, fold and the bin of the size."""
    bins = F.when(F.col("size") < 10, "5-9").when(F.col("size") < 25, "10-24").when(F.col("size") < 100, "25-99").otherwise(">=100")
    return sets.select("*", ((F.col("ap") - F.col("base_rate")) / (1 - F.col("base_rate"))).alias("normalised"), (F.col("ap") / F.col("base_rate")).alias("fold"), bins.alias("size_bin"))


def weighted_means(rows: DataFrame, keys: list[str], gammas: tuple[float, ...] = (0.0, 0.5, 1.0), value: str = "d", n: str = "n_pos") -> DataFrame:
    """keys, gamma, mean weighted by n ^ gamma."""
    g = F.explode(F.array(*[F.lit(x) for x in gammas]))
    w = F.pow(F.col(n).cast("double"), F.col("gamma"))
    return rows.withColumn("gamma", g).groupBy(*keys, "gamma").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"))


def tied_with_best(rows: DataFrame, keys: list[str], method: str, z: float, value: str = "value", se: str = "se", digits: int | None = None) -> DataFrame:
    """rows with `best` and `tied`: whether the difference to the best of its keys is within z standard errors."""
    top = F.max_by(F.struct(F.col(method), F.col(value), F.col(se)), F.struct(ordered(F.col(value), digits), F.col(method))).over(W.partitionBy(*keys))
    at = rows.withColumn("top", top)
    d, both = F.col(f"top.{value}") - F.col(value), F.sqrt(F.col(f"top.{se}") * F.col(f"top.{se}") + F.col(se) * F.col(se))
    return at.select(*rows.columns, (F.col(f"top.{method}") == F.col(method)).alias("best"), (d <= z * both).alias("tied"))


def verdicts(tests: DataFrame, family: list[str], level: float = 0.05) -> DataFrame:
    """family.., wins, losses, verdict of adjusted tests (d, adjusted) over a fixed grid; a missing test is neither."""
    win = (F.col("adjusted") < level) & (F.col("d") > 0)
    loss = (F.col("adjusted") < level) & (F.col("d") < 0)
    g = tests.groupBy(*family).agg(F.sum(win.cast("int")).cast("long").alias("wins"), F.sum(loss.cast("int")).cast("long").alias("losses"))
    return g.withColumn("verdict", F.when((F.col("wins") > 0) & (F.col("losses") == 0), "better").when(F.col("losses") > 0, "worse").otherwise("open"))


def degree_top(edges: DataFrame, k: int) -> DataFrame:
    """var, degree: the k variables with most edges (a, b)."""
    ends = edges.select(F.col("a").alias("var")).unionByName(edges.select(F.col("b").alias("var")))
    return ends.groupBy("var").agg(F.count("*").alias("degree")).orderBy(F.col("degree").desc(), "var").limit(k)


def parsed_label(label: Column | str) -> Column:
    """key=value;... as a map."""
    return F.str_to_map(label, F.lit(";"), F.lit("="))


def hub_scores(pairs: DataFrame, pi: DataFrame) -> DataFrame:
    """pairs with hub_sum and hub_product of their members' stationary masses; masses, a row a variable, are sent to the pairs."""
    a, b = pi.select(F.col("var").alias("i"), F.col("pi").alias("pi_i")), pi.select(F.col("var").alias("j"), F.col("pi").alias("pi_j"))
    return pairs.join(F.broadcast(a), "i").join(F.broadcast(b), "j").withColumn("hub_sum", F.col("pi_i") + F.col("pi_j")).withColumn("hub_product", F.col("pi_i") * F.col("pi_j")).drop("pi_i", "pi_j")


def _numbered(rows: DataFrame, bucket: Column, order: Column, sizes: DataFrame) -> DataFrame:
    """rows with k, their place in the order; buckets, of which sizes (bucket, n) has a narrow row each, are neighbours in it and sorted by themselves."""
    before = F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    at = sizes.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = rows.withColumn("bucket", bucket).repartition("bucket").withColumn("o", order)  # the order is made where it is needed
    k = F.row_number().over(W.partitionBy("bucket").orderBy("o"))
    return own.withColumn("k", k).drop("o").join(F.broadcast(at), "bucket").withColumn("k", F.col("before") + F.col("k")).drop("bucket", "before")


def shuffled_scores(pairs: DataFrame, rep: int, value: str = "score", members: DataFrame | None = None) -> DataFrame:
    """i, j, value: values (doubles, none null) dealt to other pairs, in hash order; tasks sort the pairs of a range of hashes each.

    With members (var, grp; a narrow row each) pairs are all those of members of different groups, or of any where
    grp is null: places follow from members, which are sent to the values, and pairs are made once and shuffled in
    2 to 3 bytes each. Else tasks number the pairs of a variable by themselves, and pairs meet their values by number.
    """
    places, sizes = _places(members) if members is not None else None, None
    if places is None:
        sizes = kept(pairs.groupBy(F.col("i").alias("bucket")).agg(F.count("*").alias("n")))
    n = len(places) if sizes is None else sizes.agg(F.sum("n")).first()[0] or 0
    at = _at_places(dealt_values(pairs, rep, value, n), places, value)
    if places is not None:
        return at
    return _numbered(pairs.select("i", "j"), F.col("i"), F.col("j"), sizes).select("i", "j", "k").join(at, "k").drop("k")


def shuffled_correlations(m: DataFrame, members: DataFrame, rep: int, digits: int) -> DataFrame:
    """i, j, score: `shuffled_scores` of the absolute correlations, rounded, of the variables of m (var, sample, x; a value for each) that
    are members (var, grp). Pairs are made, hashed and packed in their tasks, in passes, and each is under way in one of them only."""
    places = _places(members.join(m.select("var").distinct(), "var", "left_semi"))
    if places is None:  # members of several groups
        a, b = (members.select(F.col("var").alias(n), F.col("grp").alias(f"grp_{n}")) for n in ("i", "j"))
        apart = F.col("grp_i").isNull() | F.col("grp_j").isNull() | (F.col("grp_i") != F.col("grp_j"))
        pairs = correlation(m).join(F.broadcast(a), "i").join(F.broadcast(b), "j").filter(apart)
        return shuffled_scores(pairs.select("i", "j", F.round(F.abs("r"), digits).alias("score")), rep)
    rows = m.groupBy("var").agg(F.sort_array(F.collect_list(F.struct("sample", "x"))).alias("xs")).select("var", F.col("xs.x").alias("x"))
    return _at_places(dealt_correlations(rows, places, rep, digits), places, "score")


def _places(members: DataFrame) -> Places | None:
    """Of members with one row each."""
    own = members.filter("var IS NOT NULL").select("var", F.col("grp").cast("double")).toPandas().sort_values("var")
    return Places(own["var"].to_numpy(), own["grp"].to_numpy(dtype=float)) if own["var"].is_unique else None


def _at_places(values: DataFrame, places: Places | None, value: str) -> DataFrame:
    """Dealt values at their places."""
    if places is not None and (found := values.agg(F.sum("n")).first()[0] or 0) != len(places):
        raise ValueError(f"{found} pairs, and members have {len(places)}")
    before = F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed(values.join(F.broadcast(values.select("bucket", before.alias("before"))), "bucket"), places, value)
