"""Composites of the other operators: selections, grids, held-out depths and nested resampling.

Replicates and splits are key columns of one plan; configurations, variants and depths are few, a plan each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.numeric import ordered
from netloom.operators import calibrate, dependence, diffusion, graph, metrics, modules, resample, transform
from netloom.operators.bins import counts
from netloom.operators.diffusion import kept


def factors_and_top(genes: DataFrame, factors: DataFrame, n: int, level: float = 0.01) -> DataFrame:
    """var: of genes (var, p, variance) that are significant after Bonferroni, all factors (var) and the n of largest variance."""
    significant = genes.withColumn("m", F.count("*").over(W.partitionBy())).filter(F.col("p") * F.col("m") < level)
    top = significant.orderBy(F.col("variance").desc(), "var").limit(n).select("var")
    return significant.select("var").join(factors.select("var"), "var", "left_semi").unionByName(top).distinct()


def score_rows(pairs: DataFrame, strata: DataFrame, coherence: DataFrame, least: int = 20, high: float = 0.6, weight: str | None = None) -> DataFrame:
    """benchmark, class, metric, value: one method on every benchmark.

    Of pairs (score, label) overall and of strata (stratum, ...) with `least` positives: ap and base rate; of
    coherence (set_id, class, auroc) overall and by class: its median, the share above `high`, and how many.
    Rows of pairs and strata count `weight` times, or once.
    """
    columns = ["score", "label", *([weight] if weight else [])]
    every = pairs.select(F.lit("all").alias("stratum"), *columns).unionByName(strata.select("stratum", *columns))
    ap = metrics.average_precision(every, ["stratum"], weight=weight).filter(F.col("n_pos") >= least)
    a = coherence.select(F.explode(F.array(F.lit("all"), F.col("class"))).alias("class"), "auroc").filter("auroc IS NOT NULL").groupBy("class")
    b = a.agg(F.percentile("auroc", F.lit(0.5)).alias("median_auroc"), F.avg((F.col("auroc") > high).cast("double")).alias("share_high"), F.count("*").cast("double").alias("sets"))
    long = lambda df, name, at, columns: df.select(
        F.lit(name).alias("benchmark"), F.col(at).alias("class"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns]))
    )
    return long(ap, "comembership", "stratum", ["ap", "base_rate"]).unionByName(long(b, "coherence", "class", ["median_auroc", "share_high", "sets"]))


def grid(m: DataFrame, configurations: dict[str, dict], pairs: DataFrame) -> DataFrame:
    """config, ap_mi, ap, n_pos of pairs (i, j, label) for configurations {"bins", "transform", "combine"}."""
    out = None
    for name, c in configurations.items():
        mi = kept(dependence.mutual_information(m, c["bins"], transform=c.get("transform", "none")))
        scored = calibrate.calibrated(mi, combine=c.get("combine", "stouffer")).join(pairs, ["i", "j"]).withColumn("config", F.lit(name))
        a = metrics.average_precision(scored.withColumn("score", F.col("mi")), ["config"]).select("config", F.col("ap").alias("ap_mi"))
        own = a.join(metrics.average_precision(scored, ["config"]).select("config", "ap", "n_pos"), "config")
        out = own if out is None else out.unionByName(own)
    return out


def halves(samples: DataFrame, splits: int) -> DataFrame:
    """split, sample, half (0 or 1): every second sample in hash order."""
    reps = samples.sparkSession.range(1, splits + 1).select(F.col("id").cast("int").alias("split"))
    rank = F.row_number().over(W.partitionBy("split").orderBy(resample.key("split", "sample"), "sample"))
    return samples.select("sample").distinct().crossJoin(F.broadcast(reps)).select("split", "sample", ((rank - 1) % 2).cast("int").alias("half"))


def abs_correlations(m: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, i, j, score: absolute correlations."""
    return dependence.correlation(m, keys=keys).select(*keys, "i", "j", F.abs("r").alias("score"))


def calibrated_correlations(m: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, i, j, score: calibrated absolute correlations."""
    r = kept(abs_correlations(m, keys).withColumnRenamed("score", "v"))
    return calibrate.calibrated(r, "v", keys=keys).select(*keys, "i", "j", "score")


def calibrated_information(m: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, i, j, score: calibrated mutual information."""
    nb = counts(m.dropDuplicates(["var", "sample"]).select("var", "sample", "x"))
    return calibrate.calibrated(kept(dependence.block_mi(m, nb, keys=keys)), keys=keys).select(*keys, "i", "j", "score")


Scorer = Callable[[DataFrame, tuple[str, ...]], DataFrame]


def held_out_curves(halved: DataFrame, scorer: Scorer, depths: list[int], k: int = 10, share: float = 0.01, alpha: float = 0.5, digits: int | None = None) -> DataFrame:
    """split, direction, t, value: how well the walk of one half's operator ranks the best pairs of the other half.

    halved has a row (split, half, var, sample, x) for each value; the target is the top share of the other
    half's scores, the criterion average precision.
    """
    fits = halved.withColumn("fit", (2 * F.col("split") + F.col("half")).cast("int"))
    scores = kept(scorer(fits.select("fit", "var", "sample", "x"), ("fit",)))
    a = graph.normalised(graph.top_k(scores, k, digits=digits, keys=("fit",)), fits.select("fit", "var").distinct(), keys=("fit",))
    mass = diffusion.attention(diffusion.walked_at(a, depths, alpha, keys=("fit",)), ("t", "fit"))
    cut = scores.groupBy("fit").agg(F.percentile("score", F.lit(1 - share)).alias("cut"))
    target = scores.join(cut, "fit").select((F.col("fit") + 1 - 2 * (F.col("fit") % 2)).alias("fit"), "i", "j", (F.col("score") >= F.col("cut")).cast("int").alias("label"))
    every = target.withColumn("t", F.explode(F.array(*[F.lit(t) for t in sorted(set(depths))])))
    at = every.join(mass, ["t", "fit", "i", "j"], "left").withColumn("score", F.coalesce("s", F.lit(0.0)))
    ap = metrics.average_precision(at, ["fit", "t"])
    return ap.select(F.floor(F.col("fit") / 2).cast("int").alias("split"), (F.col("fit") % 2).alias("direction"), "t", F.col("ap").alias("value"))


def held_out_depths(curves: DataFrame, digits: int | None = None) -> DataFrame:
    """split, t: the geometric mean of both directions' best depths, rounded."""
    best = curves.groupBy("split", "direction").agg(F.max_by("t", F.struct(ordered(F.col("value"), digits), -F.col("t"))).alias("t"))
    return best.groupBy("split").agg(F.bround(F.exp(F.avg(F.ln(F.greatest(F.col("t"), F.lit(1)).cast("double"))))).cast("int").alias("t"))


def nested_draws(m: DataFrame, columns: DataFrame, scorer: Scorer, depths: list[int], pairs: DataFrame, k: int = 10, share: float = 0.01, digits: int | None = None) -> DataFrame:
    """draw, method, t, ap: resampled matrices, each with its own depth, scored against pairs (i, j, label).

    columns (draw, slot, grp, sample) are the resampled samples; a draw's halves part its groups in hash
    order, so copies of a sample stay together. Methods: the scores themselves, and the walk at the draw's depth.
    """
    drawn = kept(columns.join(m, "sample").select("draw", F.col("slot").cast("int").alias("sample"), "grp", "var", "x"))
    groups = drawn.select("draw", "grp").distinct()
    half = ((F.row_number().over(W.partitionBy("draw").orderBy(resample.key("draw", "grp"), "grp")) - 1) % 2).cast("int")
    halved = drawn.join(groups.withColumn("half", half), ["draw", "grp"]).select(F.col("draw").alias("split"), "half", "var", "sample", "x")
    usable = halved.groupBy("split", "half", "var").agg((F.max("x") > F.min("x")).alias("varies")).groupBy("split", "var").agg(F.min("varies").alias("ok"), F.count("*").alias("n"))
    halved = halved.join(usable.filter("ok AND n = 2").select("split", "var"), ["split", "var"], "left_semi")
    chosen = kept(held_out_depths(held_out_curves(halved, scorer, depths, k, share, digits=digits), digits).withColumnRenamed("split", "draw"))
    scores = kept(scorer(drawn.select("draw", "var", "sample", "x"), ("draw",)))
    a = graph.normalised(graph.top_k(scores, k, digits=digits, keys=("draw",)), drawn.select("draw", "var").distinct(), keys=("draw",))
    mass = diffusion.attention(diffusion.walked_at(a, depths, keys=("draw",)), ("t", "draw"))
    # the rounded mean of two depths may be none of the grid: then the next one below
    at = chosen.withColumn("at", F.array_max(F.filter(F.array(*[F.lit(t) for t in sorted(set(depths))]), lambda t: t <= F.col("t")))).select("draw", F.col("at").alias("t"))
    walked = mass.join(at, ["draw", "t"])
    base = scores.join(pairs, ["i", "j"]).select("draw", F.lit("scores").alias("method"), F.lit(None).cast("int").alias("t"), "score", "label")
    every = scores.select("draw", "i", "j").join(at, "draw").join(walked, ["draw", "t", "i", "j"], "left").join(pairs, ["i", "j"])
    moved = every.select("draw", F.lit("walk").alias("method"), "t", F.coalesce("s", F.lit(0.0)).alias("score"), "label")
    return metrics.average_precision(base.unionByName(moved), ["draw", "method", "t"]).select("draw", "method", "t", "ap")


def variant_criterion(variants: dict[str, DataFrame], platforms: DataFrame, split: DataFrame, least: int = 30, share: float = 0.01) -> DataFrame:
    """variant, mean, sd, splits: label-free comparison of variants (var, sample, x) of a matrix.

    The target of a split is the top share of the mean of scores calibrated within each platform (sample,
    platform) of `least` samples or more in the test half (half 1) of the first variant; the criterion is the
    average precision of each variant's scores in the training half. Scores are calibrated absolute correlations.
    """
    first = next(iter(variants.values()))
    test = first.join(split.filter("half = 1"), "sample").join(platforms, "sample")
    size = test.select("split", "platform", "sample").distinct().groupBy("split", "platform").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    fits = test.join(size.select("split", "platform", F.dense_rank().over(W.orderBy("split", "platform")).cast("int").alias("fit")), ["split", "platform"])
    of = fits.select("fit", "split").distinct()
    per = calibrated_correlations(fits.select("fit", "var", "sample", "x"), ("fit",))
    target = kept(per.join(of, "fit").groupBy("split", "i", "j").agg(F.avg("score").alias("target")))
    cut = target.groupBy("split").agg(F.percentile("target", F.lit(1 - share)).alias("cut"))
    label = target.join(cut, "split").select("split", "i", "j", (F.col("target") >= F.col("cut")).cast("int").alias("label"))
    out = None
    for name, v in variants.items():
        own = calibrated_correlations(v.join(split.filter("half = 0"), "sample").select("split", "var", "sample", "x"), ("split",))
        ap = metrics.average_precision(own.join(label, ["split", "i", "j"]), ["split"]).select(F.lit(name).alias("variant"), "split", "ap")
        out = ap if out is None else out.unionByName(ap)
    return out.groupBy("variant").agg(F.avg("ap").alias("mean"), F.stddev_samp("ap").alias("sd"), F.count("*").alias("splits"))


def loading_enrichment(loadings: DataFrame, sets: DataFrame) -> DataFrame:
    """set_id, pc, n, auroc, p, adjusted: absolute loadings (var, pc, loading) of a set's members against the rest.

    p is of the rank sum's normal approximation with ties and a continuity correction; adjusted over all rows.
    """
    at = loadings.withColumn("a", F.abs("loading")).withColumn("r", transform.average_rank("a", "pc"))
    ties = at.groupBy("pc", "a").agg(F.count("*").cast("double").alias("t")).groupBy("pc").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), F.sum("t").alias("all"))
    own = sets.select("set_id", F.col("member").alias("var")).distinct().join(at, "var").groupBy("set_id", "pc").agg(F.count("*").alias("n"), F.sum("r").alias("s")).join(ties, "pc")
    n, rest = F.col("n").cast("double"), F.col("all") - F.col("n")
    u = F.col("s") - n * (n + 1) / 2
    sd = F.sqrt(n * rest / 12 * (F.col("all") + 1 - F.col("ties") / (F.col("all") * (F.col("all") - 1))))
    off = u - n * rest / 2
    z = F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / sd
    tested = own.filter(rest > 0).select("set_id", "pc", "n", (u / (n * rest)).alias("auroc"), F.when(sd > 0, resample.two_sided_p(z)).otherwise(1.0).alias("p"))
    adjusted = resample.benjamini_hochberg(tested.withColumn("id", F.struct("set_id", "pc")), [])
    return adjusted.select("set_id", "pc", "n", "auroc", "p", "adjusted")


def depth_sweep(a: DataFrame, profiles: DataFrame, reference: DataFrame, cores: DataFrame, depths: list[int], height: float = 0.5, alpha: float = 0.5) -> DataFrame:
    """t, n_modules, largest, weighted_f1, best_mean_f1, entropy, unexplained, within, between: modules found
    afresh on the profiles (var, sample, e) diffused to each depth, under a fixed operator.

    Entropy and unexplained mass are means over the members of the reference, of their walk to the fixed cores.
    """
    # each is used by every depth, more than once: made once, or plans hold a copy of their sources' joins for each use
    a, profiles, reference, cores = kept(a), kept(profiles), kept(reference), kept(cores)
    moved = kept(diffusion.diffused(a, profiles, max(depths), alpha))
    walk = kept(diffusion.walked_at(a, depths, alpha))
    n_cores = cores.select("module").distinct().count()
    out = None
    for t in sorted(set(depths)):
        r = kept(dependence.correlation(moved.filter(F.col("t") == t).select("var", "sample", F.col("e").alias("x"))))
        found = kept(modules.complete_linkage(r, height))
        stats = kept(modules.pair_statistics(reference, found))
        n_found = found.select("module").distinct().count()
        one = modules.summary(modules.hungarian(stats), n_found).select(F.col("n_found").alias("n_modules"), "weighted_f1")
        best = modules.summary(modules.best(stats), n_found).select(F.col("mean_f1").alias("best_mean_f1"))
        largest = found.groupBy("module").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))
        mass = diffusion.affiliation(walk.filter(F.col("t") == t), cores).join(reference.select(F.col("member").alias("src")).distinct(), "src", "left_semi")
        spread = diffusion.affiliation_entropy(mass, n_cores).agg(F.avg("entropy").alias("entropy"), F.avg(F.greatest(F.col("unexplained"), F.lit(0.0))).alias("unexplained"))
        fall = diffusion.collapse(r, reference).select("within", "between")
        row = kept(one.crossJoin(best).crossJoin(largest).crossJoin(spread).crossJoin(fall).select(F.lit(t).alias("t"), "*"))
        out = row if out is None else out.unionByName(row)
    return out


def classified(samples: DataFrame, by_series: DataFrame, by_sample: DataFrame, names: dict[str, str], other: str, flag: str) -> DataFrame:
    """samples (sample, series, treatment) with platform and treated: the series' platform, where that names
    several the sample's own; known platforms by name, others `other`; treated by a pattern."""
    series = by_series.groupBy("series").agg(F.min("platform").alias("of_series"))
    own = by_sample.groupBy("sample").agg(F.min("platform").alias("of_sample"))
    both = samples.join(series, "series", "left").join(own, "sample", "left")
    found = F.when(F.col("of_series").contains(","), F.col("of_sample")).otherwise(F.col("of_series"))
    named = F.lit(other)
    for code, name in names.items():
        named = F.when(found == code, name).otherwise(named)
    return both.select(*samples.columns, named.alias("platform"), F.coalesce(F.col("treatment").rlike(flag), F.lit(False)).alias("treated"))


def toggled(scores: DataFrame, flags: list[str], key: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """s (bits of the flags that are on), config, value: every subset of flags with the score (config, value) of
    the configuration that it means; several subsets may mean one."""
    spark: SparkSession = scores.sparkSession
    subsets = spark.range(1 << len(flags)).select(F.col("id").cast("int").alias("s"))
    on = {f: F.col("s").bitwiseAND(F.lit(1 << k)) != 0 for k, f in enumerate(flags)}
    return subsets.withColumn("config", key(on)).join(scores, "config", "left").select("s", "config", "value")


def tie_ensemble(m: DataFrame, draws: int) -> DataFrame:
    """i, j, score: the mean over draws of calibrated absolute rank correlations, ties broken at random by hash."""
    reps = m.sparkSession.range(1, draws + 1).select(F.col("id").cast("int").alias("draw"))
    order = W.partitionBy("draw", "var").orderBy("x", resample.key("draw", "var", "sample"))
    r = m.crossJoin(F.broadcast(reps)).select("draw", "var", "sample", F.row_number().over(order).cast("double").alias("x"))
    return calibrate.averaged(calibrated_correlations(r, ("draw",)))


def set_table(pairs: DataFrame, groups: DataFrame, members: DataFrame, weight: str | None = None) -> DataFrame:
    """set_id, n_pos, n_neg, base_rate, same_group, ap, nonzero of a set's pairs (set_id, label, score), which count `weight` times, or once.

    same_group: the share of all pairs of members (set_id, member) that lie in one group (member, grp), null without pairs;
    nonzero: the share of scores that aren't 0.
    """
    ap = metrics.expected_average_precision(pairs, ["set_id"], weight=weight).select("set_id", "ap")
    many = F.lit(1).cast("long") if weight is None else F.col(weight)
    n = pairs.groupBy("set_id").agg(
        F.sum(F.col("label") * many).alias("n_pos"), F.sum((1 - F.col("label")) * many).alias("n_neg"), (F.sum((F.col("score") != 0).cast("double") * many) / F.sum(many)).alias("nonzero")
    )
    own = members.select("set_id", "member").distinct().join(groups.select("member", "grp").distinct(), "member")
    sizes = own.groupBy("set_id", "grp").agg(F.count("*").cast("double").alias("c")).groupBy("set_id").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sum("c").alias("c"))
    share = sizes.select("set_id", F.try_divide(F.col("same"), F.col("c") * (F.col("c") - 1)).alias("same_group"))
    base = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    return n.join(ap, "set_id").join(share, "set_id").select("set_id", "n_pos", "n_neg", base.alias("base_rate"), "same_group", "ap", "nonzero")


def digest_of(selections: DataFrame) -> str:
    """A digest of the rows, whatever their order and partitions."""
    rows = selections.select(F.sha2(F.to_json(F.struct(*sorted(selections.columns))), 256).alias("h"))
    parts = rows.select(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(20,0)").alias("a"), F.conv(F.substring("h", 16, 15), 16, 10).cast("decimal(20,0)").alias("b"))
    found = parts.agg(F.sum("a"), F.sum("b"), F.count("*")).first()  # one row
    return hashlib.sha256(repr([sorted(selections.columns), *map(str, found)]).encode()).hexdigest()


def commit(selections: DataFrame, path: str) -> str:
    """Writes the selections' digest, before the truth is looked at; a path that is there already stays as it is."""
    digest = digest_of(selections)
    selections.sparkSession.createDataFrame([(digest,)], "digest string").write.mode("ignore").json(path)
    return digest


def committed(spark: SparkSession, path: str) -> str:
    return spark.read.schema("digest string").json(path).first()["digest"]  # one row


def gate(selections: DataFrame, committed: str) -> DataFrame:
    """The selections, if they are those whose digest was committed before; else raises."""
    if digest_of(selections) != committed:
        raise ValueError("these selections aren't the committed ones")
    return selections
