"""Objects that run the stages of a network and of an alignment, and keep what each stage made."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import bins, calibrate, dependence, diffusion, graph, modules, null
from netloom.operators.transform import standardised, validated


def parallelism(spark: SparkSession) -> dict[str, int]:
    """How many tasks run at once, and into how many a shuffle is dealt."""
    return {"cores": spark.sparkContext.defaultParallelism, "shuffle": int(spark.conf.get("spark.sql.shuffle.partitions"))}


class Network:
    """Stages: mutual_information, calibrate, select, build, diffuse. A stage drops what later ones made."""

    ORDER = ("mi", "scores", "null", "edges", "operator", "trajectory")

    def __init__(self, matrix: DataFrame):
        self.matrix = validated(matrix.select("var", "sample", "x"))
        self.parameters: dict = {}
        self._made: dict[str, DataFrame] = {}
        self.timings: dict[str, float] = {}

    def __repr__(self) -> str:
        return f"Network(stages={[k for k in self.ORDER if k in self._made]}, parameters={self.parameters})"

    def get(self, stage: str) -> DataFrame:
        if stage not in self._made:
            raise ValueError(f"not available yet: {stage}")
        return self._made[stage]

    def timed(self, stage: str) -> float:
        """Seconds that it takes to compute a stage now; kept in `timings`."""
        began = time.perf_counter()
        self.get(stage).write.format("noop").mode("overwrite").save()
        self.timings[stage] = time.perf_counter() - began
        return self.timings[stage]

    def _set(self, stage: str, df: DataFrame, keep: tuple[str, ...] = ()) -> None:
        for later in self.ORDER[self.ORDER.index(stage) :]:
            if later not in keep:
                self._made.pop(later, None)
        self._made[stage] = df

    def mutual_information(self, rule: str | int = "hg", order: int = 3, transform: str = "none") -> Network:
        m = self.matrix
        if transform == "rank":
            m = dependence.ranked(m).select("var", "sample", F.col("r").alias("x"))
        self.counts = bins.counts(m, rule)
        self._used = m
        self.parameters |= {"bins": rule, "order": order, "transform": transform}
        both = dependence.block_mi(m, self.counts, order, self_pairs=True).cache()
        self.self_values = both.filter("i = j").select(F.col("i").alias("var"), F.col("mi").alias("self_mi"))
        self._set("mi", both.filter("i < j"))
        return self

    def calibrate(self, method: str = "normal", combine: str | None = None) -> Network:
        self.parameters |= {"method": method, "combine": combine or ("stouffer" if method == "normal" else None)}
        self._set("scores", calibrate.calibrate(self.get("mi"), method, combine, self_values=self.self_values).cache())
        return self

    def select(self, replicates: int = 100, method: str = "fdr", q: float = 0.05, statistic: str = "clr", alpha0: float = 0.1, level: float = 0.05) -> Network:
        null.checked(self.counts.count(), replicates, q, method, level, alpha0)
        if statistic == "clr" and self.parameters["method"] != "normal":
            raise ValueError("the clr statistic needs the normal method")
        self.statistic = statistic
        values = null.null_values(self._used, self.counts, replicates, self.parameters["order"], statistic).cache()
        self.hi = null.top_of(values)
        self.parameters |= {"replicates": replicates, "statistic": statistic}
        self._set("null", null.histogram(values, self.hi).cache())
        self._null_values = values
        return self.reselect(q, method, alpha0, level)

    def reselect(self, q: float = 0.05, method: str = "fdr", alpha0: float = 0.1, level: float = 0.05) -> Network:
        """Selects again from the null at hand."""
        observed = self.get("mi").select("i", "j", F.col("mi").alias("score")) if self.statistic == "mi" else self.get("scores")
        suf = null.survival(self.get("null")).cache()
        if method == "fdr":
            self.tau = null.bh_cutoff(null.pvalues(observed, suf, self.hi), q).first()[0]
        else:
            best = null.hc_threshold(null.hc_curve(observed, suf, self.hi, alpha0), self.hi).first()
            gate = null.gate_value(null.hc_gate(self._null_values, self.hi, self.parameters["replicates"], level, alpha0), level)
            self.tau = best["tau"] if best["hc"] is not None and best["hc"] > gate else float("inf")
        self.parameters |= {"q": q, "selection": method, "tau": self.tau}
        self._set("edges", observed.filter(F.col("score") >= self.tau).select("i", "j"))
        return self

    def build(self, k: int | None = None, tau: float | None = None, edges: bool = False, keff: float | None = None, cap: int = 50, topk_union: int | None = None, self_loops: bool = True) -> Network:
        scores = self.get("scores")
        if keff is not None:
            a = graph.softmax(scores, keff, cap)
        elif edges:
            a = graph.of_edges(scores.select("i", "j", "score"), self.get("edges"))
        elif tau is not None:
            a = graph.above(scores, tau)
        else:
            a = graph.top_k(scores, 50 if k is None else k)
        if topk_union is not None:
            a = graph.union(a, graph.top_k(scores, topk_union))
        self.parameters |= {"k": k, "keff": keff, "cap": cap}
        self._set("operator", graph.normalised(a, self.matrix.select("var").distinct(), self_loops).cache())
        return self

    def use(self, operator: DataFrame) -> Network:
        self._set("operator", graph.external(operator))
        return self

    def diffuse(self, steps: int = 10, alpha: float = 0.5, values: str = "raw", standardise: bool = True) -> Network:
        if values not in ("raw", "signed", "conditional"):
            raise ValueError("values are raw, signed or conditional")
        m = standardised(self.matrix).select("var", "sample", F.col("z").alias("e")) if standardise or values != "raw" else self.matrix.withColumnRenamed("x", "e")
        a = self.get("operator")
        if values == "conditional":
            z = m.withColumnRenamed("e", "x")
            nb = bins.counts(z, "hg")
            ranges = z.groupBy("var").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).join(nb, "var").cache()
            model = diffusion.conditional_model(a, z, z.withColumnRenamed("x", "z"), nb).cache()
            out, now = m.select(F.lit(0).alias("t"), "*"), m
            for t in range(1, steps + 1):
                now = diffusion.conditional_step(a, model, now, ranges, alpha)
                out = out.unionByName(now.select(F.lit(t).alias("t"), "*"))
        else:
            r = dependence.correlation(self.matrix) if values == "signed" else None
            out = diffusion.diffused(a, m, steps, alpha, r)
        self._set("trajectory", out)
        return self

    def attention(self, depth: int, alpha: float = 0.5) -> DataFrame:
        return diffusion.attention(diffusion.walk_blocks(self.get("operator"), [depth], alpha))

    def modules(self, least_size: int = 1) -> DataFrame:
        return modules.components(self.get("operator"), least_size)

    def release(self, *stages: str) -> None:
        for stage in stages or self.ORDER:
            self._made.pop(stage, None)


class ModuleAlignment:
    """A reference and found modules; alignments are kept by method and epsilon, so none replaces another."""

    def __init__(self, reference: DataFrame):
        self.reference = modules.validated(reference)
        self.found: DataFrame | None = None
        self._kept: dict[tuple[str, float | None], DataFrame] = {}

    def __repr__(self) -> str:
        return f"ModuleAlignment(aligned={sorted(map(str, self._kept))})"

    def set_found(self, found: DataFrame) -> ModuleAlignment:
        self.found = modules.validated(found)
        self.statistics = modules.pair_statistics(self.reference, self.found).cache()
        self._overlaps = modules.pair_statistics(self.reference, self.found, every=False).cache()
        self._kept.clear()
        return self

    def align(self, method: str = "hungarian", epsilon: float = 0.1) -> DataFrame:
        if self.found is None:
            raise ValueError("not available yet: found")
        at = (method, epsilon if method == "soft" else None)
        if at not in self._kept:
            how = {"hungarian": modules.hungarian, "best": modules.best, "soft": lambda s: modules.soft(s, epsilon)}
            if method not in how:
                raise ValueError("method is hungarian, best or soft")
            self._kept[at] = how[method](self._overlaps).cache()
        return self._kept[at]

    def summary(self, method: str = "hungarian", epsilon: float = 0.1) -> DataFrame:
        return modules.summary(self.align(method, epsilon), self.found.select("module").distinct().count())
