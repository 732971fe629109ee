"""Queries of transforms, bins, dependence, calibration, null, operators and diffusion."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.numeric import inverse_normal_sql, rounded
from netloom.operators import bins as B
from netloom.operators import calibrate as C
from netloom.operators import dependence as D
from netloom.operators import diffusion as X
from netloom.operators import graph as G
from netloom.operators import null as N
from netloom.operators import transform as T
from netloom.plans import oracles as O
from netloom.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Digits to which values are ordered, and what is added to bins, so that sums of other engines tie alike.
TIES, HAIR = 9, 1e-9
_kept: list[DataFrame] = []


def cached(df: DataFrame) -> DataFrame:
    """df cached for the query at hand; the next query releases it."""
    _kept.append(df.cache())
    return df


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL."""

    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            while _kept:
                _kept.pop().unpersist()
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def rsql(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


# --- transforms

query("matrix_long", O.with_("sup") + "SELECT var, sample, x FROM m")(lambda s, d: FX.suppliers(s, d))
query("matrix_users", O.with_("usr") + f"SELECT var, sample, {rsql('x', 'x')} FROM m")(lambda s, d: r6(FX.users(s, d), "x"))
query("varying_vars", O.with_("brd", O.STATS) + "SELECT var, count(*) AS n FROM m WHERE var IN (SELECT var FROM st WHERE hi - lo > 0) GROUP BY var")(
    lambda s, d: T.varying(FX.brands(s, d)).groupBy("var").agg(F.count("*").alias("n"))
)
query("finite_counts", O.with_("emb") + "SELECT var, count(*) AS n, count(*) FILTER (x IS NULL) AS n_null, count(*) FILTER (isnan(x) OR isinf(x)) AS n_odd FROM m GROUP BY var")(
    lambda s, d: T.finite_counts(FX.embeddings(s, d))
)
query("var_stats", O.with_("emb", O.STATS) + f"SELECT var, n, {rsql('lo', 'lo')}, {rsql('hi', 'hi')}, {rsql('mean', 'mean')}, {rsql('sd', 'sd')} FROM st")(
    lambda s, d: r6(T.stats(FX.embeddings(s, d)), "lo", "hi", "mean", "sd")
)
query("top_variance", O.with_("brd") + "SELECT var, sample, x FROM m WHERE var IN (SELECT var FROM m GROUP BY var ORDER BY round(var_samp(x), 9) DESC, var LIMIT 10)")(
    lambda s, d: T.top_variance(FX.brands(s, d), 10, TIES)
)
query("rank_avg", O.with_("brd", O.RANKS) + "SELECT var, sample, r FROM rk")(lambda s, d: T.ranked(FX.brands(s, d)).select("var", "sample", "r"))
query("zscore_rows", O.with_("brd", O.STATS) + f"SELECT var, sample, {rsql('(x - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END', 'z')} FROM m JOIN st USING (var)")(
    lambda s, d: r6(T.standardised(FX.brands(s, d)).select("var", "sample", "z"), "z")
)
query("blom_scores", O.with_("brd", O.RANKS) + f"SELECT var, sample, {rsql(inverse_normal_sql('p'), 'score')} FROM (SELECT var, sample, (r - 0.375) / (count(*) OVER (PARTITION BY var) + 0.25) AS p FROM rk)")(
    lambda s, d: r6(T.normal_scores(FX.brands(s, d)).select("var", "sample", "score"), "score")
)
_GROUPED = "mg AS (SELECT m.*, g.grp FROM m JOIN g USING (sample))"
_grouped = lambda s, d: FX.embeddings(s, d).join(FX.sample_groups(s, d), "sample")
query(
    "blom_by_group",
    O.with_("emb", "grp", _GROUPED)
    + f""", rk AS (SELECT *, rank() OVER (PARTITION BY var, grp ORDER BY x) + (count(*) OVER (PARTITION BY var, grp, x) - 1) / 2.0 AS r FROM mg)
SELECT var, sample, grp, {rsql(inverse_normal_sql('p'), 'score')} FROM (SELECT *, (r - 0.375) / (count(*) OVER (PARTITION BY var, grp) + 0.25) AS p FROM rk)""",
)(lambda s, d: r6(T.normal_scores(_grouped(s, d), "grp").select("var", "sample", "grp", "score"), "score"))
query("center_by_group", O.with_("emb", "grp", _GROUPED) + f"SELECT var, sample, grp, {rsql('x - avg(x) OVER (PARTITION BY var, grp)', 'c')} FROM mg")(
    lambda s, d: r6(T.centred(_grouped(s, d), "grp").select("var", "sample", "grp", "c"), "c")
)
_COUNTS = "mg AS (SELECT var, sample, x, sample % 4 AS grp FROM m)"
_counts = lambda s, d: FX.brands(s, d).withColumn("grp", F.col("sample") % 4)
query(
    "pearson_residuals",
    O.with_("brd", _COUNTS)
    + f""", t AS (SELECT *, sum(x) OVER (PARTITION BY grp, var) * sum(x) OVER (PARTITION BY grp, sample) / sum(x) OVER (PARTITION BY grp) AS mu FROM mg),
n AS (SELECT grp, sqrt(CAST(count(DISTINCT sample) AS DOUBLE)) AS cap FROM mg GROUP BY grp)
SELECT var, sample, grp, {rsql('greatest(least(CASE WHEN mu > 0 THEN (x - mu) / sqrt(mu + mu * mu / 100) ELSE 0 END, cap), -cap)', 'res')} FROM t JOIN n USING (grp)""",
)(lambda s, d: r6(T.pearson_residuals(_counts(s, d)).select("var", "sample", "grp", "res"), "res"))
query(
    "depth_normalised",
    O.with_("brd", _COUNTS)
    + f""", t AS (SELECT grp, sample, sum(x) AS total FROM mg GROUP BY 1, 2), md AS (SELECT grp, quantile_cont(total, 0.5) AS middle FROM t GROUP BY grp),
y AS (SELECT var, sample, grp, ln(1 + CASE WHEN total > 0 THEN x / total * middle ELSE 0 END) AS y FROM mg JOIN t USING (grp, sample) JOIN md USING (grp))
SELECT var, sample, grp, {rsql('y - avg(y) OVER (PARTITION BY var, grp)', 'y')} FROM y""",
)(lambda s, d: r6(T.depth_normalised(_counts(s, d)).select("var", "sample", "grp", "y"), "y"))
query("expressed_vars", O.with_("sup") + f"SELECT var, {rsql('avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)', 'share')} FROM m GROUP BY var HAVING avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) >= 0.5")(
    lambda s, d: r6(T.expressed(FX.suppliers(s, d), 0.5), "share")
)
_HOLES = "h AS (SELECT var, sample, CASE WHEN (var * 31 + sample) % 97 < var % 3 THEN NULL ELSE x END AS x FROM m)"
query("missing_filled", O.with_("brd", _HOLES) + "SELECT var, sample, coalesce(x, 0.0) AS x FROM h WHERE var IN (SELECT var FROM h GROUP BY var HAVING avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) <= 0.01)")(
    lambda s, d: T.without_missing(FX.brands(s, d).withColumn("x", F.when((F.col("var") * 31 + F.col("sample")) % 97 < F.col("var") % 3, None).otherwise(F.col("x")))).select("var", "sample", "x")
)
query("unique_names", "SELECT p_partkey, p_name FROM (SELECT *, count(*) OVER (PARTITION BY p_name) AS n FROM part) WHERE n = 1")(
    lambda s, d: T.without_duplicates(FX.table(s, d, "part"), "p_name").select("p_partkey", "p_name")
)
_SHUFFLE = """sh AS (
  SELECT a.rep, a.var, a.sample, b.x FROM
    (SELECT rep, var, sample, row_number() OVER (PARTITION BY rep, var ORDER BY sample) AS k FROM mr) a JOIN
    (SELECT rep, var, x, row_number() OVER (PARTITION BY rep, var ORDER BY md5(concat_ws('~', CAST(rep AS VARCHAR), CAST(var AS VARCHAR), CAST(sample AS VARCHAR)))) AS k FROM mr) b
    USING (rep, var, k))"""
_REPS = "mr AS (SELECT CAST(rep AS INTEGER) AS rep, var, sample, x FROM m, (SELECT unnest(range(1, {}))  AS rep))"
query("shuffled_values", O.with_("brd", _REPS.format(4), _SHUFFLE) + "SELECT rep, var, sample, x FROM sh")(lambda s, d: N.replicates(FX.brands(s, d), 3).select("rep", "var", "sample", "x"))

# --- bins

_STURGES = "ceil(log2(n)) + 1"
_COUNT = {
    "fd": "2 * iqr * pow(n, -1.0 / 3)",
    "scott": "3.5 * sd * pow(n, -1.0 / 3)",
    "sturges": "CAST(NULL AS DOUBLE)",
    "scott2d": "3.5 * sd * pow(n, -0.25)",
}
_SPREAD = "sp AS (SELECT var, count(*) AS n, max(x) - min(x) AS span, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM m GROUP BY var)"
for _rule, _width in _COUNT.items():
    _n = f"CASE WHEN {_width} > 0 AND span > 0 THEN ceil(span / ({_width})) ELSE {_STURGES} END"
    if _rule != "scott2d":
        query(f"bins_{_rule}", O.with_("emb", _SPREAD) + f"SELECT var, CAST(greatest(5, least(50, {_n})) AS INTEGER) AS nb FROM sp")(lambda s, d, r=_rule: B.counts(FX.embeddings(s, d), r))
    _inner = f"greatest(5, least(50, {_n}))" if _rule != "scott2d" else _n
    _name = "bins_scott2d" if _rule == "scott2d" else f"bins_median_{_rule}"
    query(_name, O.with_("emb", _SPREAD) + f"SELECT var, CAST(greatest(5, least(50, (SELECT round_even(quantile_cont({_inner}, 0.5), 0) FROM sp))) AS INTEGER) AS nb FROM sp")(
        lambda s, d, r=_rule: B.counts(FX.embeddings(s, d), r if r == "scott2d" else f"median-{r}")
    )
query("bins_hg", O.with_("emb", O.HG) + "SELECT var, nb FROM nb")(lambda s, d: B.counts(FX.embeddings(s, d)))
query("bins_fixed", O.with_("emb") + "SELECT DISTINCT var, 10 AS nb FROM m")(lambda s, d: B.counts(FX.embeddings(s, d), 10))

# --- weights, entropies, mutual information

_weights = lambda s, d, order=3: D.weights(m := FX.brands(s, d), B.counts(m), order)
query("spline_weights_o3", O.with_("brd", O.STATS, O.HG, O.W3) + f"SELECT var, sample, bin, {rsql('w', 'w')} FROM w")(lambda s, d: r6(_weights(s, d), "w"))
query("spline_weights_o2", O.with_("brd", O.STATS, O.HG, O.W2) + f"SELECT var, sample, bin, {rsql('w', 'w')} FROM w")(lambda s, d: r6(_weights(s, d, 2), "w"))
_RANGE = "rg AS (SELECT var, lo, hi, nb FROM st JOIN nb USING (var))"
query(
    "weights_clamped",
    O.with_("brd", O.STATS, O.HG, _RANGE)
    + f""", v AS (SELECT var, sample, greatest(least(x * 1.5 - 20, hi), lo) AS x, lo, hi, nb FROM m JOIN rg USING (var)),
q AS (SELECT *, (x - lo) * (nb - 2) / (hi - lo) AS z, least(floor((x - lo) * (nb - 2) / (hi - lo)), nb - 3) AS q FROM v),
ac AS (SELECT *, pow(q + 1 - z, 2) / (q + 1 - greatest(q - 1, 0)) AS a, pow(z - q, 2) / (least(q + 2, nb - 2) - q) AS c FROM q)
SELECT var, sample, CAST(q + k AS INTEGER) AS bin, round(CASE k WHEN 0 THEN a WHEN 1 THEN 1 - a - c ELSE c END, 6) + 0.0 AS w FROM ac, (SELECT unnest([0, 1, 2]) AS k)""",
)(
    lambda s, d: r6(
        D.weights_at(
            (m := FX.brands(s, d)).withColumn("x", F.col("x") * 1.5 - 20), T.stats(m).select("var", "lo", "hi").join(B.counts(m), "var")
        ),
        "w",
    )
)
query("marginal_entropy", O.with_("emb", O.STATS, O.HG, O.W3, O.H) + f"SELECT var, {rsql('h', 'h')} FROM h")(
    lambda s, d: r6(D.entropy(D.weights(m := FX.embeddings(s, d), B.counts(m))), "h")
)
query("self_mi", O.with_("brd", O.STATS, O.HG, O.W3, O.H, O.SELF) + f"SELECT var, {rsql('self_mi', 'self_mi')} FROM smi")(lambda s, d: r6(D.self_mi(_weights(s, d)), "self_mi"))
_MI = ("brd", O.STATS, O.HG, O.W3, O.H, O.MI)
_EMI = ("emb", O.STATS, O.HG, O.W3, O.H, O.MI)
query("pair_mi", O.with_(*_MI) + f"SELECT i, j, {rsql('mi', 'mi')} FROM mi")(lambda s, d: r6(D.mutual_information(FX.brands(s, d), path="sql"), "mi"))
query("pair_mi_block", O.with_(*_EMI) + f"SELECT i, j, {rsql('mi', 'mi')} FROM mi")(lambda s, d: r6(D.mutual_information(FX.embeddings(s, d)), "mi"))
query(
    "pair_mi_order2", O.with_("brd", O.STATS, O.HG, O.W2, O.H, O.MI) + f"SELECT i, j, {rsql('mi', 'mi')} FROM mi"
)(lambda s, d: r6(D.mutual_information(FX.brands(s, d), order=2), "mi"))
query(
    "pair_mi_rank",
    O.with_("brd", O.RANKS).replace("m AS (", "m0 AS (").replace("FROM m)", "FROM m0)")
    + ", m AS (SELECT var, sample, r AS x FROM rk), "
    + ",\n".join((O.STATS, O.HG, O.W3, O.H, O.MI))
    + f" SELECT i, j, {rsql('mi', 'mi')} FROM mi",
)(lambda s, d: r6(D.mutual_information(FX.brands(s, d), transform="rank"), "mi"))
query("pair_mi_float", O.with_(*_MI) + "SELECT i, j, CAST(round(mi, 4) + 0.0 AS FLOAT) AS mi FROM mi")(
    lambda s, d: r6(D.mutual_information(FX.brands(s, d)), "mi", digits=4).withColumn("mi", F.col("mi").cast("float"))
)
query("two_var_mi", O.with_(*_MI) + f"SELECT i, j, {rsql('mi', 'mi')} FROM mi WHERE i = 0 AND j = 1")(
    lambda s, d: r6(D.mutual_information(FX.brands(s, d).filter("var IN (0, 1)"), path="sql"), "mi")
)
query("abs_pearson", O.with_("emb", O.CORR) + f"SELECT i, j, {rsql('abs(r)', 'r')} FROM r")(lambda s, d: r6(D.correlation(FX.embeddings(s, d)).withColumn("r", F.abs("r")), "r"))
query(
    "abs_spearman",
    O.with_("brd", O.RANKS) + f"SELECT a.var AS i, b.var AS j, {rsql('abs(corr(a.r, b.r))', 'r')} FROM rk a JOIN rk b ON a.sample = b.sample AND a.var < b.var GROUP BY 1, 2",
)(lambda s, d: r6(D.correlation(FX.brands(s, d), rank=True).withColumn("r", F.abs("r")), "r"))
query("gaussian_mi", O.with_("emb", O.CORR) + f"SELECT i, j, {rsql('-0.5 * log2(1 - least(r * r, 1 - 1e-12))', 'g')} FROM r")(lambda s, d: r6(D.gaussian_mi(D.correlation(FX.embeddings(s, d))), "g"))
query("gaussian_mi_nats", O.with_("brd", O.CORR) + f"SELECT i, j, {rsql('-0.5 * ln(1 - least(r * r, 1 - 1e-12))', 'g')} FROM r")(
    lambda s, d: r6(D.gaussian_mi(D.correlation(FX.brands(s, d)), bits=False), "g")
)
_EXCESS = """e AS (SELECT i, j, round(mi, 9) AS mi, round(abs(r), 9) AS a, -0.5 * log2(1 - least(r * r, 1 - 1e-12)) AS g FROM mi JOIN r USING (i, j)),
er AS (SELECT *, rank() OVER (ORDER BY mi) + (count(*) OVER (PARTITION BY mi) - 1) / 2.0 AS rm, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra FROM e)"""
query(
    "mi_vs_r_excess",
    O.with_(*_MI, O.CORR, _EXCESS)
    + f"SELECT {rsql('avg(CASE WHEN mi > g + 0.1 THEN 1.0 ELSE 0.0 END)', 'above')}, {rsql('avg(CASE WHEN mi < g - 0.1 THEN 1.0 ELSE 0.0 END)', 'below')}, {rsql('corr(rm, ra)', 'spearman')}, count(*) AS pairs FROM er",
)(lambda s, d: r6(D.excess_summary(D.mutual_information(m := FX.brands(s, d)), D.correlation(m)), "above", "below", "spearman"))
_HIST2 = """hs AS (SELECT least(floor((x - x0) / (x1 - x0) * 12), 11) AS x_bin, least(floor((y - y0) / (y1 - y0) * 12), 11) AS y_bin FROM
  (SELECT round(mi, 9) AS x, round(abs(r), 9) AS y FROM mi JOIN r USING (i, j)), (SELECT min(round(mi, 9)) AS x0, max(round(mi, 9)) AS x1, min(round(abs(r), 9)) AS y0, max(round(abs(r), 9)) AS y1 FROM mi JOIN r USING (i, j)))"""
query("mi_r_histogram", O.with_(*_MI, O.CORR, _HIST2) + "SELECT CAST(x_bin AS INTEGER) AS x_bin, CAST(y_bin AS INTEGER) AS y_bin, count(*) AS pairs FROM hs GROUP BY 1, 2")(
    lambda s, d: D.histogram2d(
        D.mutual_information(m := FX.brands(s, d)).join(D.correlation(m), ["i", "j"]).select(F.round("mi", 9).alias("mi"), F.round(F.abs("r"), 9).alias("a")), "mi", "a", 12
    )
)
_RIDGE = """cx AS (SELECT a.var AS i, b.var AS j, covar_samp(a.x, b.x) AS c FROM m a JOIN m b USING (sample) GROUP BY 1, 2),
cr AS (SELECT i, j, c + CASE WHEN i = j THEN 0.1 * (SELECT avg(c) FROM cx WHERE i = j) ELSE 0 END AS v FROM cx)"""
query(
    "partial_correlation",
    O.with_("brd", _RIDGE, O.inverse("cr", list(range(25)), "om")) + f"SELECT a.i, a.j, {rsql('abs(-a.v / sqrt(x.v * y.v))', 'r')} FROM om a JOIN om x ON x.i = a.i AND x.j = a.i JOIN om y ON y.i = a.j AND y.j = a.j WHERE a.i < a.j",
)(lambda s, d: r6(D.partial_correlation(FX.brands(s, d)), "r"))

# --- calibration

# what several parts of a plan use is cached, so that it is computed once
_mi = lambda s, d: D.mutual_information(FX.brands(s, d).transform(cached)).transform(cached)
_scores = lambda s, d: C.calibrated(_mi(s, d)).select("i", "j", "score").transform(cached)
_SC = (*_MI, O.score())
query("clr_stouffer", O.with_(*_EMI, O.score()) + f"SELECT i, j, {rsql('score', 'score')} FROM sc")(
    lambda s, d: r6(C.calibrated(D.mutual_information(FX.embeddings(s, d)).transform(cached)).select("i", "j", "score"), "score")
)
query("clr_euclidean", O.with_(*_MI, O.score(combine="euclidean")) + f"SELECT i, j, {rsql('score', 'score')} FROM sc")(
    lambda s, d: r6(C.calibrated(_mi(s, d), combine="euclidean").select("i", "j", "score"), "score")
)
_RAY = """rows_ AS (SELECT i AS src, mi AS v FROM mi UNION ALL SELECT j, mi FROM mi UNION ALL SELECT var, self_mi FROM smi), s2 AS (SELECT src, avg(v * v) / 2 AS s FROM rows_ GROUP BY src),
f AS (SELECT i, j, CASE WHEN a.s > 0 THEN 1 - exp(-mi * mi / (2 * a.s)) ELSE 0 END AS fi, CASE WHEN b.s > 0 THEN 1 - exp(-mi * mi / (2 * b.s)) ELSE 0 END AS fj FROM mi JOIN s2 a ON a.src = i JOIN s2 b ON b.src = j)"""
query("clr_rayleigh", O.with_(*_MI, O.SELF, _RAY) + f"SELECT i, j, {rsql('fi + fj - fi * fj', 'score')} FROM f")(
    lambda s, d: r6(C.calibrate(_mi(s, d), "rayleigh", self_values=D.self_mi(_weights(s, d))), "score")
)
query("clr_kde", O.with_(*_MI, O.SELF, O.KDE) + f"SELECT i, j, {rsql('CASE WHEN s > 0 THEN 0 ELSE s END', 'score')} FROM ks")(lambda s, d: r6(C.calibrate(_mi(s, d), "kde", self_values=D.self_mi(_weights(s, d))), "score"))
_AR = "ar AS (SELECT i, j, abs(r) AS v FROM r)"
_abs_r = lambda s, d: D.correlation(FX.brands(s, d)).select("i", "j", F.abs("r").alias("v"))
query("clr_on_pearson", O.with_("brd", O.CORR, _AR, O.score("ar", "v")) + f"SELECT i, j, {rsql('score', 'score')} FROM sc")(lambda s, d: r6(C.calibrated(_abs_r(s, d), "v").select("i", "j", "score"), "score"))
query(
    "clr_ns",
    O.with_("brd", O.RANKS).replace("m AS (", "m0 AS (").replace("FROM m)", "FROM m0)")
    + f", m AS (SELECT var, sample, {inverse_normal_sql('p')} AS x FROM (SELECT var, sample, (r - 0.375) / (count(*) OVER (PARTITION BY var) + 0.25) AS p FROM rk)), "
    + ",\n".join((O.CORR, _AR, O.score("ar", "v")))
    + f" SELECT i, j, {rsql('score', 'score')} FROM sc",
)(
    lambda s, d: r6(
        C.calibrated(
            D.correlation(T.normal_scores(FX.brands(s, d)).select("var", "sample", F.col("score").alias("x"))).select("i", "j", F.abs("r").alias("v")), "v"
        ).select("i", "j", "score"),
        "score",
    )
)
query(
    "score_ensemble",
    O.with_(*_MI, O.score(), O.CORR, _AR, O.score("ar", "v", name="s2")) + f"SELECT i, j, {rsql('(a.score + b.score) / 2', 'score')} FROM sc a JOIN s2 b USING (i, j)",
)(lambda s, d: r6(C.averaged(_scores(s, d).unionByName(C.calibrated(_abs_r(s, d), "v").select("i", "j", "score"))), "score"))

# --- permutation null (FX-BRD, 10 replicates)

_B = 10


def _null(reps: int = _B) -> tuple[str, ...]:
    """Tables up to nv (rep, i, j, v): the calibrated statistic of every replicate."""
    w3 = O.W3.replace("m.var, m.sample", "m.rep, m.var, m.sample").replace("FROM m JOIN st USING (var) JOIN nb USING (var)", "FROM sh m JOIN st USING (var) JOIN nb USING (var)")
    w3 = w3.replace("SELECT var, sample", "SELECT rep, var, sample").replace("wq AS", "nq AS").replace("w3 AS", "n3 AS").replace("w AS", "nw AS").replace("FROM wq", "FROM nq").replace("FROM w3", "FROM n3")
    mi = f"""nh AS (SELECT rep, var, sum(-p * log2(p)) AS h FROM (SELECT rep, var, bin, sum(w) / {O.N_SAMPLES} AS p FROM nw GROUP BY 1, 2, 3) WHERE p > 0 GROUP BY 1, 2),
nhxy AS (SELECT rep, i, j, sum(-p * log2(p)) AS hxy FROM (SELECT a.rep, a.var AS i, b.var AS j, a.bin AS bi, b.bin AS bj, sum(a.w * b.w) / {O.N_SAMPLES} AS p
  FROM nw a JOIN nw b ON a.rep = b.rep AND a.sample = b.sample AND a.var < b.var GROUP BY 1, 2, 3, 4, 5) WHERE p > 0 GROUP BY 1, 2, 3),
nmi AS (SELECT t.rep, i, j, x.h + y.h - hxy AS mi FROM nhxy t JOIN nh x ON x.rep = t.rep AND x.var = i JOIN nh y ON y.rep = t.rep AND y.var = j)"""
    sc = """nb_b AS (SELECT rep, i AS src, mi AS v FROM nmi UNION ALL SELECT rep, j, mi FROM nmi),
nbg AS (SELECT rep, src, sum(v) / (count(*) + 1) AS mu, sqrt(greatest(sum(v * v) - (count(*) + 1) * pow(sum(v) / (count(*) + 1), 2), 0) / count(*)) AS sd FROM nb_b GROUP BY 1, 2),
nv AS (SELECT e.rep, i, j, (greatest(CASE WHEN a.sd > 0 THEN (mi - a.mu) / a.sd ELSE 0 END, 0) + greatest(CASE WHEN b.sd > 0 THEN (mi - b.mu) / b.sd ELSE 0 END, 0)) / sqrt(2.0) AS v
  FROM nmi e JOIN nbg a ON a.rep = e.rep AND a.src = i JOIN nbg b ON b.rep = e.rep AND b.src = j)"""
    return (_REPS.format(reps + 1), _SHUFFLE, w3, mi, sc)


_HI = "hi AS (SELECT greatest(1e-8, 1.25 * max(v)) / 20000 AS w FROM nv WHERE rep = 1)"
_bin = lambda v: f"CAST(greatest(0, least(floor(({v}) / (SELECT w FROM hi) + 1e-9), 20000)) AS INTEGER)"
_PV = f"""nbin AS (SELECT {_bin('v')} AS bin FROM nv),
pv AS (SELECT i, j, score, (1.0 + (SELECT count(*) FROM nbin WHERE bin >= {_bin('score')})) / (1.0 + (SELECT count(*) FROM nbin)) AS p FROM sc)"""
_BH = """bh AS (SELECT *, count(*) OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM pv),
tau AS (SELECT coalesce(min(score), CAST('inf' AS DOUBLE)) AS tau FROM pv WHERE p <= (SELECT max(p) FROM bh WHERE p <= k * {q} / m))"""


def _values(s, d, statistic: str = "clr"):
    m = FX.brands(s, d).transform(cached)
    v = N.null_values(m, B.counts(m), _B, statistic=statistic).transform(cached)
    return v, N.top_of(v)


def _ps(s, d):
    v, hi = _values(s, d)
    return N.pvalues(_scores(s, d), N.survival(N.histogram(v, hi, hair=HAIR)), hi, hair=HAIR)


_NULL = (*_MI, *_null(), O.score(), _HI)
query("perm_null_values", O.with_("brd", O.STATS, O.HG, *_null()) + f"SELECT rep, i, j, {rsql('v', 'v')} FROM nv")(lambda s, d: r6(_values(s, d)[0], "v"))
query("perm_null_hist", O.with_("brd", O.STATS, O.HG, *_null(), _HI) + f"SELECT rep, {_bin('v')} AS bin, count(*) AS n FROM nv GROUP BY ALL")(
    lambda s, d: N.histogram(*_values(s, d), hair=HAIR)
)
query("perm_pvalues", O.with_(*_NULL, _PV) + f"SELECT i, j, {rsql('score', 'score')}, {rsql('p', 'p')} FROM pv")(lambda s, d: r6(_ps(s, d), "score", "p").select("i", "j", "score", "p"))


def _bh_edges(s, d, q):
    ps = _ps(s, d).transform(cached)
    return r6(N.selected(ps, N.bh_cutoff(ps, q)).select("i", "j", "score"), "score")


query("bh_edges", O.with_(*_NULL, _PV, _BH.format(q=0.05)) + f"SELECT i, j, {rsql('score', 'score')} FROM sc, tau WHERE score >= tau")(lambda s, d: _bh_edges(s, d, 0.05))
query("reselect_q20", O.with_(*_NULL, _PV, _BH.format(q=0.2)) + f"SELECT i, j, {rsql('score', 'score')} FROM sc, tau WHERE score >= tau")(lambda s, d: _bh_edges(s, d, 0.2))
query("bh_edges_loose", O.with_(*_NULL, _PV, _BH.format(q=0.9)) + f"SELECT i, j, {rsql('score', 'score')} FROM sc, tau WHERE score >= tau")(lambda s, d: _bh_edges(s, d, 0.9))
_HC = f"""ob AS (SELECT {_bin('score')} AS bin FROM sc),
cand AS (SELECT DISTINCT bin FROM ob UNION SELECT DISTINCT bin FROM nbin),
cv AS (SELECT bin, (SELECT count(*) FROM ob o WHERE o.bin >= c.bin) AS i, (1.0 + (SELECT count(*) FROM nbin b WHERE b.bin >= c.bin)) / (1.0 + (SELECT count(*) FROM nbin)) AS p, (SELECT count(*) FROM ob) AS m FROM cand c)"""
query(
    "hc_statistic",
    O.with_(*_NULL, f"nbin AS (SELECT {_bin('v')} AS bin FROM nv)", _HC)
    + f"SELECT {rsql('max(sqrt(CAST(m AS DOUBLE)) * (CAST(i AS DOUBLE) / m - p) / sqrt(p * (1 - p)))', 'hc')} FROM cv WHERE i >= 1 AND i <= greatest(0.1 * m, 10) AND p < 1",
)(lambda s, d: r6(N.hc_threshold(N.hc_curve(_scores(s, d), N.survival(N.histogram(*(v := _values(s, d)), hair=HAIR)), v[1], hair=HAIR), v[1]).select("hc"), "hc"))
_LFDR = """fv AS (SELECT 'obs' AS s, score AS v FROM sc UNION ALL SELECT 'null', v FROM nv), fh AS (SELECT greatest(1e-9, max(v)) / 4096 AS step FROM fv),
fs AS (SELECT s, count(*) AS n, stddev_samp(v) AS sd, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 AS q FROM fv WHERE v > 0 GROUP BY s),
fw AS (SELECT s, greatest(0.9 * least(sd, CASE WHEN q = 0 THEN sd ELSE q END) * pow(n, -0.2), step) AS h, step FROM fs, fh),
fc AS (SELECT s, CAST(least(floor(v / step), 4095) AS INTEGER) AS b, count(*) AS c FROM fv, fh WHERE v > 0 GROUP BY 1, 2),
fm AS (SELECT w.s, k, greatest(sum(c * exp(-0.5 * pow((k - b) * step / h, 2))), 1e-300) AS d FROM fw w JOIN fc USING (s), (SELECT unnest(range(0, 4096)) AS k) GROUP BY 1, 2),
fd AS (SELECT s, k, d / (sum(d) OVER (PARTITION BY s) * (SELECT step FROM fh)) AS d FROM fm),
fz AS (SELECT i, j, score, (1.0 + (SELECT count(*) FROM nv) - (SELECT count(*) FROM nv WHERE v < score)) / (1.0 + (SELECT count(*) FROM nv)) AS p FROM sc),
f0 AS (SELECT least(1.0, avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) / 0.5) AS pi0 FROM fz),
fr AS (SELECT a.k, pi0 * a.d / b.d AS r FROM fd a JOIN fd b ON b.k = a.k AND a.s = 'null' AND b.s = 'obs', f0),
fx AS (SELECT i, j, score, greatest(0.0, least(4095.0, score / step - 0.5)) AS u FROM fz, fh),
fl AS (SELECT i, j, score, a.r + (u - floor(u)) * (b.r - a.r) AS r FROM fx JOIN fr a ON a.k = CAST(floor(u) AS INTEGER) JOIN fr b ON b.k = least(4095, CAST(floor(u) AS INTEGER) + 1))"""
query("local_fdr", O.with_(*_NULL, _LFDR) + f"SELECT i, j, {rsql('CASE WHEN score > 0 THEN least(1.0, r) ELSE 1.0 END', 'lfdr')} FROM fl")(lambda s, d: r6(N.local_fdr(_scores(s, d), _values(s, d)[0]), "lfdr"))
# the grid is symmetric around its middle, where the quadratic fit has a closed form
_CENTRAL = """mb AS (SELECT i AS src, score AS v FROM sc UNION ALL SELECT j, score FROM sc),
mq AS (SELECT src, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi, median(v) AS md, stddev_samp(v) AS sd, count(*) AS n FROM mb GROUP BY src),
mh AS (SELECT *, greatest(0.9 * least(sd, (hi - lo) / 1.34) * pow(n, -0.2), 1e-12) AS h FROM mq WHERE hi > lo),
mg AS (SELECT src, lo, hi, h, k, (2 * k - 63) / 63.0 AS t FROM mh, (SELECT unnest(range(0, 64)) AS k)),
my AS (SELECT g.src, g.t, ln(greatest(sum(exp(-0.5 * pow(((lo + hi) / 2 + t * (hi - lo) / 2 - v) / h, 2))), 1e-300)) AS y FROM mg g JOIN mb USING (src) GROUP BY 1, 2),
ms2 AS (SELECT src, (64 * sum(t * t * y) - sum(t * t) * sum(y)) / (64 * sum(pow(t, 4)) - pow(sum(t * t), 2)) AS a, sum(t * y) / sum(t * t) AS b FROM my GROUP BY src),
mf2 AS (SELECT q.src, CASE WHEN a < 0 THEN (lo + hi) / 2 + (hi - lo) / 2 * (-b / (2 * a)) ELSE md END AS mu, CASE WHEN a < 0 THEN (hi - lo) / 2 * sqrt(-1 / (2 * a)) ELSE sd END AS sigma FROM mq q LEFT JOIN ms2 USING (src))"""
query("central_matching", O.with_(*_SC, _CENTRAL) + f"SELECT src, {rsql('mu', 'mu')}, {rsql('sigma', 'sigma')} FROM mf2")(lambda s, d: r6(N.central_matching(_scores(s, d)), "mu", "sigma"))

# --- operators

_W = rsql("w", "w")
query("topk_edges", O.with_(*_EMI, O.score(), O.top_k(5)) + f"SELECT src, dst, {_W} FROM tk")(lambda s, d: r6(G.top_k(C.calibrated(D.mutual_information(FX.embeddings(s, d)).transform(cached)), 5, digits=TIES), "w"))
query("topk_directed", O.with_(*_SC, O.top_k(4)) + f"SELECT src, dst, {_W} FROM tk")(lambda s, d: r6(G.top_k(_scores(s, d), 4, digits=TIES), "w"))
_TAU = "ta AS (SELECT src, dst, v AS w FROM bo WHERE round(v, 9) >= 1.0)"
query("tau_operator", O.with_(*_SC, O.both("sc", "score"), _TAU) + f"SELECT src, dst, {_W} FROM ta")(
    lambda s, d: r6(G.above(_scores(s, d).withColumn("score", F.round("score", 9)), 1.0), "w")
)
query("topk_union", O.with_(*_SC, O.both("sc", "score"), _TAU, O.top_k(2)) + f"SELECT src, dst, {rsql('max(w)', 'w')} FROM (SELECT * FROM ta UNION ALL SELECT * FROM tk) GROUP BY 1, 2")(
    lambda s, d: r6(G.union(G.above(x := _scores(s, d).withColumn("score", F.round("score", 9)), 1.0), G.top_k(x, 2, digits=TIES)), "w")
)
query("edge_operator", O.with_(*_SC, O.both("sc", "score")) + f"SELECT src, dst, {rsql('v', 'w')} FROM bo WHERE v > 0 AND (src + dst) % 3 = 0")(
    lambda s, d: r6(G.of_edges(x := _scores(s, d), x.filter("(i + j) % 3 = 0")), "w")
)
_SM = (*_SC, O.top_k(20), O.softmax(5.0, "tk"))
_soft = lambda s, d, keff=5.0, cap=20: G.softmax(_scores(s, d), keff, cap, digits=TIES)
query("softmax_keff", O.with_(*_SM) + f"SELECT src, dst, {_W} FROM sm")(lambda s, d: r6(_soft(s, d), "w"))
query("softmax_global_tau", O.with_(*_SC, O.top_k(20)) + f"SELECT src, dst, {rsql('exp((w - m) / 0.7) / sum(exp((w - m) / 0.7)) OVER (PARTITION BY src)', 'w')} FROM (SELECT *, max(w) OVER (PARTITION BY src) AS m FROM tk)")(
    lambda s, d: r6(G.softmax_at(_scores(s, d), 0.7, 20, digits=TIES), "w")
)
_OP = (*_SC, O.top_k(4), O.normal("tk", "op"))
_op = lambda s, d, k=4: G.normalised(G.top_k(_scores(s, d), k, digits=TIES), FX.brands(s, d).select("var").distinct()).transform(cached)
query("row_normalised", O.with_(*_OP) + f"SELECT src, dst, {_W} FROM op")(lambda s, d: r6(_op(s, d), "w"))
query("hard_top10", O.with_(*_SC, O.top_k(10), O.normal("tk", "op")) + f"SELECT src, dst, {_W} FROM op")(lambda s, d: r6(_op(s, d, 10), "w"))
query("row_perplexity", O.with_(*_SM) + f"SELECT src, {rsql('exp(-sum(w * ln(w)))', 'perplexity')} FROM sm WHERE w > 0 GROUP BY src")(lambda s, d: r6(G.perplexity(_soft(s, d)), "perplexity"))
query(
    "operator_stats",
    O.with_(*_OP, O.CORR, "br AS (SELECT i AS src, j AS dst, r FROM r UNION ALL SELECT j, i, r FROM r)", "od AS (SELECT v.var, count(o.dst) AS d FROM (SELECT DISTINCT var FROM m) v LEFT JOIN (SELECT * FROM op WHERE src <> dst) o ON o.src = v.var GROUP BY 1)")
    + f"SELECT CAST(sum(d) AS BIGINT) AS edges, {rsql('avg(d)', 'mean_degree')}, count(*) FILTER (d = 0) AS isolated, {rsql('(SELECT avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END) FROM op JOIN br USING (src, dst))', 'negative_share')} FROM od",
)(lambda s, d: r6(G.statistics(_op(s, d), (m := FX.brands(s, d)).select("var").distinct(), D.correlation(m)), "mean_degree", "negative_share"))
query("score_block", O.with_(*_SC, O.both("sc", "score")) + f"SELECT src, dst, {rsql('v', 'score')} FROM bo WHERE src < 5 AND dst < 5")(lambda s, d: r6(G.block(_scores(s, d), [0, 1, 2, 3, 4]), "score"))
query(
    "multi_head",
    O.with_(*_SC, O.top_k(20), O.softmax(3.0, "tk", "s3"), O.softmax(8.0, "tk", "s8")) + f"SELECT 3.0 AS head, src, dst, {_W} FROM s3 UNION ALL SELECT 8.0, src, dst, {_W} FROM s8",
)(lambda s, d: r6(G.heads(_scores(s, d), (3, 8), 20, digits=TIES), "w"))
SQL["multi_head"] = SQL["multi_head"].replace("SELECT 3.0 AS head", "SELECT CAST(3 AS DOUBLE) AS head").replace("SELECT 8.0,", "SELECT CAST(8 AS DOUBLE),")
query("symmetric_max", O.with_(*_OP) + f"SELECT least(src, dst) AS i, greatest(src, dst) AS j, {rsql('max(w)', 'w')} FROM op WHERE src <> dst GROUP BY 1, 2")(lambda s, d: r6(G.symmetric_max(_op(s, d)), "w"))

# --- diffusion

_Z = "df0 AS (SELECT var, sample, (x - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS e FROM m JOIN st USING (var))"
_e0 = lambda s, d: T.standardised(FX.brands(s, d)).select("var", "sample", F.col("z").alias("e")).transform(cached)
_traj = lambda n: " UNION ALL ".join(f"SELECT {t} AS t, var, sample, round(e, 6) + 0.0 AS e FROM df{t}" for t in range(n + 1))
query("diffuse_raw_t3", O.with_(*_OP, _Z, O.diffusion("op", 3)) + _traj(3))(lambda s, d: r6(X.diffused(_op(s, d), _e0(s, d), 3), "e"))
_SIGNED = "so AS (SELECT a.src, a.dst, a.w * CASE WHEN a.src = a.dst THEN 1 ELSE sign(r.r) END AS w FROM op a LEFT JOIN (SELECT i AS src, j AS dst, r FROM r UNION ALL SELECT j, i, r FROM r) r USING (src, dst))"
query("diffuse_signed_t2", O.with_(*_OP, O.CORR, _SIGNED, _Z, O.diffusion("so", 2)) + _traj(2))(
    lambda s, d: r6(X.diffused(_op(s, d), _e0(s, d), 2, correlations=D.correlation(FX.brands(s, d))), "e")
)
_COND = """mu AS (SELECT o.dst, o.src, w.bin, sum(w.w * z.e) / sum(w.w) AS mu FROM op o JOIN w ON w.var = o.dst JOIN df0 z ON z.var = o.src AND z.sample = w.sample WHERE o.src <> o.dst GROUP BY 1, 2, 3 HAVING sum(w.w) > 0),
msg AS (SELECT mu.dst, mu.src, w.sample, sum(w.w * mu.mu) AS msg FROM mu JOIN w ON w.var = mu.dst AND w.bin = mu.bin GROUP BY 1, 2, 3 UNION ALL SELECT var, var, sample, e FROM df0),
df1 AS (SELECT e.var, e.sample, 0.5 * e.e + 0.5 * coalesce(x.s, 0) AS e FROM df0 e LEFT JOIN (SELECT o.src AS var, msg.sample, sum(o.w * msg.msg) AS s FROM op o JOIN msg ON msg.src = o.src AND msg.dst = o.dst GROUP BY 1, 2) x ON x.var = e.var AND x.sample = e.sample)"""


def _conditional(s, d):
    z = _e0(s, d).withColumnRenamed("e", "x")
    nb = B.counts(z)
    ranges = T.stats(z).select("var", "lo", "hi").join(nb, "var")
    a = _op(s, d)
    model = X.conditional_model(a, z, z.withColumnRenamed("x", "z"), nb).transform(cached)
    return r6(X.conditional_step(a, model, z.withColumnRenamed("x", "e"), ranges, 0.5), "e")


query("diffuse_conditional_t1", O.with_(*_OP, _Z, _COND) + f"SELECT var, sample, {rsql('e', 'e')} FROM df1")(_conditional)
query("attention_mass_t3", O.with_(*_OP, O.walk("op", 3), O.attention("wk3")) + f"SELECT i, j, {rsql('s', 's')} FROM att")(lambda s, d: r6(X.attention(X.walked(_op(s, d), 3)), "s"))
query("attention_blocks_t3", O.with_(*_OP, O.walk("op", 3), O.attention("wk3")) + f"SELECT i, j, {rsql('s', 's')} FROM att")(
    lambda s, d: r6(X.attention(X.walk_blocks(_op(s, d), [3], block=8)), "s")
)
_COLS = "cols AS (SELECT DISTINCT var FROM m WHERE var % 5 = 0)"
query("attention_block_cols", O.with_(*_OP, _COLS, O.walk("op", 3, columns="cols")) + f"SELECT src, dst, {rsql('p', 'p')} FROM wk3")(
    lambda s, d: r6(X.walked(_op(s, d), 3, columns=FX.brands(s, d).filter("var % 5 = 0").select("var").distinct()), "p")
)
_CORES = "cores AS (SELECT DISTINCT var // 5 AS module, var AS member FROM m WHERE var % 5 < 2)"
_cores = lambda s, d: FX.brands(s, d).filter("var % 5 < 2").select(F.floor(F.col("var") / 5).cast("int").alias("module"), F.col("var").alias("member")).distinct()
_MASS = "ms AS (SELECT k.src, c.module, sum(p) AS mass FROM wk3 k JOIN cores c ON c.member = k.dst GROUP BY 1, 2), mt AS (SELECT *, sum(mass) OVER (PARTITION BY src) AS total FROM ms)"
query(
    "affiliation_entropy",
    O.with_(*_OP, O.walk("op", 3), _CORES, _MASS) + f"SELECT src, {rsql('1 - max(total)', 'unexplained')}, {rsql('sum(CASE WHEN mass > 0 THEN -mass / total * ln(mass / total) ELSE 0 END) / ln(5.0)', 'entropy')} FROM mt GROUP BY src",
)(lambda s, d: r6(X.affiliation_entropy(X.affiliation(X.walked(_op(s, d), 3), _cores(s, d)), 5), "unexplained", "entropy"))
query(
    "collapse_stats",
    O.with_("brd", O.CORR, "cores AS (SELECT DISTINCT var // 5 AS module, var AS member FROM m)")
    + f"SELECT {rsql('avg(r) FILTER (a.module = b.module)', 'within')}, {rsql('avg(r) FILTER (a.module <> b.module)', 'between')}, {rsql('quantile_cont(r, 0.5)', 'median')} FROM r JOIN cores a ON a.member = i JOIN cores b ON b.member = j",
)(
    lambda s, d: r6(
        X.collapse(D.correlation(m := FX.brands(s, d)), m.select(F.floor(F.col("var") / 5).cast("int").alias("module"), F.col("var").alias("member")).distinct()), "within", "between", "median"
    )
)
query(
    "profile_similarity",
    O.with_(*_OP, _Z, O.diffusion("op", 1)) + f"SELECT a.var AS i, b.var AS j, {rsql('abs(corr(a.e, b.e))', 'r')} FROM df1 a JOIN df1 b ON a.sample = b.sample AND a.var < b.var GROUP BY 1, 2",
)(lambda s, d: r6(D.correlation(X.step(_op(s, d), _e0(s, d), 0.5).withColumnRenamed("e", "x")).withColumn("r", F.abs("r")), "r"))
query("stationary_pi", O.with_(*_OP, O.stationary("op")) + f"SELECT var, {rsql('pi', 'pi')} FROM pi")(lambda s, d: r6(X.stationary(_op(s, d)), "pi"))
query("walk_spectrum")(lambda s, d: r6(X.spectrum(a := _op(s, d), X.stationary(a), [1, 2, 4, 8, 16, 32]), "n_modules", "return_probability", "slope"))
_CURVE = "cu AS (SELECT DISTINCT sample AS t, CASE WHEN sample % 7 < 4 THEN 0.05 ELSE 0.5 END AS slope, 5.0 AS n_modules FROM m)"
query(
    "depth_plateaus",
    O.with_("brd", _CURVE)
    + """, fl AS (SELECT t, row_number() OVER (ORDER BY t) AS k, slope < 0.1 AND n_modules >= 2 AS flat FROM cu), g AS (SELECT t, k - row_number() OVER (ORDER BY t) AS g FROM fl WHERE flat)
SELECT min(t) AS from_t, max(t) AS to_t, count(*) AS length FROM g GROUP BY g HAVING count(*) >= 3""",
)(
    lambda s, d: X.plateaus(
        FX.brands(s, d).select(F.col("sample").alias("t")).distinct().withColumn("slope", F.when(F.col("t") % 7 < 4, 0.05).otherwise(0.5)).withColumn("n_modules", F.lit(5.0))
    )
)
