"""Queries of composites: selections, grids, held-out depths, nested resampling, readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import calibrate, composites, dependence, diffusion, graph, metrics, resample, transform, truths
from netloom.plans import catalog_core as CC
from netloom.plans import catalog_eval as CE
from netloom.plans import oracles as O
from netloom.plans.catalog_core import TIES, query, r6, rsql
from netloom.sources import fixtures as FX
from netloom.sources import readers
from netloom.sources.store import fresh_path, kept

_brands = lambda s, d: FX.brands(s, d).transform(CC.cached)

# --- selections

_GENES = "ge AS (SELECT p_partkey AS var, (p_partkey % 97) / 1e7 AS p, p_retailprice AS variance, p_size FROM part), sg AS (SELECT * FROM ge WHERE p * (SELECT count(*) FROM ge) < 0.01)"
query(
    "factors_and_top",
    f"WITH {_GENES} SELECT var FROM sg WHERE p_size % 10 = 0 UNION SELECT var FROM (SELECT var FROM sg ORDER BY variance DESC, var LIMIT 50)",
)(
    lambda s, d: composites.factors_and_top(
        (p := FX.table(s, d, "part")).select(F.col("p_partkey").alias("var"), ((F.col("p_partkey") % 97) / 1e7).alias("p"), F.col("p_retailprice").alias("variance")),
        p.filter("p_size % 10 = 0").select(F.col("p_partkey").alias("var")), 50,
    )
)
query(
    "factor_target_sets",
    O.with_(CE._KNOWN) + "SELECT factor AS set_id, target AS member FROM kn WHERE factor IN (SELECT factor FROM kn GROUP BY factor HAVING count(*) BETWEEN 5 AND 500) AND (SELECT count(*) FROM (SELECT factor FROM kn GROUP BY factor HAVING count(*) BETWEEN 5 AND 500)) >= 3",
)(lambda s, d: truths.enough_sets(truths.sized_sets(CE._known(s, d).select(F.col("factor").alias("set_id"), F.col("target").alias("member")))[0], 3))
_KINDS = """ks AS (SELECT 'unit' AS kind, 'u' || grp AS set_id, member FROM sets UNION ALL SELECT 'factor', 'f' || set_id, member FROM sets UNION ALL SELECT 'sigma', 's' || (set_id % 2), member FROM sets)"""
query(
    "granularity_sets",
    O.with_("sets", _KINDS) + "SELECT kind, count(DISTINCT set_id) AS sets, count(*) AS members FROM ks WHERE set_id IN (SELECT set_id FROM ks GROUP BY set_id HAVING count(DISTINCT member) BETWEEN 2 AND 500) GROUP BY kind",
)(
    lambda s, d: truths.granularity(
        {
            "unit": (x := CE._sets(s, d)).select(F.concat(F.lit("u"), "grp").alias("set_id"), "member"),
            "factor": x.select(F.concat(F.lit("f"), "set_id").alias("set_id"), "member"),
            "sigma": x.select(F.concat(F.lit("s"), F.col("set_id") % 2).alias("set_id"), "member"),
        }, 2, 500,
    )
)
query(
    "profile_half_split",
    "SELECT n_nationkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY md5(concat_ws('~', '1', CAST(n_nationkey AS VARCHAR))), n_nationkey) AS k, count(*) OVER () AS n FROM nation WHERE n_nationkey / 2e4 < 1e-3 AND NOT n_name LIKE '%3') WHERE k <= floor(n * 0.5)",
)(
    lambda s, d: resample.kept_halves(
        resample.usable_profiles(FX.table(s, d, "nation").select(F.col("n_nationkey").alias("var"), (F.col("n_nationkey") / 2e4).alias("p"), F.col("n_name").like("%3").alias("control"))), 1
    ).select(F.col("var").alias("n_nationkey"))
)
query(
    "platforms",
    """WITH sm AS (SELECT c_custkey AS sample, c_nationkey AS series, c_mktsegment AS treatment FROM customer),
se AS (SELECT n_nationkey AS series, CASE n_regionkey WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' WHEN 2 THEN 'P1,P2' END AS of_series FROM nation),
ow AS (SELECT c_custkey AS sample, 'P' || (c_custkey % 3) AS of_sample FROM customer),
bo AS (SELECT sm.*, CASE WHEN contains(of_series, ',') THEN of_sample ELSE of_series END AS found FROM sm LEFT JOIN se USING (series) LEFT JOIN ow USING (sample))
SELECT sample, series, treatment, CASE found WHEN 'P1' THEN 'First' WHEN 'P2' THEN 'Second' ELSE 'none' END AS platform, regexp_matches(treatment, '^(AUTO|MACH)') AS treated FROM bo""",
)(
    lambda s, d: composites.classified(
        (c := FX.table(s, d, "customer")).select(F.col("c_custkey").alias("sample"), F.col("c_nationkey").alias("series"), F.col("c_mktsegment").alias("treatment")),
        FX.table(s, d, "nation").select(F.col("n_nationkey").alias("series"), F.expr("CASE n_regionkey WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' WHEN 2 THEN 'P1,P2' END").alias("platform")),
        c.select(F.col("c_custkey").alias("sample"), F.concat(F.lit("P"), F.col("c_custkey") % 3).alias("platform")),
        {"P1": "First", "P2": "Second"}, "none", "^(AUTO|MACH)",
    )
)
_FLAGS = ["information", "common_bins", "context", "softmax", "depth", "components"]


def _config(on):
    dep = F.when(~on["information"], "r").when(on["common_bins"], "mi_hg").otherwise("mi_fd")
    att = F.when(~on["depth"], "none").when(on["softmax"], "soft").otherwise("hard")
    return F.concat_ws("|", dep, F.when(on["components"], "k2").otherwise("k0"), F.concat(F.lit("clr"), on["context"].cast("int")), att)


def _configurations(s: SparkSession) -> DataFrame:
    pick = lambda options, k: F.element_at(F.array(*[F.lit(o) for o in options]), (k + 1).cast("int"))
    k = F.col("id")
    config = F.concat_ws("|", pick(["r", "mi_hg", "mi_fd"], k % 3), pick(["k0", "k2"], F.floor(k / 3) % 2), pick(["clr0", "clr1"], F.floor(k / 6) % 2), pick(["none", "soft", "hard"], F.floor(k / 12)))
    return s.range(36).select(config.alias("config"), ((k * 37) % 101 / 101.0).alias("value"))


query(
    "component_grid",
    """WITH c AS (SELECT ['r', 'mi_hg', 'mi_fd'][1 + k % 3] || '|' || ['k0', 'k2'][1 + (k // 3) % 2] || '|' || ['clr0', 'clr1'][1 + (k // 6) % 2] || '|' || ['none', 'soft', 'hard'][1 + k // 12] AS config, (k * 37) % 101 / 101.0 AS value FROM (SELECT unnest(range(0, 36)) AS k)),
s AS (SELECT CAST(s AS INTEGER) AS s, (CASE WHEN s & 1 = 0 THEN 'r' WHEN s & 2 <> 0 THEN 'mi_hg' ELSE 'mi_fd' END) || '|' || (CASE WHEN s & 32 <> 0 THEN 'k2' ELSE 'k0' END) || '|' || (CASE WHEN s & 4 <> 0 THEN 'clr1' ELSE 'clr0' END) || '|' || (CASE WHEN s & 16 = 0 THEN 'none' WHEN s & 8 <> 0 THEN 'soft' ELSE 'hard' END) AS config FROM (SELECT unnest(range(0, 64)) AS s))
SELECT s, config, round(value, 6) + 0.0 AS value FROM s LEFT JOIN c USING (config)""",
)(lambda s, d: r6(composites.toggled(_configurations(s), _FLAGS, _config), "value"))

# --- one method on all benchmarks, configurations, ensembles

_LONG = (*CE._PAIRS, CE._STRATA, O.blocks("es", "stratum"), CE._COH, O.blocks("ce", "set_id", name="bc"))
_AT = """cs AS (SELECT stratum AS class, sum(tp * CAST(cum AS DOUBLE) / k) / sum(tp) AS ap, sum(tp) / CAST(sum(n) AS DOUBLE) AS base FROM bl GROUP BY stratum HAVING sum(tp) >= 20),
au AS (SELECT set_id, (sum(tp * rank) - sum(tp) * (sum(tp) + 1) / 2.0) / (CAST(sum(tp) AS DOUBLE) * sum(n - tp)) AS auroc FROM (SELECT *, sum(n) OVER (PARTITION BY set_id) - k + (n + 1) / 2.0 AS rank FROM bc) GROUP BY set_id HAVING sum(tp) > 0 AND sum(n - tp) > 0),
ac AS (SELECT unnest(['all', 'c' || (set_id % 2)]) AS class, auroc FROM au)"""
query(
    "score_rows",
    O.with_(*_LONG, _AT)
    + f"""SELECT 'comembership' AS benchmark, class, unnest(['ap', 'base_rate']) AS metric, round(unnest([ap, base]), 6) + 0.0 AS value FROM cs
UNION ALL SELECT 'coherence', class, unnest(['median_auroc', 'share_high', 'sets']), round(unnest([quantile_cont(auroc, 0.5), avg(CASE WHEN auroc > 0.5 THEN 1.0 ELSE 0.0 END), CAST(count(*) AS DOUBLE)]), 6) + 0.0 FROM ac GROUP BY class""",
)(
    lambda s, d: r6(
        composites.score_rows(
            (c := kept(CE._strata(s, d))).filter("stratum = 'all'"), c.filter("stratum <> 'all'"),
            metrics.auroc(CE._coherence(s, d), ["set_id"], weight="n").select("set_id", F.concat(F.lit("c"), F.col("set_id") % 2).alias("class"), "auroc"), high=0.5, weight="n",
        ), "value",
    )
)
_CONFIGS = {"hg_stouffer": {"bins": "hg"}, "hg_euclidean": {"bins": "hg", "combine": "euclidean"}, "eight": {"bins": 8, "combine": "euclidean"}, "rank_hg": {"bins": "hg", "transform": "rank"}}


def _config_sql(name: str, c: dict) -> str:
    bins = O.HG if c["bins"] == "hg" else f"nb AS (SELECT DISTINCT var, {c['bins']} AS nb FROM m)"
    start = O.with_("brd")
    if c.get("transform") == "rank":
        start = O.with_("brd", O.RANKS).replace("m AS (", "m0 AS (").replace("FROM m)", "FROM m0)") + ", m AS (SELECT var, sample, r AS x FROM rk)"
    gp = "gp AS (SELECT i, j, CAST(i // 5 = j // 5 AS INTEGER) AS label, mi, score FROM mi JOIN sc USING (i, j))"
    parts = (O.STATS, bins, O.W3, O.H, O.MI, O.score(combine=c.get("combine", "stouffer")), gp, O.blocks("gp", score="mi", name="b1"), O.blocks("gp", name="b2"))
    ap = "sum(tp * CAST(cum AS DOUBLE) / k) / sum(tp)"
    return f"(SELECT * FROM ({start}, {', '.join(parts)} SELECT '{name}' AS config, (SELECT round({ap}, 6) + 0.0 FROM b1) AS ap_mi, round({ap}, 6) + 0.0 AS ap, CAST(sum(tp) AS BIGINT) AS n_pos FROM b2))"


_fives = lambda s, d: (v := FX.brands(s, d).select("var").distinct()).select(F.col("var").alias("i")).join(v.select(F.col("var").alias("j")), F.col("i") < F.col("j")).select(
    "i", "j", (F.floor(F.col("i") / 5) == F.floor(F.col("j") / 5)).cast("int").alias("label")
)
query("configuration_grid", " UNION ALL ".join(_config_sql(n, c) for n, c in _CONFIGS.items()))(lambda s, d: r6(composites.grid(_brands(s, d), _CONFIGS, _fives(s, d)), "ap_mi", "ap"))


def _keyed_score(edges: str, keys: str, name: str) -> str:
    """Calibrated values of a table (keys, i, j, score), as name (keys, i, j, score)."""
    on = lambda a: " AND ".join(f"{a}.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    return f"""{name}_b AS (SELECT {keys}, i AS src, score AS v FROM {edges} UNION ALL SELECT {keys}, j, score FROM {edges}),
{name}_g AS (SELECT {keys}, src, sum(v) / (count(*) + 1) AS mu, sqrt(greatest(sum(v * v) - (count(*) + 1) * pow(sum(v) / (count(*) + 1), 2), 0) / count(*)) AS sd FROM {name}_b GROUP BY ALL),
{name} AS (SELECT e.* EXCLUDE (score), (greatest(CASE WHEN a.sd > 0 THEN (score - a.mu) / a.sd ELSE 0 END, 0) + greatest(CASE WHEN b.sd > 0 THEN (score - b.mu) / b.sd ELSE 0 END, 0)) / sqrt(2.0) AS score
  FROM {edges} e JOIN {name}_g a ON {on('a')} AND a.src = i JOIN {name}_g b ON {on('b')} AND b.src = j)"""


_TIES = """tm AS (SELECT draw, var, sample, CAST(row_number() OVER (PARTITION BY draw, var ORDER BY x, md5(concat_ws('~', CAST(draw AS VARCHAR), CAST(var AS VARCHAR), CAST(sample AS VARCHAR)))) AS DOUBLE) AS x FROM m, (SELECT unnest(range(1, 4)) AS draw)),
te AS (SELECT a.draw, a.var AS i, b.var AS j, abs(coalesce(corr(a.x, b.x), 0)) AS score FROM tm a JOIN tm b ON a.draw = b.draw AND a.sample = b.sample AND a.var < b.var GROUP BY 1, 2, 3)"""
query("tie_ensemble", O.with_("brd", _TIES, _keyed_score("te", "draw", "ts")) + f"SELECT i, j, {rsql('avg(score)', 'score')} FROM ts GROUP BY 1, 2")(lambda s, d: r6(composites.tie_ensemble(_brands(s, d), 3), "score"))
query(
    "set_table",
    O.with_("sup", "sets", O.CORR, CE._COH, O.blocks("ce", "set_id"))
    + f""", ex AS (SELECT *, unnest(range(1, CAST(n + 1 AS BIGINT))) AS t FROM bl WHERE tp > 0),
nn AS (SELECT set_id, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg, avg(CASE WHEN score <> 0 THEN 1.0 ELSE 0.0 END) AS nonzero FROM ce GROUP BY 1),
pe AS (SELECT set_id, sum(tp / CAST(n AS DOUBLE) * (cum - tp + 1 + CASE WHEN n > 1 THEN (t - 1) * (tp - 1) / CAST(n - 1 AS DOUBLE) ELSE 0 END) / (k - n + t)) AS s FROM ex GROUP BY set_id),
sg AS (SELECT set_id, sum(c * (c - 1)) / nullif(CAST(sum(c) * (sum(c) - 1) AS DOUBLE), 0) AS same_group FROM (SELECT set_id, grp, count(*) AS c FROM sets GROUP BY 1, 2) GROUP BY set_id)
SELECT set_id, n_pos, n_neg, {rsql('n_pos / CAST(n_pos + n_neg AS DOUBLE)', 'base_rate')}, {rsql('same_group', 'same_group')}, {rsql('s / n_pos', 'ap')}, {rsql('nonzero', 'nonzero')} FROM nn JOIN pe USING (set_id) JOIN sg USING (set_id)""",
)(lambda s, d: r6(composites.set_table(CE._coherence(s, d), CE._groups(s, d), CE._members(s, d), weight="n"), "base_rate", "same_group", "ap", "nonzero"))
_LOAD = """lo AS (SELECT var, sample AS pc, abs(x - 25) AS a FROM m), lr AS (SELECT *, rank() OVER (PARTITION BY pc ORDER BY a) + (count(*) OVER (PARTITION BY pc, a) - 1) / 2.0 AS r FROM lo),
ti AS (SELECT pc, sum(t * t * t - t) AS ties, sum(t) AS n_all FROM (SELECT pc, a, CAST(count(*) AS DOUBLE) AS t FROM lo GROUP BY 1, 2) GROUP BY 1),
ow AS (SELECT set_id, pc, count(*) AS n, sum(r) AS s FROM sets JOIN lr ON var = member GROUP BY 1, 2),
uz AS (SELECT set_id, pc, n, s - n * (n + 1) / 2.0 AS u, n_all - n AS rest, sqrt(n * (n_all - n) / 12 * (n_all + 1 - ties / (n_all * (n_all - 1)))) AS sd FROM ow JOIN ti USING (pc) WHERE n_all > n),
za AS (SELECT *, greatest(abs(u - n * rest / 2) - 0.5, 0) / sd / sqrt(2.0) AS a, 1 / (1 + 0.3275911 * greatest(abs(u - n * rest / 2) - 0.5, 0) / sd / sqrt(2.0)) AS t FROM uz),
pt AS (SELECT set_id, pc, n, u / (n * rest) AS auroc, CASE WHEN sd > 0 THEN {erf} ELSE 1.0 END AS p FROM za),
pk AS (SELECT *, row_number() OVER (ORDER BY p, set_id, pc) AS k, count(*) OVER () AS m_all FROM pt)""".replace("{erf}", CE._ERF)
query(
    "loading_enrichment",
    O.with_("sup", "sets", _LOAD) + f"SELECT set_id, pc, n, {rsql('auroc', 'auroc', 9)}, {rsql('p', 'p')}, {rsql('min(least(1.0, p * m_all / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)', 'adjusted')} FROM pk",
)(
    lambda s, d: r6(
        r6(composites.loading_enrichment(FX.suppliers(s, d).select("var", F.col("sample").alias("pc"), (F.col("x") - 25).alias("loading")), CE._members(s, d)), "p", "adjusted"), "auroc", digits=9
    )
)

# --- held-out depths, nested resampling, variants

_DEPTHS = [1, 2, 4]
_HALF = """hv AS (SELECT CAST(split AS INTEGER) AS split, sample, CAST((row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('~', CAST(split AS VARCHAR), CAST(sample AS VARCHAR))), sample) - 1) % 2 AS INTEGER) AS half
  FROM (SELECT DISTINCT sample FROM m), (SELECT unnest(range(1, {})) AS split))"""
_FITS = """mf AS (SELECT 2 * split + half AS fit, var, sample, x FROM m JOIN hv USING (sample)),
rf AS (SELECT a.fit, a.var AS i, b.var AS j, abs(coalesce(corr(a.x, b.x), 0)) AS score FROM mf a JOIN mf b ON a.fit = b.fit AND a.sample = b.sample AND a.var < b.var GROUP BY 1, 2, 3),
fb AS (SELECT fit, i AS src, j AS dst, score AS v FROM rf UNION ALL SELECT fit, j, i, score FROM rf),
fo AS (SELECT fit, src, dst, v / sum(v) OVER (PARTITION BY fit, src) AS w FROM (SELECT *, row_number() OVER (PARTITION BY fit, src ORDER BY round(v, 9) DESC, dst) AS k FROM fb WHERE v > 0) WHERE k <= 4),
fw0 AS (SELECT DISTINCT fit, var AS src, var AS dst, 1.0 AS p FROM mf)"""
_WALKS = ",\n".join(
    f"fw{t} AS (SELECT fit, src, dst, sum(p) AS p FROM (SELECT fit, src, dst, 0.5 * p AS p FROM fw{t - 1} UNION ALL SELECT a.fit, a.src, k.dst, 0.5 * a.w * k.p FROM fo a JOIN fw{t - 1} k ON k.fit = a.fit AND k.src = a.dst) GROUP BY 1, 2, 3)"
    for t in range(1, 5)
)
def _crit(depths: tuple[int, ...]) -> str:
    return (
        "fa AS (" + " UNION ALL ".join(f"SELECT {t} AS t, fit, least(src, dst) AS i, greatest(src, dst) AS j, sum(p) / 2 AS s FROM fw{t} WHERE src <> dst GROUP BY 2, 3, 4" for t in depths) + "),\n"
        "fl AS (SELECT CASE WHEN fit % 2 = 0 THEN fit + 1 ELSE fit - 1 END AS fit, i, j, CAST(score >= quantile_cont(score, 0.9) OVER (PARTITION BY fit) AS INTEGER) AS label FROM rf),\n"
        f"fp AS (SELECT t, l.fit, l.i, l.j, label, coalesce(s, 0) AS score FROM fl l CROSS JOIN (SELECT unnest({list(depths)}) AS t) LEFT JOIN fa USING (t, fit, i, j)),\n"
        + O.blocks("fp", "fit, t") + ",\ncv AS (SELECT fit // 2 AS split, fit % 2 AS direction, t, sum(tp * CAST(cum AS DOUBLE) / k) / sum(tp) AS value FROM bl GROUP BY fit, t)"
    )


_CURVES = ("brd", _HALF.format(3), _FITS, _WALKS, _crit(_DEPTHS))
_curves = lambda s, d, depths=_DEPTHS: composites.held_out_curves(
    composites.halves(m := _brands(s, d), 2).join(m, "sample"), composites.abs_correlations, depths, 4, 0.1, digits=TIES
).transform(CC.cached)
query("held_out_curves", O.with_(*_CURVES) + f"SELECT split, direction, t, {rsql('value', 'value')} FROM cv")(lambda s, d: r6(_curves(s, d), "value"))
query(
    "held_out_depths",
    O.with_(*_CURVES) + "SELECT split, CAST(round_even(exp(avg(ln(CAST(greatest(t, 1) AS DOUBLE)))), 0) AS INTEGER) AS t FROM (SELECT split, direction, arg_max(t, (round(value, 9), -t)) AS t FROM cv GROUP BY 1, 2) GROUP BY split",
)(lambda s, d: composites.held_out_depths(_curves(s, d), TIES))
_months = lambda s, d, by: FX.brands(s, d).select("sample").distinct().select(by.cast("int").alias("grp"), "sample")
query("nested_cluster_bootstrap")(
    lambda s, d: r6(
        composites.nested_draws(_brands(s, d), resample.cluster_columns(_months(s, d, F.col("sample") % 12), 3), composites.abs_correlations, _DEPTHS, _fives(s, d), 4, 0.1, TIES), "ap"
    )
)
query("sample_bootstrap")(
    lambda s, d: r6(composites.nested_draws(_brands(s, d), resample.cluster_columns(_months(s, d, F.col("sample")), 3), composites.abs_correlations, _DEPTHS, _fives(s, d), 4, 0.1, TIES), "ap")
)
_VARIANTS = (
    "brd", O.RANKS, _HALF.format(4),
    """vt AS (SELECT split, sample % 2 AS platform, var, sample, x FROM m JOIN hv USING (sample) WHERE half = 1 QUALIFY count(DISTINCT sample) OVER (PARTITION BY split, sample % 2) >= 10),
ve AS (SELECT a.split, a.platform, a.var AS i, b.var AS j, abs(coalesce(corr(a.x, b.x), 0)) AS score FROM vt a JOIN vt b ON a.split = b.split AND a.platform = b.platform AND a.sample = b.sample AND a.var < b.var GROUP BY 1, 2, 3, 4)""",
    _keyed_score("ve", "split, platform", "vs"),
    """vg AS (SELECT split, i, j, avg(score) AS target FROM vs GROUP BY 1, 2, 3), vl AS (SELECT split, i, j, CAST(target >= quantile_cont(target, 0.9) OVER (PARTITION BY split) AS INTEGER) AS label FROM vg),
vm AS (SELECT 'raw' AS variant, split, var, m.sample, x FROM m JOIN hv USING (sample) WHERE half = 0 UNION ALL SELECT 'rank', split, var, rk.sample, r FROM rk JOIN hv USING (sample) WHERE half = 0),
vr AS (SELECT a.variant, a.split, a.var AS i, b.var AS j, abs(coalesce(corr(a.x, b.x), 0)) AS score FROM vm a JOIN vm b ON a.variant = b.variant AND a.split = b.split AND a.sample = b.sample AND a.var < b.var GROUP BY 1, 2, 3, 4)""",
    _keyed_score("vr", "variant, split", "vc"),
    "vp AS (SELECT variant, split, label, score FROM vc JOIN vl USING (split, i, j))",
    O.blocks("vp", "variant, split"),
)
query(
    "variant_criterion",
    O.with_(*_VARIANTS) + f"SELECT variant, {rsql('avg(ap)', 'mean')}, {rsql('stddev_samp(ap)', 'sd')}, count(*) AS splits FROM (SELECT variant, split, sum(tp * CAST(cum AS DOUBLE) / k) / sum(tp) AS ap FROM bl GROUP BY 1, 2) GROUP BY variant",
)(
    lambda s, d: r6(
        composites.variant_criterion(
            {"raw": (m := _brands(s, d)), "rank": transform.ranked(m).select("var", "sample", F.col("r").alias("x"))},
            m.select("sample", (F.col("sample") % 2).alias("platform")).distinct(), composites.halves(m, 3), 10, 0.1,
        ), "mean", "sd",
    )
)
query("depth_sweep")(
    lambda s, d: r6(
        composites.depth_sweep(
            CC._op(s, d), CC._e0(s, d), (r := FX.brands(s, d).select(F.concat(F.lit("R"), F.floor(F.col("var") / 5).cast("int")).alias("module"), F.col("var").alias("member")).distinct()),
            r.filter("member % 5 < 2"), [0, 1, 3], 0.8,
        ), "weighted_f1", "best_mean_f1", "entropy", "unexplained", "within", "between", digits=5,
    )
)
query("walk_auto", O.with_(*CC._OP, O.walk("op", 3), O.attention("wk3")) + f"SELECT i, j, {rsql('s', 's')} FROM att")(lambda s, d: r6(diffusion.attention(diffusion.walked_auto(CC._op(s, d), 3)), "s"))
query("walk_snapshots", O.with_(*CC._OP, O.walk("op", 3)) + " UNION ALL ".join(f"SELECT {t} AS t, src, dst, {rsql('p', 'p')} FROM wk{t}" for t in (1, 3)))(
    lambda s, d: r6(diffusion.walked_at(CC._op(s, d), [1, 3]), "p")
)
query("external_operator", O.with_(*CC._OP) + f"SELECT src, dst, {rsql('w', 'w')} FROM op")(lambda s, d: r6(graph.external(CC._op(s, d)), "w"))


def _golden(s, d) -> DataFrame:
    """The depth at which held-out halves agree best, by the integer search over their mean curve (a row a depth)."""
    curve = {r["t"]: round(r["value"], TIES) for r in _curves(s, d, (1, 2, 3, 4)).groupBy("t").agg(F.avg("value").alias("value")).collect()}
    t, seen = diffusion.golden_depth(curve.__getitem__, 1, 4)
    return s.createDataFrame([(t, seen[t])], "t int, value double")


# depths 1, 2 and 4 are scanned; where 1 is the best of them, 3 isn't tried
query(
    "golden_depth",
    O.with_("brd", _HALF.format(3), _FITS, _WALKS, _crit((1, 2, 3, 4)))
    + f""", av AS (SELECT t, round(avg(value), 9) AS value FROM cv GROUP BY t), tried AS (SELECT * FROM av WHERE t <> 3 OR (SELECT arg_max(t, (value, -t)) FROM av WHERE t <> 3) <> 1)
SELECT CAST(arg_max(t, (value, -t)) AS INTEGER) AS t, {rsql('max(value)', 'value')} FROM tried""",
)(lambda s, d: r6(_golden(s, d), "value"))


def _committed(s, d) -> DataFrame:
    """The strongest partners of each brand, committed to a file; the gate lets those through that are made anew from the tables, by
    another number of tasks."""
    chosen = lambda m: graph.top_k(dependence.correlation(m).select("i", "j", F.round(F.abs("r"), TIES).alias("score")), 3, digits=TIES).select("src", "dst")
    path = fresh_path(s, "committed")
    composites.commit(chosen(FX.brands(s, d)), path)
    return composites.gate(chosen(FX.brands(s, d).repartition(3)), composites.committed(s, path))


query("committed_selection", O.with_("brd", O.CORR, "sc AS (SELECT i, j, round(abs(r), 9) AS score FROM r)", O.top_k(3)) + "SELECT src, dst FROM tk")(_committed)
query(
    "aliased_names",
    """SELECT n_nationkey, coalesce(CASE plain WHEN 'nATION_3' THEN 'third' WHEN 'nATION_4' THEN 'fourth' END, plain) AS name FROM (SELECT n_nationkey, lower(substr(n_name, 1, 1)) || substr(n_name, 2) AS plain FROM nation)""",
)(lambda s, d: FX.table(s, d, "nation").select("n_nationkey", truths.alias_names(F.col("n_name"), {"nATION_3": "third", "nATION_4": "fourth"}).alias("name")))
query("jittered_rows", "SELECT p_brand AS var, count(*) AS n, TRUE AS varies FROM part GROUP BY 1")(
    lambda s, d: transform.jittered(FX.table(s, d, "part").select(F.col("p_brand").alias("var"), F.col("p_partkey").alias("sample"), F.lit(1.0).alias("x")))
    .groupBy("var").agg(F.count("*").alias("n"), (F.max("x") > F.min("x")).alias("varies"))
)

# --- readers and writers: tables written in a reader's format and read back


def _wide(s, d, sep: str) -> str:
    m, path = FX.brands(s, d), fresh_path(s, "wide")
    readers.write_matrix(m, path, [r[0] for r in m.select("sample").distinct().orderBy("sample").collect()], sep)  # a fixed number of months
    return path


_ints = lambda df: df.select(F.col("var").cast("int"), F.col("sample").cast("int"), "x")
_BRD = O.with_("brd") + "SELECT var, sample, x FROM m"
query("read_named_csv", _BRD)(lambda s, d: _ints(readers.named_csv(s, _wide(s, d, ","))))


def _headed(s: SparkSession, head: list[str], lines: DataFrame) -> DataFrame:
    """The lines (k, value) in the order of k, after those of a head."""
    first = s.createDataFrame(list(enumerate(head)), "k int, value string")
    return first.unionByName(lines).orderBy("k").select("value")


def _lines(s: SparkSession, lines: DataFrame, name: str, **options: str) -> str:
    path = fresh_path(s, name)
    lines.coalesce(1).write.options(**options).text(path)
    return path


def _compendium(s, d):
    wide = s.read.csv(_wide(s, d, "\t"), sep="\t", header=True)
    path = fresh_path(s, "compendium")
    named = wide.withColumn("var", F.concat(F.lit("probe_"), "var", F.lit("_at"))).withColumnRenamed("var", "probe")
    named.write.csv(path, sep="\t", header=True)
    return _ints(readers.compendium(s, path))


query("read_compendium", _BRD)(_compendium)


def _plain(s, d):
    rows = FX.brands(s, d).groupBy("var").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "x"))), lambda c: c["x"].cast("string")).alias("xs"))
    rows = rows.orderBy("var").coalesce(1)
    return _ints(readers.plain_matrix(s, _lines(s, rows.select(F.concat_ws("\t", "xs")), "plain"), _lines(s, rows.select(F.col("var").cast("string")), "names")))


query("read_plain_matrix", O.with_("brd") + "SELECT var, CAST(dense_rank() OVER (ORDER BY sample) - 1 AS INTEGER) AS sample, x FROM m")(_plain)


def _commented(s, d):
    n = FX.table(s, d, "nation").select((F.col("n_nationkey") + 2).cast("int").alias("k"), F.concat_ws("\t", "n_nationkey", F.concat(F.lit(" "), "n_name")).alias("value"))
    return readers.commented(s, _lines(s, _headed(s, ["# comment", "1)id\t2)name"], n), "commented"))


query("read_commented", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")(_commented)


def _networks(s, d):
    n = FX.table(s, d, "nation")
    wide = n.filter("n_regionkey < 2").select(F.concat_ws("\t", F.lit("x"), F.lit("y"), "n_name", F.lit("z"), F.concat(F.lit("t"), "n_regionkey"), F.lit("+"), F.lit("strong")).alias("value"))
    five = n.filter("n_regionkey >= 2").select(F.concat_ws("\t", "n_name", F.concat(F.lit("t"), "n_regionkey"), F.lit("-"), F.lit("e"), F.lit("weak")).alias("value"))
    return readers.network(s, _lines(s, wide, "wide", compression="gzip")).unionByName(readers.network(s, _lines(s, five, "five")))


query("read_networks", "SELECT n_name AS factor, 't' || n_regionkey AS target, CASE WHEN n_regionkey < 2 THEN 'S' ELSE 'W' END AS confidence FROM nation")(_networks)


def _experimenters(s, d):
    n = FX.table(s, d, "nation").select(
        (F.col("n_nationkey") + 1).cast("int").alias("k"),
        F.concat_ws("\t", "n_name", F.concat(F.lit("c"), "n_nationkey"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("a:b, experimenter: P"), "n_regionkey", F.lit(", x:y"))).otherwise("none")).alias("value"),
    )
    return readers.experimenters(s, _lines(s, _headed(s, ["experiment_name\tchip_name\tdescription"], n), "experiments"))


query("read_experimenters", "SELECT n_name AS experiment_name, CASE WHEN n_regionkey > 0 THEN 'P' || n_regionkey ELSE 'unknown_' || n_name END AS grp FROM nation")(_experimenters)


def _artifacts(s, d):
    path = fresh_path(s, "artifacts")
    readers.save_artifacts({"matrix": FX.brands(s, d)}, {"seed": 1}, path)
    tables, parameters = readers.load_artifacts(s, path)
    return tables["matrix"].withColumn("seed", F.lit(parameters["seed"]))


query("artifact_round_trip", O.with_("brd") + "SELECT var, sample, x, 1 AS seed FROM m")(_artifacts)


def _resumed(s, d):
    path, n = fresh_path(s, "results"), FX.table(s, d, "nation").select("n_nationkey", "n_name")
    readers.write_results(n.filter("n_nationkey < 10"), path, "n_nationkey")
    readers.write_results(readers.pending(n, path, "n_nationkey"), path, "n_nationkey")
    return s.read.parquet(path).select("n_nationkey", "n_name")


query("resumed_tasks", "SELECT n_nationkey, n_name FROM nation")(_resumed)
