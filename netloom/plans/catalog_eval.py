"""Queries of modules, truths, metrics, resampling, perturbation, learned baselines and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import calibrate as C
from netloom.operators import dependence as D
from netloom.operators import folds as FO
from netloom.operators import information as I
from netloom.operators import metrics as E
from netloom.operators import modules as M
from netloom.operators import perturb as P
from netloom.operators import report as R
from netloom.operators import resample as S
from netloom.operators import truths as K
from netloom.plans import catalog_core as CC
from netloom.plans import oracles as O
from netloom.plans.catalog_core import query, r6, rsql
from netloom.sources import fixtures as FX
from netloom.sources.store import kept

# --- truths: suppliers in regions, pairs of one nation left out

_PU = """pu AS (SELECT a.member AS i, b.member AS j, CAST(a.set_id = b.set_id AS INTEGER) AS label FROM sets a JOIN sets b ON a.member < b.member AND a.grp <> b.grp)"""
_EV = "ev AS (SELECT i, j, label, round(abs(r), 2) AS score FROM pu JOIN r USING (i, j))"
_PAIRS = ("sup", "sets", O.CORR, _PU, _EV)
_sets = lambda s, d: FX.supplier_sets(s, d)
_members = lambda s, d: _sets(s, d).select("set_id", "member")
_groups = lambda s, d: _sets(s, d).select("member", "grp")
_score = lambda s, d, least=None: D.correlation(FX.suppliers(s, d), least=least).select("i", "j", F.round(F.abs("r"), 2).alias("score"))
# pairs are the square of the suppliers: they are made anew for each pass, and neither cached nor shuffled
_pairs = lambda s, d: K.labelled(_score(s, d), _members(s, d), _groups(s, d))
# what only needs counts of pairs, or a row of each, takes them from the tasks that make them
_folds = lambda s, d: FO.with_members(FO.rows_of(FX.suppliers(s, d)), _members(s, d), _groups(s, d))
_sums = lambda i, j: i + j
_vars = lambda s, d: FX.suppliers(s, d).select("var").distinct()

query("regulon_sets", O.with_("sets") + "SELECT set_id, member FROM sets WHERE set_id IN (SELECT set_id FROM sets GROUP BY set_id HAVING count(DISTINCT member) BETWEEN 10 AND 20)")(
    lambda s, d: K.sized_sets(_members(s, d), 10, 20)[0]
)
query("dropped_sets", O.with_("sets") + "SELECT set_id, count(DISTINCT member) AS size FROM sets GROUP BY set_id HAVING count(DISTINCT member) NOT BETWEEN 10 AND 20")(
    lambda s, d: K.sized_sets(_members(s, d), 10, 20)[1]
)
query("comember_pairs", O.with_("sets", _PU) + "SELECT i, j, label FROM pu")(lambda s, d: K.comembership(_members(s, d), _groups(s, d)))
query("comember_matrix", O.with_("sets") + "SELECT DISTINCT a.member AS i, b.member AS j, 1 AS label FROM sets a JOIN sets b ON a.set_id = b.set_id AND a.member < b.member")(lambda s, d: K.shared_pairs(_members(s, d)))
_KNOWN = "kn AS (SELECT DISTINCT CAST(ps_a AS INTEGER) AS factor, CAST(ps_b AS INTEGER) AS target FROM (SELECT DISTINCT l_suppkey AS ps_a, (l_partkey * 7 + l_suppkey) % 100 + 1 AS ps_b FROM lineitem) WHERE ps_a <> ps_b)"
_known = lambda s, d: (
    FX.table(s, d, "lineitem")
    .select(F.col("l_suppkey").cast("int").alias("factor"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 100 + 1).cast("int").alias("target")).filter("factor <> target").distinct()
)
_SV = "sv AS (SELECT DISTINCT CAST(l_suppkey AS INTEGER) AS var FROM lineitem)"
query(
    "tf_universe",
    O.with_(_KNOWN, _SV)
    + """, u AS (SELECT DISTINCT least(f.factor, v.var) AS i, greatest(f.factor, v.var) AS j FROM (SELECT DISTINCT factor FROM kn) f JOIN sv v ON v.var <> f.factor)
SELECT i, j, CAST(EXISTS (SELECT 1 FROM kn WHERE least(factor, target) = i AND greatest(factor, target) = j) AS INTEGER) AS label FROM u""",
)(lambda s, d: K.factor_universe((k := _known(s, d)).select("factor").distinct(), FX.table(s, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("var")).distinct(), k))
query(
    "directed_candidates",
    O.with_(_KNOWN, _SV)
    + """, t AS (SELECT factor AS src, target AS dst FROM kn WHERE factor IN (SELECT var FROM sv) AND target IN (SELECT var FROM sv))
SELECT s.src, v.var AS dst, CAST(EXISTS (SELECT 1 FROM t WHERE t.src = s.src AND t.dst = v.var) AS INTEGER) AS label FROM (SELECT DISTINCT src FROM t) s JOIN sv v ON v.var <> s.src WHERE (SELECT count(*) FROM t) >= 10""",
)(lambda s, d: K.directed_candidates(_known(s, d), FX.table(s, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("var")).distinct()))
query(
    "regulon_table",
    """WITH i AS (SELECT n_name AS regulator, CAST(n_regionkey AS VARCHAR) AS target_id, n_name AS target_name, 'up' AS effect, substr(n_name, 1, 1) AS confidence FROM nation),
u AS (SELECT CAST(r_regionkey AS VARCHAR) AS unit_id, r_name || ';' || lower(r_name) AS genes FROM region WHERE r_regionkey < 3)
SELECT DISTINCT regulator, trim(unnest(CASE WHEN genes IS NOT NULL THEN string_split(genes, ';') ELSE [target_name] END)) AS target, effect, confidence, CASE WHEN genes IS NOT NULL THEN 'unit' ELSE 'gene' END AS via
FROM i LEFT JOIN u ON target_id = unit_id""",
)(
    lambda s, d: K.regulon_table(
        FX.table(s, d, "nation").select(
            F.col("n_name").alias("regulator"), F.col("n_regionkey").cast("string").alias("target_id"), F.col("n_name").alias("target_name"), F.lit("up").alias("effect"), F.substring("n_name", 1, 1).alias("confidence")
        ),
        FX.table(s, d, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("unit_id"), F.concat_ws(";", "r_name", F.lower("r_name")).alias("genes")),
    )
)
query(
    "group_map",
    """WITH g AS (SELECT n_name AS grp, n_name || '|' || substr(n_name, 1, 1) AS members FROM nation),
e AS (SELECT grp, unnest(string_split(members, '|')) AS member, unnest(range(0, 2)) AS k FROM g)
SELECT member, grp FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY grp, k) AS r FROM e) WHERE r = 1""",
)(lambda s, d: K.group_map(FX.table(s, d, "nation").select(F.col("n_name").alias("grp"), F.concat_ws("|", "n_name", F.substring("n_name", 1, 1)).alias("members"))))
query(
    "leveled_sets",
    "SELECT DISTINCT lower(p_brand) AS set_id, lower(p_type) AS member FROM part WHERE p_size % 3 = 0 OR p_size % 5 = 0",
)(
    lambda s, d: K.leveled_sets(
        FX.table(s, d, "part").select(
            F.col("p_brand").alias("source"),
            F.col("p_type").alias("target"),
            F.concat_ws(";", F.when(F.col("p_size") % 3 == 0, "a").otherwise("x"), F.when(F.col("p_size") % 5 == 0, "b").otherwise("y")).alias("level"),
        ),
        ["A", "B"],
    )
)
query(
    "response_sets",
    O.with_("emb", "grp", CC._GROUPED)
    + """, a AS (SELECT grp AS kd, var, avg(x) AS x FROM mg GROUP BY 1, 2), z AS (SELECT kd, var, 10 * x AS z FROM a),
t AS (SELECT *, row_number() OVER (PARTITION BY kd ORDER BY round(abs(z), 9) DESC, var) AS k FROM z WHERE abs(z) > 0.05 AND kd <> var)
SELECT kd AS set_id, var AS member FROM (SELECT *, count(*) OVER (PARTITION BY kd) AS n FROM t WHERE k <= 12) WHERE n >= 3""",
)(lambda s, d: K.responses(CC._grouped(s, d).groupBy(F.col("grp").alias("kd"), "var").agg((10 * F.avg("x")).alias("z")), 12, 3, 0.05, CC.TIES))
query(
    "evidence_network",
    """WITH l AS (SELECT DISTINCT CAST(l_suppkey AS INTEGER) AS a, CAST(l_partkey % 100 AS INTEGER) AS b, max(l_quantity) AS c1, max(l_linenumber) AS c2 FROM lineitem GROUP BY 1, 2),
o AS (SELECT a, b FROM l WHERE greatest(c1, c2 * 7) >= 45), t AS (SELECT a, b FROM o UNION SELECT b, a FROM o)
SELECT a AS factor, b AS target FROM t WHERE a IN (SELECT l_suppkey FROM lineitem) AND a <> b""",
)(
    lambda s, d: K.evidence_network(
        FX.table(s, d, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("a"), (F.col("l_partkey") % 100).cast("int").alias("b"))
        .agg(F.max("l_quantity").alias("c1"), (F.max("l_linenumber") * 7).cast("double").alias("c2")),
        _vars(s, d).withColumnRenamed("var", "factor"), ["c1", "c2"], 45,
    )
)
query(
    "resolved_names",
    """WITH g AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS symbol, lower(n_name) || '|' || substr(n_name, 1, 2) AS synonyms FROM nation),
q AS (SELECT DISTINCT unnest([n_name, lower(n_name), substr(n_name, 1, 2), CAST(n_nationkey AS VARCHAR), 'nobody']) AS name FROM nation),
sy AS (SELECT id, unnest(string_split(synonyms, '|')) AS key FROM g), one AS (SELECT key, min(id) AS id FROM sy GROUP BY key HAVING count(DISTINCT id) = 1),
onel AS (SELECT lower(key) AS key, min(id) AS id FROM sy GROUP BY 1 HAVING count(DISTINCT id) = 1),
k AS (SELECT name, id, 1 AS step FROM q JOIN g ON symbol = name UNION ALL SELECT name, id, 2 FROM q JOIN g ON id = name UNION ALL SELECT name, id, 3 FROM q JOIN one ON key = name
  UNION ALL SELECT name, id, 4 FROM q JOIN g ON lower(symbol) = lower(name) UNION ALL SELECT name, id, 5 FROM q JOIN g ON lower(id) = lower(name) UNION ALL SELECT name, id, 6 FROM q JOIN onel ON key = lower(name))
SELECT q.name, (SELECT arg_min(id, (step, id)) FROM k WHERE k.name = q.name) AS id FROM q""",
)(
    lambda s, d: K.resolved(
        (n := FX.table(s, d, "nation")).select(F.explode(F.array(F.col("n_name"), F.lower("n_name"), F.substring("n_name", 1, 2), F.col("n_nationkey").cast("string"), F.lit("nobody"))).alias("name")).distinct(),
        n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("symbol"), F.concat_ws("|", F.lower("n_name"), F.substring("n_name", 1, 2)).alias("synonyms")),
    )
)

# --- metrics

_BL = O.blocks("ev")
query("ap_ties", O.with_(*_PAIRS, _BL) + f"SELECT {rsql('sum(tp * CAST(cum AS DOUBLE) / k) / sum(tp)', 'ap')}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS n_pos, {rsql('sum(tp) / CAST(sum(n) AS DOUBLE)', 'base_rate')}, {rsql('sum(tp * CAST(cum AS DOUBLE) / k) / sum(tp) / (sum(tp) / CAST(sum(n) AS DOUBLE))', 'ratio')} FROM bl")(
    lambda s, d: r6(E.average_precision(FO.label_counts(_folds(s, d)), [], weight="n"), "ap", "base_rate", "ratio")
)
_AUC = "SELECT {keys}{auc}, CAST(sum(tp) AS BIGINT) AS n_pos, CAST(sum(n - tp) AS BIGINT) AS n_neg FROM (SELECT *, sum(n) OVER ({part}) - k + (n + 1) / 2.0 AS rank FROM bl) {group}"
_auc = rsql("CASE WHEN sum(tp) > 0 AND sum(n - tp) > 0 THEN (sum(tp * rank) - sum(tp) * (sum(tp) + 1) / 2.0) / (CAST(sum(tp) AS DOUBLE) * sum(n - tp)) END", "auroc")
query("auroc", O.with_(*_PAIRS, _BL) + _AUC.format(keys="", auc=_auc, part="", group=""))(lambda s, d: r6(E.auroc(FO.label_counts(_folds(s, d)), [], weight="n"), "auroc"))
query(
    "tp_at_precision",
    O.with_(*_PAIRS, _BL)
    + "SELECT CAST(coalesce(max(cum) FILTER (k >= 10 AND cum / CAST(k AS DOUBLE) >= 0.3), 0) AS BIGINT) AS tp_30, CAST(coalesce(max(cum) FILTER (k >= 10 AND cum / CAST(k AS DOUBLE) >= 0.2), 0) AS BIGINT) AS tp_20 FROM bl",
)(lambda s, d: E.positives_at_precision(_pairs(s, d), [], (0.3, 0.2)))
query(
    "ap_expected",
    O.with_(*_PAIRS, _BL)
    + f""", ex AS (SELECT *, unnest(range(1, CAST(n + 1 AS BIGINT))) AS t FROM bl WHERE tp > 0)
SELECT {rsql("sum(tp / CAST(n AS DOUBLE) * (cum - tp + 1 + CASE WHEN n > 1 THEN (t - 1) * (tp - 1) / CAST(n - 1 AS DOUBLE) ELSE 0 END) / (k - n + t)) / (SELECT sum(label) FROM ev)", "ap")}, (SELECT CAST(sum(label) AS BIGINT) FROM ev) AS n_pos FROM ex""",
)(lambda s, d: r6(E.expected_average_precision(FO.label_counts(_folds(s, d)), [], weight="n"), "ap"))
query(
    "ap_pessimistic",
    O.with_(*_PAIRS)
    + f""", o AS (SELECT label, row_number() OVER (ORDER BY score DESC, label) AS k, sum(label) OVER (ORDER BY score DESC, label ROWS UNBOUNDED PRECEDING) AS cum FROM ev)
SELECT {rsql('sum(cum / CAST(k AS DOUBLE)) FILTER (label = 1) / sum(label)', 'ap')} FROM o""",
)(lambda s, d: r6(E.pessimistic_average_precision(_pairs(s, d), []), "ap"))
query(
    "epr",
    O.with_(*_PAIRS, _BL)
    + f""", t AS (SELECT *, sum(tp) OVER () AS want, sum(n) OVER () AS al FROM bl)
SELECT {rsql('sum(tp * CAST(greatest(0, least(n, want - (k - n))) AS DOUBLE) / n) / max(want)', 'epr')}, {rsql('sum(tp * CAST(greatest(0, least(n, want - (k - n))) AS DOUBLE) / n) / max(want) / (max(want) / CAST(max(al) AS DOUBLE))', 'epr_ratio')} FROM t""",
)(lambda s, d: r6(E.early_precision(_pairs(s, d), []), "epr", "epr_ratio"))
_STRATA = """es AS (SELECT i, j, label, score, 'all' AS stratum FROM ev UNION ALL
  SELECT i, j, label, score, 'set' || a.set_id FROM ev JOIN sets a ON a.member = i JOIN sets b ON b.member = j WHERE label = 1 AND a.set_id = b.set_id UNION ALL
  SELECT i, j, label, score, 'set' || x.set_id FROM ev, (SELECT DISTINCT set_id FROM sets) x WHERE label = 0)"""


def _strata(s, d):
    """stratum, label, score, n: how many pairs of all, and of each set its positives and all negatives."""
    counts = kept(FO.set_counts(_folds(s, d), "int"))
    sets = _members(s, d).agg(F.collect_set("set_id").alias("sets"))
    every = counts.filter("set_id IS NULL").crossJoin(F.broadcast(sets)).withColumn("sets", F.when(F.col("label") == 0, F.col("sets")).otherwise(F.array().cast("array<int>")))
    own = every.select(F.explode(F.concat(F.array(F.lit("all")), F.transform("sets", lambda x: F.concat(F.lit("set"), x)))).alias("stratum"), "label", "score", "n")
    return own.unionByName(counts.filter("set_id IS NOT NULL").select(F.concat(F.lit("set"), "set_id").alias("stratum"), "label", "score", "n"))


_BS = O.blocks("es", "stratum")
query(
    "comember_eval",
    O.with_(*_PAIRS, _STRATA, _BS)
    + f"SELECT stratum, {rsql('sum(tp * CAST(cum AS DOUBLE) / k) / sum(tp)', 'ap')}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS n_pos, {rsql('sum(tp) / CAST(sum(n) AS DOUBLE)', 'base_rate')}, {rsql('sum(tp * CAST(cum AS DOUBLE) / k) / sum(tp) / (sum(tp) / CAST(sum(n) AS DOUBLE))', 'ratio')} FROM bl GROUP BY stratum HAVING sum(tp) >= 20",
)(lambda s, d: r6(E.average_precision(_strata(s, d), ["stratum"], weight="n").filter("n_pos >= 20"), "ap", "base_rate", "ratio"))
_COH = """bg3 AS (SELECT set_id FROM sets GROUP BY 1 HAVING count(*) >= 3),
co AS (
  SELECT a.set_id, a.member AS i, b.member AS j, 1 AS label FROM sets a JOIN sets b ON a.set_id = b.set_id AND a.member < b.member AND a.grp <> b.grp
  UNION ALL SELECT a.set_id, least(a.member, b.member), greatest(a.member, b.member), 0 FROM sets a JOIN sets b ON a.set_id <> b.set_id AND a.grp <> b.grp),
ce AS (SELECT set_id, label, round(abs(r), 2) AS score FROM co JOIN bg3 USING (set_id) JOIN r USING (i, j))"""
_coherence = lambda s, d: FO.coherence_counts(FO.rows_of(FX.suppliers(s, d)), (m := _members(s, d)), m.select(F.col("member").alias("var")), _groups(s, d))
_BC = O.blocks("ce", "set_id")
query("coherence_by_set", O.with_("sup", "sets", O.CORR, _COH, _BC) + _AUC.format(keys="set_id, ", auc=_auc, part="PARTITION BY set_id", group="GROUP BY set_id"))(lambda s, d: r6(E.auroc(_coherence(s, d), ["set_id"], weight="n"), "auroc"))
query(
    "per_set_ap",
    O.with_("sup", "sets", O.CORR, _COH, _BC)
    + f""", ex AS (SELECT *, unnest(range(1, CAST(n + 1 AS BIGINT))) AS t FROM bl WHERE tp > 0), tot AS (SELECT set_id, sum(label) AS p FROM ce GROUP BY 1)
SELECT set_id, {rsql("sum(tp / CAST(n AS DOUBLE) * (cum - tp + 1 + CASE WHEN n > 1 THEN (t - 1) * (tp - 1) / CAST(n - 1 AS DOUBLE) ELSE 0 END) / (k - n + t)) / max(p)", "ap")}, CAST(max(p) AS BIGINT) AS n_pos FROM ex JOIN tot USING (set_id) GROUP BY set_id""",
)(lambda s, d: r6(E.expected_average_precision(_coherence(s, d), ["set_id"], weight="n"), "ap"))
query("selected_pr", O.with_(*_PAIRS) + f"SELECT CAST(count(*) FILTER (score >= 0.1) AS BIGINT) AS selected, {rsql('avg(label) FILTER (score >= 0.1)', 'precision')}, {rsql('sum(label) FILTER (score >= 0.1) / CAST(sum(label) AS DOUBLE)', 'recall')} FROM ev")(
    lambda s, d: r6(E.selection(_pairs(s, d).withColumn("chosen", (F.col("score") >= 0.1).cast("int"))), "precision", "recall")
)
_ROWS = "rw AS (SELECT i AS src, label, score FROM ev UNION ALL SELECT j, label, score FROM ev)"
_rows = lambda s, d: _pairs(s, d).select(F.explode(F.array("i", "j")).alias("src"), "label", "score")
query("per_tf_auroc", O.with_(*_PAIRS, _ROWS, O.blocks("rw", "src")) + _AUC.format(keys="src, ", auc=_auc, part="PARTITION BY src", group="GROUP BY src HAVING sum(tp) >= 3"))(
    lambda s, d: r6(E.auroc(_rows(s, d), ["src"]).filter("n_pos >= 3"), "auroc")
)
_GRADE = "gr AS (SELECT src, round(v, 2) AS score, (src * 7 + dst * 13) % 11 AS grade FROM bo)"
query(
    "graded_truth",
    O.with_("sup", O.CORR, O.both("r", "abs(r)"), _GRADE)
    + f""", gk AS (SELECT src, rank() OVER (PARTITION BY src ORDER BY score) + (count(*) OVER (PARTITION BY src, score) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY src ORDER BY grade) + (count(*) OVER (PARTITION BY src, grade) - 1) / 2.0 AS rg FROM gr)
SELECT src, {rsql('corr(rs, rg)', 'rho')}, count(*) AS n FROM gk GROUP BY src""",
)(lambda s, d: r6(FO.graded(FO.rows_of(FX.suppliers(s, d)), lambda src, dst: (src * 7 + dst * 13) % 11, 11), "rho"))
_DEC = """dv AS (SELECT *, CAST(greatest(1, ceil(10 * (row_number() OVER (ORDER BY i * 1000 + j) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE))) AS INTEGER) AS decile FROM ev)"""
query(
    "strat_auroc",
    O.with_(*_PAIRS, _DEC, O.blocks("dv", "decile"))
    + f""", p AS (SELECT decile, sum(tp) AS p, sum(n - tp) AS q, (sum(tp * rank) - sum(tp) * (sum(tp) + 1) / 2.0) / (CAST(sum(tp) AS DOUBLE) * sum(n - tp)) AS a FROM (SELECT *, sum(n) OVER (PARTITION BY decile) - k + (n + 1) / 2.0 AS rank FROM bl) GROUP BY decile HAVING sum(tp) > 0 AND sum(n - tp) > 0)
SELECT {rsql('sum(a * CAST(p AS DOUBLE) * q) / sum(CAST(p AS DOUBLE) * q)', 'auroc')}, count(*) AS strata FROM p""",
)(lambda s, d: r6(E.stratified_auroc(_deciles(s, d), "key", weight="n"), "auroc"))


def _deciles(s, d):
    """key (the decile, from 0), label, score, n: deciles by equal widths of rank in the order of i * 1000 + j, ties by i and j."""
    pairs, order = kept(_folds(s, d)), lambda i, j: i * 1000 + j
    return FO.label_counts(pairs, keyed=FO.parts_of(FO.places(pairs, order, FO.decile_ends), order), keys=10)


query(
    "hub_strata",
    O.with_(*_PAIRS)
    + f"""SELECT i, j, stratum, {rsql('(rank() OVER (PARTITION BY stratum ORDER BY score) + (count(*) OVER (PARTITION BY stratum, score) - 1) / 2.0) / count(*) OVER (PARTITION BY stratum)', 'pct')} FROM
(SELECT i, j, score, CAST(len(list_filter((SELECT list_distinct(quantile_cont(CAST(i + j AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM ev), lambda q: q < i + j)) AS INTEGER) AS stratum FROM ev)""",
)(lambda s, d: FO.stratified_ranks(kept(_folds(s, d)), _sums))
query("top100_sensitivity", O.with_(*_PAIRS) + f"SELECT {rsql('sum(label) FILTER (k <= 100) / CAST(sum(label) AS DOUBLE)', 'sensitivity')} FROM (SELECT label, row_number() OVER (ORDER BY score DESC, i, j) AS k FROM ev)")(
    lambda s, d: r6(E.hits_in_top(FO.top_pairs(p := kept(_folds(s, d)), 100), [], totals=FO.label_counts(p)), "sensitivity")
)
query(
    "rowwise_criterion",
    O.with_("sup", O.CORR, "sc AS (SELECT i, j, round(abs(r), 2) AS score FROM r)", "ho AS (SELECT i, j, 1.0 / (1 + (i * 31 + j * 17) % 101) AS score FROM r)", O.both("sc", "score"), O.top_k(5, "ho"),
            "rp AS (SELECT b.src, v AS score, CAST(t.src IS NOT NULL AS INTEGER) AS label FROM bo b LEFT JOIN tk t ON t.src = b.src AND t.dst = b.dst)", O.blocks("rp", "src"))
    + f"SELECT {rsql('avg(ap)', 'criterion')}, count(*) AS rows FROM (SELECT src, sum(tp * CAST(cum AS DOUBLE) / k) / sum(tp) AS ap FROM bl GROUP BY src HAVING sum(tp) > 0)",
)(lambda s, d: r6(FO.rowwise(FO.rows_of(FX.suppliers(s, d)), lambda i, j: 1.0 / (1 + (i * 31 + j * 17) % 101), 5).agg(F.avg("ap").alias("criterion"), F.count("*").alias("rows")), "criterion"))

# --- modules and alignment: components of strong edges against regions

_ADJ = "ad AS (SELECT i AS src, j AS dst FROM r WHERE round(abs(r), 2) >= 0.3), nd AS (SELECT DISTINCT var FROM m), ub AS (SELECT src, dst FROM ad UNION ALL SELECT dst, src FROM ad)"
_REACH = "re AS (SELECT var AS v, var AS u FROM nd UNION SELECT re.v, ub.dst FROM re JOIN ub ON ub.src = re.u), cc AS (SELECT v, min(u) AS root FROM re GROUP BY v), cs AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) AS k FROM cc GROUP BY root), fo AS (SELECT 'module_' || k AS module, v AS member FROM cc JOIN cs USING (root))"
_found = lambda s, d: M.components(
    _score(s, d, 0.29).filter("score >= 0.3").transform(CC.cached).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("w")).unionByName(
        _vars(s, d).select(F.col("var").alias("src"), F.col("var").alias("dst"), F.lit(1.0).alias("w"))
    )
)
_FOUND = ("sup", "sets", O.CORR, _ADJ, _REACH)
query("components", O.with_(*_FOUND) + "SELECT module, member FROM fo")(_found)
_ref = lambda s, d: _sets(s, d).select(F.concat(F.lit("R"), "set_id").alias("module"), "member")
_quart = lambda s, d: _sets(s, d).select(F.concat(F.lit("Q"), F.col("member") % 4).alias("module"), "member")
_PSTAT = """rf AS (SELECT 'R' || set_id AS module, member FROM sets), fq AS (SELECT 'Q' || (member % 4) AS module, member FROM sets),
ps AS (SELECT a.module AS ref, b.module AS found, count(*) FILTER (c.ok) AS overlap, max(a.n) AS size_ref, max(b.n) AS size_found FROM (SELECT module, count(*) AS n FROM rf GROUP BY 1) a CROSS JOIN (SELECT module, count(*) AS n FROM fq GROUP BY 1) b
  LEFT JOIN (SELECT rf.module AS x, fq.module AS y, TRUE AS ok FROM rf JOIN fq USING (member)) c ON c.x = a.module AND c.y = b.module GROUP BY 1, 2),
pp AS (SELECT *, overlap / CAST(size_found AS DOUBLE) AS precision, overlap / CAST(size_ref AS DOUBLE) AS recall, 2.0 * overlap / (size_ref + size_found) AS f1, overlap / CAST(size_ref + size_found - overlap AS DOUBLE) AS jaccard FROM ps)"""
_stats = lambda s, d: M.pair_statistics(_ref(s, d), _quart(s, d))
_F4 = [rsql(c, c) for c in ("precision", "recall", "f1", "jaccard")]
query("set_pair_stats", O.with_("sets", _PSTAT) + f"SELECT ref, found, overlap, size_ref, size_found, {', '.join(_F4)} FROM pp")(lambda s, d: r6(_stats(s, d), "precision", "recall", "f1", "jaccard"))
_BEST = "be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY round(f1, 9) DESC, found) AS k FROM pp WHERE overlap > 0) WHERE k = 1)"
query("align_best", O.with_("sets", _PSTAT, _BEST) + f"SELECT ref, size_ref, found AS top_found, {', '.join(_F4)} FROM be")(lambda s, d: r6(M.best(_stats(s, d), CC.TIES), "precision", "recall", "f1", "jaccard"))
query(
    "align_summary",
    O.with_("sets", _PSTAT, _BEST)
    + f"SELECT count(*) AS n_ref, CAST(4 AS BIGINT) AS n_found, {rsql('avg(f1)', 'mean_f1')}, {rsql('sum(f1 * size_ref) / sum(size_ref)', 'weighted_f1')}, {rsql('quantile_cont(f1, 0.5)', 'median_f1')}, {rsql('avg(CASE WHEN f1 >= 0.5 THEN 1.0 ELSE 0.0 END)', 'recovery_rate')}, {rsql('avg(precision)', 'mean_precision')}, {rsql('avg(recall)', 'mean_recall')} FROM be",
)(lambda s, d: r6(M.summary(M.best(_stats(s, d), CC.TIES), 4), "mean_f1", "weighted_f1", "median_f1", "recovery_rate", "mean_precision", "mean_recall"))
# five references and four found modules: brute force over all injections of found modules
_HUNG = """hu AS (SELECT a.f1 AS fa, b.f1 AS fb, c.f1 AS fc, d.f1 AS fd FROM pp a JOIN pp b ON a.found = 'Q0' AND b.found = 'Q1' AND a.ref <> b.ref JOIN pp c ON c.found = 'Q2' AND c.ref NOT IN (a.ref, b.ref) JOIN pp d ON d.found = 'Q3' AND d.ref NOT IN (a.ref, b.ref, c.ref))"""
query("align_hungarian_total", O.with_("sets", _PSTAT, _HUNG) + f"SELECT {rsql('max(fa + fb + fc + fd)', 'total_f1')} FROM hu")(lambda s, d: r6(M.hungarian(_stats(s, d)).agg(F.sum("f1").alias("total_f1")), "total_f1"))
_BESTHU = """hb AS (SELECT a.ref AS ra, b.ref AS rb, c.ref AS rc, d.ref AS rd FROM pp a JOIN pp b ON a.found = 'Q0' AND b.found = 'Q1' AND a.ref <> b.ref JOIN pp c ON c.found = 'Q2' AND c.ref NOT IN (a.ref, b.ref) JOIN pp d ON d.found = 'Q3' AND d.ref NOT IN (a.ref, b.ref, c.ref) ORDER BY a.f1 + b.f1 + c.f1 + d.f1 DESC LIMIT 1),
hp AS (SELECT ra AS ref, 'Q0' AS found FROM hb UNION ALL SELECT rb, 'Q1' FROM hb UNION ALL SELECT rc, 'Q2' FROM hb UNION ALL SELECT rd, 'Q3' FROM hb),
ho AS (SELECT pp.* FROM pp JOIN hp USING (ref, found) WHERE overlap > 0)"""
_ZERO = ", ".join(rsql(f"coalesce(ho.{c}, 0.0)", c) for c in ("precision", "recall", "f1", "jaccard"))
query("align_hungarian", O.with_("sets", _PSTAT, _BESTHU) + f"SELECT r.ref, r.size_ref, ho.found AS top_found, {_ZERO} FROM (SELECT DISTINCT ref, size_ref FROM pp) r LEFT JOIN ho ON ho.ref = r.ref")(lambda s, d: r6(M.hungarian(_stats(s, d)), "precision", "recall", "f1", "jaccard"))
query("align_soft")(lambda s, d: r6(M.soft(_stats(s, d)), "f1", "precision", "recall", "jaccard", "dummy_mass", "entropy", "top_prob", digits=4))
query("complete_linkage")(lambda s, d: M.complete_linkage(D.correlation(FX.brands(s, d)), 0.8))

# --- resampling and inference

_CHIPS = "ch AS (SELECT DISTINCT CAST(n_nationkey % 7 AS INTEGER) AS grp, CAST(n_nationkey AS INTEGER) AS sample FROM nation)"
_chips = lambda s, d: FX.table(s, d, "nation").select((F.col("n_nationkey") % 7).cast("int").alias("grp"), F.col("n_nationkey").cast("int").alias("sample")).distinct()
_uni = lambda parts: f"CAST(('0x' || substr(md5(concat_ws('~', {parts})), 1, 7)) AS BIGINT) / 268435456.0"
query(
    "cluster_bootstrap_cols",
    O.with_(_CHIPS)
    + f""", gs AS (SELECT grp, list_sort(list(sample)) AS samples, row_number() OVER (ORDER BY grp) - 1 AS g, count(*) OVER () AS n FROM ch GROUP BY grp),
pk AS (SELECT draw, g + 1 AS slot, CAST(floor({_uni('CAST(draw AS VARCHAR), CAST(g + 1 AS VARCHAR)')} * n) AS BIGINT) AS pick FROM gs, (SELECT unnest(range(1, 6)) AS draw)),
oc AS (SELECT *, row_number() OVER (PARTITION BY draw, pick ORDER BY slot) - 1 AS occ FROM pk)
SELECT CAST(draw AS INTEGER) AS draw, CAST(slot AS INTEGER) AS slot, grp, samples[1 + (occ + CAST(floor({_uni('CAST(draw AS VARCHAR), CAST(grp AS VARCHAR)')} * len(samples)) AS BIGINT)) % len(samples)] AS sample FROM oc JOIN gs ON gs.g = pick""",
)(lambda s, d: S.cluster_columns(_chips(s, d), 5).select("draw", F.col("slot").cast("int"), "grp", "sample"))
query(
    "replicate_bootstrap",
    O.with_(_CHIPS) + "SELECT CAST(draw AS INTEGER) AS draw, grp, arg_min(sample, md5(concat_ws('~', CAST(draw AS VARCHAR), CAST(grp AS VARCHAR), CAST(sample AS VARCHAR)))) AS sample FROM ch, (SELECT unnest(range(1, 6)) AS draw) GROUP BY 1, 2",
)(lambda s, d: S.one_each(_chips(s, d), 5))
query(
    "balanced_split",
    O.with_(
        _CHIPS,
        "gz AS (SELECT CAST(split AS INTEGER) AS split, grp, n, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('~', CAST(split AS VARCHAR), CAST(grp AS VARCHAR)))) AS k FROM (SELECT grp, count(*) AS n FROM ch GROUP BY 1), (SELECT unnest(range(1, 5)) AS split))",
        """lh AS (SELECT split, k, grp, CAST(n AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, 1 AS half FROM gz WHERE k = 1
  UNION ALL SELECT g.split, g.k, g.grp, a + CASE WHEN a <= b THEN g.n ELSE 0 END, b + CASE WHEN a <= b THEN 0 ELSE g.n END, CASE WHEN a <= b THEN 1 ELSE 2 END FROM lh JOIN gz g ON g.split = lh.split AND g.k = lh.k + 1)""",
    ) + "SELECT split, grp, half FROM lh",
)(lambda s, d: S.balanced_split(_chips(s, d).groupBy("grp").agg(F.count("*").alias("n")), 4))
_KEPT = """kp AS (SELECT rep, var FROM (SELECT CAST(rep AS INTEGER) AS rep, var, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('~', CAST(rep AS VARCHAR), CAST(var AS VARCHAR))), var) AS k, count(*) OVER (PARTITION BY rep) AS n
  FROM (SELECT DISTINCT var FROM m), (SELECT unnest(range(1, 9)) AS rep)) WHERE k <= floor(n * 0.5))"""
_jack = lambda s, d: E.average_precision(FO.replicate_counts(_folds(s, d), S.kept_halves(_vars(s, d), 8)), ["rep"], weight="n")
_JACK = (*_PAIRS, _KEPT, "je AS (SELECT a.rep, i, j, label, score FROM ev JOIN kp a ON a.var = i JOIN kp b ON b.var = j AND b.rep = a.rep)", O.blocks("je", "rep"), "ja AS (SELECT rep, sum(tp * CAST(cum AS DOUBLE) / k) / sum(tp) AS ap FROM bl GROUP BY rep)")
query("jackknife_half", O.with_(*_JACK) + f"SELECT rep, {rsql('ap', 'ap')} FROM ja")(lambda s, d: r6(_jack(s, d).select("rep", "ap"), "ap"))
query(
    "jackknife_interval",
    O.with_(*_JACK) + f"SELECT {rsql('avg(ap)', 'mean')}, {rsql('stddev_samp(ap)', 'se')}, count(*) AS reps, {rsql('avg(ap) - 1.96 * stddev_samp(ap)', 'low')}, {rsql('avg(ap) + 1.96 * stddev_samp(ap)', 'high')} FROM ja",
)(lambda s, d: r6(S.standard_error(_jack(s, d), [], "ap"), "mean", "se", "low", "high"))
_TESTS = "te AS (SELECT CAST(c_nationkey AS INTEGER) AS id, avg(c_acctbal) / 1e5 AS d, (abs(sum(c_acctbal)) % 100) / 1000 AS p FROM (SELECT c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) % 1000 AS c_acctbal FROM customer) GROUP BY 1)"
_tests = lambda s, d: (
    FX.table(s, d, "customer").select(F.col("c_nationkey").cast("int").alias("id"), (F.round(F.col("c_acctbal") * 100).cast("long") % 1000).alias("b"))
    .groupBy("id").agg((F.avg("b") / 1e5).alias("d"), ((F.abs(F.sum("b")) % 100) / 1000.0).alias("p"))
)
query("holm_adjust", O.with_(_TESTS) + f"SELECT id, {rsql('max(least(1.0, p * (n - k + 1))) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING)', 'adjusted')} FROM (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM te)")(
    lambda s, d: r6(S.holm(_tests(s, d), []).select("id", "adjusted"), "adjusted")
)
query("bh_adjust", O.with_(_TESTS) + f"SELECT id, {rsql('min(least(1.0, p * 30 / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)', 'adjusted')} FROM (SELECT *, row_number() OVER (ORDER BY p, id) AS k FROM te)")(
    lambda s, d: r6(S.benjamini_hochberg(_tests(s, d), [], 30).select("id", "adjusted"), "adjusted")
)
# A game on real scores: how well pairs of brands rank by the mean of their correlations over some of six blocks of months.
_GAME = f"""mb AS (SELECT *, CAST(sample % 6 AS INTEGER) AS block FROM m),
bc AS (SELECT a.block, a.var AS i, b.var AS j, abs(coalesce(corr(a.x, b.x), 0)) AS r FROM mb a JOIN mb b ON a.sample = b.sample AND a.var < b.var GROUP BY 1, 2, 3),
pg AS (SELECT u, i, j, coalesce(sum(r) FILTER ((u >> block) & 1 = 1) / nullif(bit_count(u), 0), 0) AS score, CAST(i // 5 = j // 5 AS INTEGER) AS label FROM bc, (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS u) GROUP BY u, i, j),
{O.blocks("pg", "u", name="gb")},
ga AS (SELECT u AS s, sum(tp * (cum / CAST(k AS DOUBLE))) / sum(tp) AS v FROM gb GROUP BY u)"""


def _game(s, d) -> DataFrame:
    """s (bits of blocks), v: the average precision of every subset of blocks, a key column."""
    m = FX.brands(s, d).withColumn("part", (F.col("sample") % 6).cast("int"))
    r = D.correlation(m, keys=("part",)).select("part", "i", "j", F.abs("r").alias("r"))
    subsets = s.range(64).select(F.col("id").cast("int").alias("s"))
    inside = F.expr("(s & shiftleft(1, part)) <> 0")
    scored = r.crossJoin(F.broadcast(subsets)).groupBy("s", "i", "j").agg((F.sum(F.when(inside, F.col("r")).otherwise(0.0)) / F.greatest(F.bit_count("s"), F.lit(1))).alias("score"))
    label = (F.floor(F.col("i") / 5) == F.floor(F.col("j") / 5)).cast("int")
    return E.average_precision(scored.withColumn("label", label), ["s"]).select("s", F.col("ap").alias("v"))


query(
    "shapley_exact",
    O.with_("brd", _GAME, "co AS (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS component)")
    + f"SELECT component, {rsql('sum(CAST(factorial(bit_count(a.s)) AS DOUBLE) * factorial(5 - bit_count(a.s)) / 720 * (b.v - a.v))', 'shapley')}, {rsql('max(CASE WHEN b.s = 63 THEN b.v - a.v END)', 'drop_one')} FROM co JOIN ga a ON (a.s & (1 << component)) = 0 JOIN ga b ON b.s = a.s + (1 << component) GROUP BY component",
)(lambda s, d: r6(S.shapley(kept(_game(s, d)), 6), "shapley", "drop_one"))
query(
    "signed_rank",
    O.with_(_TESTS)
    + f""", dd AS (SELECT d - 0.005 AS d FROM te WHERE round(d - 0.005, 12) <> 0), rr AS (SELECT d, rank() OVER (ORDER BY round(abs(d), 12)) + (count(*) OVER (PARTITION BY round(abs(d), 12)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY round(abs(d), 12)) AS t FROM dd)
SELECT count(*) AS n, {rsql('coalesce(sum(r) FILTER (d > 0), 0)', 'w')}, {rsql('(coalesce(sum(r) FILTER (d > 0), 0) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - sum(t * t - 1) / 48.0)', 'z')}, count(*) FILTER (d > 0) AS n_up FROM rr""",
)(lambda s, d: r6(S.signed_rank(_tests(s, d).withColumn("d", F.col("d") - 0.005), []), "w", "z"))
query(
    "bootstrap_median",
    O.with_(_TESTS)
    + f""", rw AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, d, count(*) OVER () AS n FROM te),
pk AS (SELECT draw, CAST(floor({_uni('CAST(draw AS VARCHAR), CAST(k AS VARCHAR)')} * n) AS BIGINT) AS pick FROM rw, (SELECT unnest(range(1, 201)) AS draw)),
md AS (SELECT draw, quantile_cont(d, 0.5) AS m FROM pk JOIN rw ON rw.k = pick GROUP BY draw)
SELECT {rsql('(SELECT quantile_cont(d, 0.5) FROM te)', 'median', 9)}, {rsql('quantile_cont(m, 0.025)', 'low', 9)}, {rsql('quantile_cont(m, 0.975)', 'high', 9)} FROM md""",
)(lambda s, d: r6(S.bootstrap_median(_tests(s, d), 200), "median", "low", "high", digits=9))
query("bca_interval")(lambda s, d: r6(S.bca_interval(_tests(s, d)), "mean", "low", "high", "p", digits=9))

# --- perturbation

_GD = ("emb", "grp")
query(
    "influence_delete_group",
    O.with_("emb")
    + f""", {O.CORR}, g AS (SELECT CAST(vec_id AS INTEGER) AS sample, CAST(label AS INTEGER) AS grp FROM embeddings),
r2 AS (SELECT a.var AS i, b.var AS j, coalesce(corr(a.x, b.x), 0) AS q FROM m a JOIN m b ON a.sample = b.sample AND a.var < b.var WHERE a.sample NOT IN (SELECT sample FROM g WHERE grp = 3) GROUP BY 1, 2),
dl AS (SELECT i, j, abs(r) - abs(q) AS dv FROM r JOIN r2 USING (i, j)), bs AS (SELECT i AS var, dv FROM dl UNION ALL SELECT j, dv FROM dl)
SELECT var, {rsql('sqrt(sum(dv * dv) / 64)', 'influence')} FROM bs GROUP BY var""",
)(
    lambda s, d: r6(
        P.influence(
            D.correlation(m := FX.embeddings(s, d)).select("i", "j", F.abs("r").alias("r")),
            D.correlation(m.join(FX.sample_groups(s, d).filter("grp = 3"), "sample", "left_anti")).select("i", "j", F.abs("r").alias("r")), 64, "r",
        ),
        "influence",
    )
)
_SMP = "sm AS (SELECT sample, CAST(grp AS VARCHAR) AS grp, CAST(sample % 5 AS INTEGER) AS lab FROM g)"
_smp = lambda s, d: FX.sample_groups(s, d).select("sample", F.col("grp").cast("string"), (F.col("sample") % 5).alias("lab"))
query(
    "deletion_plan",
    O.with_("grp", _SMP)
    + """, wa AS (SELECT lab, count(*) AS want FROM sm WHERE grp = '3' GROUP BY 1),
pl AS (SELECT draw, sample, want, row_number() OVER (PARTITION BY draw, lab ORDER BY md5(concat_ws('~', CAST(draw AS VARCHAR), CAST(sample AS VARCHAR))), sample) AS k FROM sm JOIN wa USING (lab), (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS draw) WHERE grp <> '3')
SELECT draw, sample FROM pl WHERE k <= want""",
)(lambda s, d: P.deletion_plan(_smp(s, d), "3", 3))
query("diff_expression_z", O.with_(*_GD, CC._GROUPED) + f""", tt AS (SELECT var, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM mg GROUP BY 1), ow AS (SELECT grp, var, count(*) AS gn, sum(x) AS gs, sum(x * x) AS gss FROM mg GROUP BY 1, 2),
rs AS (SELECT grp, var, (s - gs) / (n - gn) AS mean, sqrt(greatest((ss - gss - (s - gs) * (s - gs) / (n - gn)) / (n - gn - 1), 0)) AS sd FROM ow JOIN tt USING (var))
SELECT grp, var, {rsql('avg(CASE WHEN sd > 0 THEN abs(x - mean) / sd ELSE 0 END)', 'dz')} FROM mg JOIN rs USING (grp, var) GROUP BY 1, 2""")(lambda s, d: r6(P.differential(FX.embeddings(s, d), FX.sample_groups(s, d)), "dz"))
query("rank_normal_sum", O.with_(*_PAIRS) + f""", rr AS (SELECT i, j, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 - 0.375) / (count(*) OVER () + 0.25) AS p1, (rank() OVER (ORDER BY (i * 3 + j) % 50) + (count(*) OVER (PARTITION BY (i * 3 + j) % 50) - 1) / 2.0 - 0.375) / (count(*) OVER () + 0.25) AS p2 FROM ev)
SELECT i, j, {rsql('((' + CC.inverse_normal_sql('p1') + ') + (' + CC.inverse_normal_sql('p2') + ')) / sqrt(2.0)', 'combined')} FROM rr""")(
    lambda s, d: FO.normal_sums(kept(_folds(s, d)), lambda i, j: (i * 3 + j) % 50, 50)
)
_GRAM = "zc AS (SELECT var, sample, x, x - avg(x) OVER (PARTITION BY var) AS z FROM m), zg AS MATERIALIZED (SELECT a.var AS i, b.var AS j, sum(a.z * b.z) AS v FROM zc a JOIN zc b USING (sample) GROUP BY 1, 2)"
query(
    "pc_removed",
    O.with_("brd", _GRAM, O.principal("zg", 2), "zf AS (SELECT pc, sample, sum(u * z) AS s FROM zc JOIN pc USING (var) GROUP BY 1, 2)")
    + f"SELECT c.var, c.sample, {rsql('c.x - f.f', 'x')} FROM zc c JOIN (SELECT p.var, f.sample, sum(p.u * f.s) AS f FROM pc p JOIN zf f USING (pc) GROUP BY 1, 2) f ON f.var = c.var AND f.sample = c.sample",
)(lambda s, d: r6(P.without_components(FX.brands(s, d), 2), "x"))
query("pc_loadings", O.with_("brd", _GRAM, O.principal("zg", 3)) + f"SELECT CAST(pc AS INTEGER) AS pc, var, {rsql('abs(u)', 'loading')}, {rsql('value / (SELECT sum(v) FROM zg WHERE i = j)', 'share')} FROM pc")(lambda s, d: r6(P.loadings(FX.brands(s, d), 3).withColumn("loading", F.abs("loading")), "loading", "share"))
query("parallel_components")(lambda s, d: r6(P.parallel_components(FX.brands(s, d)), "share", "null_share"))
query("driven_variables")(lambda s, d: r6(P.driven(FX.brands(s, d), 2), "r2", "statistic", "dip", "p"))
query("driven_variables_bic")(lambda s, d: r6(P.driven(FX.suppliers(s, d), rule="bic"), "r2", "statistic", "dip", "p"))
query("combat")(lambda s, d: r6(P.combat(FX.embeddings(s, d), FX.sample_groups(s, d)), "x"))
query("lasso_residuals")(lambda s, d: r6(P.lasso_residuals(FX.brands(s, d)), "residual", digits=4))
query("forest_importance")(lambda s, d: r6(P.forest_importance(FX.brands(s, d), 10), "importance"))
query("boosted_importance")(lambda s, d: r6(P.boosted_importance(FX.brands(s, d), 30).drop("stages"), "importance"))
query("boosted_variants")(lambda s, d: r6(P.boosted_variants(FX.brands(s, d), 30, 8), "share_top"))
_PIDC = """rg AS (SELECT var, min(x) AS lo, max(x) AS hi FROM m GROUP BY 1),
db AS (SELECT var, sample, CAST(least(floor((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 5 + 1e-9), 4) AS INTEGER) AS b FROM m JOIN rg USING (var)),
dp AS (SELECT var, b, count(*) / CAST((SELECT count(DISTINCT sample) FROM m) AS DOUBLE) AS p FROM db GROUP BY 1, 2),
dj AS (SELECT k.var AS k, k.b AS a, g.var AS g, g.b AS b, count(*) / CAST((SELECT count(DISTINCT sample) FROM m) AS DOUBLE) AS p FROM db k JOIN db g USING (sample) GROUP BY 1, 2, 3, 4),
sp AS (SELECT k, g, a, sum(dj.p * log2(dj.p / (pk.p * pg.p))) AS s FROM dj JOIN dp pk ON pk.var = k AND pk.b = a JOIN dp pg ON pg.var = g AND pg.b = dj.b GROUP BY 1, 2, 3),
im AS (SELECT k, g, sum(s) AS mi FROM sp GROUP BY 1, 2),
rd AS (SELECT x.k, x.g AS x, y.g AS y, sum(least(x.s, y.s)) AS r FROM sp x JOIN sp y ON y.k = x.k AND y.a = x.a WHERE x.g <> y.g AND x.g <> x.k AND y.g <> x.k GROUP BY 1, 2, 3),
un AS (SELECT rd.k, x, sum(CASE WHEN mi > 0 THEN (mi - r) / mi ELSE 0 END) AS u FROM rd JOIN im ON im.k = rd.k AND im.g = x GROUP BY 1, 2),
pu2 AS (SELECT least(k, x) AS i, greatest(k, x) AS j, sum(u) AS u FROM un GROUP BY 1, 2),
cd AS (SELECT src, dst, cume_dist() OVER (PARTITION BY src ORDER BY u) AS c FROM (SELECT i AS src, j AS dst, u FROM pu2 UNION ALL SELECT j, i, u FROM pu2))"""
query("pidc", O.with_("brd", _PIDC) + f"SELECT least(src, dst) AS i, greatest(src, dst) AS j, {rsql('sum(c)', 'score')} FROM cd GROUP BY 1, 2")(lambda s, d: r6(P.pidc(FX.brands(s, d), "uniform", digits=CC.TIES), "score"))
query("pidc_blocks")(lambda s, d: r6(P.pidc(FX.suppliers(s, d), digits=CC.TIES), "score"))
query("bayesian_blocks")(lambda s, d: I.bayesian_blocks(FX.suppliers(s, d)))

# --- summaries over depths and draws (months as depths or draws, suppliers as cases)

_CUR = "cu AS (SELECT var AS k, sample AS t, x AS value FROM m)"
_cur = lambda s, d: FX.suppliers(s, d).select(F.col("var").alias("k"), F.col("sample").alias("t"), F.col("x").alias("value"))
query("best_depth", O.with_("sup", _CUR) + f"SELECT k, CAST(arg_max(t, (value, -t)) AS INTEGER) AS t, max(value) AS value, max(value) - max(value) FILTER (t = 0) AS gain FROM cu GROUP BY k")(lambda s, d: R.best_depth(_cur(s, d), ["k"], digits=CC.TIES))
query("flat_depths", O.with_("sup", _CUR) + "SELECT k, min(t) AS low, max(t) AS high FROM (SELECT *, max(value) OVER (PARTITION BY k) AS top FROM cu) WHERE round(value, 9) >= round(0.9 * top, 9) GROUP BY k")(lambda s, d: R.flat_depths(_cur(s, d), ["k"], share=0.9, digits=CC.TIES))
_SPL = "sp AS (SELECT k % 4 AS split, k % 2 AS direction, k // 4 AS fam, t, value FROM cu)"
query(
    "best_t_per_split",
    O.with_("sup", _CUR, _SPL)
    + f""", b AS (SELECT fam, split, direction, arg_max(t, (value, -t)) AS t FROM sp GROUP BY 1, 2, 3), g AS (SELECT fam, split, exp(avg(ln(CAST(greatest(t, 1) AS DOUBLE)))) AS g FROM b GROUP BY 1, 2)
SELECT CAST(fam AS BIGINT) AS fam, {rsql('quantile_cont(g, 0.5)', 't')} FROM g GROUP BY fam""",
)(lambda s, d: r6(R.held_out_depth(_cur(s, d).select((F.col("k") % 4).alias("split"), (F.col("k") % 2).alias("direction"), F.floor(F.col("k") / 4).alias("fam"), "t", "value"), ["fam"]), "t"))
query("snapped_parameters", O.with_("sup", _CUR) + "SELECT k, t, CAST(arg_min(g, (abs(ln(value + 1) - ln(g)), g)) AS DOUBLE) AS g FROM cu, (SELECT unnest([1.0, 10.0, 100.0, 1000.0]) AS g) GROUP BY k, t")(
    lambda s, d: _cur(s, d).select("k", "t", R.snapped(F.col("value") + 1, [1, 10, 100, 1000]).alias("g"))
)
_DRW = "dr AS (SELECT sample AS draw, 'm' || (var % 4) AS method, sum(x) AS value FROM m GROUP BY 1, 2)"
_drw = lambda s, d: FX.suppliers(s, d).groupBy(F.col("sample").alias("draw"), F.concat(F.lit("m"), F.col("var") % 4).alias("method")).agg(F.sum("x").alias("value"))
query(
    "draw_summary",
    O.with_("sup", _DRW) + f"SELECT a.method, {rsql('avg(a.value - b.value)', 'mean')}, {rsql('quantile_cont(a.value - b.value, 0.025)', 'low')}, {rsql('quantile_cont(a.value - b.value, 0.975)', 'high')}, {rsql('avg(CASE WHEN a.value > b.value THEN 1.0 ELSE 0.0 END)', 'share_up')} FROM dr a JOIN dr b ON a.draw = b.draw AND b.method = 'm0' WHERE a.method <> 'm0' GROUP BY 1",
)(lambda s, d: r6(R.draw_summary(_drw(s, d), [], "method", "m0"), "mean", "low", "high", "share_up"))
_case = lambda s, d: _drw(s, d).select(F.col("draw").alias("case_id"), (F.col("draw") % 5).alias("dataset"), "method", (F.col("value") + 1).alias("ratio"))
query(
    "method_summary",
    O.with_("sup", _DRW) + f"SELECT a.method, {rsql('quantile_cont(a.value + 1, 0.5)', 'median')}, {rsql('quantile_cont(a.value + 1, 0.5) / quantile_cont(b.value + 1, 0.5)', 'relative')}, {rsql('avg(CASE WHEN a.value > b.value THEN 1.0 ELSE 0.0 END)', 'beats')} FROM dr a JOIN dr b ON a.draw = b.draw AND b.method = 'm0' GROUP BY 1",
)(lambda s, d: r6(R.method_summary(_case(s, d), "method", "m0"), "median", "relative", "beats"))
query(
    "blocked_log_ratio",
    O.with_("sup", _DRW) + f"SELECT method, {rsql('avg(l)', 'log2_ratio')}, count(*) AS datasets FROM (SELECT a.method, a.draw % 5 AS dataset, avg(log2((a.value + 1) / (b.value + 1))) AS l FROM dr a JOIN dr b ON a.draw = b.draw AND b.method = 'm0' WHERE a.draw IN (SELECT draw FROM dr GROUP BY draw HAVING count(*) = 4) GROUP BY 1, 2) GROUP BY 1",
)(lambda s, d: r6(R.blocked_log_ratio(_case(s, d), "method", "m0"), "log2_ratio"))
query(
    "case_interval",
    O.with_("sup") + f", p AS (SELECT sample, quantile_cont(x, 0.5) AS md FROM m GROUP BY 1) SELECT {rsql('quantile_cont(md, 0.5)', 'median')}, {rsql('quantile_cont(md, 0.025)', 'low')}, {rsql('quantile_cont(md, 0.975)', 'high')} FROM p",
)(lambda s, d: r6(R.case_interval(FX.suppliers(s, d).select(F.col("sample").alias("draw"), F.col("x").alias("value")), []), "median", "low", "high"))
_MAC = "ms AS (SELECT var AS set_id, (var % 9) / 10.0 + 0.1 AS ap, 0.1 AS base_rate, count(*) FILTER (x > 0) AS size FROM m GROUP BY 1)"
query(
    "macro_levels",
    O.with_("sup", _MAC) + f"SELECT set_id, size, {rsql('(ap - base_rate) / (1 - base_rate)', 'normalised')}, {rsql('ap / base_rate', 'fold')}, CASE WHEN size < 10 THEN '5-9' WHEN size < 25 THEN '10-24' WHEN size < 100 THEN '25-99' ELSE '>=100' END AS size_bin FROM ms",
)(
    lambda s, d: r6(
        R.macro_levels(
            FX.suppliers(s, d).groupBy(F.col("var").alias("set_id")).agg(F.sum((F.col("x") > 0).cast("long")).alias("size")).withColumn("ap", (F.col("set_id") % 9) / 10.0 + 0.1).withColumn("base_rate", F.lit(0.1))
        ).select("set_id", "size", "normalised", "fold", "size_bin"), "normalised", "fold",
    )
)
query("weighted_means", O.with_("sup", _MAC) + f"SELECT g AS gamma, {rsql('sum(pow(size, g) * ap) / sum(pow(size, g))', 'mean')} FROM ms, (SELECT CAST(unnest([0.0, 0.5, 1.0]) AS DOUBLE) AS g) GROUP BY g")(
    lambda s, d: r6(R.weighted_means(FX.suppliers(s, d).groupBy(F.col("var").alias("set_id")).agg(F.sum((F.col("x") > 0).cast("long")).alias("n_pos")).withColumn("d", (F.col("set_id") % 9) / 10.0 + 0.1), []), "mean")
)
_SE = "se AS (SELECT draw % 6 AS fam, method, avg(value) AS value, stddev_samp(value) / sqrt(count(*)) AS se FROM dr GROUP BY 1, 2)"
query(
    "tied_with_best",
    O.with_("sup", _DRW, _SE)
    + f", tp AS (SELECT *, first_value(method) OVER w AS tm, first_value(value) OVER w AS tv, first_value(se) OVER w AS ts FROM se WINDOW w AS (PARTITION BY fam ORDER BY round(value, 9) DESC, method DESC)) SELECT fam, method, {rsql('value', 'value')}, {rsql('se', 'se')}, tm = method AS best, tv - value <= 0.3 * sqrt(ts * ts + se * se) AS tied FROM tp",
)(
    lambda s, d: r6(
        R.tied_with_best(_drw(s, d).groupBy((F.col("draw") % 6).alias("fam"), "method").agg(F.avg("value").alias("value"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se")), ["fam"], "method", 0.3, digits=CC.TIES), "value", "se"
    )
)
query(
    "verdicts",
    O.with_(_TESTS) + "SELECT id % 5 AS fam, count(*) FILTER (p < 0.05 AND d - 0.005 > 0) AS wins, count(*) FILTER (p < 0.05 AND d - 0.005 < 0) AS losses, CASE WHEN count(*) FILTER (p < 0.05 AND d - 0.005 > 0) > 0 AND count(*) FILTER (p < 0.05 AND d - 0.005 < 0) = 0 THEN 'better' WHEN count(*) FILTER (p < 0.05 AND d - 0.005 < 0) > 0 THEN 'worse' ELSE 'open' END AS verdict FROM te GROUP BY 1",
)(lambda s, d: R.verdicts(_tests(s, d).select((F.col("id") % 5).alias("fam"), (F.col("d") - 0.005).alias("d"), F.col("p").alias("adjusted")), ["fam"]))
query("degree_top", O.with_(_KNOWN) + "SELECT var, count(*) AS degree FROM (SELECT factor AS var FROM kn UNION ALL SELECT target FROM kn) GROUP BY var ORDER BY degree DESC, var LIMIT 10")(
    lambda s, d: R.degree_top(_known(s, d).select(F.col("factor").alias("a"), F.col("target").alias("b")), 10)
)
query("parsed_labels", "SELECT n_nationkey, 'tk' || CAST(n_regionkey AS VARCHAR) AS op, CAST(n_nationkey AS VARCHAR) AS t FROM nation")(
    lambda s, d: FX.table(s, d, "nation").select("n_nationkey", R.parsed_label(F.concat(F.lit("op=tk"), "n_regionkey", F.lit(";t="), "n_nationkey")).alias("p")).select("n_nationkey", F.col("p.op").alias("op"), F.col("p.t").alias("t"))
)
query(
    "hub_baseline",
    O.with_(*_PAIRS, "pi AS (SELECT var, sum(x) / (SELECT sum(x) FROM m) AS pi FROM m GROUP BY var)")
    + f"SELECT i, j, {rsql('a.pi + b.pi', 'hub_sum')}, {rsql('a.pi * b.pi', 'hub_product', 9)} FROM ev JOIN pi a ON a.var = i JOIN pi b ON b.var = j",
)(
    lambda s, d: FO.hub_scores(
        _folds(s, d).select("var", "grp").join((m := FX.suppliers(s, d)).groupBy("var").agg(F.sum("x").alias("s")).crossJoin(F.broadcast(m.agg(F.sum("x").alias("all")))).select("var", (F.col("s") / F.col("all")).alias("pi")), "var")
    )
)
query(
    "score_permutation",
    O.with_(*_PAIRS) + "SELECT a.i, a.j, b.score FROM (SELECT i, j, row_number() OVER (ORDER BY i, j) AS k FROM ev) a JOIN (SELECT score, row_number() OVER (ORDER BY md5(concat_ws('~', '1', CAST(i AS VARCHAR), CAST(j AS VARCHAR)))) AS k FROM ev) b USING (k)",
)(lambda s, d: R.shuffled_correlations(FX.suppliers(s, d), K.member_sets(_members(s, d), _groups(s, d)).select(F.col("v").alias("var"), "grp"), 1, 2))

# --- further truths, resampling and perturbation

query(
    "complex_sets",
    """WITH c AS (SELECT CAST(n_regionkey AS VARCHAR) AS name, n_name || '_' || substr(n_name, 1, 2) AS components FROM nation),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY components) AS k FROM c)
SELECT DISTINCT CASE WHEN k > 1 THEN name || '.' || k ELSE name END AS set_id, unnest(string_split(components, '_')) AS member FROM k""",
)(lambda s, d: K.complexes(FX.table(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("name"), F.concat_ws("_", "n_name", F.substring("n_name", 1, 2)).alias("components"))))
query(
    "perturbation_groups",
    """WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS sample, ['r' || (n_nationkey % 3), 'r' || (n_nationkey % 4)] AS g FROM nation),
o AS (SELECT sample, list_sort(list_distinct(g)) AS own FROM p), e AS (SELECT sample, array_to_string(own, '+') AS grp, unnest(own) AS regulator FROM o),
t AS (SELECT 'r' || (s_suppkey % 3) AS regulator, count(DISTINCT s_name) AS n FROM supplier GROUP BY 1 HAVING count(DISTINCT s_name) >= 3)
SELECT grp, regulator, sample, n FROM e JOIN t USING (regulator)""",
)(
    lambda s, d: K.perturbation_groups(
        FX.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("sample"), F.concat(F.lit("R"), F.col("n_nationkey") % 3, F.lit(" and r"), F.col("n_nationkey") % 4).alias("genes")),
        FX.table(s, d, "supplier").select(F.concat(F.lit("r"), F.col("s_suppkey") % 3).alias("regulator"), F.col("s_name").alias("target")), 3,
    )
)
query("binding_grades", f"SELECT p_brand AS factor, p_partkey % 5 AS target, {rsql('avg(CAST(p_size AS DOUBLE))', 'grade')} FROM part WHERE regexp_matches(p_type, '[A-M]$') GROUP BY 1, 2")(
    lambda s, d: r6(K.binding(FX.table(s, d, "part").select(F.col("p_brand").alias("factor"), (F.col("p_partkey") % 5).alias("target"), F.col("p_type").alias("experiment"), F.col("p_size").cast("double").alias("value")), "[A-M]$"), "grade")
)


def _named_edges(s, d):
    from netloom.sources.readers import edge_list

    n = FX.table(s, d, "nation")
    edges = n.select(F.col("n_name").alias("a"), "n_nationkey", "n_regionkey")
    other = n.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("r2"), F.col("n_nationkey").alias("k2"))
    own = edges.join(other, (F.col("n_regionkey") == F.col("r2")) & (F.col("n_nationkey") < F.col("k2"))).select("a", "b", (F.col("n_nationkey") + F.col("k2")).alias("weight"))
    return edge_list(own, n.filter("n_nationkey < 20").select(F.col("n_nationkey").cast("int").alias("var"), F.col("n_name").alias("name")), True)


query(
    "edge_list_matrix",
    """WITH e AS (SELECT CAST(a.n_nationkey AS INTEGER) AS x, CAST(b.n_nationkey AS INTEGER) AS y, CAST(a.n_nationkey + b.n_nationkey AS DOUBLE) AS w
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE b.n_nationkey < 20)
SELECT x AS src, y AS dst, w FROM e UNION ALL SELECT y, x, w FROM e""",
)(_named_edges)
query(
    "jackknife_delete_d",
    O.with_(*_JACK) + f"SELECT count(*) AS reps, {rsql('avg(ap)', 'mean')}, {rsql('stddev_samp(ap) * sqrt(80 / 20.0)', 'se')}, {rsql('avg(ap) - 1.96 * stddev_samp(ap) * sqrt(80 / 20.0)', 'low')}, {rsql('avg(ap) + 1.96 * stddev_samp(ap) * sqrt(80 / 20.0)', 'high')} FROM ja",
)(lambda s, d: r6(S.delete_d(_jack(s, d).withColumn("m", F.lit("ap")), ["m"], "ap", 100, 20, 8).drop("m"), "mean", "se", "low", "high"))
_ERF = "t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-a * a)"
query("two_sided_p", O.with_(_TESTS) + f", z AS (SELECT id, abs(d * 300) / sqrt(2.0) AS a, 1 / (1 + 0.3275911 * abs(d * 300) / sqrt(2.0)) AS t FROM te) SELECT id, {rsql(_ERF, 'p')} FROM z")(
    lambda s, d: r6(_tests(s, d).select("id", S.two_sided_p(F.col("d") * 300).alias("p")), "p")
)
query("unstable_flags", O.with_("sup") + "SELECT var, count(*) FILTER (x > 0) < 60 AS unstable FROM m GROUP BY var")(
    lambda s, d: S.unstable(FX.suppliers(s, d).withColumn("v", F.when(F.col("x") > 0, F.col("x"))), ["var"], "v", 60)
)
query(
    "subset_counts",
    O.with_("grp", _SMP)
    + f""", wa AS (SELECT lab, count(*) AS want FROM sm WHERE grp = '3' GROUP BY 1), po AS (SELECT lab, count(*) AS n FROM sm WHERE grp <> '3' GROUP BY 1)
SELECT lab, want, n, {rsql("CASE WHEN want > n THEN 0.0 ELSE list_reduce(list_transform(range(1, want + 1), lambda i: ln(CAST(n - want + i AS DOUBLE) / i)), lambda a, b: a + b) END", "log_ways", 4)} FROM wa LEFT JOIN po USING (lab)""",
)(lambda s, d: r6(P.subsets(_smp(s, d), "3").withColumn("n", F.nullif("n", F.lit(0))).select("lab", "want", "n", F.when(F.col("want") > F.col("n"), 0.0).otherwise(F.col("log_ways")).alias("log_ways")), "log_ways", digits=4))
query(
    "null_z",
    O.with_("sup") + f"SELECT var, {rsql('CASE WHEN stddev_samp(x) > 0 THEN (max(x) - avg(x)) / stddev_samp(x) ELSE 0 END', 'z')} FROM m GROUP BY var",
)(lambda s, d: r6(P.null_z((m := FX.suppliers(s, d)).groupBy("var").agg(F.max("x").alias("x")), m, "x"), "z"))
query(
    "multi_head_attention",
    O.with_(*CC._SC, O.top_k(20), O.softmax(3.0, "tk", "s3"), O.softmax(8.0, "tk", "s8"), O.walk("s3", 2, name="wa"), O.walk("s8", 2, name="wb"), O.attention("wa2", "aa"), O.attention("wb2", "ab"))
    + f"SELECT i, j, {rsql('sum(s) / 2', 's')} FROM (SELECT * FROM aa UNION ALL SELECT * FROM ab) GROUP BY 1, 2",
)(
    lambda s, d: r6(
        CC.X.walked(CC.G.heads(CC._scores(s, d), (3, 8), 20, digits=CC.TIES), 2, keys=("head",)).filter("src <> dst")
        .groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg((F.sum("p") / 4).alias("s")),
        "s",
    )
)


def _hc_gate(s, d):
    from netloom.operators import null

    values, hi = CC._values(s, d)
    found = null.hc_gate(values, hi, CC._B, hair=CC.HAIR)
    return s.createDataFrame([(k + 1, round(v, 6) + 0.0) for k, v in enumerate(found)], "rank int, hc double")


_GATE = f"""nb2 AS (SELECT rep, {CC._bin('v')} AS bin, count(*) AS n FROM nv GROUP BY ALL),
gr AS (SELECT r.rep, b.bin, coalesce(own.n, 0) AS own, b.n - coalesce(own.n, 0) AS rest FROM (SELECT DISTINCT rep FROM nb2) r CROSS JOIN (SELECT bin, sum(n) AS n FROM nb2 GROUP BY bin) b LEFT JOIN nb2 own ON own.rep = r.rep AND own.bin = b.bin),
gc AS (SELECT rep, sum(own) OVER (PARTITION BY rep ORDER BY bin DESC) AS i, sum(own) OVER (PARTITION BY rep) AS m, (1.0 + sum(rest) OVER (PARTITION BY rep ORDER BY bin DESC)) / (1.0 + sum(rest) OVER (PARTITION BY rep)) AS p FROM gr),
gh AS (SELECT rep, max(sqrt(CAST(m AS DOUBLE)) * (CAST(i AS DOUBLE) / m - p) / sqrt(p * (1 - p))) AS hc FROM gc WHERE i >= 1 AND i <= greatest(0.1 * m, 10) AND p < 1 GROUP BY rep)"""
query("hc_gate", O.with_("brd", O.STATS, O.HG, *CC._null(), CC._HI, _GATE) + f"SELECT CAST(row_number() OVER (ORDER BY hc) AS INTEGER) AS rank, {rsql('hc', 'hc')} FROM gh")(_hc_gate)
query("half_split", "SELECT n_nationkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY md5(concat_ws('~', '1', CAST(n_nationkey AS VARCHAR))), n_nationkey) AS k, count(*) OVER () AS n FROM nation) WHERE k <= floor(n * 0.5)")(
    lambda s, d: S.kept_halves(FX.table(s, d, "nation").select(F.col("n_nationkey").alias("var")), 1).select(F.col("var").alias("n_nationkey"))
)
