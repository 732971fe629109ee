"""The jobs as queries: each runs twice into one new folder and returns what stands there, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import supplier_network, term_network
from netloom.functions.numeric import rounded
from netloom.plans import oracles as O
from netloom.sources.store import fresh_path


def job1_term_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "job1")
    # as a pattern, so that a single file is as good as a folder of files
    documents = f"{sf_dir}/documents.parque[t]"
    for _ in range(2):
        out = term_network.run(spark, documents, f"{folder}/output", f"{folder}/checkpoint", term_network.config())
    return out.withColumns({c: rounded(out[c], 6) for c in ("strength", "score")})


def job2_supplier_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "job2")
    paths = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation")]
    for _ in range(2):
        out = supplier_network.run(spark, *paths, f"{folder}/output", supplier_network.config())
    return out.withColumns({c: rounded(out[c], 6) for c in ("score", "ap", "base_rate", "auroc")})


QUERIES = {"job1_term_network": job1_term_network, "job2_supplier_network": job2_supplier_network}

SQL = {
    "job1_term_network": r"""
WITH RECURSIVE d AS (
  SELECT coalesce(lang, '') AS grp, coalesce(source, '') AS sample,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT grp, sample, unnest(list_distinct(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))) AS var FROM d),
cells AS (SELECT grp, sample, var, CAST(count(*) AS DOUBLE) AS x FROM t WHERE (grp, var) IN (SELECT (grp, var) FROM t GROUP BY grp, var HAVING count(*) >= 30) GROUP BY ALL),
mg AS (
  SELECT v.grp, v.var, s.sample, coalesce(c.x, 0.0) AS x FROM (SELECT DISTINCT grp, var FROM cells) v JOIN (SELECT DISTINCT grp, sample FROM cells) s USING (grp)
  LEFT JOIN cells c ON c.grp = v.grp AND c.var = v.var AND c.sample = s.sample),
tt AS (SELECT grp, sample, sum(x) AS total FROM mg GROUP BY 1, 2), md AS (SELECT grp, quantile_cont(total, 0.5) AS middle FROM tt GROUP BY grp),
y0 AS (SELECT grp, var, sample, ln(1 + CASE WHEN total > 0 THEN x / total * middle ELSE 0 END) AS y FROM mg JOIN tt USING (grp, sample) JOIN md USING (grp)),
y AS (SELECT grp, var, sample, y - avg(y) OVER (PARTITION BY grp, var) AS x FROM y0),
best AS (SELECT grp, var FROM (SELECT grp, var, row_number() OVER (PARTITION BY grp ORDER BY round(var_samp(x), 9) DESC, var) AS k FROM y GROUP BY grp, var) WHERE k <= 200),
m AS MATERIALIZED (SELECT y.* FROM y JOIN best USING (grp, var)),
p AS MATERIALIZED (
  SELECT a.grp, a.var AS i, b.var AS j, abs(coalesce(sum(a.x * b.x) / nullif(sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)), 0), 0)) AS r
  FROM m a JOIN m b ON a.grp = b.grp AND a.sample = b.sample AND a.var < b.var GROUP BY 1, 2, 3),
b AS (SELECT grp, i AS src, r AS v FROM p UNION ALL SELECT grp, j, r FROM p),
bg AS (SELECT grp, src, sum(v) / (count(*) + 1) AS mu, sqrt(greatest(sum(v * v) - (count(*) + 1) * pow(sum(v) / (count(*) + 1), 2), 0) / count(*)) AS sd FROM b GROUP BY 1, 2),
z AS (
  SELECT p.grp, i, j, r, greatest(CASE WHEN x.sd > 0 THEN (r - x.mu) / x.sd ELSE 0 END, 0) AS zi, greatest(CASE WHEN w.sd > 0 THEN (r - w.mu) / w.sd ELSE 0 END, 0) AS zj
  FROM p JOIN bg x ON x.grp = p.grp AND x.src = i JOIN bg w ON w.grp = p.grp AND w.src = j),
sc AS MATERIALIZED (SELECT grp, i, j, r, (zi + zj) / sqrt(2.0) AS score FROM z),
two AS (SELECT grp, i AS src, j AS dst, r, score FROM sc UNION ALL SELECT grp, j, i, r, score FROM sc),
e AS MATERIALIZED (SELECT grp, src, dst, r, score FROM (SELECT *, row_number() OVER (PARTITION BY grp, src ORDER BY round(score, 9) DESC, dst) AS k FROM two WHERE score > 0) WHERE k <= 5),
near AS (SELECT grp, src, dst FROM e UNION SELECT grp, dst, src FROM e),
reach AS (SELECT grp, var AS v, var AS root FROM best UNION SELECT reach.grp, near.dst, reach.root FROM reach JOIN near ON near.grp = reach.grp AND near.src = reach.v),
module AS (SELECT grp, v, min(root) AS module FROM reach GROUP BY 1, 2)
SELECT best.grp AS lang, best.var AS term_a, e.dst AS term_b, round(e.r, 6) + 0.0 AS strength, round(e.score, 6) + 0.0 AS score, module.module
FROM best LEFT JOIN e ON e.grp = best.grp AND e.src = best.var JOIN module ON module.grp = best.grp AND module.v = best.var
""",
    "job2_supplier_network": "WITH "
    + """members AS (SELECT CAST(s_suppkey AS INTEGER) AS var, CAST(s_nationkey AS INTEGER) AS nation, CAST(n_regionkey AS INTEGER) AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cells AS (SELECT region, var, year(l_shipdate) * 12 + month(l_shipdate) AS sample, sum(l_quantity) AS x FROM lineitem JOIN members ON l_suppkey = var GROUP BY 1, 2, 3),
m0 AS (
  SELECT v.region, v.var, s.sample, coalesce(c.x, 0.0) AS x FROM (SELECT DISTINCT region, var FROM cells) v JOIN (SELECT DISTINCT region, sample FROM cells) s USING (region)
  LEFT JOIN cells c ON c.region = v.region AND c.var = v.var AND c.sample = s.sample),
m AS MATERIALIZED (SELECT * FROM m0 WHERE var IN (SELECT var FROM m0 GROUP BY var HAVING max(x) > min(x))),
"""
    + ",\n".join((O.STATS, O.HG, O.W3)).replace("w AS (\n", "w AS MATERIALIZED (\n")
    + """,
rw AS (SELECT region, var, sample, bin, w FROM w JOIN members USING (var)), nn AS (SELECT region, count(DISTINCT sample) AS n FROM m GROUP BY 1),
h AS (SELECT region, var, sum(-p * log2(p)) AS h FROM (SELECT region, var, bin, sum(w) / any_value(n) AS p FROM rw JOIN nn USING (region) GROUP BY 1, 2, 3) WHERE p > 0 GROUP BY 1, 2),
hxy AS (
  SELECT region, i, j, sum(-p * log2(p)) AS hxy FROM (
    SELECT a.region, a.var AS i, b.var AS j, a.bin AS bi, b.bin AS bj, sum(a.w * b.w) / any_value(n) AS p
    FROM rw a JOIN rw b ON a.region = b.region AND a.sample = b.sample AND a.var < b.var JOIN nn ON nn.region = a.region GROUP BY 1, 2, 3, 4, 5) WHERE p > 0 GROUP BY 1, 2, 3),
mi AS MATERIALIZED (SELECT hxy.region, i, j, x.h + y.h - hxy AS mi FROM hxy JOIN h x ON x.var = i JOIN h y ON y.var = j),
b AS (SELECT region, i AS src, mi AS v FROM mi UNION ALL SELECT region, j, mi FROM mi),
bg AS (SELECT region, src, sum(v) / (count(*) + 1) AS mu, sqrt(greatest(sum(v * v) - (count(*) + 1) * pow(sum(v) / (count(*) + 1), 2), 0) / count(*)) AS sd FROM b GROUP BY 1, 2),
z AS (
  SELECT mi.region, i, j, greatest(CASE WHEN x.sd > 0 THEN (mi - x.mu) / x.sd ELSE 0 END, 0) AS zi, greatest(CASE WHEN y.sd > 0 THEN (mi - y.mu) / y.sd ELSE 0 END, 0) AS zj
  FROM mi JOIN bg x ON x.src = i JOIN bg y ON y.src = j),
sc AS MATERIALIZED (
  SELECT z.region, i, j, (zi + zj) / sqrt(2.0) AS score, a.nation = c.nation AS same_nation FROM z JOIN members a ON a.var = i JOIN members c ON c.var = j),
two AS (SELECT region, i AS src, j AS dst, score, same_nation FROM sc UNION ALL SELECT region, j, i, score, same_nation FROM sc),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region, src ORDER BY round(score, 9) DESC, dst) AS k FROM two WHERE score > 0) WHERE k <= 10),
bl0 AS (SELECT region, round(score, 9) AS s, count(*) AS n, sum(CAST(same_nation AS INTEGER)) AS tp FROM sc GROUP BY 1, 2),
bl AS (SELECT *, sum(n) OVER (PARTITION BY region ORDER BY s DESC) AS k, sum(tp) OVER (PARTITION BY region ORDER BY s DESC) AS cum, sum(n) OVER (PARTITION BY region) AS alln FROM bl0),
ev AS (
  SELECT region, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(tp) AS BIGINT) AS positives, CASE WHEN sum(tp) > 0 THEN sum(tp * (cum / CAST(k AS DOUBLE))) / sum(tp) END AS ap,
         sum(tp) / CAST(sum(n) AS DOUBLE) AS base_rate,
         CASE WHEN sum(tp) > 0 AND sum(n - tp) > 0 THEN (sum(tp * (alln - k + (n + 1) / 2.0)) - sum(tp) * (sum(tp) + 1) / 2.0) / (CAST(sum(tp) AS DOUBLE) * sum(n - tp)) END AS auroc
  FROM bl GROUP BY region)
SELECT e.region, src, dst, round(score, 6) + 0.0 AS score, same_nation, pairs, positives, round(ap, 6) + 0.0 AS ap, round(base_rate, 6) + 0.0 AS base_rate, round(auroc, 6) + 0.0 AS auroc
FROM e JOIN ev USING (region)
""",
}
