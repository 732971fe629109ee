"""Common table expressions for DuckDB that state what the operators compute, independently of them."""

from __future__ import annotations

from netloom.sources.fixtures import SQL as FIX

N_SAMPLES = "(SELECT count(DISTINCT sample) FROM m)"
N_VARS = "(SELECT count(DISTINCT var) FROM m)"

STATS = "st AS (SELECT var, count(*) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_samp(x) AS sd FROM m GROUP BY var)"
HG = "nb AS (SELECT var, CAST(greatest(5, round_even(sqrt((1 + sqrt(1 + 24 * CAST(count(*) AS DOUBLE))) / 2), 0)) AS INTEGER) AS nb FROM m GROUP BY var)"
RANKS = "rk AS (SELECT var, sample, x, rank() OVER (PARTITION BY var ORDER BY x) + (count(*) OVER (PARTITION BY var, x) - 1) / 2.0 AS r FROM m)"

W3 = """wq AS (
  SELECT m.var, m.sample, (x - lo) * (nb - 2) / (hi - lo) AS z, nb, least(floor((x - lo) * (nb - 2) / (hi - lo)), nb - 3) AS q FROM m JOIN st USING (var) JOIN nb USING (var)),
w3 AS (SELECT var, sample, q, pow(q + 1 - z, 2) / (q + 1 - greatest(q - 1, 0)) AS a, pow(z - q, 2) / (least(q + 2, nb - 2) - q) AS c FROM wq),
w AS (
  SELECT var, sample, CAST(q AS INTEGER) AS bin, a AS w FROM w3
  UNION ALL SELECT var, sample, CAST(q + 1 AS INTEGER), 1 - a - c FROM w3
  UNION ALL SELECT var, sample, CAST(q + 2 AS INTEGER), c FROM w3)"""

W2 = """wq AS (
  SELECT m.var, m.sample, (x - lo) * (nb - 1) / (hi - lo) AS z, least(floor((x - lo) * (nb - 1) / (hi - lo)), nb - 2) AS q FROM m JOIN st USING (var) JOIN nb USING (var)),
w AS (
  SELECT var, sample, CAST(q AS INTEGER) AS bin, q + 1 - z AS w FROM wq
  UNION ALL SELECT var, sample, CAST(q + 1 AS INTEGER), z - q FROM wq)"""

H = f"h AS (SELECT var, sum(-p * log2(p)) AS h FROM (SELECT var, bin, sum(w) / {N_SAMPLES} AS p FROM w GROUP BY 1, 2) WHERE p > 0 GROUP BY var)"
MI = f"""hxy AS (
  SELECT i, j, sum(-p * log2(p)) AS hxy FROM (
    SELECT a.var AS i, b.var AS j, a.bin AS bi, b.bin AS bj, sum(a.w * b.w) / {N_SAMPLES} AS p
    FROM w a JOIN w b ON a.sample = b.sample AND a.var < b.var GROUP BY 1, 2, 3, 4) WHERE p > 0 GROUP BY 1, 2),
mi AS (SELECT i, j, x.h + y.h - hxy AS mi FROM hxy JOIN h x ON x.var = i JOIN h y ON y.var = j)"""
SELF = f"""smi AS (
  SELECT var, 2 * h - hxx AS self_mi FROM (
    SELECT var, sum(-p * log2(p)) AS hxx FROM (
      SELECT a.var, a.bin AS bi, b.bin AS bj, sum(a.w * b.w) / {N_SAMPLES} AS p FROM w a JOIN w b ON a.sample = b.sample AND a.var = b.var GROUP BY 1, 2, 3)
    WHERE p > 0 GROUP BY var) JOIN h USING (var))"""
CORR = "r AS (SELECT a.var AS i, b.var AS j, coalesce(corr(a.x, b.x), 0) AS r FROM m a JOIN m b ON a.sample = b.sample AND a.var < b.var GROUP BY 1, 2)"


def both(edges: str, value: str, name: str = "bo") -> str:
    return f"{name} AS (SELECT i AS src, j AS dst, {value} AS v FROM {edges} UNION ALL SELECT j, i, {value} FROM {edges})"


def score(edges: str = "mi", value: str = "mi", combine: str = "stouffer", name: str = "sc") -> str:
    """A table (i, j, score) of calibrated values."""
    c = "(zi + zj) / sqrt(2.0)" if combine == "stouffer" else "sqrt(zi * zi + zj * zj)"
    return f"""{both(edges, value, f"{name}_b")},
{name}_bg AS (SELECT src, sum(v) / (count(*) + 1) AS mu, sqrt(greatest(sum(v * v) - (count(*) + 1) * pow(sum(v) / (count(*) + 1), 2), 0) / count(*)) AS sd FROM {name}_b GROUP BY src),
{name}_z AS (
  SELECT e.i, e.j, greatest(CASE WHEN a.sd > 0 THEN ({value} - a.mu) / a.sd ELSE 0 END, 0) AS zi, greatest(CASE WHEN b.sd > 0 THEN ({value} - b.mu) / b.sd ELSE 0 END, 0) AS zj
  FROM {edges} e JOIN {name}_bg a ON a.src = e.i JOIN {name}_bg b ON b.src = e.j),
{name} AS (SELECT i, j, {c} AS score FROM {name}_z)"""


def top_k(k: int, scores: str = "sc", name: str = "tk") -> str:
    return f"""{both(scores, "score", f"{name}_b")},
{name} AS (SELECT src, dst, v AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(v, 9) DESC, dst) AS k FROM {name}_b WHERE v > 0) WHERE k <= {k})"""


def normal(name: str, out: str, loops: bool = True) -> str:
    lone = f" UNION ALL SELECT var, var, 1.0 FROM (SELECT DISTINCT var FROM m) WHERE var NOT IN (SELECT src FROM {name} WHERE w > 0)" if loops else ""
    return f"{out} AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM {name} WHERE w > 0{lone})"


def softmax(keff: float, top: str, out: str = "sm") -> str:
    """60 bisection steps on the log temperature as a recursive table."""
    return f"""{out}_s AS (SELECT src, dst, w, w - max(w) OVER (PARTITION BY src) AS d, count(*) OVER (PARTITION BY src) AS n FROM {top}),
{out}_r AS (
  SELECT DISTINCT src, 0 AS k, ln(1e-4) AS lo, ln(1e4) AS hi FROM {out}_s WHERE n > {keff}
  UNION ALL
  SELECT src, k + 1, CASE WHEN wide THEN lo ELSE (lo + hi) / 2 END, CASE WHEN wide THEN (lo + hi) / 2 ELSE hi END FROM (
    SELECT r.src, r.k, r.lo, r.hi,
           exp(ln(sum(exp(s.d / exp((r.lo + r.hi) / 2)))) - sum(exp(s.d / exp((r.lo + r.hi) / 2)) * s.d / exp((r.lo + r.hi) / 2)) / sum(exp(s.d / exp((r.lo + r.hi) / 2)))) > {keff} AS wide
    FROM {out}_r r JOIN {out}_s s ON s.src = r.src WHERE r.k < 60 GROUP BY r.src, r.k, r.lo, r.hi)),
{out}_t AS (SELECT src, exp((lo + hi) / 2) AS t FROM {out}_r WHERE k = 60),
{out} AS (
  SELECT s.src, s.dst, CASE WHEN s.n <= {keff} THEN 1.0 / s.n ELSE exp(s.d / t.t) / sum(exp(s.d / t.t)) OVER (PARTITION BY s.src) END AS w
  FROM {out}_s s LEFT JOIN {out}_t t ON t.src = s.src)"""


def walk(op: str, steps: int, alpha: float = 0.5, name: str = "wk", columns: str | None = None) -> str:
    where = f" WHERE var IN (SELECT var FROM {columns})" if columns else ""
    out = [f"{name}0 AS (SELECT var AS src, var AS dst, 1.0 AS p FROM (SELECT DISTINCT var FROM m){where})"]
    for t in range(1, steps + 1):
        out.append(
            f"{name}{t} AS (SELECT src, dst, sum(p) AS p FROM (SELECT src, dst, {1 - alpha} * p AS p FROM {name}{t - 1} UNION ALL "
            f"SELECT a.src, k.dst, {alpha} * a.w * k.p FROM {op} a JOIN {name}{t - 1} k ON k.src = a.dst) GROUP BY 1, 2)"
        )
    return ",\n".join(out)


def attention(walk_name: str, out: str = "att") -> str:
    return f"{out} AS (SELECT least(src, dst) AS i, greatest(src, dst) AS j, sum(p) / 2 AS s FROM {walk_name} WHERE src <> dst GROUP BY 1, 2)"


def diffusion(op: str, steps: int, alpha: float = 0.5, name: str = "df") -> str:
    """df0 (var, sample, e) must exist."""
    return ",\n".join(
        f"{name}{t} AS (SELECT e.var, e.sample, {1 - alpha} * e.e + {alpha} * coalesce(x.s, 0) AS e FROM {name}{t - 1} e LEFT JOIN "
        f"(SELECT a.src AS var, d.sample, sum(a.w * d.e) AS s FROM {op} a JOIN {name}{t - 1} d ON d.var = a.dst GROUP BY 1, 2) x ON x.var = e.var AND x.sample = e.sample)"
        for t in range(1, steps + 1)
    )


def blocks(pairs: str, keys: str = "", score: str = "score", name: str = "bl") -> str:
    part, sel = (f"PARTITION BY {keys} ", f"{keys}, ") if keys else ("", "")
    return f"""{name}_0 AS (SELECT {sel}round({score}, 9) AS s, count(*) AS n, sum(label) AS tp FROM {pairs} GROUP BY ALL),
{name} AS (SELECT *, sum(n) OVER ({part}ORDER BY s DESC) AS k, sum(tp) OVER ({part}ORDER BY s DESC) AS cum FROM {name}_0)"""


#: Cumulative kernel densities of each row's values (its own included) on 1,000 points; f of each pair's ends.
KDE = """kv AS (SELECT i AS src, j AS dst, mi AS v FROM mi UNION ALL SELECT j, i, mi FROM mi UNION ALL SELECT var, var, self_mi FROM smi),
kw AS (SELECT src, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM kv GROUP BY src),
kh AS (SELECT src, lo, hi, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) ELSE sd END * pow(n, -0.2) AS h FROM kw),
kg AS (SELECT src, k, CASE WHEN k = 999 THEN hi ELSE lo + k * ((hi - lo) / 999) END AS a, h FROM kh, (SELECT unnest(range(0, 1000)) AS k)),
kd AS (SELECT g.src, k, a, sum(exp(-0.5 * pow((a - v) / h, 2))) AS d FROM kg g JOIN kv USING (src) GROUP BY 1, 2, 3),
kc AS (SELECT src, k, a, sum(d) OVER (PARTITION BY src ORDER BY k) / sum(d) OVER (PARTITION BY src) AS f FROM kd),
kf AS (SELECT v.src, v.dst, min(f) AS f FROM kv v JOIN kc c ON c.src = v.src AND c.a >= v.v GROUP BY 1, 2),
ks AS (SELECT a.src AS i, a.dst AS j, ln(a.f) + ln(b.f) AS s FROM kf a JOIN kf b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst)"""


def inverse(matrix: str, names: list[int], out: str) -> str:
    """The inverse of a table (i, j, v) with these indices, by sweeping one after another."""
    steps = [f"{out}_0 AS MATERIALIZED (SELECT i, j, v FROM {matrix})"]
    for n, k in enumerate(names):
        last = f"{out}_{n}"
        steps.append(
            f"{out}_{n + 1} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {k} AND a.j = {k} THEN 1 / p.v WHEN a.i = {k} THEN a.v / p.v WHEN a.j = {k} THEN -a.v / p.v ELSE a.v - r.v * c.v / p.v END AS v "
            f"FROM {last} a JOIN {last} p ON p.i = {k} AND p.j = {k} JOIN {last} r ON r.i = a.i AND r.j = {k} JOIN {last} c ON c.i = {k} AND c.j = a.j)"
        )
    return ",\n".join([*steps, f"{out} AS (SELECT i, j, v FROM {out}_{len(names)})"])


def principal(matrix: str, k: int, squarings: int = 14, out: str = "pc") -> str:
    """out (pc, var, u, value): the k first eigenvectors and -values of a symmetric table (i, j, v), each by squaring
    what the ones before leave of it."""
    steps, left = [], matrix
    for c in range(1, k + 1):
        steps.append(f"{out}{c}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {left} WHERE i = j) AS v FROM {left})")
        for n in range(squarings):
            square = f"(SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {out}{c}_{n} a JOIN {out}{c}_{n} b ON b.i = a.j GROUP BY 1, 2)"
            steps.append(f"{out}{c}_{n + 1} AS MATERIALIZED (SELECT i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM {square})")
        best = f"(SELECT i FROM {out}{c}_{squarings} WHERE i = j ORDER BY v DESC LIMIT 1)"
        steps.append(f"{out}{c}_u AS MATERIALIZED (SELECT i AS var, v / sqrt(sum(v * v) OVER ()) AS u FROM {out}{c}_{squarings} WHERE j = {best})")
        steps.append(f"{out}{c}_l AS MATERIALIZED (SELECT sum(a.u * m.v * b.u) AS l FROM {left} m JOIN {out}{c}_u a ON a.var = m.i JOIN {out}{c}_u b ON b.var = m.j)")
        steps.append(f"{out}{c}_r AS MATERIALIZED (SELECT m.i, m.j, m.v - (SELECT l FROM {out}{c}_l) * a.u * b.u AS v FROM {left} m JOIN {out}{c}_u a ON a.var = m.i JOIN {out}{c}_u b ON b.var = m.j)")
        left = f"{out}{c}_r"
    every = " UNION ALL ".join(f"SELECT {c} AS pc, var, u, (SELECT l FROM {out}{c}_l) AS value FROM {out}{c}_u" for c in range(1, k + 1))
    return ",\n".join([*steps, f"{out} AS MATERIALIZED ({every})"])


def stationary(op: str, squarings: int = 16, teleport: float = 1e-3, out: str = "pi") -> str:
    """The walk with teleport, squared again and again: a row of it is the stationary distribution."""
    steps = [
        f"{out}_n AS (SELECT DISTINCT var FROM m)",
        f"{out}_0 AS MATERIALIZED (SELECT a.var AS src, b.var AS dst, {1 - teleport} * coalesce(o.w, 0) + {teleport} / (SELECT count(*) FROM {out}_n) AS p FROM {out}_n a CROSS JOIN {out}_n b LEFT JOIN {op} o ON o.src = a.var AND o.dst = b.var)",
    ]
    for k in range(squarings):
        steps.append(f"{out}_{k + 1} AS MATERIALIZED (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM {out}_{k} a JOIN {out}_{k} b ON b.src = a.dst GROUP BY 1, 2)")
    return ",\n".join([*steps, f"{out} AS (SELECT dst AS var, p / sum(p) OVER () AS pi FROM {out}_{squarings} WHERE src = (SELECT min(var) FROM {out}_n))"])


def with_(*parts: str) -> str:
    """WITH clause of the parts; names of fixtures stand for their tables."""
    return "WITH RECURSIVE " + ",\n".join(FIX.get(p, p) for p in parts)
