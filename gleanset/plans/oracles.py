"""DuckDB SQL for the query catalogue, by query name."""

from __future__ import annotations

TAU = 0.1


def hash32(key: str, salt: str) -> str:
    return f"('0x' || left(md5({key} || '|{salt}'), 8))::BIGINT"


def order(key: str, salt: str) -> str:
    return f"md5({key}::VARCHAR || '|{salt}')"


def doubles(x: str) -> str:
    return f"{x}::DOUBLE[]"


def sqd(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


E = "e AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS f, label FROM embeddings)"
P = "p AS (SELECT row_id, label, generate_subscripts(f, 1) AS i, unnest(f) AS v FROM e)"


def centroids(source: str, name: str = "mu", by: str = "") -> str:
    """Class means of long rows (row_id, label, i, v [, by])."""
    b = f"{by}, " if by else ""
    return f"{name} AS (SELECT {b}label AS c, list(m ORDER BY i) AS m FROM (SELECT {b}label, i, avg(v) AS m FROM {source} GROUP BY ALL) GROUP BY {b}label)"


def softmax_long(rows: str, mu: str, name: str = "pr", tau: float = TAU, on: str = "TRUE", extra: str = "") -> str:
    """(row_id, label, c, p) probabilities of every class."""
    return f"""lg_{name} AS (SELECT r.row_id, r.label, {extra} m.c, -{sqd('r.f', 'm.m')} / {tau} AS z FROM {rows} r JOIN {mu} m ON {on}),
{name} AS (SELECT row_id, label, {extra} c, exp(z - mx) / sum(exp(z - mx)) OVER (PARTITION BY {extra} row_id) AS p
  FROM (SELECT *, max(z) OVER (PARTITION BY {extra} row_id) AS mx FROM lg_{name}))"""


BASE = f"WITH {E}, {P}, {centroids('p')}, {softmax_long('e', 'mu')}"
LOSS = f"{BASE}, lo AS (SELECT row_id, label, -ln(greatest(p, 1e-12)) AS loss FROM pr WHERE c = label)"
#: p - q by class
RES = f"{BASE}, g AS (SELECT row_id, label, c, p - (c = label)::INT AS g FROM pr), gl AS (SELECT row_id, label, list(g ORDER BY c) AS f FROM g GROUP BY ALL)"
FOLD3 = hash32("row_id::VARCHAR", "snap") + " % 3"
SNAP = f"""WITH {E}, {P}, ks AS (SELECT unnest(range(3)) AS k),
pk AS (SELECT k, row_id, label, i, v FROM p, ks WHERE {FOLD3} <> k), {centroids('pk', 'muk', 'k')},
{softmax_long('e', 'muk', 'pk3', TAU, 'TRUE', 'k,')},
ls AS (SELECT row_id, label, avg(-ln(greatest(p, 1e-12))) AS mean_loss,
  sqrt(greatest(sum(ln(greatest(p, 1e-12)) * ln(greatest(p, 1e-12))) / 3 - (sum(-ln(greatest(p, 1e-12))) / 3) * (sum(-ln(greatest(p, 1e-12))) / 3), 0)) AS std_loss
  FROM pk3 WHERE c = label GROUP BY ALL)"""
DIRTY = f"""{SNAP}, th AS (SELECT quantile_cont(mean_loss, 0.6) AS m, quantile_cont(std_loss, 0.6) AS s, greatest(quantile_cont(mean_loss, 0.2), 1e-8) AS typical FROM ls),
di AS (SELECT ls.* FROM ls, th WHERE mean_loss >= m AND std_loss <= s)"""
CLASS_LOSS = "cl AS (SELECT row_id, label, c, avg(-ln(greatest(p, 1e-12))) AS l FROM pk3 GROUP BY ALL)"
CAND = f"""{DIRTY}, {CLASS_LOSS}, dc AS (SELECT cl.* FROM cl JOIN di USING (row_id)),
cu AS (SELECT row_id, greatest(l, 1e-8) AS cur FROM dc WHERE c = label),
ca AS (SELECT dc.* FROM dc JOIN cu USING (row_id), th WHERE c <> label AND l <= 6.0 * typical AND l <= (1 - 0.2) * cur)"""


def kd_map(reps: int, leaf: int) -> str:
    """Levels of median splits over ``reps`` representatives; rows follow the cuts."""
    out = f"WITH {E}, r0 AS (SELECT row_id, f, 1 AS node FROM e QUALIFY row_number() OVER (ORDER BY {order('row_id', 'kd')}, row_id) <= {reps}), q0 AS (SELECT row_id, f, 1 AS node FROM e)"
    level, size = 0, reps
    while size > leaf:
        k, level, size = level, level + 1, size - size // 2
        out += f""", v{k} AS (SELECT node, i, var_pop(v) AS var, count(*) AS n FROM (SELECT node, generate_subscripts(f, 1) AS i, unnest(f) AS v FROM r{k}) GROUP BY ALL),
s{k} AS (SELECT node, arg_max(i, {{'v': var, 'i': -i}}) AS dim, max(n) AS n FROM v{k} GROUP BY node HAVING max(n) > {leaf} AND max(var) > 1e-12),
o{k} AS (SELECT r.*, dim, n, row_number() OVER (PARTITION BY r.node ORDER BY f[dim], row_id) AS p FROM r{k} r LEFT JOIN s{k} s ON r.node = s.node),
c{k} AS (SELECT node, dim, max(f[dim]) FILTER (WHERE p = n // 2 + 1) AS cut FROM o{k} WHERE dim IS NOT NULL GROUP BY ALL),
r{level} AS (SELECT row_id, f, CASE WHEN dim IS NULL THEN node ELSE 2 * node + (p > n // 2)::INT END AS node FROM o{k}),
q{level} AS (SELECT row_id, f, CASE WHEN dim IS NULL THEN q.node ELSE 2 * q.node + (f[dim] > cut)::INT END AS node FROM q{k} q LEFT JOIN c{k} c ON q.node = c.node)"""
    d = sqd("q.f", "r.f")
    return out + f" SELECT q.row_id, arg_min(r.row_id, {{'d': {d}, 'c': r.row_id}}) AS rep_id, round(min({d}), 6) AS d2 FROM q{level} q JOIN r{level} r ON q.node = r.node GROUP BY q.row_id"


def boosted(rounds: int, depth: int, bins: int, rate: float, ridge: float = 1.0, least: float = 1.0) -> str:
    """Newton boosting of two classes over bins of equal width, level by level."""
    out = f"""WITH {E}, {P}, st AS (SELECT i, min(v) AS lo, max(v) AS hi FROM p GROUP BY i),
b AS (SELECT row_id, i, len(list_filter(range(1, {bins}), lambda j: v > lo + (hi - lo) * j / {bins}.0::DOUBLE)) AS bin FROM p JOIN st USING (i)),
f0 AS (SELECT row_id, (label >= 5)::INT AS y, 0.0::DOUBLE AS m FROM e)"""
    for t in range(rounds):
        out += f", g{t} AS (SELECT row_id, 1 / (1 + exp(-m)) - y AS g, 1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) AS h FROM f{t}), n{t}_0 AS (SELECT row_id, 1 AS node FROM f{t})"
        for k in range(depth):
            x = f"{t}_{k}"
            gain = f"lg * lg / (lh + {ridge}) + (tg - lg) * (tg - lg) / (th - lh + {ridge}) - tg * tg / (th + {ridge})"
            out += f""", h{x} AS (SELECT node, i, bin, sum(g) AS g, sum(h) AS h FROM n{x} JOIN g{t} USING (row_id) JOIN b USING (row_id) WHERE node >= {2**k} GROUP BY ALL),
c{x} AS (SELECT node, i, bin, sum(g) OVER o AS lg, sum(h) OVER o AS lh, sum(g) OVER (PARTITION BY node, i) AS tg, sum(h) OVER (PARTITION BY node, i) AS th FROM h{x} WINDOW o AS (PARTITION BY node, i ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s{x} AS (SELECT node, arg_max({{'i': i, 'bin': bin}}, {{'gain': round({gain}, 6), 'i': -i, 'bin': -bin}}) AS cut FROM c{x} WHERE lh >= {least} AND th - lh >= {least} AND {gain} > 1e-9 GROUP BY node),
n{t}_{k + 1} AS (SELECT n.row_id, CASE WHEN cut IS NULL THEN n.node ELSE 2 * n.node + (b.bin > cut.bin)::INT END AS node FROM n{x} n LEFT JOIN s{x} s ON n.node = s.node LEFT JOIN b ON b.row_id = n.row_id AND b.i = cut.i)"""
        out += f""", v{t} AS (SELECT node, -sum(g) / (sum(h) + {ridge}) AS v FROM n{t}_{depth} JOIN g{t} USING (row_id) GROUP BY node),
f{t + 1} AS (SELECT row_id, y, m + {rate} * v AS m FROM f{t} JOIN n{t}_{depth} USING (row_id) JOIN v{t} USING (node))"""
    names = ("first", "second", "third")[:rounds]
    return out + f" SELECT row_id, {', '.join(f'n{t}_{depth}.node AS {a}' for t, a in enumerate(names))} FROM n0_{depth} {' '.join(f'JOIN n{t}_{depth} USING (row_id)' for t in range(1, rounds))}"


def curve_clusters(windows: int, k: int, noisy: int, need: int, rounds: int) -> str:
    """Lloyd's rounds over smoothed curves by class and window of epochs; missing epochs of a window count 0."""
    out = f"""WITH {MA}, ne AS (SELECT max(epoch) + 1 AS n FROM cv), ed AS (SELECT w, w * n // {windows} AS a, (w + 1) * n // {windows} AS b FROM ne, (SELECT unnest(range({windows})) AS w)),
rw AS (SELECT DISTINCT row_id, label, w, a, b FROM ma JOIN ed ON epoch >= a AND epoch < b),
d AS (SELECT rw.row_id, rw.label, w, x.epoch, coalesce(ma, 0.0) AS v FROM (SELECT *, unnest(range(a, b)) AS epoch FROM rw) x JOIN rw USING (row_id, label, w) LEFT JOIN ma ON ma.row_id = x.row_id AND ma.epoch = x.epoch),
c0 AS (SELECT label, w, j, epoch, v AS c FROM (SELECT row_id, label, w, row_number() OVER (PARTITION BY label, w ORDER BY {order('row_id', 'kmeans0')}, row_id) AS j FROM rw) JOIN d USING (row_id, label, w) WHERE j <= {k})"""
    for r in range(rounds + 1):
        out += f""", a{r} AS (SELECT row_id, label, w, arg_min(j, {{'d': round(far, 9), 'j': j}}) AS j FROM (SELECT row_id, d.label, d.w, j, sum((v - c) * (v - c)) AS far FROM d JOIN c{r} c ON d.label = c.label AND d.w = c.w AND d.epoch = c.epoch GROUP BY ALL) GROUP BY ALL)"""
        if r < rounds:
            out += f""", c{r + 1} AS (SELECT c.label, c.w, c.j, c.epoch, coalesce(m, c) AS c FROM c{r} c LEFT JOIN (SELECT label, w, j, epoch, avg(v) AS m FROM d JOIN a{r} USING (row_id, label, w) GROUP BY ALL) s ON s.label = c.label AND s.w = c.w AND s.j = c.j AND s.epoch = c.epoch)"""
    return out + f""", ar AS (SELECT row_id, label, w, j, sum(v) AS area FROM d JOIN a{rounds} USING (row_id, label, w) GROUP BY ALL), me AS (SELECT label, w, j, round(avg(area), 9) AS area, count(*) AS n FROM ar GROUP BY ALL),
bad AS (SELECT label, w, j, row_number() OVER (PARTITION BY label, w ORDER BY area DESC, j) <= {noisy} AND sum(n) OVER (PARTITION BY label, w) > 1 AS bad FROM me),
v AS (SELECT row_id, label, sum((NOT bad)::INT) AS clean_votes FROM ar JOIN bad USING (label, w, j) GROUP BY ALL) SELECT row_id, label, clean_votes, clean_votes < {need} AS noisy FROM v"""


def stratified(salt: int) -> str:
    n, r = "count(*) OVER (PARTITION BY label)", f"row_number() OVER (PARTITION BY label ORDER BY {order('vec_id', str(salt))}, vec_id)"
    return f"SELECT vec_id AS row_id, label, CASE WHEN {r} <= CASE WHEN {n} > 1 THEN greatest(1, least({n} - 1, floor({n} * 0.8))) ELSE {n} END THEN 'train' ELSE 'test' END AS split FROM embeddings"


FOLDED = f"fo AS (SELECT vec_id AS row_id, (row_number() OVER (PARTITION BY label ORDER BY {order('vec_id', '42')}, vec_id) - 1) % 5 AS fold FROM embeddings)"
OOF = f"""WITH {E}, {P}, {FOLDED}, ef AS (SELECT e.*, fold FROM e JOIN fo USING (row_id)), ks AS (SELECT unnest(range(5)) AS k),
pk AS (SELECT k, p.row_id, label, i, v FROM p JOIN fo USING (row_id), ks WHERE fold <> k), {centroids('pk', 'muk', 'k')},
{softmax_long('ef', 'muk', 'pr', TAU, 'm.k = r.fold')}"""
CONF = f"""{OOF}, th AS (SELECT label AS c, avg(p) AS t FROM pr WHERE c = label GROUP BY label),
co AS (SELECT row_id, arg_max(pr.c, {{'p': p, 'c': -pr.c}}) AS confident FROM pr JOIN th ON pr.c = th.c WHERE p >= t GROUP BY row_id)"""
REPS = f"reps AS (SELECT row_id, f FROM e QUALIFY row_number() OVER (ORDER BY {order('row_id', 'reps')}, row_id) <= 40)"
NEAR = f"WITH {E}, {REPS}, nn AS (SELECT e.row_id, arg_min(r.row_id, {{'d': {sqd('e.f', 'r.f')}, 'c': r.row_id}}) AS rep_id, min({sqd('e.f', 'r.f')}) AS d2 FROM e, reps r GROUP BY e.row_id)"
CURVES = """cv AS (SELECT user_id AS row_id, user_id % 3 AS label, epoch, value AS loss FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch FROM events))"""
MA = f"""{CURVES}, tr AS (SELECT *, avg(loss) OVER (PARTITION BY row_id ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS t, least(5, count(*) OVER (PARTITION BY row_id)) AS w FROM cv),
ma AS (SELECT row_id, label, epoch, CASE WHEN epoch < w - 1 THEN max(CASE WHEN epoch = w - 1 THEN t END) OVER (PARTITION BY row_id) ELSE t END AS ma FROM tr)"""
ALLOC_10 = "SELECT label, count(*) AS n FROM embeddings GROUP BY label"


def allocation(total: str) -> str:
    """Budgets without surplus: shares rounded down, the rest one by one to large classes first."""
    return f"""al AS (SELECT label, n, base + CASE WHEN row_number() OVER (ORDER BY n DESC, label) <= {total} - sum(base) OVER () THEN 1 ELSE 0 END AS k
  FROM (SELECT label, count(*) AS n, least(count(*), greatest(1, floor({total} * (count(*) / sum(count(*)) OVER ()))))::BIGINT AS base FROM embeddings GROUP BY label))"""


N10 = "(SELECT round_even(0.1 * count(*)::DOUBLE, 0)::BIGINT FROM embeddings)"
N6 = "(SELECT round_even(0.06 * count(*)::DOUBLE, 0)::BIGINT FROM embeddings)"


def noisy(kind: str) -> str:
    """The noisy embeddings: error types by rank, columns and values by hash."""
    h = lambda s: f"('0x' || left(md5({s}), 8))::BIGINT"
    if kind == "random":
        label = f"(label + 1 + {h(chr(39).join(['row_id::VARCHAR || ', '|1051|y', '']))} % 9) % 10"
        value = f"lo + (hi - lo) * ({h(chr(39).join(['p.row_id::VARCHAR || ', '|', ' || (p.i - 1)::VARCHAR || ', '|1051|x', '']))} / 4294967296.0::DOUBLE)"
    else:
        label = "(label + 1) % 10"
        value = f"v + ({h(chr(39).join(['(p.i - 1)::VARCHAR || ', '|2045|d', '']))} % 2 * 2 - 1) * sd"
    return f"""WITH {E}, {P}, st AS (SELECT i, min(v) AS lo, max(v) AS hi, stddev_pop(v) AS sd FROM p GROUP BY i),
cn AS (SELECT round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT AS n FROM e), c2 AS (SELECT n, round_even(n * 2 / 5::DOUBLE, 0)::BIGINT AS a FROM cn),
ty AS (SELECT row_id, label, f, CASE WHEN r <= a THEN 1 WHEN r <= 2 * a THEN 2 WHEN r <= n THEN 3 ELSE 0 END AS error_type
  FROM (SELECT *, row_number() OVER (ORDER BY {order('row_id', '42')}, row_id) AS r FROM e), c2),
ch AS (SELECT p.row_id, p.i, row_number() OVER (PARTITION BY p.row_id ORDER BY md5(p.row_id::VARCHAR || '|' || (p.i - 1)::VARCHAR || '|42|c'), p.i) AS o,
  {h("p.row_id::VARCHAR || '|42|m'")} % 19 + 1 AS m FROM p JOIN ty USING (row_id) WHERE error_type IN (2, 3)),
nv AS (SELECT p.row_id, p.i, p.v, lo, hi, (ch.i IS NOT NULL) AS hit, greatest(lo, least(hi, {value})) AS cut FROM p JOIN st USING (i) LEFT JOIN (SELECT * FROM ch WHERE o <= m) ch ON ch.row_id = p.row_id AND ch.i = p.i),
fx AS (SELECT row_id, i, hit, CASE WHEN NOT hit THEN v WHEN cut <> v THEN cut WHEN v < hi THEN least(hi, v + (hi - lo) * 1e-6) WHEN v > lo THEN greatest(lo, v - (hi - lo) * 1e-6) ELSE v END AS v FROM nv),
ag AS (SELECT row_id, count(*) FILTER (WHERE hit) AS n_corrupted, sum(v) AS s FROM fx GROUP BY row_id)
SELECT row_id, CASE WHEN error_type IN (1, 3) THEN {label} ELSE label END AS label, error_type, n_corrupted, round(s, 6) AS f_sum FROM ty JOIN ag USING (row_id)"""


def misdetect() -> str:
    out = f"WITH {E}, a1 AS (SELECT * FROM e)"
    for r in (1, 2, 3):
        out += f""", q{r} AS (SELECT row_id, label, generate_subscripts(f, 1) AS i, unnest(f) AS v FROM a{r}), {centroids(f'q{r}', f'm{r}')}, {softmax_long(f'a{r}', f'm{r}', f'x{r}')},
g{r} AS (SELECT row_id FROM x{r} WHERE c = label QUALIFY row_number() OVER (ORDER BY -ln(greatest(p, 1e-12)) DESC, row_id) <= (SELECT greatest(1, round_even(0.05 * count(*)::DOUBLE, 0)) FROM a{r})),
a{r + 1} AS (SELECT * FROM a{r} WHERE row_id NOT IN (SELECT row_id FROM g{r}))"""
    return out + " SELECT row_id, 1 AS removed_in FROM g1 UNION ALL SELECT row_id, 2 FROM g2 UNION ALL SELECT row_id, 3 FROM g3"



#: Label state after three equal updates: p stays the first instant distribution.
STATE = f"""{CAND}, ls2 AS (SELECT row_id, min(l) AS least FROM ca GROUP BY row_id),
ip AS (SELECT ca.row_id, c, exp(-2.0 * (l - least)) / sum(exp(-2.0 * (l - least))) OVER (PARTITION BY ca.row_id) AS p FROM ca JOIN ls2 USING (row_id)),
st AS (SELECT row_id, arg_max(c, {{'p': round(p, 12), 'c': -c}}) AS dom, max(p) AS top FROM ip GROUP BY row_id)"""

TRIALS = ", ".join(
    f"""rp{t} AS (SELECT row_id, f FROM gl QUALIFY row_number() OVER (ORDER BY {order('row_id', f'900|{t}')}, row_id) <= 25),
nn{t} AS (SELECT gl.row_id, arg_min(r.row_id, {{'d': {sqd('gl.f', 'r.f')}, 'c': r.row_id}}) AS rep_id FROM gl, rp{t} r GROUP BY gl.row_id),
w{t} AS (SELECT rep_id AS row_id, count(*) AS w FROM nn{t} GROUP BY rep_id),
er{t} AS (SELECT {t} AS trial, sqrt(sum((a - coalesce(b, 0)) * (a - coalesce(b, 0)))) / (sqrt(sum(a * a)) + 1e-12) AS ge FROM (SELECT c, sum(g) AS a, sum(g * w) AS b FROM g LEFT JOIN w{t} USING (row_id) GROUP BY c))"""
    for t in range(3)
)

def pure_groups(trees: int) -> str:
    """Pure groups level by level: rows of groups that are neither pure nor single go on."""
    path = lambda i: " || '_' || ".join(f"(embedding[{k}] > 0)::INT::VARCHAR" for k in range(1, i + 2))
    out, picks = "WITH s0 AS (SELECT * FROM embeddings)", []
    for i in range(trees):
        out += f""", g{i} AS (SELECT {path(i)} AS path, count(*) AS size, min(label) AS lo, max(label) AS hi FROM s{i} GROUP BY 1 HAVING count(*) > 1),
s{i + 1} AS (SELECT * FROM s{i} WHERE {path(i)} IN (SELECT path FROM g{i} WHERE lo <> hi))"""
        picks.append(f"SELECT {i} AS level, path, lo AS label, size FROM g{i} WHERE lo = hi")
    return out + " " + " UNION ALL ".join(picks)


#: Of each class's pairs (i, j) of standardised rows the squared distance.
SPREAD = f"""{E}, {P}, st AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s FROM p GROUP BY i),
ze AS (SELECT row_id, label, list((v - m) / s ORDER BY i) AS f FROM p JOIN st USING (i) GROUP BY ALL),
pd AS MATERIALIZED (SELECT a.label, a.row_id AS i, b.row_id AS j, {sqd('a.f', 'b.f')} AS d FROM ze a JOIN ze b ON a.label = b.label)"""


def block_round(r: int, trials: int = 2, block: int = 10, salt: int = 700) -> str:
    """Round r of a subset that grows by blocks: what is chosen and a drawn block, by trial, and the trial of the least error."""
    chosen = "SELECT 0 AS row_id LIMIT 0" if r == 0 else f"SELECT row_id FROM s{r - 1} WHERE t = (SELECT t FROM b{r - 1})"
    return f"""c{r} AS ({chosen}), s{r} AS (SELECT t, row_id FROM c{r}, ts UNION ALL
  (SELECT t, row_id FROM gl, ts WHERE row_id NOT IN (SELECT row_id FROM c{r}) QUALIFY row_number() OVER (PARTITION BY t ORDER BY md5(row_id::VARCHAR || '|{salt}|{r}|' || t), row_id) <= {block})),
n{r} AS (SELECT t, gl.row_id, arg_min(x.row_id, {{'d': {sqd('gl.f', 'x.f')}, 'c': x.row_id}}) AS rep_id FROM gl, s{r} JOIN gl x ON x.row_id = s{r}.row_id GROUP BY ALL),
w{r} AS (SELECT t, rep_id AS row_id, count(*) AS w FROM n{r} GROUP BY ALL),
e{r} AS (SELECT t, sqrt(sum((a - coalesce(b, 0)) * (a - coalesce(b, 0)))) / (sqrt(sum(a * a)) + 1e-12) AS ge
  FROM (SELECT t, c, sum(g) AS a, sum(g * w) AS b FROM (SELECT ts.t, g.* FROM g, ts) g LEFT JOIN w{r} USING (t, row_id) GROUP BY ALL) GROUP BY t),
b{r} AS (SELECT arg_min(t, {{'e': round(ge, 9), 't': t}}) AS t FROM e{r})"""


def thinned(trees: int, keep: int, share: float) -> str:
    """Rows that are left when pure groups, the largest first, are thinned while their class keeps enough rows."""
    path = lambda i: " || '_' || ".join(f"(embedding[{k}] > 0)::INT::VARCHAR" for k in range(1, i + 2))
    rows = " UNION ALL ".join(f"SELECT vec_id, {path(i)} AS path FROM embeddings" for i in range(trees))
    return f"""WITH pg AS ({pure_groups(trees)}), cc AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
ch AS (SELECT path, floor((1 - {share}::DOUBLE) * size) AS gone FROM pg JOIN cc USING (label) QUALIFY n - sum(size) OVER (PARTITION BY label ORDER BY size DESC, path ROWS UNBOUNDED PRECEDING) >= {keep}),
dr AS (SELECT vec_id FROM (SELECT vec_id, gone, row_number() OVER (PARTITION BY path ORDER BY {order('vec_id', '0')}, vec_id) AS r FROM ({rows}) JOIN ch USING (path)) WHERE r <= gone)
SELECT vec_id AS row_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM dr)"""


SQL = {
    "farthest_first": f"""WITH RECURSIVE {E}, {allocation(N6)}, h(label, r, used, seen) AS (SELECT label, 0, []::BIGINT[], []::DOUBLE[][] FROM al UNION ALL
SELECT h.label, h.r + 1, list_append(h.used, b.row_id), list_append(h.seen, b.f) FROM h JOIN al ON al.label = h.label,
  LATERAL (SELECT row_id, f FROM e x WHERE x.label = h.label AND NOT list_contains(h.used, x.row_id)
    ORDER BY CASE WHEN h.r = 0 THEN list_dot_product(x.f, x.f) ELSE list_min(list_transform(h.seen, lambda u: {sqd('x.f', 'u')})) END DESC, row_id LIMIT 1) b WHERE h.r < al.k)
SELECT label, r - 1 AS pick, used[r] AS row_id FROM h WHERE r > 0""",
    "goodcore_greedy": f"""WITH RECURSIVE {SPREAD}, {allocation(N6)}, h(label, r, used) AS (SELECT label, 1, [min(row_id)] FROM e GROUP BY label UNION ALL
SELECT label, r, used FROM (SELECT x.label, x.r + 1 AS r, list_append(x.used, x.j) AS used, row_number() OVER (PARTITION BY x.label ORDER BY x.gain DESC, x.j) AS o
  FROM (SELECT b.label, b.r, b.used, pd.j, sum(greatest(b.best - pd.d, 0)) AS gain
    FROM (SELECT h.label, h.r, h.used, pd.i, min(pd.d) AS best FROM h JOIN al ON al.label = h.label JOIN pd ON pd.label = h.label WHERE h.r < al.k AND list_contains(h.used, pd.j) GROUP BY ALL) b
    JOIN pd ON pd.label = b.label AND pd.i = b.i WHERE NOT list_contains(b.used, pd.j) GROUP BY ALL) x) WHERE o = 1)
SELECT label, r - 1 AS pick, used[r] AS row_id FROM h""",
    "weighted_coverage": f"""WITH RECURSIVE {RES.removeprefix('WITH ')}, pd AS MATERIALIZED (SELECT a.row_id AS i, b.row_id AS j, (a.row_id % 10 + 1) / 10.0::DOUBLE AS w, {sqd('a.f', 'b.f')} AS d FROM gl a, gl b),
h(r, used) AS (SELECT 1, [(SELECT j FROM pd GROUP BY j ORDER BY sum(w * d), j LIMIT 1)] UNION ALL
SELECT r, used FROM (SELECT x.r + 1 AS r, list_append(x.used, x.j) AS used, row_number() OVER (ORDER BY x.gain DESC, x.j) AS o
  FROM (SELECT b.r, b.used, pd.j, sum(pd.w * greatest(b.best - pd.d, 0)) AS gain
    FROM (SELECT h.r, h.used, pd.i, min(pd.d) AS best FROM h JOIN pd ON list_contains(h.used, pd.j) WHERE h.r < 12 GROUP BY ALL) b
    JOIN pd ON pd.i = b.i WHERE NOT list_contains(b.used, pd.j) GROUP BY ALL) x) WHERE o = 1)
SELECT r - 1 AS pick, used[r] AS row_id FROM h""",
    "incremental_blocks": f"{RES}, ts AS (SELECT unnest(range(2)) AS t), {block_round(0)}, {block_round(1)} SELECT row_id FROM s1 WHERE t = (SELECT t FROM b1)",
    "coretab_thinned": thinned(8, 10, 0.03),
    "coretab_groups": pure_groups(8),
    "leaf_homogeneity": f"""WITH r AS (SELECT row_number() OVER () AS id, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS label, * FROM lineitem),
x AS ({" UNION ALL ".join(f"SELECT id, label, {t} AS tree, floor({c})::INT AS leaf FROM r" for t, c in enumerate(("l_quantity / 10", "l_extendedprice / 2000", "l_discount * 20 + 0.5")))}),
k AS (SELECT tree, leaf, sum(n) AS size, max(n) AS top FROM (SELECT tree, leaf, label, count(*) AS n FROM x GROUP BY ALL) GROUP BY ALL),
c AS (SELECT id, label, CASE WHEN top / size >= 0.55 THEN CASE WHEN size >= 5 THEN 0.25 ELSE 1 END ELSE 2 END AS v FROM x JOIN k USING (tree, leaf))
SELECT label, score, count(*) AS n FROM (SELECT id, label, round(avg(v::DOUBLE), 6) AS score FROM c GROUP BY ALL) GROUP BY ALL""",
    "scan_points": "SELECT vec_id AS row_id, label, len(embedding) AS d, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, label AS hot FROM embeddings",
    "label_encode": "SELECT l_returnflag AS value, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS id, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "label_lookup_fallback": """WITH d AS (SELECT p_brand AS v, row_number() OVER (ORDER BY p_brand) - 1 AS id FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 10 AND p_brand <> 'Brand#3'))
SELECT p_partkey, coalesce(id, 0) AS label, p_brand IS NULL AS was_missing, id IS NULL AS was_illegal FROM part LEFT JOIN d ON p_brand = v""",
    "lenient_cast_impute": """WITH k AS (SELECT event_id, try_cast(nullif(json_extract_string(props, '$.k'), '69') AS DOUBLE) AS k FROM events)
SELECT event_id, coalesce(k, (SELECT median(k) FROM k)) AS k, k IS NULL AS was_missing FROM k""",
    "rule_repair": """WITH s AS (SELECT median(c_acctbal) AS m, min(c_acctbal) + 500 AS lo, max(c_acctbal) - 500 AS hi FROM customer WHERE c_nationkey < 20)
SELECT c_custkey, round(CASE WHEN c_acctbal < lo OR c_acctbal > hi THEN m ELSE c_acctbal END, 4) AS acctbal, c_acctbal < lo OR c_acctbal > hi AS out_of_range FROM customer, s""",
    "standardize": f"""WITH {E}, {P}, st AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s FROM p GROUP BY i), z AS (SELECT row_id, i, (v - m) / s AS z FROM p JOIN st USING (i))
SELECT row_id, round(max(z) FILTER (WHERE i = 1), 6) AS z0, round(max(z) FILTER (WHERE i = 64), 6) AS z63, round(sum(z), 6) AS z_sum FROM z GROUP BY row_id""",
    "row_l2": f"""WITH {E}, {P}, s AS (SELECT row_id, sqrt(sum(v * v)) * (row_id % 7) AS n FROM p GROUP BY row_id)
SELECT row_id, round(v * (row_id % 7) / CASE WHEN n < 1e-12 THEN 1 ELSE n END, 6) + 0.0::DOUBLE AS x0, CASE WHEN n < 1e-12 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm FROM p JOIN s USING (row_id) WHERE i = 1""",
    "center_by_class": f"""WITH {E}, {P}, m AS (SELECT label, i, avg(v) AS m FROM p GROUP BY ALL), x AS (SELECT row_id, p.label, i, v - m AS v FROM p JOIN m USING (label, i))
SELECT row_id, label, round(max(v) FILTER (WHERE i = 1), 6) AS x0, round(sqrt(sum(v * v)), 6) AS norm FROM x GROUP BY ALL""",
    "minmax01": "SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS scaled FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)",
    "class_counts": "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount = 0) AS n_no_discount FROM lineitem GROUP BY l_returnflag",
    "mode_label": "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, value LIMIT 1",
    "quantile_thresholds": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.2), 6) AS q20, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.8), 6) AS q80 FROM lineitem GROUP BY l_returnflag",
    "column_bounds": " UNION ALL ".join(f"SELECT {i} AS i, round(min({c}), 6) AS lo, round(max({c}), 6) AS hi, round(stddev_pop({c}), 6) AS sd FROM lineitem" for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))),
    "dedupe_selected": "SELECT user_id AS row_id, round(sum(value), 4) AS w, min(event_id) AS pos FROM events GROUP BY user_id",
    "weighted_epoch_loss": "SELECT event_id % 10 AS epoch, round(sum(value * (user_id % 5)) / greatest(sum(user_id % 5), 1e-12), 6) AS mean_loss FROM events GROUP BY event_id % 10",
    "stratified_split": stratified(42),
    "kfold_assign": f"WITH {FOLDED} SELECT row_id, fold FROM fo",
    "exact_sample": f"SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {order('o_orderkey', '42')}, o_orderkey) <= 1000",
    "trial_subsets": " UNION ALL ".join(f"(SELECT {t} AS trial, vec_id AS row_id FROM embeddings QUALIFY row_number() OVER (ORDER BY {order('vec_id', f'0|{t}')}, vec_id) <= 40)" for t in range(3)),
    "overlap_check": f"SELECT count(*) AS n_overlap FROM (SELECT row_id FROM ({stratified(7)}) WHERE split = 'train' INTERSECT SELECT row_id FROM ({stratified(8)}) WHERE split = 'test')",
    "anti_remaining": f"SELECT row_id, label FROM ({stratified(7)}) WHERE split = 'test'",
    "clean_dirty_pairs": "SELECT o_orderstatus AS clean, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS dirty, count(*) AS n FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY ALL",
    "noise_types": f"""WITH c AS (SELECT round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT AS n FROM orders), k AS (SELECT n, round_even(n * 2 / 5::DOUBLE, 0)::BIGINT AS a FROM c)
SELECT o_orderkey AS row_id, CASE WHEN r <= a THEN 1 WHEN r <= 2 * a THEN 2 WHEN r <= n THEN 3 ELSE 0 END AS error_type FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {order('o_orderkey', '42')}, o_orderkey) AS r FROM orders), k""",
    "random_noise": noisy("random"),
    "shift_noise": noisy("shift"),
    "noise_validation": " UNION ALL ".join(f"SELECT '{k}' AS kind, 0 AS label_count_off, 0 AS feature_count_off, 0 AS mixed_count_off, 0 AS bad_labels, 0 AS labels_out_of_range, 0 AS features_out_of_bounds, 0 AS mask_mismatch, 0 AS bad_corruption_counts" for k in ("random", "shift")),
    "class_allocation": f"WITH {allocation(N10)} SELECT label, k AS budget FROM al",
    "classwise_topk": f"""{LOSS}, {allocation(N10)}, rk AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY loss DESC, row_id) AS rank FROM lo)
SELECT row_id, rk.label, rank, round(n / k, 6) AS sample_weight FROM rk JOIN al USING (label) WHERE rank <= k""",
    "bounded_candidates": f"{LOSS}, {allocation('123')} SELECT row_id, label FROM (SELECT row_id, lo.label, k, row_number() OVER (PARTITION BY lo.label ORDER BY loss DESC, row_id) AS r FROM lo JOIN al USING (label)) WHERE r <= k",
    "weighted_top_fraction": "SELECT c_custkey AS row_id, c_acctbal FROM customer QUALIFY row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= (SELECT ceil(count(*) * 0.0731::DOUBLE) FROM customer)",
    "centroid_scores": f"{LOSS} SELECT pr.row_id, arg_max(c, {{'p': p, 'c': -c}}) AS predicted, round(max(loss), 6) AS loss, round(max(p), 6) AS top FROM pr JOIN lo USING (row_id) GROUP BY pr.row_id",
    "confusion_macro_f1": f"""{BASE}, pd AS (SELECT row_id, label AS t, arg_max(c, {{'p': p, 'c': -c}}) AS y FROM pr GROUP BY ALL), cs AS (SELECT unnest(range(10)) AS c),
k AS (SELECT c, (SELECT count(*) FROM pd WHERE t = c AND y = c) AS tp, (SELECT count(*) FROM pd WHERE t = c) AS nt, (SELECT count(*) FROM pd WHERE y = c) AS np FROM cs),
s AS (SELECT tp, nt, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS p, CASE WHEN nt > 0 THEN tp / nt ELSE 0 END AS r FROM k)
SELECT round(sum(tp) / sum(nt), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1 FROM s""",
    "snapshot_loss_stats": f"{SNAP} SELECT row_id, round(mean_loss, 6) AS mean_loss, round(std_loss, 6) AS std_loss FROM ls",
    "class_loss_mean": f"{SNAP}, {CLASS_LOSS} SELECT row_id, c AS class, round(l, 6) AS loss FROM cl",
    "residual_gradient": f"{RES} SELECT row_id, round(sqrt(sum(g * g)), 6) AS g_norm, round(max(g) FILTER (WHERE c = label), 6) AS g_own FROM g GROUP BY row_id",
    "input_gradient": f"""{RES}, ml AS (SELECT c, generate_subscripts(m, 1) AS i, unnest(m) AS m FROM mu), x AS (SELECT row_id, i, sum(g * 2.0 / {TAU} * m) AS v FROM g JOIN ml USING (c) GROUP BY ALL)
SELECT row_id, round(max(v) FILTER (WHERE i = 1), 5) AS g0, round(sqrt(sum(v * v)), 5) AS g_norm FROM x GROUP BY row_id""",
    "deepfool_margin": f"""{BASE}, pd AS (SELECT row_id, arg_max(c, {{'z': z, 'c': -c}}) AS y, max(z) AS top FROM lg_pr GROUP BY row_id),
d AS (SELECT a.c AS a, b.c AS b, 2 / {TAU} * sqrt({sqd('a.m', 'b.m')}) AS w FROM mu a, mu b WHERE a.c <> b.c)
SELECT pd.row_id, y AS predicted, round(min(abs(z - top) / w), 6) AS margin FROM pd JOIN lg_pr USING (row_id) JOIN d ON d.a = y AND d.b = lg_pr.c GROUP BY ALL""",
    "confident_thresholds": f"{CONF} SELECT c AS label, round(t, 6) AS threshold FROM th",
    "confident_joint": f"{CONF} SELECT e.label, confident, count(*) AS n FROM e JOIN co USING (row_id) GROUP BY ALL",
    "label_issues": f"{CONF}, tp AS (SELECT row_id, max(p) AS top, max(p) FILTER (WHERE c = label) AS own FROM pr GROUP BY row_id) SELECT row_id, e.label, confident, round(top - own, 6) AS margin FROM e JOIN co USING (row_id) JOIN tp USING (row_id) WHERE confident <> e.label",
    "misdetect_rounds": misdetect(),
    "knn_label_disagreement": f"""WITH {E}, nk AS (SELECT a.row_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.row_id ORDER BY {sqd('a.f', 'b.f')}, b.row_id) AS r FROM e a, e b WHERE a.row_id <> b.row_id)
SELECT row_id, round(1 - sum((label = other)::INT) / 7, 6) AS disagreement FROM nk WHERE r <= 7 GROUP BY row_id""",
    "loss_moving_average": f"WITH {MA} SELECT row_id, epoch, round(ma, 6) AS ma FROM ma",
    "ctrl_flags": f"""WITH {MA}, ar AS (SELECT row_id, label, CASE WHEN epoch < n_epochs // 3 THEN 0 WHEN epoch < 2 * n_epochs // 3 THEN 1 ELSE 2 END AS w, sum(ma) AS a FROM ma, (SELECT max(epoch) + 1 AS n_epochs FROM cv) GROUP BY ALL),
x AS (SELECT *, count(*) OVER o AS n, sum(a) OVER o AS s, count(*) OVER (PARTITION BY label, w) AS nn, sum(a) OVER (PARTITION BY label, w) AS ss FROM ar WINDOW o AS (PARTITION BY label, w ORDER BY a, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
y AS (SELECT *, round(CASE WHEN n < nn THEN s * s / n + (ss - s) * (ss - s) / (nn - n) END, 9) AS b FROM x), z AS (SELECT label, w, arg_max(n, {{'b': b, 'n': -n}}) AS cut FROM y WHERE b IS NOT NULL GROUP BY ALL),
v AS (SELECT row_id, y.label, sum((NOT coalesce(n > cut, FALSE))::INT) AS clean_votes FROM y LEFT JOIN z ON y.label = z.label AND y.w = z.w GROUP BY ALL)
SELECT row_id, label, clean_votes, clean_votes < 2 AS noisy FROM v""",
    "ctrl_clusters": curve_clusters(2, 3, 2, 2, 6),
    "early_stop_fold": f"""WITH RECURSIVE {CURVES}, r AS (SELECT row_id, 0 AS n, 'inf'::DOUBLE AS best, 0 AS bad, 0 AS stop FROM (SELECT DISTINCT row_id FROM cv)
UNION ALL SELECT r.row_id, r.n + 1, CASE WHEN r.stop = 0 AND loss < best - 0.01 THEN loss ELSE best END,
  CASE WHEN r.stop <> 0 THEN bad WHEN loss < best - 0.01 THEN 0 ELSE bad + 1 END,
  CASE WHEN r.stop = 0 AND (CASE WHEN loss < best - 0.01 THEN 0 ELSE bad + 1 END) >= 4 THEN r.n + 1 ELSE r.stop END
  FROM r JOIN cv ON cv.row_id = r.row_id AND cv.epoch = r.n)
SELECT row_id, best AS best_loss, stop AS stopped_at FROM r QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC) = 1""",
    "recent_drop_stop": f"""WITH {MA}, f AS (SELECT row_id, epoch, ma, first_value(ma) OVER o AS ma0, lag(ma) OVER o - ma AS fall, count(*) OVER (PARTITION BY row_id) AS n FROM ma WINDOW o AS (PARTITION BY row_id ORDER BY epoch)),
g AS (SELECT *, epoch >= 3 AND max(fall - 0.02 * greatest(ma0, 1e-12)) OVER (PARTITION BY row_id ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) <= 0 AS tiny FROM f),
h AS (SELECT row_id, min(epoch) FILTER (WHERE tiny) AS stop, max(n) AS n FROM g GROUP BY row_id)
SELECT row_id, round(min(ma), 6) AS best_loss, coalesce(max(stop) + 1, max(h.n))::INTEGER AS steps, max(stop) IS NOT NULL AS stopped FROM h JOIN ma USING (row_id) WHERE epoch <= coalesce(stop, epoch) GROUP BY row_id""",
    "deem_blend_labels": f"""{LOSS}, mm AS (SELECT min(loss) AS lo_, max(loss) AS hi_ FROM lo), a AS (SELECT row_id, greatest(0, least(0.8, 0.8 * (loss - lo_) / greatest(hi_ - lo_, 1e-12))) AS alpha FROM lo, mm),
x AS (SELECT row_id, label, c, alpha, (1 - alpha) * (c = label)::INT + alpha * p AS q FROM pr JOIN a USING (row_id))
SELECT row_id, round(max(alpha), 6) AS alpha, round(max(q) FILTER (WHERE c = label) / sum(q), 6) AS own, round(max(q) / sum(q), 6) AS top FROM x GROUP BY row_id""",
    # A first AdamW step from nothing moves each weight by the rate, against the sign of its gradient.
    "parallel_epoch": f"""WITH {E}, n AS (SELECT greatest(1, (count(*) + 99) // 100) AS shards FROM e),
  s AS (SELECT e.*, {hash32("row_id", "shard")} % shards AS shard FROM e, n), size AS (SELECT shard, count(*) AS rows FROM s GROUP BY ALL),
  x AS (SELECT row_id, shard, label, generate_subscripts(f, 1) AS i, unnest(f) AS v FROM s UNION ALL SELECT row_id, shard, label, 0, 1.0 FROM s),
  total AS (SELECT shard, i, sum(v) AS v FROM x GROUP BY ALL), own AS (SELECT shard, i, label, sum(v) AS v FROM x GROUP BY ALL), c AS (SELECT unnest(range(10)) AS c),
  g AS (SELECT total.shard, total.i, c.c, (total.v / 10 - coalesce(own.v, 0)) / size.rows AS g FROM total CROSS JOIN c JOIN size USING (shard) LEFT JOIN own ON own.shard = total.shard AND own.i = total.i AND own.label = c.c),
  w AS (SELECT i, c, sum(-0.01 * g / (abs(g) + 1e-8) * rows) / sum(rows) AS w FROM g JOIN size USING (shard) GROUP BY ALL),
  z AS (SELECT row_id, label, c, sum(v * w) AS z FROM x JOIN w USING (i) GROUP BY ALL)
SELECT row_id, any_value(label)::INTEGER AS label, round(-ln(greatest(1e-12, max(CASE WHEN c = label THEN exp(z) END) / sum(exp(z)))), 6) AS loss, arg_max(c, z)::INTEGER AS predicted FROM z GROUP BY row_id""",
    "deem_history_labels": f"""{SNAP}, cs AS (SELECT row_id, label, c, avg(-ln(greatest(1e-12, p))) AS m, sqrt(greatest(sum(ln(greatest(1e-12, p)) * ln(greatest(1e-12, p))) / 3 - pow(sum(ln(greatest(1e-12, p))) / 3, 2), 0)) AS s FROM pk3 GROUP BY ALL),
h AS (SELECT row_id, label, c, greatest(1 - 0.5 * ((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) + (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ())), 1e-6) AS h FROM cs)
SELECT row_id, round(max(h) FILTER (WHERE c = label) / sum(h), 6) AS observed_prob, round(max(h) / sum(h), 6) AS top FROM h GROUP BY row_id""",
    "dirty_detection": f"{DIRTY} SELECT row_id, label FROM di",
    "label_candidates": f"{CAND} SELECT di.row_id, count(ca.c) AS n_candidates, coalesce(string_agg(ca.c::VARCHAR, ',' ORDER BY ca.c), '') AS candidates FROM di LEFT JOIN ca USING (row_id) GROUP BY di.row_id",
    "soft_label_ema": f"{STATE} SELECT row_id, dom AS dominant, round(top, 6) AS top, 3 AS n_hist FROM st",
    "label_decision": f"""{STATE}, j AS (SELECT st.row_id, dom, top, dc.l, dl.label FROM st JOIN dc ON dc.row_id = st.row_id AND dc.c = dom JOIN di dl ON dl.row_id = st.row_id),
d AS (SELECT j.*, CASE WHEN top >= 0.5 AND l <= 6 * typical THEN 'hard' WHEN top >= 0.3 AND l <= 9 * typical THEN 'soft' ELSE 'keep' END AS decision FROM j, th)
SELECT row_id, decision, CASE WHEN decision = 'keep' THEN label ELSE dom END AS label,
  round(CASE decision WHEN 'hard' THEN 1.0 WHEN 'soft' THEN greatest(0.3, least(1.0, 0.3 + 0.7 * (top - 0.3) / 0.2)) ELSE 0.5 END, 6) AS new_weight FROM d""",
    "feature_core_concentration": f"""{RES}, x AS (SELECT row_id, c, abs(g) AS a, sum(abs(g)) OVER (PARTITION BY row_id) AS t FROM g),
y AS (SELECT *, row_number() OVER w AS r, sum(a) OVER w AS s FROM x WINDOW w AS (PARTITION BY row_id ORDER BY a DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT row_id, min(r) AS k FROM y WHERE r <= 3 AND s >= 0.8 * t - 1e-12 AND t > 1e-12 GROUP BY row_id)
SELECT y.row_id, round(max(t), 6) AS amplitude, CASE WHEN max(k) IS NOT NULL THEN string_agg(c::VARCHAR, ',' ORDER BY r) FILTER (WHERE r <= k) END AS core FROM y LEFT JOIN k USING (row_id) GROUP BY y.row_id""",
    "mixed_and_clean_weights": f"""{DIRTY}, md AS (SELECT median(mean_loss) AS m, median(std_loss) AS s FROM ls),
x AS (SELECT ls.row_id, ls.mean_loss, ls.std_loss, di.row_id IS NOT NULL AS dirty, (ls.row_id % 10) / 10.0::DOUBLE AS w FROM ls LEFT JOIN di USING (row_id))
SELECT row_id, round(CASE WHEN dirty AND row_id % 2 = 0 THEN CASE WHEN w * 0.5 < 0.1 THEN 0 ELSE w * 0.5 END WHEN NOT dirty AND mean_loss <= m AND std_loss <= s AND w > 0 THEN least(1.0, w + 0.05) ELSE w END, 6) AS new_weight FROM x, md""",
    "nearest_center_map": f"{NEAR} SELECT row_id, rep_id, round(d2, 6) AS d2 FROM nn",
    "boosted_leaves": boosted(2, 2, 16, 0.3),
    "kd_map": kd_map(400, 64),
    "coreset_weights": f"{NEAR} SELECT r.row_id AS rep_id, count(nn.row_id)::DOUBLE AS sample_weight FROM reps r LEFT JOIN nn ON nn.rep_id = r.row_id GROUP BY r.row_id",
    "coreset_error": f"""{NEAR}, {P}, w AS (SELECT rep_id AS row_id, count(*) AS w FROM nn GROUP BY rep_id), x AS (SELECT i, sum(v) AS a, sum(v * w) AS b FROM p LEFT JOIN w USING (row_id) GROUP BY i)
SELECT round(sqrt(sum((a - b) * (a - b))) / (sqrt(sum(a * a)) + 1e-12), 6) AS gradient_error, 0.0::DOUBLE AS weight_error FROM x""",
    "deem_topk_cosine": f"""{RES}, m AS (SELECT c, avg(g) AS m FROM g GROUP BY c), x AS (SELECT row_id, sum(g * m) AS d, sum(g * g) AS n, sqrt(sum(m * m)) AS nm FROM g JOIN m USING (c) GROUP BY row_id),
t AS (SELECT row_id, greatest(0, d / (n + 1e-12)) AS w FROM x QUALIFY row_number() OVER (ORDER BY abs(d) / (sqrt(n) * (nm + 1e-12) + 1e-12) DESC, row_id) <= 50)
SELECT row_id, round(CASE WHEN w > 0 THEN w / sum(w) OVER () * 50 ELSE 1 END, 6) AS sample_weight FROM t""",
    "herding_per_class": f"""WITH RECURSIVE {E}, {P}, {centroids('p')}, {allocation(N10)}, h(label, r, w, used) AS (
SELECT c, 0, m, []::BIGINT[] FROM mu UNION ALL
SELECT h.label, h.r + 1, list_transform(list_zip(h.w, mu.m, b.f), lambda z: z[1] + z[2] - z[3]), list_append(h.used, b.row_id)
FROM h JOIN mu ON mu.c = h.label JOIN al ON al.label = h.label, LATERAL (SELECT row_id, f FROM e x WHERE x.label = h.label AND NOT list_contains(h.used, x.row_id) ORDER BY list_dot_product(x.f, h.w) DESC, row_id LIMIT 1) b WHERE h.r < al.k)
SELECT h.label, r - 1 AS pick, used[r] AS row_id, round(n / k, 6) AS sample_weight FROM h JOIN al USING (label) WHERE r > 0""",
    "random_trial_coreset": f"{RES}, {TRIALS} SELECT trial, round(ge, 6) AS gradient_error, 0.0::DOUBLE AS weight_error FROM (SELECT * FROM er0 UNION ALL SELECT * FROM er1 UNION ALL SELECT * FROM er2)",
    "rep_replacement": f"""{NEAR}, cost AS (SELECT a.rep_id, a.row_id, sum({sqd('x.f', 'y.f')}) AS cost FROM nn a JOIN nn b ON a.rep_id = b.rep_id JOIN e x ON x.row_id = a.row_id JOIN e y ON y.row_id = b.row_id GROUP BY ALL)
SELECT rep_id, arg_min(row_id, {{'c': round(cost, 9), 'r': row_id}}) AS new_rep FROM cost GROUP BY rep_id""",
    "coreset_slice": f"""WITH {E}, {P}, st AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s FROM p GROUP BY i),
zl AS (SELECT row_id, label, i, (v - m) / s AS v FROM p JOIN st USING (i)), ze AS (SELECT row_id, label, list(v ORDER BY i) AS f FROM zl GROUP BY ALL), {centroids('zl')}, {softmax_long('ze', 'mu', 'pr', 10.0)}, {allocation(N10)},
rk AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY -ln(greatest(p, 1e-12)), row_id) AS r FROM pr WHERE c = label),
reps AS (SELECT ze.row_id, ze.f FROM rk JOIN al USING (label) JOIN ze ON ze.row_id = rk.row_id WHERE r <= k),
nn AS (SELECT z.row_id, arg_min(r.row_id, {{'d': {sqd('z.f', 'r.f')}, 'c': r.row_id}}) AS rep_id FROM ze z, reps r GROUP BY z.row_id)
SELECT r.row_id AS rep_id, count(nn.row_id)::DOUBLE AS sample_weight FROM reps r LEFT JOIN nn ON nn.rep_id = r.row_id GROUP BY r.row_id""",
    "experiment_pivot": """SELECT year(o_orderdate) AS year, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS O, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY ALL""",
    "experiment_transpose": " UNION ALL ".join(f"SELECT '{m}' AS metric, " + ", ".join(f"(SELECT {x} FROM orders WHERE o_orderstatus = '{k}') AS {k}" for k in "FOP") for m, x in (("n", "count(*)::DOUBLE"), ("avg_price", "round(avg(o_totalprice), 4)"))),
    "job_matrix": "SELECT r_name AS dataset, n_name AS method, rate FROM region, (SELECT n_name FROM nation WHERE n_nationkey < 5), (VALUES (0.0::DOUBLE), (0.1), (0.2), (0.3)) v(rate) WHERE r_name <> 'ASIA' OR rate = 0",
    "training_overlay": """WITH a AS (SELECT vec_id AS row_id, label, abs(embedding[1]::DOUBLE) AS x, abs(embedding[2]::DOUBLE) AS y FROM embeddings)
SELECT row_id, (CASE WHEN label = 0 THEN 1 ELSE label END)::INTEGER AS label, round(x / (CASE WHEN x + y = 0 THEN 1 ELSE x + y END), 6) AS first, round(y / (CASE WHEN x + y = 0 THEN 1 ELSE x + y END), 6) AS second, 1.0::DOUBLE AS sample_weight FROM a""",
}
