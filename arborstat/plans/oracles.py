"""The SQL that each registered query is checked against."""

from __future__ import annotations

from ..operators.grid import kernel
from .catalogue import DIGITS, N_PERM, TARGET_NATIONS

PANEL = """
months AS (SELECT month, CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS img FROM (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)),
held AS (SELECT l_suppkey AS vox, img, avg(l_quantity) AS qty, avg(l_extendedprice) AS price, avg(l_discount) AS disc
  FROM lineitem JOIN months ON strftime(l_shipdate, '%Y-%m') = month GROUP BY 1, 2),
means AS (SELECT vox, avg(qty) AS mq, avg(price) AS mp, avg(disc) AS md FROM held GROUP BY vox),
panel AS (SELECT m.vox, i.img, coalesce(qty, mq) AS qty, coalesce(price, mp) AS price, coalesce(disc, md) AS disc
  FROM means m CROSS JOIN (SELECT img FROM months) i LEFT JOIN held h ON h.vox = m.vox AND h.img = i.img),
tree AS (SELECT s_suppkey AS vox, n_regionkey AS region, s_nationkey AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
LEVEL = "CAST(3 - grouping(region) - grouping(nation) - grouping(vox) AS INTEGER) AS level"
NODES = f"""
size AS (SELECT max(img) + 1 AS n FROM panel),
proj AS (SELECT vox, 1 AS size, sum(qty / sqrt(n)) AS a0, sum(qty * (img - (n - 1) / 2.0) / sqrt(n * (n * n - 1) / 12.0)) AS a1, sum(qty * qty) AS t FROM panel CROSS JOIN size GROUP BY vox),
nodes AS (SELECT {LEVEL}, region, nation, vox, CAST(sum(size) AS BIGINT) AS size, sum(a0) AS a0, sum(a1) AS a1, sum(t) AS t FROM proj JOIN tree USING (vox) GROUP BY ROLLUP (region, nation, vox)),
eh AS (SELECT level, region, nation, vox, size, t - a0 * a0 / size - a1 * a1 / size AS e, a1 * a1 / size AS h FROM nodes)"""
PERMS = f"""
n AS (SELECT count(*) AS n FROM months),
perms AS (SELECT CAST(k AS INTEGER) AS k, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN k = 0 THEN pos ELSE row_number() OVER (PARTITION BY k ORDER BY md5(k::VARCHAR || ':' || pos::VARCHAR), pos) - 1 END AS INTEGER) AS src
  FROM range({N_PERM + 1}) a(k) CROSS JOIN (SELECT unnest(range(n)) AS pos FROM n))"""
DRAWS = f"""
basis AS (SELECT k, pos AS img, (src - (n - 1) / 2.0) / sqrt(n * (n * n - 1) / 12.0) AS w FROM perms CROSS JOIN n),
vdraw AS (SELECT vox, k, sum(qty * w) AS p FROM panel JOIN basis USING (img) GROUP BY vox, k),
vfix AS (SELECT vox, sum(qty) / sqrt(max(n)) AS a0, sum(qty * qty) AS t FROM panel CROSS JOIN n GROUP BY vox),
dnodes AS (SELECT k, {LEVEL}, region, nation, vox, count(*) AS size, sum(a0) AS a0, sum(t) AS t, sum(p) AS p FROM vdraw JOIN vfix USING (vox) JOIN tree USING (vox)
  GROUP BY GROUPING SETS ((k), (k, region), (k, region, nation), (k, region, nation, vox))),
draws AS (SELECT k, level, region, nation, vox, CASE WHEN t - a0 * a0 / size > 0 AND t - a0 * a0 / size - p * p / size > 0 THEN 0.5 * size * (ln(t - a0 * a0 / size) - ln(t - a0 * a0 / size - p * p / size)) END AS stat FROM dnodes),
moments AS (SELECT level, region, nation, vox, avg(stat) AS mu, stddev_samp(stat) AS sd FROM draws GROUP BY 1, 2, 3, 4),
zs AS (SELECT d.k, d.level, d.region, d.nation, d.vox, (d.stat - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END AS z FROM draws d JOIN moments m
  ON d.level = m.level AND d.region IS NOT DISTINCT FROM m.region AND d.nation IS NOT DISTINCT FROM m.nation AND d.vox IS NOT DISTINCT FROM m.vox)"""
GRID = """
cells AS (SELECT i * 1000 + j AS vox, i, j, val FROM (SELECT p_size AS i, CAST(dense_rank() OVER (ORDER BY p_brand) AS INTEGER) AS j, val FROM (SELECT p_size, p_brand, avg(p_retailprice) AS val FROM part GROUP BY 1, 2))),
over_mid AS (SELECT * FROM cells WHERE val >= (SELECT quantile_cont(val, 0.5) FROM cells))"""


def components(cells: str, keys: str = "") -> str:
    """Recursive reachability: (keys, vox, comp) of the component's smallest voxel."""
    k, on = (f"{keys}, " if keys else ""), (f" AND a.{keys} = b.{keys}" if keys else "")
    ka, same = (f"a.{keys}, " if keys else ""), (f" AND r.{keys} = e.{keys}" if keys else "")
    kr = f"r.{keys}, " if keys else ""
    return f"""
edges AS (SELECT {ka}a.vox AS u, b.vox AS v FROM {cells} a JOIN {cells} b ON abs(a.i - b.i) + abs(a.j - b.j) = 1{on}),
reach AS (SELECT {k}vox, vox AS comp FROM {cells} UNION SELECT {kr}e.v AS vox, r.comp FROM reach r JOIN edges e ON r.vox = e.u{same}),
comps AS (SELECT {k}vox, min(comp) AS comp FROM reach GROUP BY {k}vox)"""


def least_labels(cells: str) -> str:
    """comps (step, vox, comp) of `cells` over `edges`: a voxel's label falls to its neighbours' least until none does."""
    return f"""comps(step, vox, comp) USING KEY (step, vox) AS (SELECT step, vox, vox FROM {cells} UNION
(SELECT e.step, e.v, min(c.comp) FROM comps c JOIN edges e ON e.step = c.step AND e.u = c.vox JOIN recurring.comps o ON o.step = e.step AND o.vox = e.v WHERE c.comp < o.comp GROUP BY e.step, e.v)),"""


def r(column: str, name: str | None = None) -> str:
    return f"round({column}, {DIGITS}) AS {name or column}"


def smoothing_sql() -> str:
    weights = ", ".join(f"({x}, {w!r})" for x, w in kernel(2.0))
    return f"""WITH {GRID}, k(x, w) AS (VALUES {weights}),
a AS (SELECT i + x AS i, j, sum(val * w) AS num, sum(CAST(w AS DOUBLE)) AS den FROM cells CROSS JOIN k GROUP BY 1, 2),
b AS (SELECT i, j + x AS j, sum(num * w) AS num, sum(den * w) AS den FROM a CROSS JOIN k GROUP BY 1, 2)
SELECT vox, {r('num / den', 'val')} FROM cells JOIN b USING (i, j)"""


TARGET = f"nation IN {TARGET_NATIONS}"


def oracle_sql() -> dict[str, str]:
    with_panel, with_nodes, with_draws = f"WITH {PANEL}", f"WITH {PANEL}, {NODES}", f"WITH {PANEL}, {PERMS}, {DRAWS}"
    five = {
        "llr": "CASE WHEN e > 0 AND e + h > 0 THEN 0.5 * (ln(e + h) - ln(e)) END", "wilks": "CASE WHEN e > 0 AND e + h > 0 THEN 1 - e / (e + h) END", "pillai": "h / nullif(h + e, 0)", "hotelling": "h / nullif(e, 0)", "roy": "h / nullif(e, 0)",
    }
    pairs = [("qty", "qty"), ("qty", "price"), ("qty", "disc"), ("price", "price"), ("price", "disc"), ("disc", "disc")]
    trend = "(img - (n - 1) / 2.0) / sqrt(n * (n * n - 1) / 12.0)"
    return {
        "panel_fill": f"{with_panel} SELECT vox, img, {r('qty')}, {r('price')}, {r('disc')} FROM panel",
        "voxel_screen": f"""{with_panel}, s AS (SELECT vox, stddev_pop(qty) AS q, stddev_pop(price) AS p, stddev_pop(disc) AS d FROM panel GROUP BY vox),
m AS (SELECT median(q) AS mq, median(p) AS mp, median(d) AS md FROM s)
SELECT vox, q <= 0.9 * mq OR p <= 0.9 * mp OR d <= 0.9 * md AS dead FROM s CROSS JOIN m""",
        "whiten_moments": with_panel + " UNION ALL ".join(f" SELECT '{f}' AS f, '{g}' AS g, {r(f'avg({f})', 'mean_f')}, {r(f'avg({g})', 'mean_g')}, {r(f'covar_samp({f}, {g})', 'cov')} FROM panel" for f, g in pairs),
        "zero_mean_scale": f"{with_panel} SELECT vox, img, " + ", ".join(r(f"({f} - (SELECT avg({f}) FROM panel)) / (SELECT stddev_samp({f}) FROM panel)", f) for f in ("qty", "price", "disc")) + " FROM panel",
        "sigma_stretch": f"{with_panel} SELECT vox, img, " + ", ".join(r(f"avg({f}) OVER (PARTITION BY img) + 1.5 * ({f} - avg({f}) OVER (PARTITION BY img))", f) for f in ("qty", "price", "disc")) + " FROM panel",
        "offset_patch": f"{with_panel} SELECT vox, img, {r(f'qty + CASE WHEN {TARGET} THEN 0.5 * img ELSE 0 END', 'qty')} FROM panel JOIN tree USING (vox)",
        "image_select": f"{with_panel}, s AS (SELECT img AS old_img, CAST(row_number() OVER (ORDER BY again, CASE WHEN again THEN img ELSE -img END) - 1 AS INTEGER) AS img FROM (SELECT img, false AS again FROM months UNION ALL SELECT img, true FROM months WHERE img % 2 = 0)) SELECT vox, s.img, {r('qty')} FROM panel JOIN s ON panel.img = old_img",
        "leading_images": f"{with_panel} SELECT vox, img, {r('qty')} FROM panel WHERE img < 12",
        "group_split_cut": """WITH g AS (SELECT s_nationkey AS grp, count(*) AS n FROM supplier GROUP BY 1),
o AS (SELECT grp, n, row_number() OVER w AS pos, sum(n) OVER w AS cum FROM g WINDOW w AS (ORDER BY md5(grp::VARCHAR), grp)),
c AS (SELECT pos FROM o ORDER BY abs(cum - (SELECT sum(n) * 0.5 FROM g)), pos LIMIT 1)
SELECT grp, n, CASE WHEN pos <= (SELECT pos FROM c) THEN 'a' ELSE 'b' END AS fold FROM o""",
        "tree_node_sum": f"{with_panel} SELECT {LEVEL}, region, nation, vox, count(DISTINCT vox) AS size, {r('sum(qty)', 'qty')} FROM panel JOIN tree USING (vox) GROUP BY ROLLUP (region, nation, vox)",
        "tree_confusion": f"""{with_panel}, c AS (SELECT {LEVEL}, region, nation, vox, count(*) FILTER ({TARGET}) AS tp, count(*) FILTER (NOT {TARGET}) AS fp FROM tree GROUP BY ROLLUP (region, nation, vox)),
f AS (SELECT *, (SELECT count(*) FROM tree WHERE {TARGET}) - tp AS fn, (SELECT count(*) FROM tree WHERE NOT {TARGET}) - fp AS tn FROM c)
SELECT level, region, nation, vox, tp, fp, fn, tn, {r('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'dice')}, {r('coalesce(1.0 * tp / nullif(tp + fn, 0), 0)', 'sens')}, {r('1.0 * tp / nullif(tp + fp, 0)', 'ppv')}, {r('1.0 * tn / nullif(tn + fp, 0)', 'spec')} FROM f""",
        "tree_eh_b1": f"{with_nodes} SELECT level, region, nation, vox, size, {r('e')}, {r('h')} FROM eh",
        "tree_llr_scan": f"{with_nodes} SELECT level, region, nation, vox, size, {r('CASE WHEN e > 0 AND e + h > 0 THEN 0.5 * size * (ln(e + h) - ln(e)) END', 'llr')} FROM eh",
        "five_stats_unpivot": with_nodes + " UNION ALL ".join(f" SELECT level, region, nation, vox, '{k}' AS statistic, {r(v, 'value')} FROM eh" for k, v in five.items()),
        "tree_llr_b2": f"""{with_panel}, size AS (SELECT max(img) + 1 AS n FROM panel),
z AS (SELECT vox, img, (qty - (SELECT avg(qty) FROM panel)) / (SELECT stddev_samp(qty) FROM panel) AS x, (price - (SELECT avg(price) FROM panel)) / (SELECT stddev_samp(price) FROM panel) AS y FROM panel),
p AS (SELECT vox, sum(x / sqrt(n)) AS x0, sum(y / sqrt(n)) AS y0, sum(x * {trend}) AS x1, sum(y * {trend}) AS y1, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM z CROSS JOIN size GROUP BY vox),
s AS (SELECT {LEVEL}, region, nation, vox, count(*) AS size, sum(x0) AS x0, sum(y0) AS y0, sum(x1) AS x1, sum(y1) AS y1, sum(xx) AS xx, sum(xy) AS xy, sum(yy) AS yy FROM p JOIN tree USING (vox) GROUP BY ROLLUP (region, nation, vox)),
t AS (SELECT *, xx - x0 * x0 / size AS txx, xy - x0 * y0 / size AS txy, yy - y0 * y0 / size AS tyy FROM s),
d AS (SELECT *, txx * tyy - txy * txy AS dt, (txx - x1 * x1 / size) * (tyy - y1 * y1 / size) - (txy - x1 * y1 / size) ** 2 AS de FROM t)
SELECT level, region, nation, vox, size, {r('CASE WHEN de > 0 AND dt > 0 THEN 0.5 * size * (ln(dt) - ln(de)) END', 'llr')} FROM d""",
        "perm_table_md5": f"{with_panel}, {PERMS} SELECT k, pos, src FROM perms",
        "perm_draws": f"{with_draws} SELECT k, level, region, nation, vox, {r('stat')} FROM draws",
        "draw_zscore": f"{with_draws} SELECT k, level, region, nation, vox, {r('z')} FROM zs",
        "max_stat_null": f"{with_draws} SELECT k, {r('max(z)', 'max_stat')} FROM zs GROUP BY k",
        "fwer_pvalues": f"""{with_draws}, zr AS (SELECT * REPLACE (round(z, {DIGITS}) AS z) FROM zs), m AS (SELECT k, max(z) AS max_stat FROM zr GROUP BY k),
p AS (SELECT level, region, nation, vox, z, CASE WHEN z IS NOT NULL THEN greatest((SELECT count(*) FROM m WHERE max_stat >= z) / (SELECT count(*) FROM m), 1.0 / (SELECT count(*) FROM m)) END AS pval FROM zr WHERE k = 0)
SELECT level, region, nation, vox, z, {r('pval')}, pval <= 0.05 AS sig FROM p""",
        "critical_value": f"{with_draws} SELECT {r('quantile_cont(max_stat, 0.95)', 'critical')} FROM (SELECT k, max(z) AS max_stat FROM zs GROUP BY k)",
        "voxel_stat_matrix": f"{with_draws} SELECT k, vox, {r('stat')} FROM draws WHERE level = 3",
        "cft_quantile": f"{with_draws} SELECT {r('quantile_cont(stat, 0.95)', 'threshold')}, count(stat) AS n FROM draws WHERE level = 3 AND k > 0",
        "neighbor_join": f"WITH {GRID} SELECT a.vox, count(*) AS n, {r('avg(b.val)', 'near')} FROM cells a JOIN cells b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY a.vox",
        "grid_components": f"WITH RECURSIVE {GRID}, {components('over_mid')} SELECT vox, comp FROM comps",
        "cluster_extent_test": f"""WITH RECURSIVE {GRID}, st AS (SELECT k, vox, i, j, val + k * ((i * 7 + j * 13) % 100) AS stat FROM cells CROSS JOIN range(4) r(k)), ov AS (SELECT * FROM st WHERE stat >= 1500), {components('ov', 'k')},
x AS (SELECT k, vox, count(*) OVER (PARTITION BY k, comp) AS extent FROM comps), e AS (SELECT st.k, st.vox, coalesce(extent, 0) AS extent FROM st LEFT JOIN x USING (k, vox))
SELECT CAST(k AS INTEGER) AS k, vox, extent, max(extent) OVER (PARTITION BY k) AS max_stat FROM e""",
        "tfce_enhance": f"""WITH RECURSIVE {GRID}, im AS (SELECT vox, i, j, CASE WHEN vox % 11 <> 0 THEN val / 1000 END AS stat FROM cells), top AS (SELECT max(stat) AS top FROM im),
lv AS (SELECT step, vox, i, j, CASE WHEN step = 100 THEN top ELSE top * step / 100 END AS height FROM im CROSS JOIN top CROSS JOIN range(1, 101) r(step) WHERE top > 0 AND stat >= CASE WHEN step = 100 THEN top ELSE top * step / 100 END),
edges AS (SELECT a.step, a.vox AS u, b.vox AS v FROM lv a JOIN lv b ON a.step = b.step AND ((a.i = b.i AND abs(a.j - b.j) = 1) OR (a.j = b.j AND abs(a.i - b.i) = 1))),
{least_labels('lv')}
sz AS (SELECT step, comp, count(*) AS n FROM comps GROUP BY step, comp), ts AS (SELECT vox, sum(sqrt(n) * height * height) AS v FROM lv JOIN comps USING (step, vox) JOIN sz USING (step, comp) GROUP BY vox)
SELECT vox, {r('CASE WHEN stat IS NOT NULL THEN coalesce(v, 0) END', 'tfce')} FROM im LEFT JOIN ts USING (vox)""",
        "grid_smooth": smoothing_sql(),
        "grid_inflate": f"WITH {GRID} SELECT DISTINCT b.vox, b.i, b.j FROM cells a JOIN cells b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 WHERE a.val >= (SELECT quantile_cont(val, 0.9) FROM cells)",
        "grid_bbox": f"WITH {GRID} SELECT min(i) AS lo_i, max(i) AS hi_i, min(j) AS lo_j, max(j) AS hi_j FROM over_mid",
        "entropy_bits": f"SELECT {r('coalesce(-sum(p * log2(p)), 0)', 'entropy')} FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM customer WHERE c_nationkey >= 0 GROUP BY c_nationkey)",
    }
