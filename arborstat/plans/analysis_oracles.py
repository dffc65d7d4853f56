"""The SQL that the queries of `analysis`, and the fits that SQL can express, are checked against.

Seeded draws are part of a query's definition, so their numbers stand in the SQL as values: those of NumPy's generator
for the 83 months that the tables hold.
"""

from __future__ import annotations

import numpy as np

from .analysis import BOOTSTRAP, BOOTSTRAP_SEED, DESIGN_SEED, INNER_COUNTS, STATUSES
from .oracles import DRAWS, GRID, NODES, PANEL, PERMS, TARGET, components, r
from .reporting_oracles import CONFUSION, EDGES, FIRST, MEANS, REGIONS, TRIALS

MONTHS, N_PERM, TAIL = 83, 99, 0.001
PLACES = "places AS (SELECT tree.*, (vox - 1) // 10 AS i, (vox - 1) % 10 AS j FROM tree)"
SCORED = f"""WITH {PANEL}, v AS (SELECT tree.region AS exp_id, nation, vox, s_acctbal < 0 AS t1, {TARGET} AS t0 FROM tree JOIN supplier ON vox = s_suppkey),
w AS (SELECT *, t0 OR t1 AS t, nation % 2 = 0 AS p FROM v)"""
RECORDS = f"""{SCORED}, rec AS (SELECT exp_id, nation AS region, count(*) AS num_vox, max((nation + 1) * 0.01) AS pval, count(*) FILTER (t) AS target, count(*) FILTER (t0) AS target0, count(*) FILTER (t1) AS target1 FROM w WHERE p GROUP BY 1, 2)"""


def four(pred: str, target: str, suffix: str = "") -> str:
    cells = {"tp": (1, 1), "fp": (1, 0), "fn": (0, 1), "tn": (0, 0)}
    return ", ".join(f"count(*) FILTER ({'' if a else 'NOT '}{pred} AND {'' if b else 'NOT '}{target}) AS {n}{suffix}" for n, (a, b) in cells.items())


def values(name: str, columns: str, rows: list[str]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join(rows)})"


def bootstrap_sql() -> str:
    drawn = np.random.default_rng(BOOTSTRAP_SEED).choice(MONTHS, BOOTSTRAP, replace=True)
    return values("boot", "img, old", [f"({k}, {old})" for k, old in enumerate(drawn.tolist())])


def design_sql() -> str:
    x = np.random.default_rng(DESIGN_SEED).standard_normal((2, MONTHS))
    rows = [f"(0, {i}, 1.0::DOUBLE, false)" for i in range(MONTHS)] + [f"({k + 1}, {i}, {float(x[k, i])!r}::DOUBLE, true)" for k in range(2) for i in range(MONTHS)]
    return f"WITH {values('d', 'reg, img, x, interest', rows)} SELECT CAST(reg AS INTEGER) AS reg, CAST(img AS INTEGER) AS img, {r('x')}, interest FROM d"


def moved(n_perm: int) -> str:
    """basis(k, img, w): the trend where draw k of the seeded permutations puts it; k = 0 is as it stands."""
    rows = []
    for k in range(n_perm + 1):
        order = np.arange(MONTHS) if k == 0 else np.argsort(np.random.default_rng(k).permutation(MONTHS))
        back = np.empty(MONTHS, int)
        back[order] = np.arange(MONTHS)
        rows.append(f"({k}, {back.tolist()})")
    return f"""n AS (SELECT count(*) AS n FROM months), {values('orders_of', 'k, places', rows)},
basis AS (SELECT k, u.img, (places[u.img + 1] - (n - 1) / 2.0) / sqrt(n * (n * n - 1) / 12.0) AS w FROM orders_of, n, (SELECT unnest(range({MONTHS})) AS img) u)"""


#: The suppliers with a planted trend, as the fits take them.
PLANTED = f"{PLACES}, data AS (SELECT panel.vox, img, i, j, qty + CASE WHEN i < 4 AND j < 4 THEN 0.1 * img ELSE 0 END AS qty FROM panel JOIN (SELECT DISTINCT vox, (vox - 1) // 10 AS i, (vox - 1) % 10 AS j FROM panel) USING (vox))"
VOXEL_WALK = f"""WITH RECURSIVE {PANEL}, {PLANTED}, {moved(N_PERM)},
fix AS (SELECT vox, any_value(i) AS i, any_value(j) AS j, sum(qty) / sqrt(max(n)) AS a0, sum(qty * qty) AS t FROM data CROSS JOIN n GROUP BY vox),
walk AS (SELECT vox, k, sum(qty * w) AS p FROM data JOIN basis USING (img) GROUP BY vox, k),
stats AS (SELECT k, vox, i, j, p * p / nullif(t - a0 * a0 - p * p, 0) AS stat FROM walk JOIN fix USING (vox))"""


def p_of(value: str, null: str) -> str:
    return f"greatest((SELECT count(*) FROM {null} WHERE max_stat >= {value}) / (SELECT count(*) FROM {null}), 1.0 / (SELECT count(*) FROM {null}))"


def fits_sql() -> dict[str, str]:
    return {
        "voxel_fit": f"""{VOXEL_WALK}, nul AS (SELECT k, max(stat) AS max_stat FROM stats GROUP BY k),
found AS (SELECT vox, i, j, stat, {p_of('stat', 'nul')} AS pval FROM stats WHERE k = 0), sig AS (SELECT * FROM found WHERE pval <= 0.05), {components('sig')}
SELECT found.vox, {r('stat')}, {r('pval')}, pval <= 0.05 AS sig, comp AS effect FROM found LEFT JOIN comps USING (vox)""",
        "cluster_fit": f"""{VOXEL_WALK}, cut AS (SELECT quantile_cont(stat, {1 - TAIL}) AS cut FROM stats WHERE k > 0), ov AS (SELECT * FROM stats CROSS JOIN cut WHERE stat >= cut),
near AS (SELECT a.k, a.vox AS u, b.vox AS v FROM ov a JOIN ov b ON a.k = b.k AND abs(a.i - b.i) + abs(a.j - b.j) = 1),
spread AS (SELECT k, vox, vox AS comp FROM ov UNION SELECT s.k, e.v AS vox, s.comp FROM spread s JOIN near e ON s.vox = e.u AND s.k = e.k),
held_in AS (SELECT k, vox, min(comp) AS comp FROM spread GROUP BY 1, 2), extents AS (SELECT k, vox, count(*) OVER (PARTITION BY k, comp) AS extent FROM held_in),
nul AS (SELECT d.k, coalesce(max(extent), 0) AS max_stat FROM (SELECT DISTINCT k FROM stats) d LEFT JOIN extents USING (k) GROUP BY d.k),
found AS (SELECT s.vox, s.i, s.j, coalesce(extent, 0) AS extent, {p_of('coalesce(extent, 0)', 'nul')} AS pval FROM stats s LEFT JOIN extents e ON s.vox = e.vox AND e.k = 0 WHERE s.k = 0), sig AS (SELECT * FROM found WHERE pval <= 0.05), {components('sig')}
SELECT found.vox, CAST(extent AS DOUBLE) AS extent, {r('pval')}, pval <= 0.05 AS sig, comp AS effect FROM found LEFT JOIN comps USING (vox)""",
        "oracle_fit": f"""WITH {PANEL}, {PLANTED}, {moved(N_PERM)}, lab AS (SELECT *, CASE WHEN i < 4 AND j < 4 THEN 0 ELSE 1 END AS label FROM data),
sums AS (SELECT label, img, sum(qty) AS s, count(*) AS size, sum(qty * qty) AS t FROM lab GROUP BY 1, 2),
fix AS (SELECT label, max(size) AS size, sum(s) / sqrt(max(n)) AS a0, sum(t) AS t FROM sums CROSS JOIN n GROUP BY label),
walk AS (SELECT label, k, sum(s * w) AS p FROM sums JOIN basis USING (img) GROUP BY 1, 2),
dr AS (SELECT label, k, 0.5 * size * (ln(t - a0 * a0 / size) - ln(t - a0 * a0 / size - p * p / size)) AS llr FROM walk JOIN fix USING (label)),
zz AS (SELECT *, (llr - avg(llr) OVER w) / stddev_samp(llr) OVER w AS z FROM dr WINDOW w AS (PARTITION BY label)), nul AS (SELECT k, max(z) AS max_stat FROM zz GROUP BY k),
f AS (SELECT label, llr, z, {p_of('z', 'nul')} AS pval FROM zz WHERE k = 0) SELECT 'demo' AS exp_id, CAST(label AS BIGINT) AS label, {r('llr')}, {r('z')}, {r('pval')}, pval <= 0.05 AS sig FROM f""",
    }


def oracle_sql() -> dict[str, str]:
    with_draws = f"WITH {PANEL}, {PERMS}, {DRAWS}"
    years, status = "CAST(year(o_orderdate) AS INTEGER)", f"list_position({list(STATUSES)!r}, stat)"
    return fits_sql() | {
        "image_bootstrap": f"WITH {PANEL}, {bootstrap_sql()} SELECT vox, CAST(boot.img AS INTEGER) AS img, {r('qty')}, {r('price')} FROM boot JOIN panel ON panel.img = old",
        "design_sample": design_sql(),
        "backgrounds": f"""WITH {PANEL}, m AS (SELECT vox, avg(qty) AS qty, avg(price) AS price FROM panel GROUP BY vox)
SELECT vox, {r('qty')}, {r('price')}, {r('min(qty) OVER ()', 'qty_low')}, {r('max(qty) OVER ()', 'qty_high')}, {r('min(price) OVER ()', 'price_low')}, {r('max(price) OVER ()', 'price_high')} FROM m""",
        "mask_restrict": f"WITH {PANEL}, {PLACES} SELECT row_number() OVER (ORDER BY i, j) - 1 AS vox, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM places WHERE {TARGET}",
        "whitened_pair": f"""WITH {PANEL}, m AS (SELECT avg(qty) AS a, stddev_samp(qty) AS sa, avg(price) AS b, stddev_samp(price) AS sb, CASE WHEN corr(qty, price) < 0 THEN -1 ELSE 1 END AS s FROM panel)
SELECT vox, img, {r('abs((qty - a) / sa - s * (price - b) / sb) / sqrt(2)', 'first')}, {r('abs((qty - a) / sa + s * (price - b) / sb) / sqrt(2)', 'second')}, {r('qty')} FROM panel CROSS JOIN m""",
        "inflate_replay": f"""WITH {PANEL}, {PLACES}, kept AS (SELECT * FROM places WHERE region = 1), grown AS (SELECT DISTINCT b.vox FROM kept a JOIN places b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1)
SELECT CAST(any_value(i) AS INTEGER) AS i, CAST(any_value(j) AS INTEGER) AS j, {r(f'sum(qty + CASE WHEN {TARGET} THEN 0.5 * img ELSE 0 END)', 'total')} FROM panel JOIN grown USING (vox) JOIN places USING (vox) GROUP BY vox""",
        "detection_score": f"""{SCORED}, s AS (SELECT exp_id, count(*) AS num_vox, {four('p', 't')}, {four('p', 't0', '0')}, {four('p', 't1', '1')}, count(DISTINCT nation) FILTER (p) AS n_pred, min((nation + 1) * 0.01) FILTER (nation % 5 <> 0) AS min_pval FROM w GROUP BY exp_id)
SELECT * REPLACE ({r('CAST(min_pval AS DOUBLE)', 'min_pval')}) FROM s""",
        "detection_regions": f"{RECORDS} SELECT exp_id, region, num_vox, {r('CAST(pval AS DOUBLE)', 'pval')}, target, target0, target1 FROM rec",
        "pred_rectangle": f"""{RECORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY region) - 1 AS place FROM rec), e AS (SELECT DISTINCT exp_id FROM w)
SELECT e.exp_id, CAST(a.place AS INTEGER) AS place, num_vox AS value FROM e CROSS JOIN (SELECT DISTINCT place FROM o) a LEFT JOIN o ON o.exp_id = e.exp_id AND o.place = a.place""",
        "max_z_region": f"""{CONFUSION}, {PERMS}, {DRAWS}, zr AS (SELECT level, region, nation, vox, {r('z')} FROM zs WHERE k = 0)
SELECT d.level, d.region, d.nation, d.vox, d.tp + d.fp AS size, z, d.tp, d.fp, d.fn, d.tn FROM d JOIN zr ON d.level = zr.level AND d.region IS NOT DISTINCT FROM zr.region AND d.nation IS NOT DISTINCT FROM zr.nation AND d.vox IS NOT DISTINCT FROM zr.vox
WHERE d.tp + d.fp >= 2 AND z IS NOT NULL ORDER BY z DESC, d.level, coalesce(d.region, -1), coalesce(d.nation, -1), coalesce(d.vox, -1) LIMIT 1""",
        "target_stats": f"""WITH {PANEL}, {NODES}, o AS (SELECT count(*) AS size, sum(a0) AS a0, sum(a1) AS a1, sum(t) AS t FROM proj JOIN tree USING (vox) WHERE {TARGET})
SELECT size AS n_voxel, {r('0.5 * size * (ln(t - a0 * a0 / size) - ln(t - a0 * a0 / size - a1 * a1 / size))', 'llr')}, 1.0::DOUBLE AS dice, 1.0::DOUBLE AS sens, 1.0::DOUBLE AS ppv, 1.0::DOUBLE AS spec, size AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, (SELECT count(*) FROM tree) - size AS tn FROM o""",
        "planted_labels": f"""WITH {PANEL}, l AS (SELECT vox, CASE WHEN nation IN (3, 4) THEN 1 WHEN region = 1 THEN 0 ELSE 3 END AS raw FROM tree), d AS (SELECT vox, dense_rank() OVER (ORDER BY raw) - 1 AS label FROM l)
SELECT CAST(label AS INTEGER) AS label, count(*) AS n, string_agg(vox::VARCHAR, ',' ORDER BY vox) AS voxels FROM d GROUP BY label""",
        "mask_algebra": f"""WITH {PANEL} SELECT 'union' AS op, vox FROM tree WHERE region = 1 OR nation IN (3, 4, 8) OR vox % 4 = 0 UNION ALL SELECT 'intersection', vox FROM tree WHERE region = 1 AND vox % 4 = 0
UNION ALL SELECT 'difference', vox FROM tree WHERE region = 1 AND nation NOT IN (3, 4, 8) AND vox % 4 <> 0""",
        "region_regression": f"""WITH {PANEL}, m AS (SELECT nation, img, avg(qty) AS mean, stddev_pop(qty) AS sd FROM panel JOIN tree USING (vox) GROUP BY 1, 2)
SELECT nation, count(*) AS n, {r('regr_slope(mean, img)', 'slope')}, {r('regr_intercept(mean, img)', 'intercept')}, {r('CASE WHEN stddev_pop(mean) <> 0 THEN regr_r2(mean, img) END', 'r2')}, {r('avg(sd)', 'spread')} FROM m GROUP BY nation""",
        "drift_report": f"""WITH {PANEL}, {NODES}, l AS (SELECT level, CASE WHEN e > 0 AND e + h > 0 THEN 0.5 * size * (ln(e + h) - ln(e)) END AS a FROM eh), b AS (SELECT *, CASE WHEN level <> 1 THEN a * 1.0001 END AS b, round(1 / (1 + a), 2) AS p, round(1 / (1 + 1.05 * a), 2) AS q FROM l)
SELECT {r('max(abs(a - b) / greatest(abs(a), 1e-12))', 'stat_rel')}, count(*) FILTER (level = 1 OR p IS DISTINCT FROM q) AS n_flip, count(*) AS n, {r('max(a)', 'max_ref')}, {r('max(b)', 'max_got')}, {r('avg(CAST(b IS NOT NULL AS INTEGER))', 'known')} FROM b""",
        "difference_band": f"""WITH {MEANS}, p AS (SELECT seed, x, max(metric) FILTER (method = {FIRST}) AS own, max(metric) FILTER (method <> {FIRST}) AS best FROM means GROUP BY seed, x)
SELECT x, count(*) AS n, {r('median(own - best)', 'median')}, {r('quantile_cont(own - best, 0.25)', 'low')}, {r('quantile_cont(own - best, 0.75)', 'high')} FROM p WHERE own - best IS NOT NULL GROUP BY x""",
        "rate_line": f"WITH {TRIALS} SELECT method, x, {r('100 * avg(CAST(metric > 250 AS INTEGER))', 'rate')}, count(*) AS n FROM trials GROUP BY 1, 2",
        "seed_medians": f"WITH {MEANS} SELECT method, x, count(*) AS n_seed, {r('median(metric)', 'median')} FROM means GROUP BY 1, 2",
        "precision_parts": f"""{REGIONS}, s AS (SELECT nation % 7 AS trial, CAST(sum(o) AS BIGINT) AS tp, CAST(sum(n - o) AS BIGINT) AS fp, CAST(max(nation) AS BIGINT) AS fn, CAST(coalesce(sum(n - o) FILTER (o > 0), 0) AS BIGINT) AS leaked, CAST(coalesce(sum(n - o) FILTER (o = 0), 0) AS BIGINT) AS spurious FROM g GROUP BY 1)
SELECT *, tp + fp AS pred_vol, tp + fn AS true_vol, {r('1.0 * leaked / nullif(tp + fn, 0)', 'vol_leak')}, {r('1.0 * spurious / nullif(tp + fn, 0)', 'vol_spur')}, {r('1.0 * fp / nullif(tp + fn, 0)', 'vol_fp')}, {r('1.0 * tp / nullif(tp + spurious, 0)', 'ppv_noleak')}, {r('1.0 * tp / nullif(tp + leaked, 0)', 'ppv_nospur')},
CASE WHEN leaked > 0 AND spurious > 0 THEN 'both' WHEN leaked > 0 THEN 'over-inclusion' WHEN spurious > 0 THEN 'spurious' ELSE 'none' END AS mechanism FROM s WHERE tp + fp > 0""",
        "runtime_summary": f"""WITH p AS (SELECT l_returnflag, l_quantity AS x, median(l_extendedprice) / 60 AS median, min(l_extendedprice) / 60 AS low, max(l_extendedprice) / 60 AS high FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_returnflag, CASE WHEN (SELECT max(l_quantity) / greatest(min(l_quantity), 1) FROM lineitem) >= 10 THEN regr_slope(log10(median), log10(x)) END AS slope FROM (SELECT *, max(x) OVER (PARTITION BY l_returnflag) AS top FROM p) WHERE x >= top / 10 GROUP BY 1)
SELECT l_returnflag, x, {r('median')}, {r('low')}, {r('high')}, {r('slope')} FROM p JOIN s USING (l_returnflag)""",
        "deepest_agreement": f"""WITH o AS (SELECT o_custkey % 20 AS seed, CASE WHEN o_custkey % 4 <> 0 THEN {years} END AS x, o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 3 END AS reg FROM orders)
SELECT *, reg IS NOT DISTINCT FROM last_value(reg) OVER (PARTITION BY seed, x ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS agree FROM o""",
        "stability_table": f"""WITH t AS (SELECT o_custkey % 20 AS seed, {years} AS x, o_totalprice / 1000 AS metric, o_orderkey % 5 + 1 AS m FROM orders)
SELECT x, m, {r('avg(metric)', 'metric')}, {r('avg(CAST(metric > 200 AS INTEGER))', 'sig')}, count(DISTINCT seed) AS n_seed, {r('m / sqrt(m + 1)', 'z_ceiling')} FROM t GROUP BY x, m""",
        "wide_metrics": f"""WITH {TRIALS} SELECT x, method, {r('avg(metric)', 'own_level')}, {r('max(metric)', 'level_other')}, {r('CASE WHEN x <> 1996 THEN stddev_samp(metric) END', 'own_spread')}, {r('CASE WHEN x <> 1996 THEN min(metric) END', 'spread_other')} FROM trials GROUP BY x, method""",
        "width_table": f"""WITH m AS (SELECT o_orderstatus, o_orderpriority AS method, {years} AS width, avg(floor(o_totalprice / 400000)) AS mean FROM orders GROUP BY ALL),
b AS (SELECT o_orderstatus, method, width FROM m QUALIFY row_number() OVER (PARTITION BY o_orderstatus, method ORDER BY mean DESC, width) = 1), k AS (SELECT method, row_number() OVER (ORDER BY method) - 1 AS place FROM (SELECT DISTINCT method FROM b))
SELECT o_orderstatus, {', '.join(f'max(width) FILTER (place = {i}) AS w{i}' for i in range(5))} FROM b JOIN k USING (method) GROUP BY 1""",
        "tune_ties": f"""WITH v AS (SELECT o_orderpriority AS method, CASE WHEN o_custkey % 2 = 0 THEN 'raw' ELSE 'z' END AS zt, o_orderstatus AS stat, {years} AS fwhm FROM orders),
m AS (SELECT DISTINCT *, CASE WHEN method = '1-URGENT' THEN fwhm % 3 + CASE WHEN stat = 'F' THEN 0.5 ELSE 0 END ELSE fwhm % 2 END AS mean FROM v), n AS (SELECT *, count(*) OVER (PARTITION BY method) AS tied FROM (SELECT * FROM m QUALIFY mean = max(mean) OVER (PARTITION BY method))),
ref AS (SELECT stat AS ref FROM n WHERE method = '1-URGENT' ORDER BY fwhm, {status}, zt <> 'raw' LIMIT 1)
SELECT method, zt, stat, fwhm, tied FROM n CROSS JOIN ref QUALIFY row_number() OVER (PARTITION BY method ORDER BY method <> '1-URGENT' AND stat <> ref, fwhm, {status}, zt <> 'raw') = 1""",
        "matched_metric": f"""WITH c AS (SELECT l_returnflag, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2), s AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM c WINDOW w AS (PARTITION BY l_returnflag ORDER BY x)),
a AS (SELECT *, CASE WHEN x = 20.25 THEN y WHEN x0 < 20.25 AND x > 20.25 THEN y0 + (20.25 - x0) / (x - x0) * (y - y0) END AS met FROM s) SELECT l_returnflag, {r('arg_min(met, x) FILTER (met IS NOT NULL)', 'y')} FROM a GROUP BY 1""",
        "feature_columns": "SELECT * FROM (VALUES ('generic', 's_acctbal'), ('pruning', 'gain_sum'), ('significance', 's_name'), ('significance', 's_nationkey')) t(grp, name)",
        "visible_rows": "SELECT s_suppkey, s_acctbal, s_nationkey AS n_voxel FROM supplier WHERE s_acctbal > 0 AND s_nationkey >= 5",
        "swept_axis": f"WITH {TRIALS} SELECT 'x_num_img' || (x % 3)::VARCHAR AS label, count(*) AS n FROM trials GROUP BY 1",
        "tidy_frame": "SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'first' WHEN '5-LOW' THEN 'last' ELSE o_orderpriority END AS label, TRY_CAST(o_orderstatus AS INTEGER) AS status, CAST(trunc(o_totalprice) AS BIGINT) AS price, o_orderkey AS key, CAST(NULL AS DOUBLE) AS absent FROM orders",
        "method_order": "SELECT method, CAST(row_number() OVER (ORDER BY CASE method WHEN '5-LOW' THEN 0 WHEN '2-HIGH' THEN 1 WHEN 'none' THEN 2 ELSE 3 END, method) AS INTEGER) AS place FROM (SELECT DISTINCT o_orderpriority AS method FROM orders)",
        "region_extras": f"{REGIONS}, x AS (SELECT nation, max(price) AS top_price FROM panel JOIN tree USING (vox) WHERE nation % 3 = 0 GROUP BY 1) SELECT g.*, {r('top_price')} FROM g LEFT JOIN x USING (nation)",
        "leaf_costs": f"""WITH t AS (SELECT l_orderkey AS cell, l_linenumber AS leaf, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS s, l_tax FROM lineitem)
SELECT cell, leaf, {r('coalesce(s, max(s) OVER (PARTITION BY cell), 0) + CASE WHEN cell % 2 = 0 THEN 0 ELSE coalesce(CASE WHEN cell % 3 <> 0 THEN l_tax END, 0) END', 'cost')} FROM t""",
        "merged_moments": f"SELECT l_returnflag, count(l_extendedprice) AS n, {r('avg(l_extendedprice)', 'mean')}, {r('stddev_samp(l_extendedprice)', 'std')} FROM lineitem GROUP BY 1",
        "draw_summary": f"""{with_draws} SELECT d.level, d.region, d.nation, d.vox, {r('stat')}, {r('mu')}, {r('sd', 'std')}, {r('(stat - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END', 'z')} FROM draws d JOIN moments m
ON d.level = m.level AND d.region IS NOT DISTINCT FROM m.region AND d.nation IS NOT DISTINCT FROM m.nation AND d.vox IS NOT DISTINCT FROM m.vox WHERE k = 0""",
        "inner_count_sweep": f"""{with_draws}, c AS (SELECT unnest({list(INNER_COUNTS)!r}) AS m)
SELECT level, region, nation, vox, CAST(m AS INTEGER) AS m, {r('(max(stat) FILTER (k = 0) - avg(stat)) / CASE WHEN stddev_samp(stat) > 1e-12 THEN stddev_samp(stat) ELSE 1 END', 'z')} FROM draws JOIN c ON k <= m GROUP BY level, region, nation, vox, m""",
        "walk_statistics": f"""WITH {PANEL}, {PERMS}, {DRAWS}, w AS (SELECT k, vox, p * p AS h, t - a0 * a0 - p * p AS e FROM vdraw JOIN vfix USING (vox) WHERE k < 10)
""" + " UNION ALL ".join(f"SELECT k, vox, '{n}' AS statistic, {r(v, 'value')} FROM w" for n, v in {"llr": "CASE WHEN e > 0 AND e + h > 0 THEN 0.5 * (ln(e + h) - ln(e)) END", "wilks": "CASE WHEN e > 0 AND e + h > 0 THEN 1 - e / (e + h) END", "pillai": "h / nullif(h + e, 0)", "hotelling": "h / nullif(e, 0)", "roy": "h / nullif(e, 0)"}.items()),
        "validation_order": """WITH j AS (SELECT c_custkey::VARCHAR AS uid, c_mktsegment AS cache, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3:' || c_custkey::VARCHAR), c_custkey::VARCHAR) AS turn FROM customer)
SELECT uid, cache, CAST(row_number() OVER (ORDER BY turn, list_position(['MACHINERY', 'BUILDING', 'AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD'], cache)) - 1 AS INTEGER) AS place FROM j""",
        "cache_members": "SELECT 'o' || o_orderkey AS uid, CASE WHEN o_orderkey % 2 = 0 THEN 'stat' ELSE 'segment' END AS function FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)",
        "leaves_by_cell": f"SELECT 'c' || o_custkey AS cell, count(*) AS n, {r('max(o_totalprice / 1000)', 'longest')} FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1",
        "grid_product": "SELECT r_regionkey, source, llr, CAST(row_number() OVER (ORDER BY r_regionkey, a, llr) - 1 AS INTEGER) AS position FROM region, (VALUES (0, 'wgn'), (1, 'hcp')) s(a, source), (VALUES (0.5::DOUBLE), (1.0), (2.0)) l(llr)",
        "export_manifest": f"""WITH {EDGES}, c AS (SELECT 'c' || c_custkey AS uid, c_mktsegment AS cache FROM customer WHERE c_acctbal > 9000), n AS (SELECT DISTINCT e.parent AS uid, cache FROM c JOIN edges e USING (uid)), g AS (SELECT DISTINCT e.parent AS uid, cache FROM n JOIN edges e USING (uid))
SELECT cache, function, count(*) AS n FROM (SELECT cache, 'customer' AS function FROM c UNION ALL SELECT cache, 'nation' FROM n UNION ALL SELECT cache, 'region' FROM g) GROUP BY 1, 2""",
        "value_hashes": f"WITH {PANEL} SELECT vox, sha256(string_agg(CAST(round(qty * 100) AS BIGINT)::VARCHAR, ',' ORDER BY img)) AS digest FROM panel GROUP BY vox",
        "volume_scatter": f"""WITH {GRID}, b AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM over_mid)
SELECT CAST(c.i - i0 AS INTEGER) AS i, CAST(c.j - j0 AS INTEGER) AS j, {r('coalesce(o.val, -1)', 'val')} FROM cells c CROSS JOIN b LEFT JOIN over_mid o USING (vox) WHERE c.i BETWEEN i0 AND i1 AND c.j BETWEEN j0 AND j1""",
        "volume_gather": f"WITH {GRID} SELECT c.vox, {r('coalesce(o.val, 0)', 'val')} FROM cells c LEFT JOIN over_mid o USING (vox)",
    }
