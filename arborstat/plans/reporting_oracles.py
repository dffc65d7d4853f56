"""The SQL that the reporting queries are checked against."""

from __future__ import annotations

from .oracles import LEVEL, PANEL, TARGET, r

TRIALS = "trials AS (SELECT o_orderpriority AS method, o_custkey % 20 AS seed, CAST(year(o_orderdate) AS INTEGER) AS x, o_totalprice / 1000 AS metric FROM orders)"
MEANS = f"{TRIALS}, means AS (SELECT method, seed, x, avg(metric) AS metric FROM trials GROUP BY ALL)"
FIRST = "(SELECT min(method) FROM trials)"
CONFUSION = f"""WITH {PANEL}, c AS (SELECT {LEVEL}, region, nation, vox, count(*) FILTER ({TARGET}) AS tp, count(*) FILTER (NOT {TARGET}) AS fp FROM tree GROUP BY ROLLUP (region, nation, vox)),
f AS (SELECT *, (SELECT count(*) FROM tree WHERE {TARGET}) - tp AS fn, (SELECT count(*) FROM tree WHERE NOT {TARGET}) - fp AS tn FROM c), d AS (SELECT *, 2.0 * tp / (2 * tp + fp + fn) AS dice FROM f)"""
EDGES = """edges AS (SELECT 'n' || n_nationkey AS uid, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""
REGIONS = f"WITH {PANEL}, g AS (SELECT region AS key, nation, count(*) AS n, count(*) FILTER (s_acctbal < 0) AS o FROM supplier JOIN tree ON s_suppkey = vox GROUP BY 1, 2)"


def h(a: str, b: str) -> str:
    p = f"({a} * 1.0 / nullif({b}, 0))"
    return f"coalesce(CASE WHEN {p} > 0 THEN -{p} * log2({p}) ELSE 0 END, 0)"


def oracle_sql() -> dict[str, str]:
    return {
        "sem_band": f"WITH {TRIALS} SELECT method, x, count(metric) AS n, {r('avg(metric)', 'mean')}, {r('avg(metric) - 1.96 * stddev_samp(metric) / sqrt(count(metric))', 'low')}, {r('avg(metric) + 1.96 * stddev_samp(metric) / sqrt(count(metric))', 'high')} FROM trials GROUP BY method, x",
        "percentile_band": f"WITH {TRIALS} SELECT method, x, {r('avg(metric)', 'mean')}, {r('quantile_cont(metric, 0.025)', 'low')}, {r('quantile_cont(metric, 0.975)', 'high')} FROM trials GROUP BY method, x",
        "head_to_head": f"""WITH {MEANS}, p AS (SELECT seed, x, max(metric) FILTER (method = {FIRST}) AS own, max(metric) FILTER (method <> {FIRST}) AS best_other FROM means GROUP BY seed, x)
SELECT seed, x, {r('own')}, {r('best_other')}, {r('own - best_other', 'diff')}, CAST(own > best_other AS INTEGER) AS win FROM p""",
        "win_rates": f"WITH {MEANS} SELECT a.x, b.method, {r('avg(CAST(a.metric > b.metric AS INTEGER))', 'rate')}, count(*) AS n FROM means a JOIN means b ON a.seed = b.seed AND a.x = b.x WHERE a.method = {FIRST} AND b.method <> {FIRST} GROUP BY a.x, b.method",
        "discovery_threshold": f"""WITH {PANEL}, c AS (SELECT nation, l_quantity AS x, avg(l_extendedprice / 1000) AS m FROM lineitem JOIN tree ON l_suppkey = vox GROUP BY 1, 2),
s AS (SELECT *, lag(m) OVER w AS m0, lag(x) OVER w AS x0 FROM c WINDOW w AS (PARTITION BY nation ORDER BY x)),
k AS (SELECT *, CASE WHEN m0 < 40 AND m >= 40 THEN pow(10, log10(x0) + (40 - m0) / (m - m0) * (log10(x) - log10(x0))) END AS cr FROM s),
o AS (SELECT nation, arg_min(m, x) AS first, arg_min(cr, x) FILTER (cr IS NOT NULL) AS reached FROM k GROUP BY nation)
SELECT nation, {r('CASE WHEN first < 40 THEN reached END', 'threshold')}, CASE WHEN first >= 40 THEN 'below' WHEN reached IS NULL THEN 'above' ELSE 'ok' END AS status FROM o""",
        "balanced_panel": f"WITH {MEANS} SELECT method, seed, x, {r('metric')} FROM means QUALIFY count(*) OVER (PARTITION BY seed, x) = (SELECT count(DISTINCT method) FROM trials)",
        "tie_table": f"""WITH {TRIALS}, g AS (SELECT method, seed, max(metric) - min(metric) AS gap FROM trials GROUP BY 1, 2)
SELECT method, count(*) AS n, {r('100 * avg(CAST(gap <= 1e-9 AS INTEGER))', 'ties')}, {r('100 * avg(CAST(gap > 400 AS INTEGER))', 'decisive')}, {r('avg(gap)', 'mean_gap')}, {r('median(gap)', 'median_gap')}, {r('max(gap)', 'max_gap')} FROM g GROUP BY method""",
        "tune_best": f"""WITH {TRIALS}, m AS (SELECT x, method, seed, round(avg(metric) / 50) AS metric FROM trials GROUP BY 1, 2, 3)
SELECT x, method, seed, metric FROM m QUALIFY row_number() OVER (PARTITION BY x ORDER BY metric DESC, method <> '2-HIGH', method, seed) = 1""",
        "loglog_slope": f"""WITH t AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_returnflag) AS top FROM lineitem)
SELECT l_returnflag, {r('regr_slope(log10(l_extendedprice), log10(l_quantity))', 'slope')}, count(*) AS n FROM t WHERE l_quantity >= top / 10 AND l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1""",
        "seed_pareto": f"""WITH {TRIALS}, t AS (SELECT seed, sum(metric) AS total FROM trials GROUP BY seed)
SELECT seed, {r('total')}, row_number() OVER w AS place, {r('total / sum(total) OVER ()', 'share')}, {r('sum(total) OVER (w ROWS UNBOUNDED PRECEDING) / sum(total) OVER ()', 'cumulative')} FROM t WINDOW w AS (ORDER BY total DESC, seed)""",
        "size_staircase": f"""WITH s AS (SELECT p_size, max(p_retailprice) AS z FROM part GROUP BY 1), b AS (SELECT p_size, max(z) OVER (ORDER BY p_size DESC) AS best FROM s)
SELECT p_size, {r('best')} FROM (SELECT *, lead(best) OVER (ORDER BY p_size) AS above FROM b) WHERE above IS NULL OR above <> best""",
        "min_size_cutoff": "WITH c AS (SELECT p_size, sum(count(*)) OVER (ORDER BY p_size DESC) AS kept FROM part GROUP BY p_size) SELECT coalesce(min(p_size) FILTER (kept <= 100), max(p_size) + 1) AS least FROM c",
        "common_bins": "WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT CAST(least(12, floor((c_acctbal - lo) / (hi - lo) * 12) + 1) AS INTEGER) AS bin, count(*) AS n FROM customer CROSS JOIN s WHERE hi > lo GROUP BY 1",
        "rejection_curve": f"SELECT alpha, {r('avg(CAST(l_discount <= alpha AS INTEGER))', 'rate')}, count(*) AS n FROM lineitem CROSS JOIN (SELECT unnest([0.01, 0.025, 0.05, 0.075]::DOUBLE[]) AS alpha) GROUP BY alpha",
        "rank_correlation": f"""WITH k AS (SELECT l_returnflag, l_quantity, l_discount, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT l_returnflag, {r('corr(l_quantity, l_discount)', 'pearson')}, {r('corr(a, b)', 'spearman')} FROM k GROUP BY 1""",
        "homogeneity": f"""{REGIONS}, t AS (SELECT *, n - o AS e, sum(n) OVER w AS tn, sum(o) OVER w AS tt, sum(n - o) OVER w AS te FROM g WINDOW w AS (PARTITION BY key)),
s AS (SELECT key, max({h('tt', 'tn')} + {h('te', 'tn')}) AS hc, sum(n / tn * ({h('o', 'n')} + {h('e', 'n')})) AS hck, sum({h('n', 'tn')}) AS hk, sum(tt / tn * {h('o', 'tt')} + te / tn * {h('e', 'te')}) AS hkc, max(tt) AS tt, max(tn) AS tn FROM t GROUP BY key)
SELECT key, {r('CASE WHEN tn > 0 AND tt > 0 THEN CASE WHEN hc > 0 THEN 1 - hck / hc ELSE 1 END END', 'hom')}, {r('CASE WHEN tn > 0 AND tt > 0 THEN CASE WHEN hk > 0 THEN 1 - hkc / hk ELSE 1 END END', 'com')} FROM s""",
        "fp_parts": f"{REGIONS} SELECT key, CAST(sum(n - o) AS BIGINT) AS fp, CAST(coalesce(sum(n - o) FILTER (o = 0), 0) AS BIGINT) AS spurious, CAST(coalesce(sum(n - o) FILTER (o > 0), 0) AS BIGINT) AS leaked FROM g GROUP BY key",
        "best_dice_node": f"{CONFUSION} SELECT level, region, nation, vox, tp, fp, fn, tn, {r('dice')} FROM d ORDER BY round(dice, 9) DESC, level, coalesce(region, -1), coalesce(nation, -1), coalesce(vox, -1) LIMIT 1",
        "region_centroids": f"WITH {PANEL} SELECT {LEVEL}, region, nation, vox, round(avg((vox_ - 1) // 10), 1) AS ci, round(avg((vox_ - 1) % 10), 1) AS cj FROM (SELECT *, vox AS vox_ FROM tree) GROUP BY ROLLUP (region, nation, vox)",
        "union_score": f"""WITH {PANEL}, t AS (SELECT region = 1 OR nation IN (3, 4) AS p, {TARGET} AS t FROM tree), c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM t)
SELECT tp, fp, fn, tn, {r('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'dice')}, {r('coalesce(1.0 * tp / nullif(tp + fn, 0), 0)', 'sens')}, {r('1.0 * tp / nullif(tp + fp, 0)', 'ppv')}, {r('1.0 * tn / nullif(tn + fp, 0)', 'spec')} FROM c""",
        "dag_ancestors": f"WITH RECURSIVE {EDGES}, up AS (SELECT uid, parent AS ancestor, 1 AS depth FROM edges UNION ALL SELECT up.uid, e.parent, depth + 1 FROM up JOIN edges e ON up.ancestor = e.uid) SELECT uid, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY uid, ancestor",
        "dag_flatten": "SELECT 'c' || c_custkey AS uid, c_name AS customer, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
        "cell_complete": """WITH d AS (SELECT c_custkey AS uid, c_nationkey AS cell FROM customer WHERE c_nationkey <= 8 OR c_acctbal < -900), h AS (SELECT o_custkey AS uid FROM orders WHERE o_totalprice > 440000 OR (o_orderstatus = 'F' AND o_custkey % 2 = 0))
SELECT cell, count(*) AS n, bool_and(uid IN (SELECT uid FROM h)) AS complete FROM d GROUP BY 1""",
        "todo_leaves": "SELECT c_custkey AS uid FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 440000)",
        "recipe_uid": """WITH u AS (SELECT c_custkey, substr(sha256('{"canon_version":1,"impl_version":0,"kwargs":{"kinds":["\\"a\\"","\\"b\\""],"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"},"op":"plant","parents":[]}'), 1, 32) AS uid FROM customer)
SELECT c_custkey, uid, CAST('0x' || right(sha256('seed:' || uid), 8) AS BIGINT) AS seed FROM u""",
        "latest_records": f"SELECT user_id, event_id, event_type, {r('value')} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "event_windows": f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    }
