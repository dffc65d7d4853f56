"""SQL of those queries that SQL can express. The others are tested against brute force."""

from __future__ import annotations

from .queries import RULES
from .url_filter import LEAST_CORRELATION, MOST_CORRELATION, TWO_LABELS, rule_sql

TWO = f"regexp_matches(pair, '{TWO_LABELS}')"


def level(groups: str, keys: str, parent: str) -> str:
    """Strength and posterior mean of one level, as CTEs <groups>_s and <groups>_m."""
    correlation = f"greatest({LEAST_CORRELATION}, least({MOST_CORRELATION}, coalesce(sum((good - n * {parent}) ** 2 - n * {parent} * (1 - {parent})) / nullif(sum(n * (n - 1) * {parent} * (1 - {parent})), 0), {LEAST_CORRELATION})))"
    return f"""{groups}_s AS (SELECT 1 / {correlation} - 1 AS strength FROM {groups}),
{groups}_m AS (SELECT {keys}, n, strength, (good + strength * {parent}) / (n + strength) AS mean FROM {groups} CROSS JOIN {groups}_s)"""


URLS = r"regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {})"
OP1 = f"""WITH u AS (SELECT page_id, translate(coalesce({URLS.format(1)}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce({URLS.format(2)}, '') AS path FROM pages),
h AS (SELECT host, count(quality) AS n, coalesce(sum(quality), 0) AS good FROM u LEFT JOIN labels ON page_id = doc_id GROUP BY host),
l AS (SELECT *, string_split(host, '.') AS p, array_to_string(string_split(host, '.')[-2:], '.') AS pair FROM h),
nm AS (SELECT host, n, good, CASE WHEN {TWO} THEN pair ELSE p[-1] END AS suffix, CASE WHEN {TWO} THEN array_to_string(p[-3:], '.') ELSE pair END AS dom FROM l),
a AS (SELECT coalesce(sum(good) / nullif(sum(n), 0), 0.5) AS pm FROM h),
su AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(pm) AS pm FROM nm CROSS JOIN a GROUP BY suffix),
{level("su", "suffix", "pm")},
dm AS (SELECT nm.dom, nm.suffix, sum(nm.n) AS n, sum(nm.good) AS good, any_value(su_m.mean) AS pm FROM nm JOIN su_m USING (suffix) GROUP BY 1, 2),
{level("dm", "dom", "pm")},
ho AS (SELECT host, nm.n, nm.good, dm_m.mean AS pm FROM nm JOIN dm_m USING (dom)),
{level("ho", "host", "pm")},
v AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + strength + 1)) AS bound FROM ho_m),
f AS (SELECT page_id, host, path, bound, {rule_sql(RULES)} AS fit FROM u JOIN v USING (host))
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.action, CASE WHEN bound >= 0.7 THEN 'allow' ELSE 'block' END) AS verdict FROM f"""
#: White space goes, letter by letter, as in the operator.
PLAIN = "translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"
OP3 = f"""WITH t AS (SELECT doc_id, {PLAIN} AS plain, length(coalesce(text, '')) AS points FROM documents),
k AS (SELECT plain, arg_min(doc_id, struct_pack(a := -points, b := doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM t JOIN k USING (plain)"""
#: The table of the crc's 256 bytes is made by its rule; a text's bytes are folded one by one.
OP9 = """WITH RECURSIVE bit(n, c, k) AS (SELECT n, n, 0 FROM range(256) r(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS step FROM bit WHERE k = 8),
t AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, n + 8 AS size, CASE WHEN n = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: CAST(('0x' || substr(hex(text), 2 * i + 1, 2)) AS BIGINT))), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1]))) END AS text_crc32 FROM t CROSS JOIN crc),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM b),
s AS (SELECT doc_id, size, text_crc32, CAST(least(23, (2 * before + size) * 24 // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

OP7 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON r.doc_id = e.u)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""

#: Every string of 100 bytes by its digest; those that also start earlier, as runs that overlap or touch; what is left of each text.
OP8 = """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, i, md5(b[i + 1:i + 100]) AS s FROM t, unnest(range(n - 99)) u(i) WHERE n >= 100),
e AS (SELECT s, min({'d': doc_id, 'i': i}) AS first FROM p GROUP BY s HAVING count(*) > 1),
l AS (SELECT doc_id, i FROM p JOIN e USING (s) WHERE doc_id <> first.d OR i <> first.i),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM l)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, run),
c AS (SELECT doc_id, list(struct_pack(a := a, z := z) ORDER BY a) AS runs, CAST(sum(z - a) AS BIGINT) AS gone, count(*) AS spans FROM r GROUP BY doc_id),
k AS (SELECT t.doc_id, n, coalesce(gone, 0) AS gone, coalesce(spans, 0) AS spans, CASE WHEN runs IS NULL THEN hex(b) ELSE array_to_string(list_transform(range(len(runs) + 1), lambda j: hex(b[CASE WHEN j = 0 THEN 0 ELSE runs[j].z END + 1:CASE WHEN j = len(runs) THEN n ELSE runs[j + 1].a END])), '') END AS kept FROM t LEFT JOIN c USING (doc_id))
SELECT doc_id, n AS n_bytes, gone AS n_removed, spans AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op3_exact_dedup": OP3, "op7_jaccard_join": OP7, "op8_suffix_dedup": OP8, "op9_sharding": OP9}
