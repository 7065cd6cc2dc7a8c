"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY 1),
lines AS (
  SELECT doc_id, source, line, regexp_extract_all(line, {WORD}) AS lw FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE len(lw) > 0 GROUP BY 1),
norm AS (
  SELECT doc_id, source, {LOWER("array_to_string(lw, ' ')")} AS h, sum(len(lw)) AS w FROM lines WHERE len(lw) > 0 GROUP BY ALL),
hosts AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
frequent AS (
  SELECT n.source, h FROM norm n JOIN hosts s ON n.source IS NOT DISTINCT FROM s.source
  GROUP BY n.source, h, s.n HAVING count(*) > 20 AND count(*) > s.n * 0.02),
gone AS (
  SELECT doc_id, count(*) AS n_removed_lines, sum(w) AS n_removed_words
  FROM norm n JOIN frequent f ON n.h = f.h AND n.source IS NOT DISTINCT FROM f.source GROUP BY 1),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_words, 0) AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= n_words * 0.5 AS kept FROM m
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER("coalesce(text, '')")}, {WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY 1),
same AS (SELECT doc_id, count(*) OVER (PARTITION BY h) AS class_size FROM (SELECT doc_id, md5(string_agg(sh, chr(10) ORDER BY sh)) AS h FROM s GROUP BY 1))
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, coalesce(class_size, 1) AS class_size
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of l ON l.a = d.doc_id LEFT JOIN same USING (doc_id)
"""

_TREE = (
    "list_transform(string_split({}, chr(10)), lambda l: list_transform(regexp_extract_all(l, '[^ ]+(?: +[^ ]+){{0,7}} *| +'), lambda p: substr(sha256(p), 1, 12)))"
).format


def _print(tree: str) -> str:
    branch = "coalesce(array_to_string(s, ','), '')"
    digest = f"substr(sha256({branch}), 1, 16)"
    return (
        f"sha256(array_to_string(list_transform({tree}, lambda s: {digest}), '')) || ':' || "
        f"array_to_string(list_transform({tree}, lambda s: {digest} || '(' || {branch} || ')'), ';')"
    )


def _alike(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len(list_distinct({a})) + len(list_distinct({b}))) END"
    )


OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT *, substr(t, 1, n - n // 4) || substr(nt, 1, n // 4) AS edited FROM x),
y AS (SELECT *, {_TREE('t')} AS a, {_TREE('edited')} AS b, {_TREE('nt')} AS c FROM e),
z AS (SELECT *, flatten(a) AS fa, flatten(b) AS fb, flatten(c) AS fc FROM y)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_print('a')} AS fingerprint, {_print('b')} AS edited_fingerprint,
  {_alike('fa', 'fb')} AS near_edited, {_alike('fa', 'fc')} AS near_next,
  len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) AS n_edited_sections
FROM z
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d)),
twice AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY k) > 1),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM twice),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, g, min(i) AS s, max(i) + 200 AS z FROM numbered GROUP BY 1, 2),
gaps AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY s), 0) AS since FROM spans),
cut AS (
  SELECT g.doc_id, sum(z - s) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (s - since)), '' ORDER BY s) AS front, max(z) AS last
  FROM gaps g JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD})) AS size FROM documents),
per AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY 1),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][r % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM per),
lv AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
water AS (SELECT level AS water FROM lv WHERE level <= cap / w ORDER BY cap / w, r LIMIT 1),
t AS (SELECT lv.*, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * w) END AS target FROM lv LEFT JOIN water ON true),
items AS (
  SELECT d.doc_id, d.source, d.size, t.r, t.target, t.source_size, t.budget, p, md5('mix:' || p || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, unnest([0, 1]) AS u(p)),
tagged AS (
  SELECT *, CASE WHEN target > 0 THEN sum(size) OVER (PARTITION BY source ORDER BY p, k, size ROWS UNBOUNDED PRECEDING) / target ELSE 0 END AS f FROM items),
run AS (SELECT *, sum(size) OVER (ORDER BY f, r, p, k, size ROWS UNBOUNDED PRECEDING) AS upto FROM tagged)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken, source
FROM run GROUP BY doc_id, size, source_size, target, source
"""


#: CRC-32 of the decimal text of a number, bit by bit.
CRC = (
    "xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(regexp_extract_all(CAST({} AS VARCHAR), '.'), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
).format
PUT = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')".format
LEAF = lambda text: "sha256(" + " || ".join(PUT(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
OP11 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {LEAF("text")} AS leaf, CASE WHEN {CRC("doc_id")} % 2 = 0 THEN {LEAF("replace(text, chr(10), '')")} ELSE {LEAF("text")} END AS changed FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d),
low(lvl, s, p, n, node) AS (
  SELECT 0, s, p, n, leaf FROM placed
  UNION ALL SELECT lvl + 1, s, p // 3, max((n + 2) // 3), sha256(string_agg(node, '' ORDER BY p)) FROM low WHERE n > 1 GROUP BY lvl, s, p // 3),
subroots AS (SELECT s, lvl AS height, node AS subroot FROM low WHERE n = 1),
high(lvl, p, n, node) AS (
  SELECT 0, s, count(*) OVER (), subroot FROM subroots
  UNION ALL SELECT lvl + 1, p // 3, max((n + 2) // 3), sha256(string_agg(node, '' ORDER BY p)) FROM high WHERE n > 1 GROUP BY lvl, p // 3),
nodes AS (
  SELECT s, lvl, p, n, node FROM low WHERE n > 1
  UNION ALL SELECT x.s, x.height + h.lvl, h.p, h.n, h.node FROM subroots x JOIN high h ON h.n > 1 AND h.p // 3 = CAST(floor(x.s / 3 ** (h.lvl + 1)) AS BIGINT)),
own AS (
  SELECT f.s, f.p, n.lvl, n.p AS q, n.node, CASE WHEN n.lvl < x.height THEN CAST(floor(f.p / 3 ** n.lvl) AS BIGINT) ELSE CAST(floor(f.s / 3 ** (n.lvl - x.height)) AS BIGINT) END AS me
  FROM placed f JOIN subroots x USING (s) JOIN nodes n ON n.s = f.s AND (n.lvl >= x.height OR n.p // 3 = CAST(floor(f.p / 3 ** (n.lvl + 1)) AS BIGINT))),
runs AS (
  SELECT s, p, lvl, coalesce(string_agg(node, '' ORDER BY q) FILTER (q < me), '') AS l, coalesce(string_agg(node, '' ORDER BY q) FILTER (q > me), '') AS r FROM own GROUP BY s, p, lvl),
fold(s, p, lvl, node) AS (
  SELECT s, p, 0, changed FROM placed
  UNION ALL SELECT f.s, f.p, f.lvl + 1, sha256(r.l || f.node || r.r) FROM fold f JOIN runs r ON r.s = f.s AND r.p = f.p AND r.lvl = f.lvl),
ends AS (SELECT s, p, arg_max(node, lvl) AS folded_root FROM fold GROUP BY s, p),
proofs AS (SELECT s, p, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof_sha256 FROM runs GROUP BY s, p)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (s) CROSS JOIN (SELECT node AS root FROM high WHERE n = 1) JOIN ends USING (s, p) LEFT JOIN proofs USING (s, p)
"""


OP12 = rf"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, count(*) AS n, {CRC("c")} % 4 AS h, c - c % 20 AS b FROM t GROUP BY c),
k AS (SELECT x.c, x.n, x.h, x.b, least(x.h, coalesce(y.n, 0)) AS m, least(x.h, coalesce(y.n, 0)) + greatest(0, x.n - x.h) AS total FROM convs x LEFT JOIN convs y ON y.c = x.b),
r AS (
  SELECT k.c, m + p - h + 1 AS d, role, text FROM t JOIN k USING (c) WHERE p >= h
  UNION ALL SELECT k.c, p + 1, role, text FROM k JOIN t ON t.c = k.b WHERE p < h),
pre AS (
  SELECT c, d, len(regexp_extract_all(text, {WORD})) AS w, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS x FROM r
  UNION ALL SELECT c, 0, 0, '' FROM k),
nodes AS (
  SELECT x, d, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = total), '') AS ends,
    CASE WHEN count(*) FILTER (d < total) = 0 THEN 1 ELSE 0 END AS leaf
  FROM pre JOIN k USING (c) GROUP BY x, d),
above AS (SELECT d, leaf, (n_convs - 1) * w AS saved, substr(x, 1, 64 * j) AS ax, j FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM nodes)),
sums AS (SELECT ax, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (d = j + 1) AS n_children FROM above GROUP BY ax)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums ON ax = n.x LEFT JOIN nodes u ON u.d = n.d - 1 AND u.x = substr(n.x, 1, 64 * (n.d - 1))
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_frequency": OP2, "op4_partenum": OP4, "op5_merkle": OP5, "op8_suffix": OP8, "op10_mix": OP10, "op11_manifest": OP11, "op12_prefix_trie": OP12}
