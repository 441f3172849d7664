"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

_SHINGLES = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l)
"""

NEAR_DUPLICATES = (
    "WITH RECURSIVE "
    + _SHINGLES.strip().removeprefix("WITH ")
    + """,
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b OR true)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
)

#: Classes of equal sets, candidates by the rarest words of each, similarity on the full sets; ids are unique.
LINE_DEDUP = r"""
WITH x AS (SELECT doc_id, "text" AS t, string_split("text", chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, i, parts[i + 1] AS line FROM x, unnest(range(len(parts))) u(i) WHERE t <> ''),
s AS (SELECT doc_id, i, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))) AS ws FROM l),
c AS MATERIALIZED (SELECT row_number() OVER () AS id, ws, len(ws) AS n, min(struct_pack(d := doc_id, i := i)) AS f FROM s WHERE len(ws) > 0 GROUP BY ws),
w AS MATERIALIZED (SELECT id, n, unnest(ws) AS w FROM c),
o AS MATERIALIZED (SELECT id, w FROM (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY k, w) AS r FROM w JOIN (SELECT w, count(*) AS k FROM w GROUP BY w) USING (w)) WHERE r <= n - (90 * n + 99) // 100 + 1),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM o a JOIN o b ON a.w = b.w AND a.id <> b.id),
g AS (SELECT DISTINCT a AS id FROM p JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE x.f > y.f AND 190 * len(list_intersect(x.ws, y.ws)) >= 90 * (x.n + y.n)),
k AS (SELECT s.doc_id, s.i, s.line FROM s LEFT JOIN c ON c.ws = s.ws AND c.f.d = s.doc_id AND c.f.i = s.i LEFT JOIN g ON g.id = c.id WHERE len(s.ws) = 0 OR (c.id IS NOT NULL AND g.id IS NULL)),
r AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM k GROUP BY doc_id)
SELECT x.doc_id, CAST(CASE WHEN coalesce(x.t, '') = '' THEN 0 ELSE len(x.parts) END AS BIGINT) AS n_lines,
  CAST(CASE WHEN coalesce(x.t, '') = '' THEN 0 ELSE len(x.parts) - coalesce(r.n, 0) END AS BIGINT) AS n_removed,
  CASE WHEN x.t IS NULL THEN NULL ELSE sha256(coalesce(r.t, '')) END AS kept_sha256
FROM x LEFT JOIN r USING (doc_id)
"""

#: Five bits a document, then sums over sets of bits for each of the 120 orders.
FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce("text", '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS q, max(CAST(toxic = 1 AS INT)) AS x FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
  + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS m FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, sum(q) AS good, sum(x) AS toxic FROM f GROUP BY part, m),
y AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS y),
o AS (SELECT concat(a.y, b.y, c.y, d.y, e.y) AS o FROM y a, y b, y c, y d, y e WHERE len(list_distinct([a.y, b.y, c.y, d.y, e.y])) = 5),
s AS (SELECT o, k, 1 << (instr('ABCDE', o[k]) - 1) AS bit, CAST(list_sum(list_concat([0], list_transform(range(1, k), lambda j: 1 << (instr('ABCDE', o[j]) - 1)))) AS BIGINT) AS before FROM o, range(1, 6) t(k))
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (m & (before | bit) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (m & before = 0 AND m & bit <> 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (m & before <> 0 AND m & bit <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (m = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (m & before = 0 AND m & bit <> 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (m & before = 0 AND m & bit <> 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(1, bit_count(CAST(m AS BIGINT))))) FILTER (m & bit <> 0), 0) AS BIGINT) AS shapley
FROM c, s GROUP BY part, o, k
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", '"text"')) + "))"
#: CRC-32 of a short ASCII text, bit by bit (4294967295 and 3988292384 are fixed values of the checksum).
_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda r, b: list_reduce(list_concat([xor(r, b)], CAST(range(8) AS BIGINT[])), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"

#: Levels of both trees, siblings by level, and a fold from the tampered leaves.
MERKLE_MANIFEST = f"""
WITH RECURSIVE a AS MATERIALIZED (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} END AS claimed FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS part FROM a),
lv(part, l, i, h, n) AS (SELECT part, 0, pos, leaf, n FROM p UNION ALL SELECT part, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY part, l, i // 2, n),
lt AS MATERIALIZED (SELECT * FROM lv),
lr(l, i, h, n) AS (SELECT 0, part, h, (SELECT count(DISTINCT part) FROM p) FROM lt WHERE n = 1 UNION ALL SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM lr WHERE n > 1 GROUP BY l, i // 2, n),
rt AS MATERIALIZED (SELECT * FROM lr),
sib AS (SELECT rid, 0 AS tree, l, t.h FROM p JOIN lt t ON t.part = p.part AND t.i = xor(p.pos >> t.l, 1) UNION ALL SELECT rid, 1, l, t.h FROM p JOIN rt t ON t.i = xor(p.part >> t.l, 1)),
proof AS (SELECT rid, sha256(string_agg(h, '' ORDER BY tree, l)) AS s FROM sib GROUP BY rid),
fa(rid, part, l, i, n, h) AS (SELECT rid, part, 0, pos, n, coalesce(claimed, leaf) FROM p UNION ALL
  SELECT rid, fa.part, fa.l + 1, fa.i // 2, (fa.n + 1) // 2, sha256(CASE WHEN fa.i % 2 = 1 THEN coalesce(t.h, '') || fa.h ELSE fa.h || coalesce(t.h, '') END) FROM fa LEFT JOIN lt t ON t.part = fa.part AND t.l = fa.l AND t.i = xor(fa.i, 1) WHERE fa.n > 1),
fb(rid, l, i, n, h) AS (SELECT rid, 0, part, (SELECT count(DISTINCT part) FROM p), h FROM fa WHERE n = 1 UNION ALL
  SELECT rid, fb.l + 1, fb.i // 2, (fb.n + 1) // 2, sha256(CASE WHEN fb.i % 2 = 1 THEN coalesce(t.h, '') || fb.h ELSE fb.h || coalesce(t.h, '') END) FROM fb LEFT JOIN rt t ON t.l = fb.l AND t.i = xor(fb.i, 1) WHERE fb.n > 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(proof.s, sha256('')) AS proof_sha256, fb.h AS folded_root, fb.h = r.h AS verified
FROM p JOIN lt s ON s.part = p.part AND s.n = 1 JOIN rt r ON r.n = 1 LEFT JOIN proof USING (rid) JOIN fb ON fb.rid = p.rid AND fb.n = 1
"""

ORACLE = {"op11_filter_audit": FILTER_AUDIT, "op12_merkle_manifest": MERKLE_MANIFEST, "op1_line_dedup": LINE_DEDUP, "op4_minhash_near_dedup": NEAR_DUPLICATES}
