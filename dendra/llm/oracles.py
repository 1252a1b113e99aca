"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from dendra.llm import urls

ORACLES: dict[str, str] = {}

ORACLES["op1_mix"] = r"""
WITH base AS (
  SELECT doc_id, source, source IS NULL AS src_null, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))) AS key
  FROM documents),
sizes AS (
  SELECT src_null, src, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY src_null, src) AS rank
  FROM base GROUP BY src_null, src),
weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         2 * source_size AS cap, (SELECT sum(size) FROM base)::DOUBLE * 1.5 AS budget
  FROM sizes),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY cap / weight, rank
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT src_null, src, source_size, budget,
         least(cap::DOUBLE, max(level) OVER () * weight) AS target
  FROM levels),
queued AS (
  SELECT b.*, t.source_size, t.target, t.budget,
         row_number() OVER (PARTITION BY b.src_null, b.src ORDER BY key, doc_id, size) AS rn,
         sum(size) OVER (PARTITION BY b.src_null, b.src ORDER BY key, doc_id, size
                         ROWS UNBOUNDED PRECEDING) AS cum
  FROM base b JOIN targets t USING (src_null, src)),
copies AS (
  SELECT q.*, c.copy, (c.copy * q.source_size + q.cum)::DOUBLE / q.target AS finish
  FROM queued q, (VALUES (0), (1)) c(copy) WHERE q.size > 0 AND q.target > 0),
totals AS (
  SELECT *, sum(size) OVER (ORDER BY finish, src_null, src, key, copy, rn
                            ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT src_null, src, rn, sum(size)::BIGINT AS taken FROM totals
          WHERE total <= budget GROUP BY ALL)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target,
       coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t USING (src_null, src, rn)
"""

ORACLES["op2_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
i AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(
           lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
masks(kind, least, most, span, offs) AS (VALUES
  (0, 5, 1000000000, 4, [0, 1, 2, 3]), (1, 8, 1000000000, 6, [0, 1, 4, 5]), (2, 8, 11, 8, [0, 1, 6, 7]),
  (3, 5, 7, 5, [0, 1, 3, 4]), (4, 5, 7, 5, [0, 1, 2, 4]), (5, 5, 7, 5, [0, 2, 3, 4])),
iseeds AS (
  SELECT item_id, ws AS iws, p AS ip, kind,
         list_transform(offs, lambda o: ws[p + o + 1]) AS seed
  FROM (SELECT i.*, m.*, unnest(range(len(ws) - span + 1)) AS p
        FROM i, masks m WHERE len(ws) BETWEEN least AND most)),
dseeds AS (
  SELECT doc_id, ws, p, kind, list_transform(offs, lambda o: ws[p + o + 1]) AS seed
  FROM (SELECT d.*, m.*, unnest(range(len(ws) - span + 1)) AS p
        FROM d, masks m WHERE len(ws) >= span)),
hits AS (SELECT * FROM dseeds JOIN iseeds USING (kind, seed)),
eq AS (
  SELECT doc_id, item_id, iws,
         list_transform(range(greatest(0, ip - p, ip - 32),
                              least(len(iws), ip + 44, len(ws) - p + ip)),
                        lambda j: (ws[p - ip + j + 1] = iws[j + 1])::INT) AS e
  FROM hits),
scored AS (
  SELECT *, len(e) AS c, list_sum(e) AS m,
         list_max(list_transform(range(len(e) - least(16, len(e)) + 1),
                  lambda j: list_sum(e[j + 1 : j + least(16, len(e))])))::DOUBLE
           / least(16, len(e)) AS overlap
  FROM eq)
SELECT doc_id, item_id, ((max(m * 1000 + 999 - c)) // 1000)::BIGINT AS n_matched,
       (999 - max(m * 1000 + 999 - c) % 1000)::BIGINT AS n_compared, max(overlap) AS overlap
FROM scored WHERE overlap >= 0.75 AND c >= least(len(iws), 12) GROUP BY doc_id, item_id
"""

ORACLES["op3_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + least(5, len(ws))], ' ') AS g
  FROM (SELECT *, unnest(range(greatest(len(ws) - 4, 1))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       least(d.doc_id, coalesce(m.lo, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS lo FROM reach GROUP BY a) m USING (doc_id)
"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
_TERMS = ", ".join([f"('{t}', {urls.LIMIT})" for t in urls.STRICT] + [f"('{t}', 1)" for t in urls.SOFT])

ORACLES["op11_urls"] = rf"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULES}), terms(term, w) AS (VALUES {_TERMS}),
u AS (
  SELECT page_id, url, row_number() OVER () AS n,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UP}', '{_LOW}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         translate(coalesce(url, ''), '{_UP}', '{_LOW}') AS low
  FROM pages),
ruled AS (
  SELECT u.*, rhost || rpath AS rule, rverdict
  FROM u LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY len(rhost) + len(rpath) DESC) = 1),
hits AS (
  SELECT n, string_agg(term, ' ' ORDER BY term) FILTER (w > 1) AS strict_terms,
         string_agg(term, ' ' ORDER BY term) FILTER (w = 1) AS soft_terms, sum(w)::BIGINT AS weight
  FROM ruled JOIN terms ON regexp_matches(low, '(^|[^\p{{L}}\p{{N}}])' || term || '($|[^\p{{L}}\p{{N}}])')
  WHERE rule IS NULL GROUP BY n)
SELECT page_id, host, path, rule,
       coalesce(rverdict, CASE WHEN weight >= {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(strict_terms, '') AS strict_terms, coalesce(soft_terms, '') AS soft_terms,
       coalesce(weight, 0)::BIGINT AS weight
FROM ruled LEFT JOIN hits USING (n)
"""

ORACLES["op12_trie"] = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                     coalesce(text, '')) - 1 AS pos,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS v
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(v ORDER BY pos) AS own FROM t GROUP BY conv_id),
h AS (
  SELECT *, conv_id - conv_id % 100 AS base,
         (4294967295 - list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda acc, ch: list_reduce(list_prepend(xor(acc, ch), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda a, z: xor(a >> 1, (a & 1) * 3988292384)))) % 6 AS h
  FROM c),
r AS (
  SELECT a.conv_id, list_concat(coalesce(b.own, [])[1 : a.h], a.own[a.h + 1 :]) AS path
  FROM h a LEFT JOIN c b ON b.conv_id = a.base),
m AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM r),
n AS (
  SELECT path[1 : d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(path)) > d AS goes_on,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = d), '')) AS ends_sha256
  FROM m GROUP BY 1, 2),
below AS (
  SELECT a.k, count(*) FILTER (NOT b.goes_on) AS n_leaves, count(*) FILTER (b.d = a.d + 1) AS n_children,
         sum(CASE WHEN b.d > 0 THEN (b.n_convs - 1) * length(b.k[b.d].t) ELSE 0 END)::BIGINT AS saved_tokens
  FROM n a JOIN n b ON b.d >= a.d AND b.k[1 : a.d] = a.k GROUP BY a.k)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens,
       n.ends_sha256
FROM n JOIN below USING (k) LEFT JOIN n p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.k[1 : n.d - 1]
"""
