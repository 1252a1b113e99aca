"""DuckDB SQL equivalents of the registered queries (tables are views named
after the driver tables).  Column names and types match the Spark side."""

_EMB = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"

_PAIRS_COS = f"""{_EMB},
p AS (SELECT a.vec_id, b.vec_id AS nbr_id, list_cosine_similarity(a.v, b.v) AS s
      FROM e a JOIN e b ON a.vec_id <> b.vec_id)"""

_PAIRS_EUC = f"""{_EMB},
p AS (SELECT a.vec_id, b.vec_id AS nbr_id, list_distance(a.v, b.v) AS s
      FROM e a JOIN e b ON a.vec_id <> b.vec_id)"""

ORACLES = {
    "knn_top5": f"""
WITH {_PAIRS_COS},
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nbr_id) AS rk FROM p)
SELECT vec_id, rk::BIGINT AS rank, nbr_id, round(s, 6) AS score FROM r WHERE rk <= 5""",

    "knn_filtered": f"""
WITH {_EMB},
p AS (SELECT a.vec_id, b.vec_id AS nbr_id, list_cosine_similarity(a.v, b.v) AS s
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE b.label = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nbr_id) AS rk FROM p)
SELECT vec_id, rk::BIGINT AS rank, nbr_id, round(s, 6) AS score FROM r WHERE rk <= 5""",

    "knn_vote": f"""
WITH {_PAIRS_COS},
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nbr_id) AS rk FROM p),
nn AS (SELECT vec_id, nbr_id, rk FROM r WHERE rk <= 5),
v AS (SELECT nn.vec_id, e.label AS c, count(*) AS n, min(nn.rk) AS first_rk
      FROM nn JOIN e ON nn.nbr_id = e.vec_id WHERE e.label <> -1 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, first_rk) AS pos FROM v),
agg AS (SELECT vec_id, max(CASE WHEN pos = 1 THEN c END) AS predicted,
               max(CASE WHEN pos = 1 THEN n END) AS n_votes, sum(n) AS total_votes,
               string_agg(printf('cluster %d: %d votes', c, n), ', ' ORDER BY pos) AS vote_dist
        FROM o GROUP BY vec_id)
SELECT e.vec_id, e.label::BIGINT AS label, coalesce(agg.predicted, -1)::BIGINT AS predicted,
       coalesce(agg.n_votes, 0)::BIGINT AS n_votes, coalesce(agg.total_votes, 0)::BIGINT AS total_votes,
       coalesce(agg.vote_dist, '') AS vote_dist
FROM e LEFT JOIN agg ON e.vec_id = agg.vec_id""",

    "core_distance": f"""
WITH {_PAIRS_EUC},
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, nbr_id) AS rk FROM p)
SELECT vec_id, round(s, 6) AS core_distance FROM r WHERE rk = 3""",

    "mutual_reachability": f"""
WITH {_PAIRS_EUC},
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, nbr_id) AS rk FROM p),
core AS (SELECT vec_id, s AS core FROM r WHERE rk = 3)
SELECT r.vec_id, r.nbr_id, round(greatest(r.s, ca.core, cb.core), 6) AS mrd
FROM r JOIN core ca ON r.vec_id = ca.vec_id JOIN core cb ON r.nbr_id = cb.vec_id
WHERE r.rk <= 3""",
}

_CUT = 1.2          # the cut of the registered query

# All mutual-reachability weights g(vec_id, nbr_id, w), min_samples 3.
_MRD = f"""{_PAIRS_EUC},
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, nbr_id) AS rk FROM p),
core AS (SELECT vec_id, s AS core FROM r WHERE rk = 3),
g AS (SELECT p.vec_id, p.nbr_id, greatest(p.s, a.core, b.core) AS w
      FROM p JOIN core a ON p.vec_id = a.vec_id JOIN core b ON p.nbr_id = b.vec_id)"""

# Prim's algorithm: dist holds each outside point's lightest edge to the tree
# (NULL once inside); every step takes the lightest of all.
ORACLES["mst_weight"] = f"""
WITH RECURSIVE {_MRD},
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM core),
m AS MATERIALIZED (
  SELECT i, list(w ORDER BY j) AS ws
  FROM (SELECT a.i, b.i AS j, g.w FROM ids a CROSS JOIN ids b
        LEFT JOIN g ON g.vec_id = a.vec_id AND g.nbr_id = b.vec_id)
  GROUP BY i),
prim(step, dist, total) AS (
  SELECT 0, ws, 0::DOUBLE FROM m WHERE i = 1
  UNION ALL
  SELECT step + 1,
         list_transform(dist, lambda x, k: CASE WHEN x IS NULL OR k = m.i THEN NULL
                                           ELSE least(x, m.ws[k]) END),
         total + list_min(dist)
  FROM prim JOIN m ON m.i = list_position(dist, list_min(dist))
  WHERE list_min(dist) IS NOT NULL)
SELECT round(max(total), 6) AS mst_weight, max(step)::BIGINT AS n_edges FROM prim"""

ORACLES["density_components"] = f"""
WITH RECURSIVE {_MRD},
light AS MATERIALIZED (SELECT vec_id AS a, nbr_id AS b FROM g WHERE w <= {_CUT}),
reach(a, b) AS (SELECT a, b FROM light UNION SELECT r.a, l.b FROM reach r JOIN light l ON r.b = l.a)
SELECT c.vec_id, least(c.vec_id, coalesce(x.lo, c.vec_id)) AS component
FROM core c LEFT JOIN (SELECT a, min(b) AS lo FROM reach GROUP BY a) x ON x.a = c.vec_id"""


# Density clusters with leaf selection, least size 3.  Prim's algorithm in the
# strict order (w, lo, hi) gives the tree; ``lab`` holds every point's component
# after each of its edges.  A leaf of the cluster tree is born where two small
# components reach the size together; a point that leaves a component which
# holds one birth alone leaves that leaf.
ORACLES["hdbscan_leaf"] = f"""
WITH RECURSIVE {_MRD},
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM core),
m AS MATERIALIZED (
  SELECT i, list(CASE WHEN w IS NOT NULL THEN {{'w': w, 'lo': least(i, j), 'hi': greatest(i, j)}} END ORDER BY j) AS ws
  FROM (SELECT a.i, b.i AS j, g.w FROM ids a CROSS JOIN ids b
        LEFT JOIN g ON g.vec_id = a.vec_id AND g.nbr_id = b.vec_id)
  GROUP BY i),
prim(step, dist, e) AS (
  SELECT 0, ws, NULL::STRUCT(w DOUBLE, lo BIGINT, hi BIGINT) FROM m WHERE i = 1
  UNION ALL
  SELECT step + 1,
         list_transform(dist, lambda x, k: CASE WHEN x IS NULL OR k = m.i THEN NULL
                                           WHEN m.ws[k] < x THEN m.ws[k] ELSE x END),
         list_min(dist)
  FROM prim JOIN m ON m.i = list_position(dist, list_min(dist))
  WHERE list_min(dist) IS NOT NULL),
edges AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY e) AS r, e.w AS w, e.lo AS lo, e.hi AS hi FROM prim WHERE e IS NOT NULL),
lab(r, l) AS (
  SELECT 0, (SELECT list(i ORDER BY i) FROM ids)
  UNION ALL
  SELECT e.r, list_transform(l, lambda x: CASE WHEN x = l[e.hi] THEN l[e.lo] ELSE x END)
  FROM lab JOIN edges e ON e.r = lab.r + 1),
spots AS MATERIALIZED (
  SELECT r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS c FROM lab),
sized AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY r, c) AS n FROM spots),
births AS (
  SELECT e.r, e.w, e.lo FROM edges e
  JOIN sized a ON a.r = e.r - 1 AND a.i = e.lo JOIN sized b ON b.r = e.r - 1 AND b.i = e.hi
  WHERE a.n < 3 AND b.n < 3 AND a.n + b.n >= 3),
falls AS (SELECT i, min(r) AS r FROM sized WHERE n >= 3 GROUP BY i),
inside AS (
  SELECT f.i, max(b.r) AS birth, count(*) AS n, max(e.w) AS w, max(b.w) AS bw
  FROM falls f JOIN edges e ON e.r = f.r JOIN spots p ON p.r = f.r AND p.i = f.i
  JOIN births b ON b.r <= f.r JOIN spots q ON q.r = f.r AND q.i = b.lo AND q.c = p.c
  GROUP BY f.i),
own AS (SELECT * FROM inside WHERE n = 1 AND (SELECT count(*) FROM births) > 1),
firsts AS (SELECT birth, row_number() OVER (ORDER BY min(i)) - 1 AS cluster FROM own GROUP BY birth)
SELECT ids.vec_id, coalesce(f.cluster, -1)::INTEGER AS cluster,
       round(CASE WHEN o.i IS NULL THEN 0.0 ELSE greatest(o.bw, 1e-12) / greatest(o.w, 1e-12) END, 4) AS confidence
FROM ids LEFT JOIN own o ON o.i = ids.i LEFT JOIN firsts f ON f.birth = o.birth"""


# Smooth-kNN weights by the same bisection: 64 steps, a sigma is kept once its
# sum is within 1e-5 of log2(5).
ORACLES["project_start"] = f"""
WITH RECURSIVE {_PAIRS_COS},
nn AS (
  SELECT vec_id, nbr_id, greatest(0.0, 1.0 - s) AS d, rk
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nbr_id) AS rk FROM p) WHERE rk <= 5),
ds AS (SELECT vec_id, list(d ORDER BY rk) FILTER (rk > 1) AS ds FROM nn GROUP BY vec_id),
b(vec_id, step, ds, lo, hi, mid, found) AS (
  SELECT vec_id, 0, ds, 0.0::DOUBLE, 'inf'::DOUBLE, 1.0::DOUBLE, false FROM ds
  UNION ALL
  SELECT vec_id, step + 1, ds,
         CASE WHEN found OR ok OR s > t THEN lo ELSE mid END,
         CASE WHEN found OR ok OR s <= t THEN hi ELSE mid END,
         CASE WHEN found OR ok THEN mid WHEN s > t THEN (lo + mid) / 2
              WHEN isinf(hi) THEN mid * 2 ELSE (mid + hi) / 2 END,
         found OR ok
  FROM (SELECT *, log2(5) AS t, abs(s - log2(5)) < 1e-5 AS ok
        FROM (SELECT *, list_sum(list_transform(ds, lambda x: CASE WHEN x > 0 THEN exp(-(x / mid)) ELSE 1.0 END)) AS s
              FROM b)) WHERE step < 64),
sig AS (SELECT vec_id, greatest(mid, 1e-3 * (SELECT avg(d) FROM nn)) AS sigma FROM b WHERE step = 64),
w AS (SELECT nn.*, exp(-d / sigma) / sum(exp(-d / sigma)) OVER (PARTITION BY nn.vec_id) AS w FROM nn JOIN sig USING (vec_id))
SELECT w.vec_id, round(sum(w * e.v[1]), 6) AS x, round(sum(w * e.v[2]), 6) AS y
FROM w JOIN e ON e.vec_id = w.nbr_id GROUP BY w.vec_id"""


def _ari_sql(src: str, truth: str, pred: str) -> str:
    """ARI of two columns of relation ``src`` in pair-confusion form."""
    return f"""(
WITH c AS (SELECT {truth} AS t, {pred} AS p, count(*) AS n FROM {src} GROUP BY ALL),
s AS (SELECT sum(n::DOUBLE * n) AS sc, sum(n)::DOUBLE AS nt FROM c),
r AS (SELECT sum(x::DOUBLE * x) AS sr FROM (SELECT sum(n) AS x FROM c GROUP BY t)),
k AS (SELECT sum(x::DOUBLE * x) AS sk FROM (SELECT sum(n) AS x FROM c GROUP BY p)),
z AS (SELECT sc - nt AS tp, sk - sc AS fp, sr - sc AS fn, nt * nt - (sk - sc) - (sr - sc) - sc AS tn FROM s, r, k)
SELECT CASE WHEN fn = 0 AND fp = 0 THEN 1.0 ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari FROM z)"""


def _sil_sql(src: str) -> str:
    """Mean silhouette of relation src(vec_id, v, c)."""
    return f"""(
WITH sz AS (SELECT c, count(*) AS n FROM {src} GROUP BY c),
d AS (SELECT a.vec_id, a.c AS own, b.c AS oc, sum(list_distance(a.v, b.v)) AS ds FROM {src} a, {src} b GROUP BY ALL),
m AS (SELECT d.*, sz.n, CASE WHEN oc = own THEN (CASE WHEN sz.n > 1 THEN ds / (sz.n - 1) END) ELSE ds / sz.n END AS m
      FROM d JOIN sz ON d.oc = sz.c),
p AS (SELECT vec_id, max(CASE WHEN oc = own THEN m END) AS a, min(CASE WHEN oc <> own THEN m END) AS b,
             max(CASE WHEN oc = own THEN n END) AS own_size FROM m GROUP BY vec_id)
SELECT avg(CASE WHEN own_size <= 1 OR b IS NULL THEN 0.0 WHEN greatest(a, b) = 0 THEN 0.0
                ELSE (b - a) / greatest(a, b) END) AS silhouette FROM p)"""


def _db_sql(src: str) -> str:
    """Davies-Bouldin of relation src(vec_id, v, c)."""
    return f"""(
WITH u AS (SELECT c, i, avg(x) AS m FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {src}) GROUP BY c, i),
cen AS (SELECT c, list(m ORDER BY i) AS cv FROM u GROUP BY c),
sc AS (SELECT s.c, avg(list_distance(s.v, cen.cv)) AS s FROM {src} s JOIN cen ON s.c = cen.c GROUP BY s.c),
cs AS (SELECT cen.c, cv, s FROM cen JOIN sc ON cen.c = sc.c),
pr AS (SELECT a.c, max(CASE WHEN list_distance(a.cv, b.cv) = 0 THEN 0.0 ELSE (a.s + b.s) / list_distance(a.cv, b.cv) END) AS r,
              max(list_distance(a.cv, b.cv)) AS dmax FROM cs a, cs b GROUP BY a.c)
SELECT CASE WHEN (SELECT max(abs(s)) FROM cs) <= 1e-8 OR (SELECT max(dmax) FROM pr) <= 1e-8 THEN 0.0 ELSE avg(r) END AS davies_bouldin FROM pr)"""


_VOTE_CTES = f"""{_PAIRS_COS},
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nbr_id) AS rk FROM p),
nn AS (SELECT vec_id, nbr_id, rk FROM r WHERE rk <= 5),
v AS (SELECT nn.vec_id, e.label AS c, count(*) AS n, min(nn.rk) AS first_rk
      FROM nn JOIN e ON nn.nbr_id = e.vec_id WHERE e.label <> -1 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, first_rk) AS pos FROM v),
agg AS (SELECT vec_id, max(CASE WHEN pos = 1 THEN c END) AS predicted,
               max(CASE WHEN pos = 1 THEN n END) AS n_votes FROM o GROUP BY vec_id),
asg AS (SELECT e.vec_id, coalesce(agg.predicted, -1) AS cluster, coalesce(agg.n_votes, 0) / 5.0 AS confidence,
               e.label, e.v FROM e LEFT JOIN agg ON e.vec_id = agg.vec_id),
nz AS (SELECT vec_id, v, cluster AS c FROM asg WHERE cluster <> -1)"""

ORACLES.update({
    "contingency": """
SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY lang, source""",

    "ari": f"""SELECT round(ari, 6) AS ari FROM {_ari_sql('documents', 'lang', 'source')}""",

    "silhouette": f"""
WITH {_EMB}, x AS (SELECT vec_id, v, label AS c FROM e)
SELECT round(silhouette, 6) AS silhouette FROM {_sil_sql('x')}""",

    "davies_bouldin": f"""
WITH {_EMB}, x AS (SELECT vec_id, v, label AS c FROM e)
SELECT round(davies_bouldin, 6) AS davies_bouldin FROM {_db_sql('x')}""",

    "run_metrics": f"""
WITH {_VOTE_CTES},
base AS (SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, count(*) AS n_rows,
                count(*) FILTER (WHERE cluster = -1) AS n_noise,
                avg(CASE WHEN cluster <> -1 THEN confidence END) AS conf,
                count(*) FILTER (WHERE confidence < 0.5) AS n_low FROM asg),
sil AS {_sil_sql('nz')},
db AS {_db_sql('nz')},
ar AS {_ari_sql('asg', 'label', 'cluster')}
SELECT n_clusters::BIGINT AS n_clusters, round(100.0 * n_noise / n_rows, 1) AS noise_pct,
       CASE WHEN n_clusters >= 2 AND n_rows - n_noise > n_clusters THEN round(sil.silhouette, 4) END AS silhouette,
       CASE WHEN n_clusters >= 2 AND n_rows - n_noise > n_clusters THEN round(db.davies_bouldin, 4) END AS davies_bouldin,
       round(ar.ari, 4) AS ari, round(conf, 4) AS avg_membership_confidence,
       n_low::BIGINT AS n_low_confidence, round(100.0 * n_noise / n_rows, 1) < 15.0 AS noise_healthy
FROM base, sil, db, ar""",

    "dominant_label": """
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first_pos FROM documents GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_pos) AS rk FROM c)
SELECT source, sum(n)::BIGINT AS size, max(CASE WHEN rk = 1 THEN lang END) AS dominant,
       string_agg(printf('%s(%d)', lang, n), ', ' ORDER BY rk) AS distribution, count(*)::BIGINT AS n_labels
FROM o GROUP BY source""",
})


# Python str.strip() whitespace, as an RE2 class
_WS = r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = f"'^{_WS}+|{_WS}+\\z'"

_HITS = rf"""hits AS (
  SELECT regexp_extract(html, '<html lang="([^"]+)"', 1) AS topic,
         floor(page_id / 20)::INT AS query_no, (page_id % 20 + 1)::INT AS rank, url,
         regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, html AS content,
         regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', ' ', 'g') AS description,
         page_id FROM pages),
cl AS (
  SELECT *, split_part(url, '?', 1) AS url_clean,
         regexp_extract(split_part(url, '?', 1), '/[a-z]{{2}}/(\d+)', 1) AS pmid,
         CASE WHEN contains(coalesce(content, ''), '## Abstract' || chr(10) || chr(10))
              THEN regexp_replace(regexp_extract(coalesce(content, ''), '(?s)## Abstract\n\n(.*?)(\n## |\z)', 1), {_STRIP}, '', 'g')
              WHEN length(regexp_replace(coalesce(description, ''), {_STRIP}, '', 'g')) > 80
              THEN regexp_replace(coalesce(description, ''), {_STRIP}, '', 'g') END AS abstract,
         regexp_replace(CASE WHEN suffix(coalesce(title, ''), ' - PubMed') THEN left(title, length(title) - 9) ELSE coalesce(title, '') END,
                        {_STRIP}, '', 'g') AS title_clean
  FROM hits),
valid AS (SELECT * FROM cl WHERE rank <= 20 AND pmid <> '' AND abstract IS NOT NULL AND abstract <> ''),
topics AS (SELECT dense_rank() OVER (ORDER BY topic) AS topic_no, topic, 10 AS target FROM (SELECT DISTINCT topic FROM hits)),
vt AS (SELECT valid.*, topics.topic_no, topics.target FROM valid JOIN topics USING (topic)),
pt AS (SELECT * FROM vt QUALIFY row_number() OVER (PARTITION BY topic, pmid ORDER BY query_no, rank) = 1)"""


def _before_chain(max_topics: int = 8) -> str:
    """dedup-before-quota as a chain of CTEs, one per topic slot."""
    parts = []
    for t in range(1, max_topics + 1):
        prev = " UNION ALL ".join(f"SELECT pmid FROM acc{j}" for j in range(1, t)) or "SELECT NULL::VARCHAR AS pmid WHERE false"
        parts.append(f"""acc{t} AS (SELECT * FROM pt WHERE topic_no = {t} AND pmid NOT IN (SELECT pmid FROM ({prev}) WHERE pmid IS NOT NULL)
  QUALIFY row_number() OVER (ORDER BY query_no, rank) <= target)""")
    union = " UNION ALL ".join(f"SELECT * FROM acc{t}" for t in range(1, max_topics + 1))
    return ",\n".join(parts) + f",\naccepted AS ({union})"


ORACLES.update({
    "page_canonical_url": "SELECT page_id, split_part(url, '?', 1) AS url_clean FROM pages",
    "page_id_extract": r"""
SELECT page_id, regexp_extract(split_part(url, '?', 1), '/[a-z]{2}/(\d+)', 1) AS item_id FROM pages
WHERE regexp_extract(split_part(url, '?', 1), '/[a-z]{2}/(\d+)', 1) <> ''""",
    "page_text_fallback": f"""WITH {_HITS}
SELECT page_id, abstract FROM cl WHERE abstract IS NOT NULL AND abstract <> ''""",
    "title_suffix_strip": f"""WITH {_HITS} SELECT page_id, title_clean AS title FROM cl""",
    "ascii_safe": f"""WITH {_HITS} SELECT page_id, regexp_replace(title_clean, '[^\\x{{00}}-\\x{{7F}}]', '?', 'g') AS title FROM cl""",
    "first_seen_dedup": f"""WITH {_HITS}
SELECT pmid, page_id, topic FROM vt QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY topic_no, query_no, rank) = 1""",
    "topic_quota_after_dedup": f"""WITH {_HITS},
q AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY topic ORDER BY query_no, rank) <= target)
SELECT topic, pmid, page_id FROM q QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY topic_no, query_no, rank) = 1""",
    "topic_quota_before_dedup": f"""WITH {_HITS},
{_before_chain()}
SELECT topic, pmid, page_id FROM accepted""",
    "quota_status": f"""WITH {_HITS},
{_before_chain()},
c AS (SELECT topic, count(*) AS n FROM accepted GROUP BY topic)
SELECT topics.topic_no::BIGINT AS topic_id, topics.topic, coalesce(c.n, 0)::BIGINT AS n, topics.target::BIGINT AS target,
       CASE WHEN coalesce(c.n, 0) >= topics.target THEN 'OK' ELSE 'SHORT by ' || (topics.target - coalesce(c.n, 0))::VARCHAR END AS status
FROM topics LEFT JOIN c USING (topic)""",
    "sample_titles": f"""WITH {_HITS},
{_before_chain()}
SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY query_no, rank)::BIGINT AS n, pmid,
       regexp_replace(title_clean, '[^\\x{{00}}-\\x{{7F}}]', '?', 'g') AS title
FROM accepted QUALIFY n <= 2""",
    "dim_check": """
SELECT count(*)::BIGINT AS n_vectors, min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim,
       count(*) FILTER (WHERE len(embedding) <> 64)::BIGINT AS n_bad, count(*) FILTER (WHERE len(embedding) <> 64) = 0 AS ok
FROM embeddings""",
})


def _tfidf_sql(src: str, id_col: str, prefix: str, df_from: str | None = None) -> str:
    """CTEs {prefix}tc, {prefix}w (doc_id, term, term_id, weight) for texts of src.
    df_from: prefix of the corpus whose document frequencies to use."""
    p = prefix
    dfp = df_from or p
    out = rf"""{p}tok AS (SELECT {id_col} AS doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS term FROM {src}),
{p}tc AS (SELECT doc_id, term, count(*) AS tf FROM {p}tok WHERE term <> '' GROUP BY ALL)"""
    if df_from is None:
        out += f""",
{p}nd AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM {p}tc),
{p}dfq AS (SELECT term, count(*)::DOUBLE AS df FROM {p}tc GROUP BY term)"""
    out += f""",
{p}raw AS (SELECT t.doc_id, t.term, t.tf * (ln((1 + {dfp}nd.n) / (1 + d.df)) + 1) AS raw
           FROM {p}tc t JOIN {dfp}dfq d USING (term), {dfp}nd),
{p}nrm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS nrm FROM {p}raw GROUP BY doc_id),
{p}w AS (SELECT r.doc_id, r.term, ('0x' || substr(md5(r.term), 1, 15))::BIGINT AS term_id, r.raw / n.nrm AS weight
         FROM {p}raw r JOIN {p}nrm n USING (doc_id))"""
    return out


def _dense_sql(p: str) -> str:
    """CTE {p}dv(doc_id, j, x): normalised signed projection of {p}w."""
    h1 = "((term_id % 2147483647) * 16807 + j * 48271 + 1) % 2147483647"
    h2 = f"(({h1}) * 69621) % 2147483647"
    h3 = f"(({h2}) * 48271) % 2147483647"
    return f"""{p}dq AS (SELECT doc_id, j, sum(weight * CASE WHEN {h3} < 1073741823 THEN 1.0 ELSE -1.0 END) AS x
          FROM {p}w, range(64) t(j) GROUP BY ALL),
{p}dn AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM {p}dq GROUP BY doc_id),
{p}dv AS (SELECT q.doc_id, q.j, CASE WHEN n.n > 0 THEN q.x / n.n ELSE q.x END AS x FROM {p}dq q JOIN {p}dn n USING (doc_id))"""


ORACLES.update({
    "tfidf_weights": f"""WITH {_tfidf_sql('documents', 'doc_id', 'c')}
SELECT doc_id, term, term_id, round(weight, 6) AS weight FROM cw""",
    "vocab_index": f"""WITH {_tfidf_sql('documents', 'doc_id', 'c')}
SELECT term, term_id, (row_number() OVER (ORDER BY term_id) - 1)::BIGINT AS col FROM (SELECT DISTINCT term, term_id FROM cw)""",
    "doc_term_triples": f"""WITH {_tfidf_sql('documents', 'doc_id', 'c')},
v AS (SELECT term_id, (row_number() OVER (ORDER BY term_id) - 1)::BIGINT AS col FROM (SELECT DISTINCT term_id FROM cw))
SELECT doc_id, col, round(sum(weight), 6) AS val FROM cw JOIN v USING (term_id) GROUP BY doc_id, col""",
    "corpus_sparsity": f"""WITH {_tfidf_sql('documents', 'doc_id', 'c')}
SELECT count(DISTINCT doc_id)::BIGINT AS n_docs, count(DISTINCT term)::BIGINT AS vocab_size,
       round(count(*) / count(DISTINCT doc_id), 1) AS avg_nnz FROM cw""",
    "sparse_top5": f"""WITH {_tfidf_sql('documents', 'doc_id', 'c')},
{_tfidf_sql('benchmark', 'item_id', 'q', df_from='c')},
s AS (SELECT q.doc_id AS item_id, d.doc_id, sum(q.weight * d.weight) AS s FROM qw q JOIN cw d USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rk FROM s)
SELECT item_id, rk::BIGINT AS rank, doc_id, round(s, 6) AS score FROM r WHERE rk <= 5""",
    "dense_embed": f"""WITH {_tfidf_sql('documents', 'doc_id', 'c')},
{_dense_sql('c')}
SELECT doc_id, list(round(x, 6) ORDER BY j) AS embedding FROM cdv GROUP BY doc_id""",
    "hybrid_top5": f"""WITH {_tfidf_sql('documents', 'doc_id', 'c')},
{_tfidf_sql('benchmark', 'item_id', 'q', df_from='c')},
{_dense_sql('c')},
{_dense_sql('q')},
dd AS (SELECT a.doc_id AS item_id, b.doc_id, sum(a.x * b.x) AS s FROM qdv a JOIN cdv b USING (j) GROUP BY ALL),
ss AS (SELECT q.doc_id AS item_id, d.doc_id, sum(q.weight * d.weight) AS s FROM qw q JOIN cw d USING (term) GROUP BY ALL),
hs AS (SELECT dd.item_id, dd.doc_id, dd.s + coalesce(ss.s, 0) AS s FROM dd LEFT JOIN ss USING (item_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rk FROM hs)
SELECT item_id, rk::BIGINT AS rank, doc_id, round(s, 6) AS score FROM r WHERE rk <= 5""",
})


def _vote_run_sql(k: int, p: str) -> str:
    """CTE {p}run(id, cluster, confidence, label): kNN-vote run with k neighbours."""
    return f"""{p}r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nbr_id) AS rk FROM p),
{p}nn AS (SELECT vec_id, nbr_id, rk FROM {p}r WHERE rk <= {k}),
{p}v AS (SELECT nn.vec_id, e.label AS c, count(*) AS n, min(nn.rk) AS first_rk
      FROM {p}nn nn JOIN e ON nn.nbr_id = e.vec_id WHERE e.label <> -1 GROUP BY 1, 2),
{p}o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, first_rk) AS pos FROM {p}v),
{p}agg AS (SELECT vec_id, max(CASE WHEN pos = 1 THEN c END) AS predicted,
               max(CASE WHEN pos = 1 THEN n END) AS n_votes FROM {p}o GROUP BY vec_id),
{p}run AS (SELECT e.vec_id AS id, coalesce(a.predicted, -1)::INT AS cluster,
               coalesce(a.n_votes, 0) / {float(k)} AS confidence, e.label
        FROM e LEFT JOIN {p}agg a ON e.vec_id = a.vec_id)"""


_RUN = f"{_PAIRS_COS},\n{_vote_run_sql(5, '')}"

ORACLES.update({
    "cluster_summary": f"""WITH {_RUN},
cc AS (SELECT cluster, label, count(*) AS n, min(id) AS first_pos FROM run GROUP BY ALL),
oo AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first_pos) AS rk FROM cc),
d AS (SELECT cluster, sum(n)::BIGINT AS size, max(CASE WHEN rk = 1 THEN label END) AS dominant,
             string_agg(printf('%s(%d)', label::VARCHAR, n), ', ' ORDER BY rk) AS distribution FROM oo GROUP BY cluster),
h AS (SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END)::BIGINT AS n_clusters,
             round(100.0 * count(*) FILTER (WHERE cluster = -1) / count(*), 1) AS noise_pct FROM run),
ar AS {_ari_sql('run', 'label', 'cluster')}
SELECT cluster, CASE WHEN cluster = -1 THEN 'NOISE' ELSE 'Cluster ' || cluster::VARCHAR END AS cluster_label,
       size, dominant, distribution, n_clusters, noise_pct, round(ar.ari, 4) AS ari FROM d, h, ar""",
    "top_members": f"""WITH {_RUN},
a AS (SELECT * FROM run WHERE cluster <> -1),
sz AS (SELECT cluster, count(*) AS size FROM a GROUP BY cluster),
t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY confidence DESC, id) AS member_rank FROM a)
SELECT t.cluster, member_rank::BIGINT AS member_rank, id, round(confidence, 4) AS confidence,
       greatest(size - 5, 0)::BIGINT AS more FROM t JOIN sz USING (cluster) WHERE member_rank <= 5""",
    "paper_lookup": f"""WITH {_RUN},
sz AS (SELECT cluster, count(*) AS cluster_size FROM run GROUP BY cluster),
pr AS (SELECT a.id, b.id AS pid, row_number() OVER (PARTITION BY a.id ORDER BY b.confidence DESC, b.id) AS r
       FROM run a JOIN run b ON a.cluster = b.cluster AND a.id <> b.id WHERE a.cluster <> -1),
pl AS (SELECT id, list(pid ORDER BY r) AS peers FROM pr WHERE r <= 5 GROUP BY id)
SELECT run.id, true AS found, run.cluster, round(run.confidence, 4) AS confidence, run.cluster = -1 AS is_noise,
       sz.cluster_size::BIGINT AS cluster_size,
       CASE WHEN run.cluster = -1 THEN []::BIGINT[] ELSE coalesce(pl.peers, []::BIGINT[]) END AS peers
FROM run JOIN sz USING (cluster) LEFT JOIN pl ON run.id = pl.id""",
    "lookup_suggestions": """
SELECT suggestion, row_number() OVER (ORDER BY suggestion)::BIGINT AS pos
FROM (SELECT vec_id::VARCHAR AS suggestion FROM embeddings ORDER BY suggestion LIMIT 10)""",
    "noise_flags": f"""WITH {_RUN}
SELECT id, cluster, CASE WHEN cluster = -1 THEN 'NOISE' ELSE 'Cluster ' || cluster::VARCHAR END AS cluster_label,
       round(confidence, 4) AS confidence, confidence < 0.5 AS low_confidence FROM run""",
    "label_codes": """
SELECT lang AS label, (row_number() OVER (ORDER BY lang) - 1)::BIGINT AS code
FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)""",
    "run_compare": f"""WITH {_PAIRS_COS},
{_vote_run_sql(5, 'a_')},
{_vote_run_sql(3, 'b_')},
ma AS (SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END)::DOUBLE AS n_clusters,
              round(100.0 * count(*) FILTER (WHERE cluster = -1) / count(*), 1) AS noise_pct,
              round(avg(CASE WHEN cluster <> -1 THEN confidence END), 4) AS avg_conf FROM a_run),
mb AS (SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END)::DOUBLE AS n_clusters,
              round(100.0 * count(*) FILTER (WHERE cluster = -1) / count(*), 1) AS noise_pct,
              round(avg(CASE WHEN cluster <> -1 THEN confidence END), 4) AS avg_conf FROM b_run),
ra AS {_ari_sql('a_run', 'label', 'cluster')},
rb AS {_ari_sql('b_run', 'label', 'cluster')},
bt AS (SELECT a.cluster AS ca, b.cluster AS cb FROM a_run a JOIN b_run b USING (id)),
rx AS {_ari_sql('bt', 'ca', 'cb')}
SELECT 'n_clusters' AS metric, ma.n_clusters AS run_a, mb.n_clusters AS run_b FROM ma, mb
UNION ALL SELECT 'noise_pct', ma.noise_pct, mb.noise_pct FROM ma, mb
UNION ALL SELECT 'ari', round(ra.ari, 4), round(rb.ari, 4) FROM ra, rb
UNION ALL SELECT 'avg_conf', ma.avg_conf, mb.avg_conf FROM ma, mb
UNION ALL SELECT 'ari_between_runs', round(rx.ari, 4), round(rx.ari, 4) FROM rx""",
    "upsert_latest": """
WITH latest AS (SELECT conv_id AS id, role, text FROM conversations
                QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
existing AS (SELECT conv_id AS id, role, text FROM conversations WHERE turn = 0)
SELECT * FROM existing WHERE id NOT IN (SELECT id FROM latest)
UNION ALL SELECT * FROM latest""",
    "index_stats": """
SELECT count(*)::BIGINT AS n_vectors, min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim,
       count(DISTINCT label)::BIGINT AS n_labels FROM embeddings""",
    "dense_sparse_join": f"""WITH {_tfidf_sql('documents', 'doc_id', 'c')}
SELECT doc_id, 64::BIGINT AS dim, count(*)::BIGINT AS nnz, 0::BIGINT AS n_missing FROM cw GROUP BY doc_id""",
})

ORACLES["stream_first_seen"] = f"""WITH {_HITS}
SELECT DISTINCT pmid FROM valid"""

ORACLES.update({
    "search_report": f"""WITH {_tfidf_sql('documents', 'doc_id', 'c')},
{_tfidf_sql('benchmark', 'item_id', 'q', df_from='c')},
s AS (SELECT q.doc_id AS item_id, d.doc_id, sum(q.weight * d.weight) AS s FROM qw q JOIN cw d USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rk FROM s)
SELECT item_id, rk::BIGINT AS n, r.doc_id, printf('%.4f', round(s, 9)) AS score,
       upper(coalesce(documents.lang, '?')) AS category, left(documents.text, 60) AS title
FROM r JOIN documents ON r.doc_id = documents.doc_id WHERE rk <= 5""",
    "related_vote": f"""WITH req AS (
  SELECT 'doc:' || doc_id::VARCHAR AS req_id, doc_id::VARCHAR AS input FROM labels
  UNION ALL SELECT 'text:' || item_id::VARCHAR, text FROM benchmark),
res AS (SELECT req.req_id, coalesce(d.text, req.input) AS text, d.doc_id AS exclude_id
        FROM req LEFT JOIN documents d ON req.input = d.doc_id::VARCHAR),
{_tfidf_sql('documents', 'doc_id', 'c')},
{_tfidf_sql('res', 'req_id', 'q', df_from='c')},
s AS (SELECT q.doc_id AS req_id, d.doc_id, sum(q.weight * d.weight) AS s FROM qw q JOIN cw d USING (term)
      JOIN res ON res.req_id = q.doc_id WHERE res.exclude_id IS NULL OR d.doc_id <> res.exclude_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY round(s, 9) DESC, doc_id) AS rk FROM s),
nn AS (SELECT req_id, doc_id, rk FROM r WHERE rk <= 5),
v AS (SELECT nn.req_id, documents.lang AS c, count(*) AS n, min(rk) AS first_rk
      FROM nn JOIN documents USING (doc_id) WHERE documents.lang <> '-1' GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY n DESC, first_rk) AS pos FROM v),
agg AS (SELECT req_id, max(CASE WHEN pos = 1 THEN c END) AS predicted, max(CASE WHEN pos = 1 THEN n END) AS n_votes,
               sum(n) AS total_votes,
               string_agg(printf('cluster %s: %d votes', c, n), ', ' ORDER BY pos) AS vote_dist FROM o GROUP BY req_id)
SELECT res.req_id, coalesce(agg.predicted, '-1') AS predicted, coalesce(agg.n_votes, 0)::BIGINT AS n_votes,
       coalesce(agg.total_votes, 0)::BIGINT AS total_votes, coalesce(agg.vote_dist, '') AS vote_dist
FROM res LEFT JOIN agg ON res.req_id = agg.req_id""",
})
